"""Language identification: script ranges narrow the candidates, Viterbi labels spans of mixed text.

Every word gets one score per language, the sum of log-probabilities of its hashed character trigrams. A word whose
script is written by some languages only leaves the others out; a script that no language uses scores nothing. Viterbi
with a switching penalty then labels the words, and neighbouring words of one label form a span.

Cases: a null text, an empty text or one without letters gives language ``und``, score 0 and no spans; without a single
training row every text does. Text in scripts that no learned language uses gets score 0. Repeated rows are labelled alike; a tie goes to the language that sorts first. Null
doc_ids pass through. Extra columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, row_sign, unused

#: Expected number of labelled training documents for each language, at most.
TRAIN_DOCS_PER_LANG = 4000
BUCKETS = 1 << 16
SWITCH = 14.0
UND = "und"
#: Least share of a script's letters that makes a language its candidate.
SCRIPT_SHARE = 0.01
CHUNK_CHARS = 1 << 20
TOP = 0x33480

# First and last code point of scripts.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x323AF), ("hangul", 0xAC00, 0xD7A3),
]
NAMES = ["none", "other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # BUCKETS x languages
    candidates: np.ndarray  # scripts x languages, boolean


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Script number (0: no letter) and lower-case code point of each code point below TOP."""
    script, lower = np.zeros(TOP, np.uint8), np.arange(TOP, dtype=np.uint32)
    for c in range(TOP):
        ch = chr(c)
        if ch.isalpha():
            script[c] = 1
            if len(low := ch.lower()) == 1:
                lower[c] = ord(low)
    for name, first, last in SCRIPTS:
        part = script[first : last + 1]
        part[part > 0] = NAMES.index(name)
    return script, lower


def _letters(texts: list[str]):
    """Of texts joined with a gap after each: letters' places, scripts, trigram buckets, and the texts' first places."""
    script, lower = _tables()
    flat = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    flat = np.where(flat < TOP, flat, 0)
    kind = script[flat]
    code = np.where(kind > 0, lower[flat], 0).astype(np.uint32)
    at = np.flatnonzero(kind)
    before = code[at - 1] * (at > 0)
    mixed = (before * np.uint32(0x9E3779B1)) ^ (code[at] * np.uint32(0x85EBCA77)) ^ (code[at + 1] * np.uint32(0xC2B2AE3D))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return at, kind[at], (mixed >> np.uint32(16)) & np.uint32(BUCKETS - 1), first


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHUNK_CHARS characters, long texts by themselves; nulls are empty."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if len(t or "") > CHUNK_CHARS:
            if i > begin:
                yield begin, [x or "" for x in texts[begin:i]]
            yield i, [t]
            begin, size = i + 1, 0
            continue
        size += len(t or "")
        if size >= CHUNK_CHARS or i + 1 == len(texts):
            yield begin, [x or "" for x in texts[begin : i + 1]]
            begin, size = i + 1, 0


def train(docs: DataFrame, per_lang: int = TRAIN_DOCS_PER_LANG) -> Model:
    """Fit on rows of docs(text, lang, pick), pick being a number evenly spread over 0..2^32 - 1.

    Of each language the rows with the smallest picks are taken, about per_lang of them; only counts by language and
    bucket leave the executors, at most BUCKETS + scripts for each language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    below = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(int(min(1.0, per_lang / sizes[k]) * 2**32)))])
    number = {k: i for i, k in enumerate(langs)}
    width = BUCKETS + len(NAMES)

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(langs) * width, np.int64)
        for batch in batches:
            texts, of = batch.column(0).to_pylist(), [number[k] for k in batch.column(1).to_pylist()]
            for begin, part in _chunks(texts):
                at, kind, bucket, first = _letters(part)
                lang = np.array(of[begin : begin + len(part)])[np.searchsorted(first, at, "right") - 1]
                total += np.bincount(lang * width + bucket, minlength=len(total))
                total += np.bincount(lang * width + BUCKETS + kind, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    counted = (
        known.where(F.col("pick") < below[F.col("lang")]).select("text", "lang").mapInArrow(count, "cell long, n long")
        .groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    )
    cells = np.zeros(len(langs) * width)
    cells[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    cells = cells.reshape(len(langs), width).T
    grams, scripts = cells[:BUCKETS], cells[BUCKETS:]
    logp = np.log((grams + 0.1) / (grams.sum(0) + 0.1 * BUCKETS))
    return Model(langs, logp.astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1))


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each row of scores (words x languages) when each change of label costs switch."""
    n, k = scores.shape
    best = int(scores.sum(0).argmax())
    if k == 1:
        return np.zeros(n, np.int64)
    # No path beats the constant one unless some stretch gains more than one switch over it.
    rest = scores.copy()
    rest[:, best] = -np.inf
    gain = np.cumsum(rest.max(1).astype(np.float64) - scores[:, best])
    if (gain - np.minimum(np.minimum.accumulate(np.concatenate(([0.0], gain[:-1]))), 0)).max() <= switch:
        return np.full(n, best)
    back, now = np.empty((n, k), np.int64), scores[0].astype(np.float64)
    own = np.arange(k)
    for i in range(1, n):
        top = int(now.argmax())
        stay = now >= now[top] - switch
        back[i] = np.where(stay, own, top)
        now = np.where(stay, now, now[top] - switch) + scores[i]
    path = np.empty(n, np.int64)
    path[-1] = now.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def _word_scores(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts: scores, begins and ends in their text; and the texts' bounds in words."""
    if len(texts) == 1 and len(texts[0]) > 2 * CHUNK_CHARS:  # piece by piece, cut where no word is
        parts, at = [], 0
        while at < len(texts[0]):
            end = min(len(texts[0]), at + CHUNK_CHARS)
            while end < min(len(texts[0]), at + 2 * CHUNK_CHARS) and texts[0][end].isalpha():
                end += 1
            score, begins, ends, _ = _word_scores([texts[0][at:end]], model)
            parts.append((score, begins + at, ends + at))
            at = end
        score, begins, ends = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return score, begins, ends, np.array([0, len(score)])
    at, kind, bucket, first = _letters(texts)
    if not len(at):
        return np.zeros((0, len(model.langs)), np.float32), at, at, np.zeros(len(texts) + 1, np.int64)
    starts = np.flatnonzero(np.diff(at, prepend=-5) > 1)
    score = np.add.reduceat(model.logp[bucket], starts, axis=0)
    cands = model.candidates[kind[starts]]
    score = np.where(cands.any(1, keepdims=True), np.where(cands, score, -1e4), 0).astype(np.float32)
    begins, ends = at[starts], at[np.append(starts[1:], len(at)) - 1] + 1
    bounds = np.searchsorted(begins, first)
    shift = np.repeat(first[:-1], np.diff(bounds))
    return score, begins - shift, ends - shift, bounds


def _label(texts: list[str], model: Model) -> Iterator[tuple[str, float, list[dict]]]:
    if not model.langs:
        yield from ((UND, 0.0, []) for _ in texts)
        return
    score, begins, ends, bounds = _word_scores(texts, model)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if a == b:
            yield UND, 0.0, []
            continue
        s, size = score[a:b], ends[a:b] - begins[a:b]
        path = viterbi(s)
        share = np.bincount(path, size, len(model.langs)) / size.sum()
        lang = int(share.argmax())
        total = s.sum(0, dtype=np.float64)
        other = np.delete(total, lang).max() if len(total) > 1 else -np.inf
        # Of a mixed text the share says enough; of a text of one language, how far the next one lies behind.
        sure = 1 / (1 + np.exp(-np.clip(total[lang] - other, -50, 50))) if share[lang] == 1 else 1.0
        # Letters of scripts that no learned language uses speak for none.
        sure *= size[s.any(1)].sum() / size.sum()
        turn = np.flatnonzero(np.diff(path, prepend=-1))
        last = np.append(turn[1:], b - a) - 1
        spans = [{"start": int(begins[a + x]), "end": int(ends[a + y]), "lang": model.langs[path[x]]} for x, y in zip(turn, last)]
        yield model.langs[lang], float(share[lang] * sure), spans


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("lang_pred", "score", "spans")) -> DataFrame:
    """The columns keep of docs, then the language, its score (0 to 1) and the spans (start, end in characters, lang)."""
    rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys((*keep, "text"))))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages x 4 bytes
    text, kept = rows.columns.index("text"), len(keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:kept])
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for _, part in _chunks(batch.column(text).to_pylist()) for x in _label(part, sent.value)]
            cols = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), spans))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *cols], names=[*keep, *names])

    return rows.mapInArrow(run, f"{schema}, {names[0]} string, {names[1]} double, {names[2]} array<struct<start:int,end:int,lang:string>>")


def fold(doc_id) -> F.Column:
    """crc32 of the id as text modulo 4; ids that are null count as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4, F.lit(0))


def fit_documents(docs: DataFrame) -> Model:
    """The model of documents(doc_id, text, lang), from the rows outside the held-out fold."""
    rows = docs.where(fold(F.col("doc_id")) != 2)
    pick = row_sign().bitwiseAND(F.lit(2**32 - 1))
    return train(rows.select("text", "lang", pick.alias("pick")))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, fit_documents(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", "spans")


#: Rows whose score is below this are rejected, like those without letters.
LEAST_SCORE = 0.3


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known well enough; the others go. Columns stay."""
    names = tuple(unused(docs.columns, "lang_pred", "score", "spans"))
    found = identify(docs, fit_documents(docs), tuple(docs.columns), names)
    kept = (F.col(names[0]) != UND) & (F.col(names[1]) >= LEAST_SCORE)
    return found.where(kept).select(*(F.col(f"`{c}`") for c in docs.columns))
