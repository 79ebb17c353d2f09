"""Quality rules, lines first: lines that fail a rule are removed, then documents that lose too much are rejected.

A line with a word fails as
  navigation   if a fifth or more of its words are separators,
  punctuation  if symbols are over a tenth of its characters, or it has 8 words or more and no mark of punctuation,
  boilerplate  if it has 25 words at most and holds a phrase of the list.
A document is kept if its base counts pass and the failing lines hold at most half of its characters, white space aside.

Cases: a null text has no words and fails for that, like an empty one. Lines without a word neither fail nor count.
Repeated rows are judged alike; null doc_ids pass through; long texts are judged whole. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = ["|", ">", "<", "»", "·", "•", "/"]
MARKS = ".?!,;:…。！？"
PHRASES = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies", "enable javascript",
    "subscribe to our", "sign up for", "log in to", "click here", "read more", "share this", "skip to content", "lorem ipsum",
]

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
_phrase = re.compile("|".join(map(re.escape, PHRASES)), re.I | re.A)
_mark = re.compile(f"[{re.escape(MARKS)}]")


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in runs of window words that occur twice or more."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    key, base = ids[: n - window + 1], len(number)
    for i in range(1, window):
        if key.max() >= 2**62 // base:
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + ids[i : n - window + 1 + i]
    _, place, counts = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[place] > 1)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return int(np.count_nonzero(np.cumsum(step[:-1])))


def fails(line: str, words: list[bytes], chars: int) -> str | None:
    """The rule that a line with words fails, if any."""
    separators = sum(line.count(s) for s in SEPARATORS) and sum(w.decode() in SEPARATORS for w in words)
    if separators * 5 >= len(words) and separators:
        return "navigation"
    if sum(map(line.count, SYMBOLS)) * 10 > chars or (len(words) >= 8 and not _mark.search(line)):
        return "punctuation"
    if len(words) <= 25 and _phrase.search(line):
        return "boilerplate"
    return None


def judge(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_failed_lines, cleaned."""
    text = text or ""
    chars = lambda x: len(x) - sum(map(x.count, SPACE))
    words, word_chars = text.encode("utf-8").split(), chars(text)
    lines = text.split("\n")
    real = [x for x in lines if x.strip(SPACE)]
    repeats = repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    left, lost, bad = [], 0, 0
    for line in lines:
        own = line.encode("utf-8").split()
        if own and fails(line, own, size := chars(line)):
            lost, bad = lost + size, bad + 1
        else:
            left.append(line)
    return (len(words), word_chars, sum(map(text.count, SYMBOLS)), len(real) - len(set(real)), repeats, failed,
            not failed and lost * 2 <= word_chars, len(real), bad, "\n".join(left))


FIELDS = [
    ("n_words", "long", pa.int64()), ("word_chars", "long", pa.int64()), ("n_symbols", "long", pa.int64()), ("n_dup_lines", "long", pa.int64()),
    ("n_repeat_words", "long", pa.int64()), ("base_failed", "boolean", pa.bool_()), ("kept", "boolean", pa.bool_()), ("n_lines", "long", pa.int64()),
    ("n_failed_lines", "long", pa.int64()), ("cleaned", "string", pa.string()),
]


def clean(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, counts and verdict of every row of docs(doc_id, text), and with texts what its passing lines leave."""
    fields = FIELDS[: len(FIELDS) - (not texts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [judge(x.as_py()) for x in batch.column(1)]
            cols = [pa.array([g[i] for g in got], kind) for i, (_, _, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *(n for n, _, _ in fields)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} {t}" for n, t, _ in fields))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return clean(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


_W = r"[^\x20\x09-\x0D]"
OP5_SQL = rf"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '{_W}+') as ws from d),
grams as (select row, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') as gram
  from (select row, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) as i from w where len(ws) >= {WINDOW})),
twice as (select row, i from grams qualify count(*) over (partition by row, gram) > 1),
repeated as (select row, count(distinct i + j) as n from twice, range({WINDOW}) t(j) group by row),
lines as (select row, unnest(string_split(text, chr(10))) as line from d),
real as (select row, line, len(regexp_extract_all(line, '{_W}+')) as n, len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as chars,
  len(regexp_extract_all(line, '[{SYMBOLS}]')) as symbols,
  len(list_filter(regexp_extract_all(line, '{_W}+'), lambda x: x in ({", ".join(f"'{s}'" for s in SEPARATORS)}))) as seps
  from lines where regexp_matches(line, '{_W}')),
judged as (select *, (seps > 0 and seps * 5 >= n) or symbols * 10 > chars or (n >= 8 and not regexp_matches(line, '[{MARKS}]'))
  or (n <= 25 and regexp_matches(line, '(?i)({"|".join(PHRASES)})')) as bad from real),
by_doc as (select row, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines, count(*) filter (bad) as n_failed_lines,
  coalesce(sum(chars) filter (bad), 0) as lost from judged group by row),
counts as (select doc_id, len(ws)::bigint as n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  len(regexp_extract_all(text, '[{SYMBOLS}]'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
  coalesce(repeated.n, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines,
  coalesce(n_failed_lines, 0)::bigint as n_failed_lines, coalesce(lost, 0) as lost
  from w left join by_doc using (row) left join repeated using (row)),
based as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and lost * 2 <= word_chars as kept, n_lines, n_failed_lines from based
"""
