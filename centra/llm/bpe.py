"""Byte-level BPE: every distinct word is encoded once, ids are joined back and reassembled by position.

1. Documents are cut into pre-tokens and dealt into blocks. A block keeps each document as a sequence of numbers of its
   own word list (a pre-token's position is its place in the sequence); both are written once, packed.
2. The blocks' word lists are shuffled by word over the whole corpus, and each distinct word is encoded once. A word
   travels once for each block that has it, however often it occurs there.
3. Ids go back to the blocks that asked for them, and each block puts its documents together.

Decoding looks up every id in the table of token bytes, which is as small as the vocabulary.

Cases: null and empty texts encode to no ids and decode to no bytes. Repeated rows are separate documents. Texts of any
length stay whole: one document has to fit in a task, and blocks hold BLOCK_CHARS characters or one document. Lone
surrogates cannot occur in Spark strings. Null doc_ids pass through. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import public_tokenizers

from .common import durable, lean

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
BLOCK_CHARS = 32 << 20
BLOCK_WORDS = 600_000
#: Words that one group of the word shuffle gets at most on average, counted once for each block.
PART_WORDS = 300_000
LEVEL = 6

# Letters and digits among the first 256 code points, as in PATTERN's \p{L} and \p{N}; white space as in \s.
LOW_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
LOW_NUMBER = "0-9²³¹¼-¾"
LOW_SPACE = r"\t-\r \x85\xa0"


@cache
def _splitters(pattern: str):
    """findall for any text, and a quicker one for texts of the first 256 code points if the pattern is the known one."""
    import re

    whole = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return whole, whole
    low = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LOW_LETTER}]+| ?[{LOW_NUMBER}]+| ?[^{LOW_SPACE}{LOW_LETTER}{LOW_NUMBER}]+|[{LOW_SPACE}]+(?![^{LOW_SPACE}])|[{LOW_SPACE}]+").findall
    return whole, low


def pretokens(text: str, pattern: str = PATTERN) -> list[str]:
    whole, low = _splitters(pattern)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return whole(text)
    return low(text)


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _word_encoder(path: str):
    """Encodes a string as a single pre-token."""
    return tiktoken.Encoding("word", pat_str=r"[\s\S]+", mergeable_ranks=_ranks(path), special_tokens={}).encode_ordinary


@cache
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of token bytes: all bytes in a row, and each id's first place and length."""
    ranks = sorted(_ranks(path).items(), key=lambda x: x[1])
    size = np.zeros(ranks[-1][1] + 1, np.int64)
    size[[i for _, i in ranks]] = [len(b) for b, _ in ranks]
    return np.frombuffer(b"".join(b for b, _ in ranks), np.uint8), np.cumsum(size) - size, size


def decode_ids(ids: np.ndarray, path: str = RANKS) -> bytes:
    flat, first, size = _token_bytes(path)
    n = size[ids]
    ends = np.cumsum(n)
    return flat[np.repeat(first[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def _pack(*arrays: np.ndarray) -> bytes:
    """Unsigned numbers below 2^32 byte plane by byte plane, compressed."""
    planes = b"".join(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=LEVEL).compress(planes)


def _unpack(data: bytes, n: int = 1) -> list[np.ndarray]:
    """n arrays of one length."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(n, 4, -1)
    return [np.ascontiguousarray(p.T).view("<u4").ravel() for p in planes]


def _pack_words(words: list[bytes]) -> bytes:
    sizes = np.array([len(words), *map(len, words)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(sizes + b"".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist())]


def blocks(docs: DataFrame, pattern: str = PATTERN) -> DataFrame:
    """A row for each block: its documents' ids, their lengths in words, all their words' numbers, and the word list."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: defaultdict[str, int] = defaultdict(count().__next__)
        held: list = []
        seqs: list[np.ndarray] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            seq, words = np.concatenate([np.zeros(0, np.uint32), *seqs]), list(ids)
            # Frequent words get small numbers, and the many that occur once follow in order, which packs best.
            often = np.bincount(seq, minlength=len(words)).tolist()
            order = sorted(range(len(words)), key=lambda i: (-often[i], words[i]))
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words))
            seq, words = rank[seq], _pack_words([words[i].encode("utf-8") for i in order])
            return pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([held], pa.list_(pa.int64())), pa.array([[len(x) for x in seqs]], pa.list_(pa.int32())),
                pa.array([_pack(seq)], pa.binary()), pa.array([words], pa.binary()), pa.array([len(ids)], pa.int64()),
            ], names=["block", "doc_ids", "sizes", "seq", "words", "n_words"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = pretokens(text or "", pattern)
                seqs.append(np.fromiter(map(ids.__getitem__, words), np.uint32, len(words)))
                held.append(doc_id)
                chars += len(text or "")
                if chars >= BLOCK_CHARS or len(ids) >= BLOCK_WORDS:
                    yield flush()
                    ids = defaultdict(count().__next__)
                    held, seqs, chars, number = [], [], 0, number + 1
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "block long, doc_ids array<long>, sizes array<int>, seq binary, words binary, n_words long")


def asks(table: DataFrame, parts: int) -> DataFrame:
    """Each block's words dealt by their hash: (part, of, at, words); at are the steps between the
    words' numbers in the block."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = _unpack_words(packed.as_py())
                part = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words)) % parts
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
                own = [order[cuts[p] : cuts[p + 1]].tolist() for p in some]
                yield pa.RecordBatch.from_arrays([
                    pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([_pack(np.diff(x, prepend=0)) for x in own], pa.binary()),
                    pa.array([_pack_words([words[i] for i in x]) for x in own], pa.binary()),
                ], names=["part", "of", "at", "words"])

    return table.select("block", "words").mapInArrow(run, "part int, of long, at binary, words binary")


def answers(asked: DataFrame, parts: int, path: str = RANKS) -> DataFrame:
    """(of, at, sizes, ids) for each row of asked; each distinct word of a part is encoded once."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, now = _word_encoder(path), {}, None

        def ids_of(word: bytes) -> bytes:
            if (found := known.get(word)) is None:
                found = known[word] = np.array(encode(word.decode()), "<u4").tobytes()
            return found

        for batch in batches:
            of, at, words = (batch.column(i) for i in (1, 2, 3))
            for i, part in enumerate(batch.column(0).to_pylist()):
                if part != now:
                    known, now = {}, part
                got = [ids_of(w) for w in _unpack_words(words[i].as_py())]
                sizes = _pack(np.array([len(x) >> 2 for x in got]))
                ids = _pack(np.frombuffer(b"".join(got), "<u4"))
                yield pa.RecordBatch.from_arrays([of.slice(i, 1), at.slice(i, 1), pa.array([sizes], pa.binary()), pa.array([ids], pa.binary())], names=["of", "at", "sizes", "ids"])

    return asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "of long, at binary, sizes binary, ids binary")


def _assembled(docs: DataFrame, emit, fields: list[tuple[str, str, pa.DataType]], pattern: str, path: str) -> DataFrame:
    """For each document a row (doc_id, *fields): emit(ids of all the block's words, their ends) maps its words to fields."""
    table = durable(blocks(docs, pattern), "bpe-blocks")
    parts = -(-(table.agg(F.sum("n_words")).first()[0] or 1) // PART_WORDS)
    back = answers(asks(table, parts), parts, path)
    names = ["doc_id", *(n for n, _, _ in fields)]
    kinds = [pa.int64(), *(k for _, _, k in fields)]

    @lean
    def run(key, own: pa.Table, words: pa.Table) -> pa.Table:
        got = [(np.cumsum(_unpack(a.as_py())[0]), *_unpack(s.as_py()), *_unpack(i.as_py())) for a, s, i in zip(words.column("at"), words.column("sizes"), words.column("ids"))]
        none = [np.zeros(0, np.uint32)]
        at, size, flat = (np.concatenate(none + [g[k] for g in got]).astype(np.int64) for k in range(3))
        first, order = np.cumsum(size) - size, np.argsort(at)
        lookup = emit(flat, first[order], (first + size)[order])
        rows = []
        for ids, sizes, packed in zip(own.column("doc_ids").to_pylist(), own.column("sizes").to_pylist(), own.column("seq")):
            seq, cut = _unpack(packed.as_py())[0], 0
            for doc_id, n in zip(ids, sizes):
                rows.append((doc_id, *lookup(seq[cut : cut + n])))
                cut += n
        return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    schema = "doc_id long, " + ", ".join(f"{n} {s}" for n, s, _ in fields)
    own = table.select("block", "doc_ids", "sizes", "seq")
    return own.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(run, schema)


def _gather(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    ends = np.cumsum(n)
    return flat[np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def _ids_of(flat, begin, end):
    size = end - begin
    return lambda seq: _gather(flat, begin[seq], size[seq])


def encode(docs: DataFrame, pattern: str = PATTERN, path: str = RANKS) -> DataFrame:
    """doc_id and ids of every row of docs(doc_id, text)."""

    def emit(flat, begin, end):
        whole = _ids_of(flat, begin, end)
        return lambda seq: (whole(seq),)

    return _assembled(docs, emit, [("ids", "array<int>", pa.list_(pa.int32()))], pattern, path)


def decode(coded: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id and bytes of every row of coded(doc_id, ids); null ids give no bytes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decode_ids(np.array(x.as_py() or [], np.int64), path) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, pattern: str = PATTERN, path: str = RANKS, with_ids: bool = False) -> DataFrame:
    """doc_id, the ids if asked for, n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256 of every row."""

    def emit(flat, begin, end):
        size = end - begin
        text = [" ".join(map(str, flat[a:b].tolist())) for a, b in zip(begin, end)]

        def lookup(seq: np.ndarray):
            ids = _gather(flat, begin[seq], size[seq])
            said = " ".join(map(text.__getitem__, seq.tolist())).encode()
            found = len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(decode_ids(ids, path)).hexdigest()
            return (ids, *found) if with_ids else found

        return lookup

    fields = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    if with_ids:
        fields = [("ids", "array<int>", pa.list_(pa.int32())), *fields]
    return _assembled(docs, emit, fields, pattern, path)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document with their digests."""
    return digests(docs, with_ids=True)
