"""Removal of repeated substrings: every byte that a string of WINDOW bytes covers which also starts earlier.

1. Documents are dealt into blocks, written once. Each window picks the gram of GRAM bytes whose hash is least in it, the
   leftmost of several; equal windows pick equal grams at the same place. Neighbouring windows that pick one gram form
   its context, so each window belongs to one context, and equal windows belong to contexts of equal grams.
2. Picks meet by gram (class), one for each block and context. A context that an earlier one equals is repeated
   throughout. A class whose contexts are all equal is thereby done.
3. The other classes' contexts, each once, are dealt into shards by class. Suffix arrays of a shard's bins of classes are made by
   induced sorting; permuted common prefixes of WINDOW and more join equal windows, and all but the earliest are repeated.
   Classes of more than HOT_CONTEXTS contexts, which one task might not hold, are compared window by window instead:
   a block sends the hash of 128 bits and the place of each window, the earliest of equal ones, and these are dealt
   by their hash, whatever the class.
4. Each block takes its repeated intervals out of its documents.

Cases: a null text is empty; texts shorter than WINDOW keep all their bytes. Documents come in the order of doc_id, null
last, those with an equal id in the order they were read. Matches never cross documents. A document of any length stays
whole in its block. Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, lean
from .suffix import permuted_common_prefixes, suffix_array

WINDOW = 100
GRAM = 32
REACH = WINDOW - GRAM  # how far a window goes beyond a gram on either side
BLOCK_BYTES = 8 << 20
SLICE = 1 << 19
#: Picks that one group of the class shuffle gets, and bytes of contexts that one shard gets, on average.
PART_PICKS = 600_000
SHARD_BYTES = 1 << 20
HOT_CONTEXTS = 1 << 14
#: A shard's classes fall into so many bins; bins that begin within so many bytes are sorted together, so that a task
#: holds the suffix array of some bins, not of a shard into which large classes happen to fall.
BINS, PORTION_BYTES = 256, 1 << 19
#: Windows of hot classes that one group gets, on average.
HOT_WINDOWS = 500_000
LAST = np.iinfo(np.int64).max
NONE = np.iinfo(np.uint64).max


def _zip(a: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else a
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unzip(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def blocks(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(block, doc_ids, sizes, data, rest): documents in order, their lengths in bytes, their bytes, compressed, and the
    columns carry of theirs as an Arrow stream."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, rest, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def flush() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            data = zstandard.ZstdCompressor(level=5).compress(b"".join(texts[i] for i in order))
            stream = _to_stream(pa.Table.from_batches(rest).take(order)) if carry else None
            return pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), pa.array([[len(texts[i]) for i in order]], pa.list_(pa.int64())),
                pa.array([data], pa.binary()), pa.array([size], pa.int64()), pa.array([stream], pa.binary()),
            ], names=["block", "doc_ids", "sizes", "data", "n_bytes", "rest"])

        for batch in batches:
            begun = 0
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                ids.append(doc_id), texts.append((text or "").encode("utf-8"))
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    rest.append(batch.slice(begun, i + 1 - begun).select(list(range(2, 2 + len(carry)))))
                    yield flush()
                    number, ids, texts, rest, size, begun = number + 1, [], [], [], 0, i + 1
            rest.append(batch.slice(begun).select(list(range(2, 2 + len(carry)))))
        if ids:
            yield flush()

    columns = docs.select(F.col("doc_id").cast("long"), "text", *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)))
    return columns.mapInArrow(run, "block long, doc_ids array<long>, sizes array<long>, data binary, n_bytes long, rest binary")


def _to_stream(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


@cache
def _byte_codes() -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([i]), 1) for i in range(256)), np.uint64)


def _gram_hashes(data: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of all strings of 32, 64 and 128 bytes, by their first place; each level joins two halves."""
    h, size, out = _byte_codes()[data], 1, {}
    while size < 128:
        h = (h[:-size] * np.uint64(0x9E3779B97F4A7C15 + 2 * size)) + h[size:]
        h ^= h >> np.uint64(32)
        size *= 2
        if size >= GRAM:
            out[size] = h * np.uint64(0xD6E8FEB86659FD93) ^ (h >> np.uint64(29))
    return out


def _sliding(h: np.ndarray, width: int, best) -> np.ndarray:
    """best over each run of width numbers."""
    out, size = h, 1
    while size * 2 <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    return best(out[: len(h) - width + 1], out[width - size : width - size + len(h) - width + 1]) if size < width else out


def picks(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of documents in a row: first places, lengths, gram hashes, hashes of their bytes."""
    n = len(data)
    ends = np.cumsum(sizes)
    # Windows that would leave their document are void.
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.maximum(ends - sizes, ends - WINDOW + 1), 1)
    np.add.at(step, ends, -1)
    void = np.cumsum(step[:-1]) > 0
    place = np.uint64((1 << 20) - 1)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for a in range(0, n, SLICE):
        b = min(n, a + SLICE)
        start = np.flatnonzero(~void[a:b])
        if not len(start):
            continue
        hashes = _gram_hashes(np.concatenate([data[a : b + WINDOW], np.zeros(256, np.uint8)]))
        grams = hashes[GRAM][: b - a + REACH]
        # The place stands in the low bits, so the least number tells the leftmost least gram.
        at = (_sliding(grams & ~place | np.arange(len(grams), dtype=np.uint64), REACH + 1, np.minimum)[start] & place).astype(np.int64)
        first = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(start) > 1)))
        left, last = start[first], start[np.append(first[1:], len(start)) - 1]
        size = last - left + WINDOW
        half = np.where(size > 128, 128, 64)
        ends_at = left + size - half
        c = np.where(size > 128, hashes[128][left], hashes[64][left]) ^ (np.where(size > 128, hashes[128][ends_at], hashes[64][ends_at]) * np.uint64(0xA24BAED4963EE407))
        c = (c ^ size.astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        found.append((left + a, size, hashes[GRAM][at[first]], c))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def _merged(left: np.ndarray, right: np.ndarray, touching: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as disjoint ones in order; those that only touch stay apart unless touching is set."""
    order = np.argsort(left, kind="stable")
    left, reach = left[order], np.maximum.accumulate(right[order]) if len(right) else right
    first = np.append(True, left[1:] >= reach[:-1] + touching)[: len(left)]
    start = np.flatnonzero(first)
    return left[start], reach[np.append(start[1:], len(left)) - 1] if len(start) else reach


CUTS = "block long, left binary, right binary"


def _doc_keys(ids: list[int | None]) -> np.ndarray:
    return np.array([LAST if d is None else d for d in ids], np.int64)


def shared(table: DataFrame, parts: int) -> DataFrame:
    """Rows (part, block, left, right) of intervals repeated in the block, or (part, block, left, size, h, c, doc) of other
    contexts."""
    names = ["part", "block", "left", "right", "size", "h", "c", "doc"]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, sizes, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                sizes = np.array(sizes, np.int64)
                left, size, h, c = picks(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed.as_py()), np.uint8), sizes)
                order = np.lexsort((c, h))  # stable: places ascend among equals
                left, size, h, c = left[order], size[order], h[order], c[order]
                first = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))[: len(h)]
                cut_left, cut_right = _merged(left[~first], (left + size)[~first])
                rows = [[block % parts, block, _zip(cut_left), _zip(cut_right), None, None, None, None]] if len(cut_left) else []
                part = (h >> np.uint64(20)) % np.uint64(parts)
                order = np.flatnonzero(first)[np.argsort(part[first], kind="stable")]
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                doc = _doc_keys(ids)
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    own = order[cuts[p] : cuts[p + 1]]
                    of = doc[np.searchsorted(np.cumsum(sizes), left[own], "right")]
                    rows.append([p, block, _zip(left[own].astype("<u4")), None, size[own].astype(np.uint8).tobytes(), h[own].tobytes(), c[own].tobytes(), _zip(of)])
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    schema = "part int, block long, left binary, right binary, size binary, h binary, c binary, doc binary"
    return table.select("block", "doc_ids", "sizes", "data").mapInArrow(run, schema)


def met(picked: DataFrame, parts: int, hot_contexts: int) -> DataFrame:
    """By class: rows (block, left, right) of repeated intervals, as they come and of contexts that came earlier; and
    (block, at, size, h, n, hot) of the classes with several contexts, the first ones of each; hot counts them where
    there are more than HOT_CONTEXTS in a class, else n does."""
    names = ["block", "left", "right", "at", "size", "h", "n", "hot"]
    kinds = [pa.int64(), *[pa.binary()] * 5, pa.int64(), pa.int64()]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for part, block, left, right, size, h, c, doc in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now and held:
                    yield from compare(held)
                    held = []
                now = part
                if h is None:
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((block, left, right, None, None, None, 0, 0), kinds)], names=names)
                else:
                    held.append((block, np.frombuffer(h, np.uint64), np.frombuffer(c, np.uint64), _unzip(doc, np.int64), _unzip(left, "<u4"), np.frombuffer(size, np.uint8)))
        if held:
            yield from compare(held)

    def compare(held: list) -> Iterator[pa.RecordBatch]:
        own = np.array(sorted({x[0] for x in held}))
        block = np.repeat(np.searchsorted(own, [x[0] for x in held]), [len(x[1]) for x in held])
        h, c, doc, left, size = (np.concatenate([x[i] for x in held]) for i in range(1, 6))
        held.clear()
        order = np.lexsort((left, block, doc, c, h))
        block, h, c, left, size = block[order], h[order], c[order], left[order].astype(np.int64), size[order]
        new_class = np.append(True, h[1:] != h[:-1])
        first = new_class | np.append(True, c[1:] != c[:-1])
        many = np.bincount(np.cumsum(new_class) - 1, first)[np.cumsum(new_class) - 1]
        several, hot = (many > 1) & first, many > hot_contexts
        order = np.argsort(block, kind="stable")
        bounds = np.searchsorted(block[order], np.arange(len(own) + 1))
        for b in range(len(own)):
            rows = order[bounds[b] : bounds[b + 1]]
            known, asked = rows[~first[rows]], rows[several[rows]]
            lo, hi = _merged(left[known], left[known] + size[known])
            for apart in (False, True):
                some = asked[hot[asked] == apart]
                if len(some) or (len(known) and not apart):
                    counts = (0, len(some)) if apart else (len(some), 0)
                    cuts = (None, None) if apart else (_zip(lo), _zip(hi))
                    values = (int(own[b]), *cuts, _zip(left[some].astype("<u4")), size[some].tobytes(), h[some].tobytes(), *counts)
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], names=names)

    schema = "block long, left binary, right binary, at binary, size binary, h binary, n long, hot long"
    return picked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, schema)


SHIPPED = ["shard", "block", "doc", "left", "right", "size", "bin", "data"]


def contexts(table: DataFrame, asked: DataFrame, shards: int, hot_shards: int) -> DataFrame:
    """Rows (shard, block, doc, left, size, bin, data) with the bytes of the contexts asked for; for hot classes, from shard
    number shards on, rows (shard, block, doc, left, data) with windows and their hashes, the first of equal ones in the
    block, and rows (shard, block, left, right) of the others."""
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]

    @lean
    def run(key, own: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = []
        left = np.concatenate([np.zeros(0, np.int64), *(_unzip(x, "<u4").astype(np.int64) for x in wanted.column("at").to_pylist())])
        size = np.frombuffer(b"".join(wanted.column("size").to_pylist()), np.uint8).astype(np.int64)
        h = np.frombuffer(b"".join(wanted.column("h").to_pylist()), np.uint64)
        hot = np.repeat(np.array(wanted.column("hot").to_pylist()) > 0, [len(x) for x in wanted.column("size").to_pylist()])
        for block, ids, sizes, packed in zip(*(own.column(c).to_pylist() for c in ("block", "doc_ids", "sizes", "data"))):
            if not len(left):
                continue
            data, ends, keys = zstandard.ZstdDecompressor().decompress(packed), np.cumsum(sizes), _doc_keys(ids)
            doc = keys[np.searchsorted(ends, left, "right")]
            shard = (h >> np.uint64(7)) % np.uint64(shards)
            order = np.lexsort((h, shard))
            order = order[~hot[order]]
            for s, of in _dealt(shard, order, shards):
                text = zstandard.ZstdCompressor(level=3).compress(b"".join(data[a : a + n] for a, n in zip(left[of].tolist(), size[of].tolist())))
                bins = (h[of] >> np.uint64(48)) % np.uint64(BINS)
                rows.append((s, block, _zip(doc[of]), _zip(left[of]), None, size[of].astype(np.uint8).tobytes(), bins.astype(np.uint8).tobytes(), text))
            if hot.any():
                n = size[hot] - WINDOW + 1
                at = np.repeat(left[hot] - np.cumsum(n) + n, n) + np.arange(n.sum())
                sums = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[a : a + WINDOW]) for a in at.tolist()), np.uint64).reshape(-1, 2)
                order = np.lexsort((at, sums[:, 1], sums[:, 0]))
                at, sums = at[order], sums[order]
                first = np.append(True, (sums[1:] != sums[:-1]).any(1))
                lo, hi = _merged(at[~first], at[~first] + WINDOW)
                rows.append((block % shards, block, None, _zip(lo), _zip(hi), None, None, None))
                shard = sums[:, 0] % np.uint64(hot_shards)
                order = np.flatnonzero(first)[np.argsort(shard[first], kind="stable")]
                for s, of in _dealt(shard, order, hot_shards):
                    rows.append((shards + s, block, _zip(keys[np.searchsorted(ends, at[of], "right")]), _zip(at[of]), None, None, None, sums[of].tobytes()))
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=SHIPPED)

    schema = "shard int, block long, doc binary, left binary, right binary, size binary, bin binary, data binary"
    wanted = asked.where("n > 0 or hot > 0").select(F.col("block").alias("of"), "at", "size", "h", "hot")
    own = table.join(wanted.select(F.col("of").alias("block")).distinct(), "block", "left_semi").select("block", "doc_ids", "sizes", "data")
    return own.groupBy("block").cogroup(wanted.groupBy("of")).applyInArrow(run, schema)


def _dealt(shard: np.ndarray, order: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of shards that have some of order, which is sorted by shard, and what they have."""
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)).tolist():
        yield s, order[bounds[s] : bounds[s + 1]]


def portions(size: np.ndarray, bins: np.ndarray) -> list[np.ndarray]:
    """Contexts by whole bins, as many as begin within PORTION_BYTES; a bin alone may be larger."""
    total = np.bincount(bins, size, BINS)
    number = ((np.cumsum(total) - total) // PORTION_BYTES)[bins]
    order = np.argsort(number, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(number[order])) + 1)


def repeated(text: list[bytes], doc: np.ndarray, block: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context numbers and offsets of windows that also start earlier; no window is in two of the contexts."""
    size = np.array([len(x) for x in text], np.int32)
    flat = np.frombuffer(b"\0".join(text) + b"\0", np.uint8)
    begins = np.cumsum(size + 1, dtype=np.int32) - size - 1
    symbols = flat.astype(np.int32)
    symbols += 1
    symbols[begins + size] = 0
    sa = suffix_array(symbols)
    del symbols
    prefix = permuted_common_prefixes(flat, sa, WINDOW)
    of = np.repeat(np.arange(len(text), dtype=np.int32), size + 1)
    offset = np.arange(len(flat), dtype=np.int32) - begins[of]
    valid = offset + WINDOW <= size[of]
    place = sa[valid[sa]]
    # Equal windows stand next to each other; a void suffix never shares WINDOW symbols with one that is not.
    was = np.append(np.int32(-1), sa[:-1])[valid[sa]]
    joined = (prefix[place] >= WINDOW) & (was >= 0) & valid[was]
    own, offset = of[place], offset[place]
    group = np.flatnonzero(~joined)
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Windows of one context follow each other without any of another between them, so contexts are put in order.
    turn = np.empty(len(text), np.int64)
    turn[np.lexsort((left, block, doc))] = np.arange(len(text)) * (int(size.max()) + 1)
    rank = turn[own] + offset
    least = np.minimum.reduceat(rank, group)
    later = rank > np.repeat(least, np.diff(np.append(group, len(rank))))
    return own[later].astype(np.int64), offset[later].astype(np.int64)


def sorted_shards(shipped: DataFrame) -> DataFrame:
    """(block, left, right) of the intervals that the shards find repeated, or that blocks have found."""

    @lean
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        text, doc, left, block, bins, sums, out = [], [], [], [], [], [], []
        for at, d, of, right, size, b, data in zip(*(rows.column(c).to_pylist() for c in SHIPPED[1:])):
            if d is None:
                out.append((at, of, right))
                continue
            doc.append(_unzip(d, np.int64)), left.append(_unzip(of, np.int64)), block.append(np.full(len(doc[-1]), at))
            if size is None:
                sums.append(np.frombuffer(data, np.uint64).reshape(-1, 2))
                continue
            bins.append(np.frombuffer(b, np.uint8))
            ends = np.cumsum(np.frombuffer(size, np.uint8), dtype=np.int64)
            raw = zstandard.ZstdDecompressor().decompress(data)
            text += [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        if doc:
            doc, left, block = map(np.concatenate, (doc, left, block))
            if sums:
                sums = np.concatenate(sums)
                order = np.lexsort((left, block, doc, sums[:, 1], sums[:, 0]))
                later = order[1:][(sums[order[1:]] == sums[order[:-1]]).all(1)]
                start, at = left[later], block[later]
            else:
                found = []
                for some in portions(np.array([len(x) for x in text]), np.concatenate(bins)):
                    own, offset = repeated([text[i] for i in some.tolist()], doc[some], block[some], left[some])
                    found.append((left[some[own]] + offset, block[some[own]]))
                start, at = (np.concatenate([f[i] for f in found]) for i in range(2))
            order = np.argsort(at, kind="stable")
            start, at = start[order], at[order]
            for b in np.unique(at):
                a, z = np.searchsorted(at, [b, b + 1])
                lo, hi = _merged(start[a:z], start[a:z] + WINDOW)
                out.append((int(b), _zip(lo), _zip(hi)))
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["block", "left", "right"])

    return shipped.groupBy("shard").applyInArrow(run, CUTS)


def cut(table: DataFrame, cuts: DataFrame, emit, schema: str, names: list[str]) -> DataFrame:
    """Rows of emit(ids, texts, begins and ends of their removed runs, rest), columns for each block's documents."""

    @lean
    def run(key, own: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for ids, sizes, packed, rest in zip(*(own.column(c).to_pylist() for c in ("doc_ids", "sizes", "data", "rest"))):
            sizes = np.array(sizes, np.int64)
            lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for left, right in zip(found.column("left").to_pylist(), found.column("right").to_pylist()):
                lefts.append(_unzip(left, np.int64)), rights.append(_unzip(right, np.int64))
            left, right = np.concatenate(lefts), np.concatenate(rights)
            ends = np.cumsum(sizes)
            # Runs of neighbouring documents touch but are not one, so documents are set apart by their number.
            doc = np.searchsorted(ends, left, "right")
            left, right = _merged(left + doc, right + doc, touching=True)
            doc = np.searchsorted(ends + np.arange(len(ends)), left, "right")
            first = (ends - sizes)[doc] + doc if len(ends) else left
            left, right = (left - first).tolist(), (right - first).tolist()
            bounds = np.searchsorted(doc, np.arange(len(sizes) + 1)).tolist()
            data = zstandard.ZstdDecompressor().decompress(packed)
            texts = [data[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
            runs = [(left[a:b], right[a:b]) for a, b in zip(bounds, bounds[1:])]
            out.append(pa.table(emit(ids, texts, runs, rest), names=names))
        return pa.concat_tables(out)

    own = table.select("block", "doc_ids", "sizes", "data", "rest")
    return own.groupBy("block").cogroup(cuts.groupBy("of")).applyInArrow(run, schema)


def _kept(text: bytes, left: list[int], right: list[int]) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *right], [*left, len(text)]))


def find(docs: DataFrame, carry: tuple[str, ...] = (), hot_contexts: int = HOT_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """The blocks of docs(doc_id, text), and (of, left, right): their repeated intervals."""
    table = durable(blocks(docs, carry), "substring-blocks")
    size = table.agg(F.sum("n_bytes")).first()[0] or 0
    parts = int(size * 2 / (REACH + 2)) // PART_PICKS + 1
    classes = durable(met(shared(table, parts), parts, hot_contexts), "substring-classes")
    asked, hot = classes.agg(F.sum("n"), F.sum("hot")).first()
    shards = (asked or 0) * (WINDOW + REACH // 2) // SHARD_BYTES + 1
    hot_shards = (hot or 0) * (REACH // 2) // HOT_WINDOWS + 1
    later = sorted_shards(contexts(table, classes, shards, hot_shards))
    cuts = classes.where("left is not null").select("block", "left", "right").unionByName(later)
    return table, cuts.withColumnRenamed("block", "of")


def digests(docs: DataFrame, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs(doc_id, text)."""

    def emit(ids, texts, runs, rest):
        kept = [_kept(t, *r) for t, r in zip(texts, runs)]
        counts = ([len(t) for t in texts], [len(t) - len(k) for t, k in zip(texts, kept)], [len(r[0]) for r in runs])
        return [pa.array(x, pa.int64()) for x in (ids, *counts)] + [pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return cut(*find(docs, hot_contexts=hot_contexts), emit, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", names)


def clean(docs: DataFrame) -> DataFrame:
    """docs with what is left of each text; a character cut in two goes as a whole. n_chars follows where it is there."""
    carry = tuple(c for c in docs.columns if c != "text")
    place = {c: i for i, c in enumerate(carry)}

    def emit(ids, texts, runs, rest):
        kept = [_kept(t, *r).decode("utf-8", "ignore") for t, r in zip(texts, runs)]
        columns = pa.ipc.open_stream(rest).read_all().combine_chunks()
        new = {"text": pa.array(kept, pa.string()), "n_chars": pa.array(map(len, kept), pa.int64())}
        return [new[c] if c in new else columns.column(place[c]) for c in docs_columns]

    docs_columns = docs.columns
    schema = ", ".join(f"`{f.name}` {'long' if f.name == 'n_chars' else f.dataType.simpleString()}" for f in docs.schema)
    return cut(*find(docs, carry), emit, schema, docs_columns)


def op3_suffix_array(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its repeated substrings; columns stay."""
    return clean(docs)
