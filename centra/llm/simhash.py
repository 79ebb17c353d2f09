"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits fall into PARTS groups of bits; two that differ in at most LINK bits differ in at most
LINK // PARTS bits of some part. Fewer parts copy a fingerprint to more anchors (44 with three parts, some hundreds with
two) and leave fewer to compare at each: three suit some 1e8 distinct fingerprints, two more than that. A part's values are covered by anchors: the words of the Hamming code of length 15 on
its first 15 bits, any value on the others, so every value has an anchor within 1 (its home). Each distinct fingerprint
is copied to every anchor within 1 + LINK // PARTS of it, where it meets all fingerprints at home there that might link.
An anchor yields its links, or where they are many a spanning forest of them; components join them.

The pipeline's stage looks for a shingle similarity of 0.8, where 64 bits differ in some ten and covering that many would
compare most pairs. Its fingerprints are wider and fall into parts, and in each part they are compared where they agree
under one of a set of masks, chosen so that any two that differ in as few bits as link agree under some mask of some part
(Pagh's covering). So no link is lost, whatever its bits; the price is that blocks of fingerprints are compared pairwise.

Cases: a null text and one without words have fingerprint zero and link like any other. Equal texts share a fingerprint
and are compared once. A component's id is its smallest doc_id; null doc_ids do not count, and a component of nothing
else has a null id. Rows with an equal doc_id are separate documents. Empty tables give empty results; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, durable, lean, row_sign, unused
from centra.operators.components import components

SHINGLE = 4
SEED = 42
LINK = 4
PARTS = 3
#: Groups with more pairs to compare than this, or more links than four for each row, are walked instead of listed.
LISTED = 1 << 24


def _shingles(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; one of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    last = min(shingle, len(words)) - 1
    begins = [0, *(gaps[: len(gaps) - last] + 1).tolist()]
    ends = [*gaps[last:].tolist(), len(flat)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(flat[a:b], SEED) for a, b in zip(begins, ends)], np.uint64, len(begins))


def _majority(h: np.ndarray) -> np.ndarray:
    """The bits set in over half of the rows of h (rows, words of 64 bits)."""
    ones = np.zeros(64 * h.shape[1], np.int64)
    for i in range(0, len(h), 255):  # as many rows as bytes can count
        ones += np.unpackbits(np.ascontiguousarray(h[i : i + 255]).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return int(_majority(_shingles(text, shingle)[:, None])[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, sign) of every row of docs(doc_id, text); fp holds the 64 bits, sign is a hash of doc_id and text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2)], names=["doc_id", "fp", "sign"])

    return docs.select(F.col("doc_id").cast("long"), "text", row_sign().alias("sign")).mapInArrow(run, "doc_id long, fp long, sign long")


def _syndromes(low: np.ndarray) -> np.ndarray:
    """Of 15-bit values: 0 for a code word, else 1 + the place of the bit whose change makes it one."""
    out = np.zeros(low.shape, np.int64)
    for bit in range(15):
        out ^= np.where(low >> bit & 1, bit + 1, 0)
    return out


def visits(fps: np.ndarray, part: int, parts: int = PARTS, link: int = LINK) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint its home anchor in this part, then the anchors within 1 + link // parts as a matrix, -1 for none.

    Every such anchor is the home of a value within link // parts of the fingerprint's value, so these values' homes are listed.
    """
    edges = np.linspace(0, 64, parts + 1).astype(int)
    first, width = int(edges[part]), int(edges[part + 1] - edges[part])
    value = (fps >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)

    def home(v: np.ndarray) -> np.ndarray:
        s = _syndromes(v & 0x7FFF)
        return v ^ np.where(s > 0, 1 << np.maximum(s - 1, 0), 0)

    near = [np.zeros(1, np.int64)]
    for _ in range(link // parts):
        near.append(np.unique((near[-1][:, None] ^ (1 << np.arange(width))).ravel()))
    flips = np.unique(np.concatenate(near))
    found = np.sort(home(value[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return home(value), found


def _walk(home: np.ndarray, visitor: np.ndarray, link: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the fingerprints at home and all others; home ones are visitors too."""
    left = np.unique(visitor)
    own = np.isin(left, home)
    a, b = [], []
    while len(left):
        queue = [left[0]]
        at_home = {left[0]: own[0]}
        left, own = left[1:], own[1:]
        while queue and len(left):
            x = queue.pop()
            hit = np.bitwise_count(left ^ x) <= link
            if not at_home.pop(x):
                hit &= own
            if hit.any():
                new = left[hit]
                a.append(np.full(len(new), x)), b.append(new)
                at_home.update(zip(new, own[hit]))
                queue.extend(new)
                left, own = left[~hit], own[~hit]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links_at(anchor: np.ndarray, fp: np.ndarray, at_home: np.ndarray, link: int = LINK) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows sorted by anchor, comparing those at home with all."""
    start = np.flatnonzero(np.diff(anchor, prepend=anchor[:1] - 1))
    end = np.append(start[1:], len(anchor))
    homes = np.add.reduceat(at_home.astype(np.int64), start)
    pairs = homes * (end - start)
    out = [(fp[:0], fp[:0])]
    big = pairs > LISTED
    for s, e in zip(start[big], end[big]):
        out.append(_walk(fp[s:e][at_home[s:e]], fp[s:e], link))
    group = np.repeat(np.arange(len(start)), end - start)
    own = np.flatnonzero(at_home & ~big[group])
    width = (end - start)[group[own]]
    cut = 0
    while cut < len(own):  # as many home rows at a time as have LISTED pairs
        upto = cut + max(1, int(np.searchsorted(np.cumsum(width[cut:]), LISTED // 4)))
        mine, n = own[cut:upto], width[cut:upto]
        x = np.repeat(mine, n)
        y = np.repeat(start[group[mine]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        hit = (np.bitwise_count(fp[x] ^ fp[y]) <= link) & (fp[x] != fp[y])
        x, y = x[hit], y[hit]
        many = np.flatnonzero(np.bincount(group[x], minlength=len(start)) > 4 * (end - start)) if len(x) else []
        for g in many:
            s, e = start[g], end[g]
            out.append(_walk(fp[s:e][at_home[s:e]], fp[s:e], link))
        keep = ~np.isin(group[x], many)
        out.append((fp[x[keep]], fp[y[keep]]))
        cut = upto
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def links(distinct: DataFrame, link: int = LINK, parts: int = PARTS) -> DataFrame:
    """(a, b) connecting all of distinct(fp) that differ in at most link bits, without listing dense groups' pairs."""

    @lean
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for part in range(parts):
                home, found = visits(fps, part, parts, link)
                row, col = np.nonzero(found >= 0)
                anchor = found[row, col]
                yield pa.RecordBatch.from_arrays([pa.array(anchor | part << 32), pa.array(fps[row].view(np.int64)), pa.array(anchor == home[row])], names=["anchor", "fp", "home"])

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            anchor, fp, home = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(anchor):
                continue
            turn = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on in the next batch
            if turn or (held and held[-1][0][-1] != anchor[0]):
                yield from _edges([*held, [anchor[:turn], fp[:turn], home[:turn]]], link)
                held = []
            held.append([anchor[turn:], fp[turn:], home[turn:]])
        yield from _edges(held, link)

    rows = distinct.select("fp").mapInArrow(spread, "anchor long, fp long, home boolean")
    met = rows.repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(compare, "a long, b long")


def _edges(parts: list[list[np.ndarray]], link: int) -> Iterator[pa.RecordBatch]:
    parts = [p for p in parts if len(p[0])]
    if parts:
        anchor, fp, home = (np.concatenate([p[i] for p in parts]) for i in range(3))
        a, b = links_at(anchor, fp.view(np.uint64), home, link)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def near_duplicates(docs: DataFrame, link: int = LINK, parts: int = PARTS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, sign, root, component_id) of every row of docs(doc_id, text); root is the component's least fingerprint."""
    marked = durable(fingerprints(docs, shingle), "simhash")
    groups = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(groups, link, parts)).select(F.col("node").alias("fp"), "root")
    rooted = groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Cut off, so that Spark can broadcast it if it is small, and split a giant component's fingerprints if it is not.
    least = checkpointed(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "sign", "root", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The pipeline's stage: words of a shingle, words of 64 bits in a fingerprint, bits by which linked ones may differ.
#: Shingle sets with a Jaccard similarity of 0.8 have a cosine of 0.89 and differ in 15 % of the bits, 39 of 256 on
#: average with a standard deviation of 6.
STAGE_SHINGLE, LANES, STAGE_LINK = 5, 4, 44
#: Fingerprints are dealt into blocks, of which each two, and each with itself, are compared in tasks of their own: one block
#: up to SPARSE rows, two up to twice BLOCK, then as many as hold BLOCK rows each. Few blocks' parts are dealt to several tasks.
SPARSE, BLOCK, TASKS = 1 << 17, 1 << 20, 128
#: Larger groups are walked; so many pairs are compared at a time.
SMALL, AT_ONCE = 1024, 1 << 17


def sketch(text: str | None) -> np.ndarray:
    """A fingerprint of LANES words: the first as in fingerprint(), the others from further mixtures of the same hashes."""
    h = _shingles(text, STAGE_SHINGLE)
    if not len(h):
        return np.zeros(LANES, np.uint64)
    return _majority(np.stack([h, *(_mixed(h, lane) for lane in range(1, LANES))], axis=1))


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """The finaliser of SplitMix64."""
    z = h + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def _packed(fps: np.ndarray) -> pa.Array:
    """Rows of LANES words as binary values."""
    step = 8 * LANES
    offsets = np.arange(0, step * len(fps) + 1, step, dtype=np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(fps), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(fps))])


def _unpacked(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, LANES), np.uint64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(np.uint64).reshape(-1, LANES)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, sign) of every row of docs(doc_id, text); fp is binary."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([sketch(x.as_py()) for x in batch.column(1)], np.uint64).reshape(-1, LANES)
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(fps), batch.column(2)], names=["doc_id", "fp", "sign"])

    return docs.select(F.col("doc_id").cast("long"), "text", row_sign().alias("sign")).mapInArrow(run, "doc_id long, fp binary, sign long")


def layout(rows: int) -> list[np.ndarray]:
    """The parts into which the bits of so many fingerprints fall; each bit is in one.

    Fewer and wider parts need more masks but leave fewer to compare under each, which pays as rows grow.
    """
    parts = next(n for n, most in ((9, 1 << 20), (8, 1 << 22), (7, 1 << 28), (6, np.inf)) if rows <= most)
    return np.array_split(np.arange(64 * LANES), parts)


def covers(parts: list[np.ndarray], link: int = STAGE_LINK) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each part and its masks: two fingerprints that differ in at most link bits agree under a mask of some part.

    Shares of the parts sum to link + 1, so a part has fewer differing bits than its share d. Each of a part's bits has a
    vector of d bits and each mask but zero another; a mask takes the bits whose vectors have an odd product with its own.
    Fewer than d vectors are all orthogonal to some vector, whose mask then takes none of the bits that differ. That holds
    for any vectors; they are chosen one by one so that few unrelated values agree.
    """
    out = []
    for number, places in enumerate(parts):
        share = (link + 1) // len(parts) + (number < (link + 1) % len(parts))
        vectors = np.arange(1, 1 << share)
        odd = (np.bitwise_count(vectors[:, None] & vectors) & 1).astype(np.uint64)
        masks, taken = np.zeros(len(vectors), np.uint64), np.zeros(len(vectors))
        for place in range(len(places) if len(vectors) else 0):
            best = (2.0 ** -(taken[:, None] + odd)).sum(0).argmin()
            masks |= odd[:, best] << np.uint64(place)
            taken += odd[:, best]
        out.append((places, masks))
    return out


def _values(fps: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits at successive places, at most 64, as numbers."""
    lane, skip = divmod(int(places[0]), 64)
    value = fps[:, lane] >> np.uint64(skip)
    if skip + len(places) > 64:
        value |= fps[:, lane + 1] << np.uint64(64 - skip)
    return value & np.uint64((1 << len(places)) - 1)


def _dealt(value: np.ndarray, mask: np.uint64, width: int) -> tuple[np.ndarray, np.ndarray]:
    """value & mask sorted, and the rows in that order, equal ones as they come."""
    spare = np.uint64(max(len(value) - 1, 1).bit_length())
    if width + int(spare) > 64:
        order = np.argsort(value & mask, kind="stable")
        return (value & mask)[order], order
    packed = np.sort((value & mask) << spare | np.arange(len(value), dtype=np.uint64))
    return packed >> spare, (packed & (np.uint64(1) << spare) - np.uint64(1)).astype(np.int64)


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of each row's component, once rows a and b are joined."""
    while True:
        x, y = root[a], root[b]
        left = x != y
        if not left.any():
            return root
        a, b, x, y = a[left], b[left], x[left], y[left]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up


def joined(fps: np.ndarray, first: int, cover: list[tuple[np.ndarray, np.ndarray]], link: int = STAGE_LINK) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) that connect all links between the first so many of fps and the others, if they agree under a mask of
    cover; between all, if none are others. Groups that are connected already are not compared again.
    """
    root, a, b = np.arange(len(fps)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for places, masks in cover if len(fps) else ():
        value = _values(fps, places)
        for mask in masks:
            anchor, order = _dealt(value, mask, len(places))
            start = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            roots = root[order]
            apart = np.minimum.reduceat(roots, start) != np.maximum.reduceat(roots, start)
            some = np.repeat(apart, np.diff(np.append(start, len(anchor))))
            rows = order[some]
            x, y = meet(anchor[some], fps[rows], link, rows < first if first < len(fps) else None)
            x, y = rows[x], rows[y]
            new = root[x] != root[y]
            if new.any():
                a.append(x[new]), b.append(y[new])
                root = _merged(root, a[-1], b[-1])
    return np.concatenate(a), np.concatenate(b)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _forest(fps: np.ndarray, link: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) that span the links between all of fps."""
    left, a, b = np.arange(len(fps)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = _apart(fps[left], fps[x]) <= link
            new, left = left[hit], left[~hit]
            a.append(np.full(len(new), x)), b.append(new)
            queue.extend(new)
    return np.concatenate(a), np.concatenate(b)


def meet(anchor: np.ndarray, fps: np.ndarray, link: int = STAGE_LINK, ours: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) that connect what links at each anchor, of rows sorted by anchor; given ours, rows that come first at
    each anchor, only what links one of them to one of the others need be connected."""
    start = np.flatnonzero(np.diff(anchor, prepend=anchor[:1] - 1))
    size = np.diff(np.append(start, len(anchor)))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def walk(groups: np.ndarray) -> None:
        for s, n in zip(start[groups], size[groups]):
            x, y = _forest(fps[s : s + n], link)
            out.append((x + s, y + s))

    walk(np.flatnonzero(size > SMALL))
    group = np.repeat(np.arange(len(start)), size)
    begin = np.arange(1, len(anchor) + 1)  # each row is compared with those of its anchor from here on
    if ours is not None:
        mine = np.add.reduceat(ours, start, dtype=np.int64) if len(start) else size
        begin = np.where(ours, np.repeat(start + mine, size), np.repeat(start + size, size))
    after = np.repeat(start + size, size) - begin
    head = np.ascontiguousarray(fps[:, : LANES // 2].T)
    listed = (size > 1) & (size <= SMALL)
    groups, places = np.flatnonzero(listed), np.flatnonzero(listed[group])
    total, ends, cut = np.cumsum(size[groups] ** 2), np.append(0, np.cumsum(size[groups])), 0
    while cut < len(groups):
        upto = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + AT_ONCE, "right")))
        rows = places[ends[cut] : ends[upto]]
        n = after[rows]
        x = np.repeat(rows, n)
        y = np.repeat(begin[rows] - np.cumsum(n) + n, n) + np.arange(len(x))
        near = sum(np.bitwise_count(lane[x] ^ lane[y]) for lane in head) <= link  # most are beyond that in half of the lanes
        x, y = x[near], y[near]
        hit = _apart(fps[x], fps[y]) <= link
        x, y = x[hit], y[hit]
        found, links_in = np.unique(group[x], return_counts=True)
        many = found[links_in > 4 * size[found]]
        walk(many)
        keep = ~np.isin(group[x], many)
        out.append((x[keep], y[keep]))
        cut = upto
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def similar(distinct: DataFrame, rows: int, link: int = STAGE_LINK) -> DataFrame:
    """(a, b) connecting all of distinct(fp binary), so many rows, that differ in at most link bits."""
    cover = covers(layout(rows), link)
    blocks = max(1, min(2, -(-rows // SPARSE)), -(-rows // BLOCK))
    couples = blocks * (blocks + 1) // 2
    slices = min(len(cover), -(-TASKS // couples))

    @lean
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = (_mixed(_unpacked(batch.column(0))[:, 0], LANES) % np.uint64(blocks)).astype(np.int32)
            for other in range(blocks) if len(block) else ():
                low, high = np.minimum(block, other), np.maximum(block, other)
                couple = high * (high + 1) // 2 + low
                for part in range(slices):
                    yield pa.RecordBatch.from_arrays([pa.array(couple * slices + part), pa.array(block == low), batch.column(0)], names=["task", "first", "fp"])

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            task, first, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), _unpacked(batch.column(2))
            for one in np.unique(task):
                held.setdefault(int(one), []).append((first[task == one], fps[task == one]))
        while held:
            task, own = held.popitem()
            first = np.concatenate([f for f, _ in own])
            fps = np.concatenate([x[f] for f, x in own] + [x[~f] for f, x in own])
            a, b = joined(fps, int(first.sum()), cover[task % slices :: slices], link)
            for i in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([_packed(fps[a[i : i + (1 << 16)]]), _packed(fps[b[i : i + (1 << 16)]])], names=["a", "b"])

    dealt = distinct.select("fp").mapInArrow(spread, "task int, first boolean, fp binary")
    return dealt.repartitionById(couples * slices, "task").mapInArrow(compare, "a binary, b binary")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id; columns stay.

    Near-duplicates are told by fingerprints of 64 * LANES bits over shingles of STAGE_SHINGLE words that differ in at most
    STAGE_LINK bits, an estimate of a Jaccard similarity of 0.8 or more; groups are the components of all such links. Null
    ids come last; of rows alike in doc_id and text one stays. Other cases are as above.
    """
    marked = durable(sketches(docs), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sign")).alias("first")
    groups = durable(marked.groupBy("fp").agg(first), "simhash-groups")
    roots = components(similar(groups, groups.count())).select(F.col("node").alias("fp"), "root")
    rooted = groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    sign, of, key = unused(docs.columns, "sign", "of", "key")
    kept = durable(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(key), F.col("first.sign").alias(of)).distinct(), "simhash-kept")
    signed = docs.withColumn(sign, row_sign())
    same = F.coalesce(F.col("doc_id") == F.col(key), F.col("doc_id").isNull() & F.col(key).isNull())
    return signed.join(kept, (F.col(sign) == F.col(of)) & same, "left_semi").dropDuplicates([sign, "doc_id"]).drop(sign)
