"""Nearest neighbours by largest inner product: anisotropic quantisation, four-bit table scans, exact reranking.

Vectors are cut into pieces of PIECE numbers, each coded by one of 16 centres. Codes and centres minimise a loss in
which the residual's part along the vector, which changes inner products most, weighs WEIGHT times as much as the rest.
A scan adds up, for each query and code, table entries of a query's products with the centres; pairs of four-bit codes
share a table of 256 entries. The best RERANK of each run of rows are measured exactly in double precision. Every other
row whose product could still be among the nearest is measured too: a product differs from its table sum by the query's
length times the row's distance from its centres at most. So results are exact, whatever the codes are worth; where
those bound little, more rows are measured.

Centres are fitted on about SAMPLE rows; every row is indexed. Queries go out in blocks of about QUERY_BLOCK, and each
block scans the whole index once; equal vectors are scanned once and stand for all their ids.

Cases: vectors that are null, empty, zero, of another length than most, or that hold null or non-finite numbers take no
part, like rows with a null vec_id. Rows equal in vec_id and vector count once. A query's own vec_id is no candidate of
it. Ties go to the smaller vec_id. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

SAMPLE = 20_000
QUERY_BLOCK = 8192
RUN_ROWS = 8192
PIECE = 2
NEAREST = 20
RERANK = 80
#: Rounding of the scan's single precision, as a share of the lengths that are multiplied; and of double precision.
SLACK = 1e-5
FINE = 1e-12
#: Pairs of a query and a row that are measured at once.
PAIRS = 1 << 16
#: Inner products below this share of the norm matter less; it sets the weight of the parallel residual.
THRESHOLD = 0.2
ROUNDS = 12


@dataclass
class Codebook:
    centres: np.ndarray  # pieces x 16 x PIECE
    weight: float

    @property
    def pieces(self) -> int:
        return len(self.centres)


def _cut(x: np.ndarray) -> np.ndarray:
    """rows x pieces x PIECE, with zeros at the end to make the number of pieces even."""
    wide = -(-x.shape[1] // (2 * PIECE)) * 2 * PIECE
    return np.pad(x, ((0, 0), (0, wide - x.shape[1]))).reshape(len(x), -1, PIECE)


def codes(x: np.ndarray, book: Codebook, sweeps: int = 2) -> np.ndarray:
    """Codes (rows x pieces) of least anisotropic loss found by sweeping over the pieces."""
    parts, norm2 = _cut(x.astype(np.float32)), (x.astype(np.float32) ** 2).sum(1)
    extra = (book.weight - 1) / norm2
    plain = np.stack([((parts[:, m, None] - book.centres[m]) ** 2).sum(2) for m in range(book.pieces)], 1)
    along = np.stack([(parts[:, m, None] * (parts[:, m, None] - book.centres[m])).sum(2) for m in range(book.pieces)], 1)
    code = plain.argmin(2)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for m in range(book.pieces):
            rest = total - along[rows, m, code[:, m]]
            code[:, m] = (plain[:, m] + extra[:, None] * (rest[:, None] + along[:, m]) ** 2).argmin(1)
            total = rest + along[rows, m, code[:, m]]
    return code.astype(np.uint8)


def fit(x: np.ndarray, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> Codebook:
    """Centres for the rows of x, by turns of coding and weighted least squares."""
    dim = x.shape[1]
    weight = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    parts, norm2 = _cut(x.astype(np.float32)), (x.astype(np.float64) ** 2).sum(1)
    rng = np.random.default_rng(7)
    start = rng.choice(len(x), 16, replace=len(x) < 16)
    spread = parts.std(0)[:, None] * 0.01 * rng.standard_normal((parts.shape[1], 16, PIECE))
    book = Codebook((parts[start].transpose(1, 0, 2) + spread).astype(np.float32), weight)
    for _ in range(rounds):
        code = codes(x, book, sweeps=1)
        near = np.stack([book.centres[m][code[:, m]] for m in range(book.pieces)], 1)
        along = (parts * (parts - near)).sum(2)
        total = along.sum(1)
        for m in range(book.pieces):
            p = parts[:, m].astype(np.float64)
            # Normal equations of sum |p - c|^2 + (w - 1) / |x|^2 (rest + p.(p - c))^2 over the rows of each centre.
            scale = (weight - 1) / norm2
            outer = np.eye(PIECE) + scale[:, None, None] * p[:, :, None] * p[:, None, :]
            right = p + (scale * (total - along[:, m] + (p**2).sum(1)))[:, None] * p
            for c in range(16):
                own = code[:, m] == c
                if own.any():
                    book.centres[m, c] = np.linalg.solve(outer[own].sum(0), right[own].sum(0))
                else:
                    book.centres[m, c] = parts[rng.integers(len(x)), m]
    return book


def _exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up from the first number on: queries x d with queries x r x d."""
    out = np.zeros(rows.shape[:2])
    for d in range(queries.shape[1]):
        out += queries[:, d, None].astype(np.float64) * rows[:, :, d]
    return out


def _scan(queries: np.ndarray, code: np.ndarray, x: np.ndarray, book: Codebook, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers and exact products of the rerank best rows of each query, in no order, and all table sums."""
    parts = _cut(queries.astype(np.float32))
    tables = np.einsum("qmp,mcp->mqc", parts, book.centres)
    pairs = (tables[0::2, :, :, None] + tables[1::2, :, None, :]).reshape(book.pieces // 2, len(queries), 256)
    joint = (code[:, 0::2].astype(np.intp) << 4) | code[:, 1::2]
    about = np.zeros((len(queries), len(code)), np.float32)
    for m in range(len(pairs)):
        about += np.take(pairs[m], joint[:, m], axis=1)
    k = min(rerank, len(code))
    best = np.argpartition(-about, k - 1, axis=1)[:, :k] if k < len(code) else np.broadcast_to(np.arange(k), about.shape)
    return best, _exact(queries, x[best]), about


def _radius(code: np.ndarray, x: np.ndarray, book: Codebook) -> np.ndarray:
    """How far each row is from its centres, and what rounding may add."""
    parts = _cut(x.astype(np.float64))
    near = np.stack([book.centres[m][code[:, m]] for m in range(book.pieces)], 1).astype(np.float64)
    length = lambda v: np.sqrt((v**2).sum((1, 2)))
    return length(parts - near) + SLACK * (length(parts) + length(near))


def _missed(queries: np.ndarray, x: np.ndarray, about: np.ndarray, radius: np.ndarray, best: np.ndarray, least: np.ndarray, own: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, rows and exact products of the pairs outside best that may reach least, which is what each query's last
    place holds so far. Rows have to differ; own marks the pairs that are no candidates."""
    q = queries.astype(np.float64)
    length = np.sqrt((q**2).sum(1))
    # Written so that what is no number stays open.
    open_ = ~(about + length[:, None] * radius < least[:, None]) | ~np.isfinite(about)
    np.put_along_axis(open_, best, False, 1)
    rows = np.flatnonzero(open_.any(0))
    if not len(rows):
        return np.empty(0, np.intp), rows, np.empty(0)
    far = x[rows].astype(np.float64)
    score, open_ = q @ far.T, open_[:, rows]
    slack = FINE * length[:, None] * np.sqrt((far**2).sum(1))
    if len(rows) > nearest:
        low = np.where(open_ & ~own[:, rows] & ~np.isnan(score), score - slack, -np.inf)
        least = np.maximum(least, np.partition(low, len(rows) - nearest, axis=1)[:, len(rows) - nearest])
    of, at = np.nonzero(open_ & ~(score + slack < least[:, None]))
    value = [_exact(queries[of[a : a + PAIRS]], x[rows[at[a : a + PAIRS]]][:, None])[:, 0] for a in range(0, len(of), PAIRS)]
    return of, rows[at], np.concatenate(value) if value else np.empty(0)


def _merge(score: np.ndarray, ids: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest of each line by falling score, ties by rising id; -inf marks none."""
    order = np.argsort(ids, axis=1, kind="stable")
    score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
    order = np.argsort(-score, axis=1, kind="stable")[:, :nearest]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def search_run(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, code: np.ndarray, x: np.ndarray, book: Codebook, nearest: int, rerank: int, least: np.ndarray | None = None):
    """Best scores and ids (queries x nearest) among the rows x; equal rows are scanned once. Scores below a query's
    least may be missing."""
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    _, first, of = np.unique(raw, return_index=True, return_inverse=True)
    order = np.lexsort((ids, of))
    starts = np.searchsorted(of[order], np.arange(len(first)))
    stops = np.append(starts[1:], len(order))
    # A query needs nearest ids of each vector at most, and one more if its own is among them.
    copies = int(min(nearest + 1, (stops - starts).max()))
    table = np.full((len(first), copies), -1, np.int64)
    for k in range(copies):
        there = starts + k < stops
        table[there, k] = ids[order[starts[there] + k]]
    scores, found = np.full((len(queries), nearest), -np.inf), np.full((len(queries), nearest), -1, np.int64)
    code, x = code[first], x[first]
    radius = _radius(code, x, book)

    def owned(q_ids: np.ndarray, rows: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of all copies of rows (queries x r), a query's own id and missing copies marked by -inf."""
        owners = table[rows].reshape(len(q_ids), -1)
        value = np.repeat(exact, copies, axis=1)
        value[(owners < 0) & (np.arange(owners.shape[1]) % copies > 0)[None]] = -np.inf
        value[owners == q_ids[:, None]] = -np.inf
        return value, owners

    for a in range(0, len(queries), 256):
        q, q_ids = queries[a : a + 256], query_ids[a : a + 256]
        best, exact, about = _scan(q, code, x, book, rerank)
        s, i = _merge(*owned(q_ids, best, exact), nearest)
        last = s[:, -1] if s.shape[1] == nearest else np.full(len(q), -np.inf)
        last = last if least is None else np.maximum(last, least[a : a + 256])
        own = (stops - starts == 1) & (table[:, 0] == q_ids[:, None])
        of, rows, value = _missed(q, x, about, radius, best, last, own, nearest)
        if len(of):
            # Lines of equal width: of each query, the rows that were missed.
            size = np.bincount(of, minlength=len(q))
            at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            for c in range(0, int(size.max()), rerank):
                own = (at >= c) & (at < c + rerank)
                more, score = np.zeros((len(q), rerank), np.intp), np.full((len(q), rerank), -np.inf)
                more[of[own], at[own] - c], score[of[own], at[own] - c] = rows[own], value[own]
                v, o = owned(q_ids, more, score)
                s, i = _merge(np.hstack([s, v]), np.hstack([i, o]), nearest)
        scores[a : a + 256, : s.shape[1]], found[a : a + 256, : s.shape[1]] = s, i
    return scores, found


def index(vectors: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, Codebook] | None:
    """The table (vec_id, vector, code) of the rows that take part, and the codebook; None without any."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    number = F.transform("embedding", lambda v: v.cast(kind))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    valid = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select("vec_id", number.alias("vector"))
    sizes = valid.groupBy(F.size("vector").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    if sizes is None:
        return None
    dim, n = sizes
    rows = valid.where(F.size("vector") == dim)
    share = int(min(1.0, sample / n) * 2**32)
    drawn = rows.where(F.xxhash64("vec_id").bitwiseAND(F.lit(2**32 - 1)) < share) if share < 2**32 else rows
    x = drawn.select("vector").toArrow().column(0).combine_chunks().flatten().to_numpy().reshape(-1, dim)
    book = fit(x.astype(np.float32) if len(x) else np.eye(dim, dtype=np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = codes(batch.column(1).flatten().to_numpy().reshape(-1, dim), book)
                packed = np.ascontiguousarray(c[:, 0::2] << 4 | c[:, 1::2])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in packed], pa.binary())], names=["vec_id", "vector", "code"])

    return durable(rows.dropDuplicates(["vec_id", "vector"]).mapInArrow(run, f"vec_id long, vector array<{kind}>, code binary"), "vectors"), book


def nearest_neighbours(vectors: DataFrame, asking, nearest: int = NEAREST, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id and score for the rows of vectors(vec_id, embedding) where asking (a condition) holds."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, vec_id long, score double, q int")
    built = index(vectors)
    if built is None:
        return empty.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    table, book = built
    queries = table.where(asking)
    blocks = -(-queries.count() // QUERY_BLOCK)
    parts = []
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "vector").orderBy("vec_id", "vector").toArrow()
        if not own.num_rows:
            continue
        sent = spark.sparkContext.broadcast((own.column(0).to_numpy(), own.column(1).combine_chunks().flatten().to_numpy().reshape(own.num_rows, -1)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            query_ids, q = sent.value
            best = None
            for ids, x, code in _runs(batches, q.shape[1]):
                found = search_run(query_ids, q, ids, code, x, book, nearest, rerank, None if best is None else best[0][:, -1])
                best = found if best is None else _merge(np.hstack([best[0], found[0]]), np.hstack([best[1], found[1]]), nearest)
            if best is not None:
                row, col = np.nonzero(best[0] > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(best[1][row, col]), pa.array(best[0][row, col]), pa.array(row.astype(np.int32))], names=["query_id", "vec_id", "score", "q"])

        found = table.mapInArrow(run, "query_id long, vec_id long, score double, q int")
        parts.append(found if blocks == 1 else durable(found, "neighbours"))
    place = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id"))
    ranked = [p.withColumn("rank", place).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score") for p in parts]
    return reduce(DataFrame.unionByName, ranked or [empty.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")])


def _runs(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    held, n = [], 0

    def joined():
        whole = pa.Table.from_batches(held)
        packed = np.frombuffer(b"".join(whole.column(2).to_pylist()), np.uint8).reshape(whole.num_rows, -1)
        code = np.empty((len(packed), packed.shape[1] * 2), np.uint8)
        code[:, 0::2], code[:, 1::2] = packed >> 4, packed & 15
        return whole.column(0).to_numpy(), whole.column(1).combine_chunks().flatten().to_numpy().reshape(-1, dim), code

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= RUN_ROWS:
            yield joined()
            held, n = [], 0
    if held:
        yield joined()


def op9_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
