"""Mixing sources to target weights by entropy balancing.

Targets: sources in code point order, null last, weigh 1, 2, 3 and so on in turn and share all words; a source stops at
MOST times its own words, and the excess is shared again by weight until none is above.

Rates: among all rates between 0 and MOST that give each source its target, those with the largest entropy relative to
the corpus as it is (every document once). The convex dual has one multiplier for each source's token constraint, and
its solution tilts the odds of a document exponentially in its size x: r / (MOST - r) = exp(m x) / (MOST - 1). Newton
steps with a bracket solve the dual; each iteration is one pre-aggregated sum over the table of (source, size, count).

Copies: rates are rounded to a whole number, the one below or above or at most one further. The documents of a source
are dealt into groups of bounded size; in a group, larger ones first, each takes the choice that leaves the words taken
so far nearest to the sum of the rates times sizes so far. What is left over is about half a small document for a group.

Cases: null and empty texts have size 0 and are taken once in the mix, which adds no words. Null sources form a source
of their own. Repeated rows are documents of their own. An empty table gives an empty mix. Groups and ties depend on
doc_id and size alone, so reruns agree. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from centra.functions.numbering import numbered

from .common import WORD, checkpointed, durable, row_sign, unused

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3.0
#: Documents that one rounding group holds, about.
GROUP = 5000
STEPS = 60


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sources(source, source_size) with target."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    table = checkpointed(numbered(sources, [F.col("source").isNull(), F.col("source")]).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)))
    level = 0.0  # words for each unit of weight; a source stops where its cap is less
    while True:
        stopped = F.col("cap") <= F.col("weight") * F.lit(level)
        total, held, free = table.agg(
            F.sum("source_size"), F.sum(F.when(stopped, F.col("cap")).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight")))
        ).first()
        new = ((total or 0) - held) / free if free else level
        if not new > level:
            break
        level = new
    target = F.least(F.col("cap"), F.col("weight") * F.lit(float(level)))
    return table.select("source", "source_size", target.alias("target"))


def rate(size: Column, tilt: Column, most: float = MOST) -> Column:
    """The tilted rate; null tilts stand for the limit in which all of a source is taken as often as can be."""
    return F.when(tilt.isNull(), F.lit(most)).otherwise(F.lit(most) / (1 + F.lit(most - 1) * F.exp(F.least(-tilt * size, F.lit(700.0)))))


def balance(sizes: DataFrame, goals: DataFrame, most: float = MOST, steps: int = STEPS) -> DataFrame:
    """(source, source_size, target, tilt) solving each source's dual.

    sizes(source, size, count) holds the corpus, goals(source, source_size, target) the constraints. A source that has
    to be taken as often as can be has a null tilt, one with target 0 the tilt 0 when it has no words.
    """
    full = F.col("target") >= F.col("source_size") * F.lit(most * (1 - 1e-12))
    table = durable(sizes.where("size > 0"), "mix-sizes")
    state = checkpointed(
        goals.withColumn("open", ~full & (F.col("target") > 0) & (F.col("source_size") > 0))
        .withColumn("tilt", F.when(full & (F.col("source_size") > 0), F.lit(None).cast("double")).otherwise(F.lit(0.0)))
        .withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double"))
    )
    for step in range(steps):
        r = rate(F.col("size"), F.col("tilt"), most)
        words = (F.col("count") * F.col("size")).cast("double")
        key = state.where("open").select(F.col("source").alias("of"), "tilt")
        sums = table.join(key, F.col("source").eqNullSafe(F.col("of"))).groupBy("of").agg(
            F.sum(words * r).alias("got"), F.sum(words * F.col("size") * r * (1 - r / most)).alias("slope"))
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        miss = F.col("target") - F.col("got")
        done = miss.isNull() | (F.abs(miss) <= F.col("target") * 1e-9 + 1e-6)
        low = F.when(miss > 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss < 0, F.col("tilt")).otherwise(F.col("high"))
        moved = moved.withColumn("low", low).withColumn("high", high).withColumn("done", done)
        newton = F.col("tilt") + (F.col("target") - F.col("got")) / F.col("slope")
        # Outside the bracket: its middle, or twice as far where one side is not known yet.
        reach = 2 * F.abs(F.col("tilt")) + F.col("source_size") ** -1.0
        between = F.coalesce((F.col("low") + F.col("high")) / 2, F.when(F.col("high").isNull(), F.col("tilt") + reach).otherwise(F.col("tilt") - reach))
        near = F.abs(newton - F.col("tilt")) <= 8 * reach + 1e-3
        inside = newton.isNotNull() & ~F.isnan(newton) & near & (newton > F.coalesce("low", F.lit(float("-inf")))) & (newton < F.coalesce("high", F.lit(float("inf"))))
        tilt = F.when(F.col("open") & ~F.col("done"), F.when(inside, newton).otherwise(between)).otherwise(F.col("tilt"))
        state = checkpointed(moved.withColumn("tilt", tilt).withColumn("open", F.col("open") & ~F.col("done")).drop("got", "slope", "done"))
        if not state.where("open").limit(1).count():
            break
    return state.select("source", "source_size", "target", "tilt")


def _rounded(group: np.ndarray, size: np.ndarray, rate: np.ndarray, most: int) -> np.ndarray:
    """Copies of rows sorted by group."""
    copies = np.empty(len(size), np.int64)
    due, now = 0.0, None
    for i, (g, s, r) in enumerate(zip(group.tolist(), size.tolist(), rate.tolist())):
        if g != now:
            due, now = 0.0, g
        if not s:
            copies[i] = 1
            continue
        due += r * s
        least = int(r)
        copies[i] = min(most, max(0, least - 1, min(least + (r > least) + 1, round(due / s))))
        due -= int(copies[i]) * s
    return copies


def copies(sized: DataFrame, tilts: DataFrame, most: float = MOST, group: int = GROUP) -> DataFrame:
    """(doc_id, sign, size, source_size, target, copies) for each row of sized(doc_id, sign, source, size)."""
    counts = sized.groupBy("source").agg((F.ceil(F.count("*") / group)).alias("groups")).withColumnRenamed("source", "of")
    known = tilts.join(counts, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumnRenamed("source", "of")
    known = checkpointed(known)  # so that Spark can broadcast it if it is small, and split a source's rows if it is not
    joined = sized.join(known, F.col("source").eqNullSafe(F.col("of")))
    dealt = joined.select(
        F.xxhash64("source", F.pmod(F.xxhash64("doc_id", "size", "sign"), F.col("groups"))).alias("group"),
        "doc_id", "sign", "size", "source_size", "target", rate(F.col("size"), F.col("tilt"), most).alias("rate"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple[float, int | None] = (0.0, None)
        held: list[pa.RecordBatch] = []

        def finish(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in pa.Table.from_batches(rows).combine_chunks().to_batches():
                got = _rounded(*(whole.column(c).to_numpy() for c in ("group", "size", "rate")), int(most))
                cols = [whole.column(c) for c in ("doc_id", "sign", "size", "source_size", "target")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(got)], names=["doc_id", "sign", "size", "source_size", "target", "copies"])

        for batch in batches:  # groups are small, so whole ones are rounded at once
            if batch.num_rows:
                g = batch.column(0).to_numpy()
                turn = int(np.flatnonzero(np.diff(g, prepend=g[0] - 1))[-1]) if g[0] != g[-1] else 0
                if turn:
                    yield from finish([*held, batch.slice(0, turn)])
                    held = []
                elif held and held[-1].column(0)[0] != batch.column(0)[0]:
                    yield from finish(held)
                    held = []
                held.append(batch.slice(turn))
        if held:
            yield from finish(held)

    sorted_rows = dealt.repartition("group").sortWithinPartitions("group", F.col("size").desc(), "doc_id", "sign")
    return sorted_rows.mapInArrow(run, "doc_id long, sign long, size long, source_size long, target double, copies long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, sign, size, source_size, target, copies) of every row of docs(doc_id, text, source)."""
    sized = durable(docs.select(F.col("doc_id").cast("long"), row_sign().alias("sign"), "source", word_count(F.col("text")).alias("size")), "mix")
    sizes = sized.groupBy("source", "size").count()
    goals = targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size")))
    return copies(sized, balance(sizes, goals))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; columns stay."""
    # Rows alike in doc_id and text may differ in copies: these are added up and dealt over the rows.
    sign, key, of, total, rows, at, n, copy = unused(docs.columns, "sign", "key", "of", "all", "rows", "at", "n", "copy")
    same = mix(docs).groupBy("doc_id", "sign").agg(F.sum("copies").alias(total), F.count("*").alias(rows)).withColumnsRenamed({"doc_id": key, "sign": of})
    alike = F.coalesce(F.col("doc_id") == F.col(key), F.col("doc_id").isNull() & F.col(key).isNull())
    met = docs.withColumn(sign, row_sign()).join(same, (F.col(sign) == F.col(of)) & alike)
    place = F.row_number().over(Window.partitionBy(sign, "doc_id").orderBy("doc_id"))
    taken = met.withColumn(at, place).withColumn(n, F.floor(F.col(total) / F.col(rows)) + (F.col(at) <= F.col(total) % F.col(rows)).cast("long"))
    return taken.where(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
