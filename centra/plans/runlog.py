"""Analytics over run logs: groups, pivots, paired ratios and verdicts, all left to Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def means(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean and sample standard deviation, 0 for a single run."""
    return runs.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def spread(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.min(value).alias("least"), F.median(value).alias("median"), F.max(value).alias("most"))


def medians(runs: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    return runs.groupBy(*by).agg(*(F.median(v).alias(v) for v in values))


def speed_up(runs: DataFrame, by: list[str], value: str, arm: str, slow: str, fast: str) -> DataFrame:
    """Mean of value for two arms side by side, null where an arm is missing, and their ratio."""
    wide = runs.groupBy(*by).pivot(arm, [slow, fast]).agg(F.avg(value))
    return wide.withColumn("ratio", F.try_divide(F.col(f"`{slow}`"), F.col(f"`{fast}`")))


def grid(runs: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    return runs.groupBy(row).pivot(column, values).agg(F.avg(value))


def thread_scaling(runs: DataFrame, by: list[str], value: str = "seconds", one: int = 1, some: int = 8, many: int = 48) -> DataFrame:
    """The median by threads, where it is least, and ratios of chosen thread counts."""
    med = runs.groupBy(*by, "threads").agg(F.median(value).alias("m"))
    at = lambda t: F.max(F.when(F.col("threads") == t, F.col("m")))
    best = F.min_by("threads", F.struct("m", "threads"))
    return med.groupBy(*by).agg(best.alias("best_threads"), F.min("m").alias("best"), F.try_divide(at(many), at(some)).alias("many_over_some"), F.try_divide(at(one), F.min("m")).alias("one_over_best"))


def paired_ratios(runs: DataFrame, keys: list[str], arm: str, base: object, values: list[str]) -> DataFrame:
    """Each run over the base run of the same keys, value by value."""
    ref = runs.where(F.col(arm) == F.lit(base)).select(*keys, *(F.col(v).alias(f"base_{v}") for v in values))
    return runs.where(F.col(arm) != F.lit(base)).join(ref, keys).select(*keys, arm, *(F.try_divide(F.col(v), F.col(f"base_{v}")).alias(f"{v}_ratio") for v in values))


def ratio_summary(ratios: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sample std, range, and whether the mean lies beyond one std from 1."""
    got = ratios.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("least"), F.median(value).alias("median"), F.max(value).alias("most"))
    return got.withColumn("beyond", F.abs(F.col("mean") - 1) > F.col("std"))


def wins(pairs: DataFrame, by: list[str], mine: str, other: str) -> DataFrame:
    """How often mine is less, and a verdict."""
    got = pairs.groupBy(*by).agg(F.sum((F.col(mine) < F.col(other)).cast("long")).alias("wins"), F.count("*").alias("n"))
    word = F.when(F.col("wins") == F.col("n"), "always").when(F.col("wins") == 0, "never").otherwise("mixed")
    return got.withColumn("verdict", F.concat_ws(" ", word, F.concat(F.col("wins").cast("string"), F.lit("/"), F.col("n").cast("string"))))


def places(scores: DataFrame, row: str, name: str, value: str, largest: bool = True) -> DataFrame:
    """Dense ranks of names within each row; equal values share a place."""
    order = F.col(value).desc_nulls_last() if largest else F.col(value).asc_nulls_last()
    return scores.withColumn("place", F.dense_rank().over(Window.partitionBy(row).orderBy(order))).select(row, name, value, "place")


def complete_means(scores: DataFrame, name: str, value: str, expected: int) -> DataFrame:
    """The mean over all graphs, null unless all are there."""
    return scores.groupBy(name).agg(F.when(F.count(value) == expected, F.avg(value)).alias("mean"))


def improvement(means_: DataFrame, name: str, mine: str, largest: bool = True) -> DataFrame:
    """By how many percent mine is better than the best other."""
    best = F.max if largest else F.min
    own = means_.where(F.col(name) == mine).agg(F.first("mean").alias("mine"))
    rest = means_.where(F.col(name) != mine).agg(best("mean").alias("other"))
    return own.join(F.broadcast(rest)).withColumn("percent", 100 * (F.col("mine") - F.col("other")) / F.abs("other"))


def run_matrix(axes: list[DataFrame]) -> DataFrame:
    """All combinations of small axis tables: the runs that are planned."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), axes)


def missing(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def last_seeds(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))).where("__n = 1").drop("__n")


def running(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    return rows.withColumn("running", F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def with_neighbours(rows: DataFrame, by: list[str], value: str, id_: str) -> DataFrame:
    """Each row's value between those ranked before and after it."""
    order = Window.partitionBy(*by).orderBy(F.col(value).desc(), id_)
    return rows.withColumn("before", F.lag(value).over(order)).withColumn("after", F.lead(value).over(order))


def seed_means(rows: DataFrame, name: str, values: list[str]) -> DataFrame:
    """One row for each name but for its _S<number>: means of what is a number, and the name, in which several seeds are
    counted as _<n>_seeds. rows(place, name, *values), of which the first one's place names the group."""
    base = F.regexp_replace(name, r"_S\d+", "")
    number = {v: F.avg(F.col(v).try_cast("double")).alias(v) for v in values}
    got = rows.withColumn("__base", base).groupBy("__base").agg(F.min_by(name, "place").alias("__first"), F.count("*").alias("n_seeds"), *number.values())
    counted = F.regexp_replace("__first", r"^(.*?)_S\d+", F.concat(F.lit("$1_"), F.col("n_seeds").cast("string"), F.lit("_seeds")))
    return got.select(F.when(F.col("n_seeds") > 1, counted).otherwise(F.col("__first")).alias(name), "n_seeds", *values)


def split_filtered(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows of plain and of filtered scores."""
    return rows.where(~F.col(name).endswith("_filtered")), rows.where(F.col(name).endswith("_filtered"))


def doubled_means(rows: DataFrame, by: list[str], mean: list[str], doubled: list[str], least: list[str]) -> DataFrame:
    """Means of some columns, twice the mean of others (two-sided bounds), the minimum of those that do not vary."""
    return rows.groupBy(*by).agg(*(F.avg(c).alias(c) for c in mean), *((2 * F.avg(c)).alias(c) for c in doubled), *(F.min(c).alias(c) for c in least))


def complements(rows: DataFrame, by: list[str], complement: str, mean: str) -> DataFrame:
    """One less the mean of a column, beside the mean of another."""
    return rows.groupBy(*by).agg((1 - F.avg(complement)).alias(complement), F.avg(mean).alias(mean))


def regrouped(rows: DataFrame, fine: list[str], coarse: list[str], value: str) -> DataFrame:
    """Range and median in fine groups, then the outer range and the mean median in coarse ones."""
    inner = spread(rows, fine, value)
    return inner.groupBy(*coarse).agg(F.min("least").alias("least"), F.avg("median").alias("median"), F.max("most").alias("most"), F.count("*").alias("groups"))


def seed_speed_up(runs: DataFrame, by: list[str], value: str, arm: str, slow: str, fast: str) -> DataFrame:
    """The median over by of speed_up()'s ratios, and how many there are."""
    return speed_up(runs, by, value, arm, slow, fast).agg(F.median("ratio").alias("median_ratio"), F.count("ratio").alias("n"))


def predicted_stops(lines: DataFrame, variants: tuple[str, ...] = ("code", "paper", "cpp")) -> DataFrame:
    """(log, k, variant, samples) of lines(log, line, value): the header '# k = N' holds for what follows it; samples is
    null where a variant does not stop. A later line for the same key counts."""
    kinds = "|".join(variants)
    header, stop = r"^#+ k = (\d+)", rf"^\s+({kinds})\s+(?:(\d+) samples|does NOT stop)"
    order = Window.partitionBy("log").orderBy("line")
    marked = lines.withColumn("k", F.last(F.when(F.col("value").rlike(header), F.regexp_extract("value", header, 1).cast("int")), ignorenulls=True).over(order))
    found = marked.where(F.col("value").rlike(stop) & F.col("k").isNotNull())
    samples = F.regexp_extract("value", stop, 2).try_cast("long")
    return found.groupBy("log", "k", F.regexp_extract("value", stop, 1).alias("variant")).agg(F.max_by(samples, "line").alias("samples"))


def predicted_summary(stops: DataFrame, by: list[str], seed: str) -> DataFrame:
    """By graph and k the mean ratios over seeds of paper and cpp to code, and of code and paper to code at k = 0."""
    wide = stops.groupBy(*by, seed, "k").pivot("variant", ["code", "paper", "cpp"]).agg(F.first("samples"))
    base = wide.where("k = 0").select(*by, seed, F.col("code").alias("zero"))
    met = wide.join(base, [*by, seed], "left")
    ratio = lambda a, b: F.avg(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")))
    return met.groupBy(*by, "k").agg(ratio("paper", "code").alias("paper_over_code"), ratio("cpp", "code").alias("cpp_over_code"), ratio("code", "zero").alias("code_over_zero"), ratio("paper", "zero").alias("paper_over_zero"))
