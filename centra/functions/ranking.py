"""Rank quality of scores against a truth, over tables (id, truth, pred); ties go to smaller ids."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered, running_total
from .storage import checkpointed


def paired(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """truth(id, score) and pred(id, score) side by side, 0 where there is no prediction."""
    return truth.select("id", F.col("score").alias("truth")).join(pred.select("id", F.col("score").alias("pred")), "id", "left").fillna(0.0, ["pred"])


def inversions(values: np.ndarray) -> int:
    """Pairs in falling order, by merging runs of doubling length."""
    order = np.unique(values, return_inverse=True)[1].astype(np.int64)
    n, width, total = len(order), 1, 0
    top = int(order.max()) + 1 if n else 1
    while width < n:
        run = np.arange(n) // (2 * width)
        right = np.arange(n) % (2 * width) >= width
        key = run * top + order
        left_keys = key[~right]  # sorted: runs ascend, and each left half is sorted
        upto = np.searchsorted(left_keys, key[right], "right")
        ends = np.searchsorted(left_keys, (run[right] + 1) * top)
        total += int((ends - upto).sum())
        order = np.sort(key, kind="stable") - run * top
        width *= 2
    return total


def kendall(pairs: DataFrame) -> DataFrame:
    """One row (n, tau_a, tau_b). Ties and sizes are pre-aggregated; discordant pairs are counted in ranges of the truth:
    within each by merging, and between ranges from counts of predictions, so that no task holds more than a range."""
    n0 = lambda c: F.coalesce(F.sum(c * (c - 1) / 2), F.lit(0.0))
    ties = lambda *by: pairs.groupBy(*by).agg(F.count("*").cast("double").alias("c")).agg(n0(F.col("c")).alias("t"))
    n = pairs.count()
    t1, t2, t3 = (ties(*by).first()[0] for by in (("truth",), ("pred",), ("truth", "pred")))
    inv = discordant(pairs)
    all_ = n * (n - 1) / 2
    spark = pairs.sparkSession
    concordant_less = all_ - t1 - t2 + t3 - 2 * inv
    under = (all_ - t1) * (all_ - t2)
    tau_b = 1.0 if n <= 1 else float(concordant_less / under**0.5) if under else float("nan")
    tau_a = float("nan") if not n else 1.0 if n == 1 else concordant_less / all_
    return spark.createDataFrame([(n, tau_a, tau_b)], "n long, tau_a double, tau_b double")


#: Rows up to which discordant pairs are counted at once, 16 bytes each.
SMALL = 1_000_000


def discordant(pairs: DataFrame, bits: int = 12, small: int = SMALL) -> int:
    """Pairs with truth and prediction in strictly opposite order; of more than small rows in ranges:

    Each row has a place t by truth and p by prediction, ties broken by the other one, so that tied pairs are in order.
    Pairs within 2^bits places of either are counted by merging in one task for each range; all others from the counts
    of cells, level by level of the bits in which their ranges differ first, with distributed running totals.
    """
    pairs = checkpointed(pairs.select("id", "truth", "pred"))
    if pairs.count() <= small:
        table = pairs.select("truth", "pred").toArrow()
        truth, pred = (table.column(k).to_numpy() for k in (0, 1))
        return inversions(pred[np.lexsort((pred, truth))])
    rank = numbered(pairs.select("id", "truth", "pred"), [F.col("pred"), F.col("truth"), F.col("id")], "p")
    rank = numbered(rank, [F.col("truth"), F.col("pred"), F.col("id")], "t")
    cell = checkpointed(rank.select("t", "p", F.shiftright("t", bits).alias("a"), F.shiftright("p", bits).alias("b")))

    def within(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("t").to_numpy())
        return pa.table([[inversions(rows.column("p").to_numpy()[order])]], names=["inv"])

    def same_column(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("t").to_numpy())
        p, a = rows.column("p").to_numpy()[order], rows.column("a").to_numpy()[order]
        ends = np.append(np.flatnonzero(np.diff(a)) + 1, len(a))
        inside = sum(inversions(p[x:y]) for x, y in zip(np.append(0, ends[:-1]), ends))
        return pa.table([[inversions(p) - inside]], names=["inv"])

    total = 0
    for key, count in (("a", within), ("b", same_column)):
        total += cell.groupBy(key).applyInArrow(count, "inv long").agg(F.sum("inv")).first()[0] or 0
    grid = checkpointed(cell.groupBy("a", "b").agg(F.count("*").alias("c")))
    for level in range(int(grid.agg(F.max("a")).first()[0] or 0).bit_length()):
        side = F.shiftright("a", level).bitwiseAND(F.lit(1))
        halves = grid.select(F.shiftright("a", level + 1).alias("g"), side.alias("right"), "b", "c").withColumn("left", F.when(F.col("right") == 0, F.col("c")).otherwise(0))
        summed = halves.groupBy("g", "b", "right").agg(F.sum("c").alias("c"), F.sum("left").alias("left"))
        upto = running_total(summed, [F.col("g"), F.col("b"), F.col("right")], "left", "upto")
        ends = upto.groupBy("g").agg(F.max("upto").alias("all"))
        after = upto.where("right = 1").join(ends, "g").agg(F.sum(F.col("c") * (F.col("all") - F.col("upto")))).first()[0]
        total += after or 0
    return int(total)


def ranks(pairs: DataFrame) -> DataFrame:
    """With rank_truth and rank_pred, from 1."""
    by_truth = numbered(pairs, [F.col("truth").desc(), F.col("id")], "rank_truth")
    both = numbered(by_truth, [F.col("pred").desc(), F.col("id")], "rank_pred")
    return both.withColumn("rank_truth", F.col("rank_truth") + 1).withColumn("rank_pred", F.col("rank_pred") + 1)


def top(pairs: DataFrame, by: str, k: int) -> DataFrame:
    return pairs.orderBy(F.col(by).desc(), "id").limit(k).select("id", "truth", "pred")


def overlap(pairs: DataFrame, k: int = 0) -> DataFrame:
    """One row (k, overlap): how many of the k best are common; 100 for k = 0, n at most."""
    common = top(pairs, "truth", k or 100).join(top(pairs, "pred", k or 100).select("id"), "id", "left_semi")
    n = pairs.agg(F.least(F.count("*"), F.lit(k or 100)).alias("k"))
    return common.agg(F.count("*").alias("overlap")).join(F.broadcast(n)).select("k", "overlap")


def top_share(pairs: DataFrame, percent: float) -> DataFrame:
    """One row (k, share) of the best percent, one at least."""
    k = max(1, int(pairs.count() * percent / 100))
    return overlap(pairs, k).select("k", (F.col("overlap") / F.col("k")).alias("share"))


def ndcg(pairs: DataFrame, k: int) -> DataFrame:
    """One row (ndcg): gains are true scores, 1 without any."""
    gain = lambda by: top(pairs, by, k).withColumn("r", F.row_number().over(Window.orderBy(F.col(by).desc(), "id"))).agg(F.sum(F.col("truth") / F.log2(F.col("r") + 1.0)).alias(by))  # noqa: E731  k rows
    return gain("pred").join(F.broadcast(gain("truth"))).select(F.when(F.coalesce("truth", F.lit(0.0)) == 0, 1.0).otherwise(F.col("pred") / F.col("truth")).alias("ndcg"))


def errors(pairs: DataFrame, eps: float) -> DataFrame:
    """One row: n, wrong (above eps), mean, population std, quartiles, largest, mean square of absolute errors."""
    e = pairs.select(F.abs(F.col("truth") - F.col("pred")).alias("e"))
    q = F.percentile("e", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    got = e.agg(F.count("*").alias("n"), F.sum((F.col("e") > eps).cast("long")).alias("wrong"), F.avg("e").alias("mae"), F.stddev_pop("e").alias("std"), F.avg(F.col("e") ** 2).alias("mse"), q.alias("q"))
    return got.select("n", "wrong", "mae", "std", "mse", *(F.col("q")[i].alias(c) for i, c in enumerate(("least", "q1", "median", "q3", "max_ae"))))


def kendall_top(pairs: DataFrame, k: int) -> DataFrame:
    """kendall() on the k largest true scores."""
    return kendall(top(pairs, "truth", k))


def kendall_positive(pairs: DataFrame) -> DataFrame:
    """kendall() where the truth is above 0; NaN for fewer than two such rows."""
    nan = lambda c: F.when(F.col("n") < 2, float("nan")).otherwise(F.col(c)).alias(c)
    return kendall(pairs.where("truth > 0")).select("n", nan("tau_a"), nan("tau_b"))


def offset_check(truth: DataFrame, pred: DataFrame, margin: float = 0.1) -> DataFrame:
    """One row (tau, shifted, sound): tau-b as it is and with predictions moved up by one id, which has to be worse by
    margin if ids are placed rightly."""
    right = kendall(paired(truth, pred)).select(F.col("tau_b").alias("tau"))
    wrong = kendall(paired(truth, pred.withColumn("id", F.col("id") + 1))).select(F.col("tau_b").alias("shifted"))
    return right.join(F.broadcast(wrong)).withColumn("sound", F.col("tau") > F.col("shifted") + margin)


def bias_check(pairs: DataFrame, eps: float, n: int, tau: int, k: int = 1000) -> DataFrame:
    """Rows (kind, max_ae, over_eps, argmax_rank, mae, scale) of predictions as they are, times n / (n - tau), and times
    the least-squares scale to the truth over its k largest; argmax_rank is the true rank of the largest error."""
    own = checkpointed(pairs)
    fit = top(own, "truth", k).agg((F.sum(F.col("truth") * F.col("pred")) / F.sum(F.col("pred") ** 2)).alias("scale"))
    kinds = [("raw", F.lit(1.0), None), ("rescaled", F.lit(n / (n - tau)), None), ("fitted", F.col("scale"), fit)]
    out = None
    for kind, scale, table in kinds:
        rows = (own.join(F.broadcast(table)) if table is not None else own).withColumn("by", scale)
        e = rows.withColumn("e", F.abs(F.col("pred") * F.col("by") - F.col("truth")))
        got = e.agg(F.max("e").alias("max_ae"), F.sum((F.col("e") > eps).cast("long")).alias("over_eps"), F.max_by("truth", F.struct("e", -F.col("id"))).alias("at"), F.avg("e").alias("mae"), F.max("by").alias("scale"))
        rank = own.join(F.broadcast(got.select("at"))).agg((F.sum((F.col("truth") > F.col("at")).cast("long")) + 1).alias("argmax_rank"))
        row = got.join(F.broadcast(rank)).select(F.lit(kind).alias("kind"), "max_ae", "over_eps", "argmax_rank", "mae", "scale")
        out = row if out is None else out.unionByName(row)
    return out


def unmatched(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(id, side) of ids that only one of the two has; exact scores and a sample's agree in keys if there is none."""
    one = lambda a, b, side: a.select("id").join(b.select("id"), "id", "left_anti").withColumn("side", F.lit(side))
    return one(truth, pred, "truth").unionByName(one(pred, truth, "pred"))


def median_scale(pairs: DataFrame) -> DataFrame:
    """One row (ratio): the median of prediction over truth where that is positive."""
    return pairs.where("truth > 0").agg(F.median(F.col("pred") / F.col("truth")).alias("ratio"))


def fitted_scale(pairs: DataFrame, k: int = 1000) -> DataFrame:
    """One row (slope): least squares of prediction on truth over the k best."""
    return top(pairs, "truth", k).agg((F.sum(F.col("truth") * F.col("pred")) / F.sum(F.col("truth") ** 2)).alias("slope"))


def margin_loss(pairs: DataFrame, margin: float = 1.0) -> DataFrame:
    """One row (loss) over (s_u, s_v, y): the mean of relu(margin - y (s_u - s_v))."""
    return pairs.agg(F.avg(F.greatest(F.lit(0.0), margin - F.col("y") * (F.col("s_u") - F.col("s_v")))).alias("loss"))


def ranking_cross_entropy(pairs: DataFrame) -> DataFrame:
    """One row (loss) over (pred_u, pred_v, target_u, target_v): binary cross-entropy of logit differences against the
    sigmoids of target differences."""
    x, y = F.col("pred_u") - F.col("pred_v"), 1 / (1 + F.exp(-(F.col("target_u") - F.col("target_v"))))
    return pairs.agg(F.avg(F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))).alias("loss"))


