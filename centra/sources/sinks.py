"""Writing edges, scores and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_edges(edges: DataFrame, path: str, separator: str = " ", once: bool = False, base: int = 0) -> None:
    """A text edge list; once keeps one direction of undirected edges, base is taken from each id."""
    rows = edges.where("src < dst") if once else edges
    rows.select(F.concat_ws(separator, *((F.col(c) - base).cast("string") for c in ("src", "dst"))).alias("value")).write.mode("overwrite").text(path)


def write_training_instance(edges: DataFrame, ids: DataFrame, scores: DataFrame, path: str) -> None:
    """Edges, and node_id,betweenness with 0.0 where a score is missing."""
    write_edges(edges, f"{path}/edges")
    filled = ids.select("id").join(scores, "id", "left").select(F.col("id").alias("node_id"), F.coalesce("score", F.lit(0.0)).alias("betweenness"))
    filled.write.mode("overwrite").csv(f"{path}/scores", header=True)


def write_runs(runs: DataFrame, path: str, scores: bool = True) -> None:
    """One JSON object a line; without scores the map of centralities is left out."""
    (runs if scores else runs.drop("centralities")).write.mode("append").json(path)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").csv(path, header=True)


def wide_results(long: DataFrame, graphs: list[str]) -> DataFrame:
    """One row for each (metric, algorithm), one column for each graph, from (algorithm, metric, graph, value)."""
    return long.groupBy("metric", "algorithm").pivot("graph", graphs).agg(F.first("value"))


def predictions(truth: DataFrame, pred: DataFrame, degrees: DataFrame) -> DataFrame:
    """(id, truth, pred, in_deg, out_deg), for a Parquet dump."""
    both = truth.withColumnRenamed("score", "truth").join(pred.withColumnRenamed("score", "pred"), "id")
    return both.join(degrees, "id").select("id", "truth", "pred", F.col("indeg").alias("in_deg"), F.col("deg").alias("out_deg"))


def _cells(rows: DataFrame, digits: int) -> list[Column]:
    return [F.coalesce(F.format_string(f"%.{digits}f", F.col(f"`{c}`")) if t in ("double", "float") else F.col(f"`{c}`").cast("string"), F.lit("-")) for c, t in rows.dtypes]


def _with_head(rows: DataFrame, head: list[str]) -> DataFrame:
    return rows.sparkSession.createDataFrame([(h,) for h in head], "value string").unionByName(rows)


def markdown(rows: DataFrame, digits: int = 4, header: bool = False) -> DataFrame:
    """(value): lines of a table, numbers with digits places; for results of a few rows."""
    lines = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *_cells(rows, digits)), F.lit(" |")).alias("value"))
    return _with_head(lines, [f"| {' | '.join(rows.columns)} |", f"|{'-|' * len(rows.columns)}"]) if header else lines


def latex(rows: DataFrame, digits: int = 4) -> DataFrame:
    """(value): the body of a LaTeX table, special characters escaped."""
    cells = [F.regexp_replace(c, r"([_%&#$])", r"\\$1") for c in _cells(rows, digits)]
    lines = rows.select(F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("value"))
    return _with_head(lines, [" & ".join(rows.columns) + r" \\ \midrule"])
