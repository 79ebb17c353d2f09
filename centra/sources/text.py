"""Edge lists, manifests, truths, scores and logs as DataFrames. Lines are read and parsed by Spark alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from centra.functions.numbering import numbered
from centra.functions.storage import dealt
from centra.operators.graph import one_based, relabel_first_seen, symmetrise


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("value"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) from 0 in the order of the file's bytes: the parts of a file are numbered by their place in it."""
    raw = spark.read.text(path).withColumn("__at", F.monotonically_increasing_id())
    return numbered(raw, [F.col("__at")], "line").select("line", F.trim("value").alias("value"))


def _comment(value: str = "value") -> Column:
    return (F.col(value) == "") | F.col(value).startswith("#") | F.col(value).startswith("%")


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """(path, directed) of a manifest with lines 'path D' or 'path U'."""
    part = F.split("value", r"\s+")
    return _lines(spark, path).where(~_comment()).select(part[0].alias("path"), (F.try_element_at(part, F.lit(2)) == "D").alias("directed"))


def read_edges(spark: SparkSession, path: str, directed: bool = True, shift: bool = False, separator: str = r"[\s,]+") -> DataFrame:
    """Distinct (src, dst) of a text edge list; comments, blank lines, further fields and lines that do not start with
    two integers are skipped, undirected edges stand in both directions, and with shift ids start at 1 if they start at 0."""
    part = F.split("value", separator)
    id_ = lambda i: F.try_element_at(part, F.lit(i)).try_cast("long")
    lines = _lines(spark, path)
    edges = lines.where(~_comment()).select(id_(1).alias("src"), id_(2).alias("dst")).where("src is not null and dst is not null")
    if not directed:
        ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
        edges = edges.select(F.explode(ends).alias("e")).select("e.src", "e.dst")
    edges = dealt(edges, lines.count() * (1 if directed else 2), "src", "dst").distinct()
    return one_based(edges) if shift else edges


def read_edges_relabelled(spark: SparkSession, path: str, directed: bool = True) -> tuple[DataFrame, DataFrame]:
    """The same with ids 0..n-1 in the order in which they first appear, and the map (id, n)."""
    part = F.split("value", r"\s+")
    lines = numbered_lines(spark, path).where(~_comment()).select("line", part[0].try_cast("long").alias("src"), F.try_element_at(part, F.lit(2)).try_cast("long").alias("dst"))
    edges, ids = relabel_first_seen(lines.where("src is not null and dst is not null"))
    return (edges if directed else symmetrise(edges)), ids


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are no comment and do not start with two integers."""
    return _lines(spark, path).where(~_comment() & ~F.col("value").rlike(r"^\d+[\s,]+\d+"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(id, score) of a CSV file node,betweenness; ids start at 1 if the least is 0."""
    rows = spark.read.csv(path, header=True, schema="id long, score double").where("id is not null")
    shift = rows.agg((F.min("id") == 0).cast("long").alias("shift"))
    return rows.join(F.broadcast(shift)).select((F.col("id") + F.col("shift")).alias("id"), "score")


def zero_filled(ids: DataFrame, scores: DataFrame) -> DataFrame:
    return ids.select("id").join(scores, "id", "left").fillna(0.0, ["score"])


def read_score_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, score): the number of each line that is not blank, gaps kept."""
    return numbered_lines(spark, path).where("value != ''").select(F.col("line").alias("id"), F.col("value").try_cast("double").alias("score"))


#: Patterns of tools' score lines: fixed formats.
SCORE_LINES = {
    "plain": r"^(\d+)\s+([-+.\deE]+)$",
    "csv": r"^(\d+)\s*,\s*([-+.\deE]+)$",
    "colon": r"^(\d+)\s*:\s*([-+.\deE]+)$",
}
RANKED_LINE = r"^(\?\s*)?(\d+)\)\s+(\d+)\s+([-+.\deE]+)\s+([-+.\deE]+)\s+([-+.\deE]+)"
TOTAL_TIME = r"[Tt]otal time:\s*([.\d]+)"


def parse_scores(lines: DataFrame, kind: str, n: int | None = None) -> DataFrame:
    """(id, score) of lines(value) of one kind; other lines and ids from n on are ignored."""
    get = lambda i: F.regexp_extract("value", SCORE_LINES[kind], i)
    out = lines.where(F.col("value").rlike(SCORE_LINES[kind])).select(get(1).cast("long").alias("id"), get(2).cast("double").alias("score"))
    return out if n is None else out.where(F.col("id") < n)


def parse_ranked(lines: DataFrame) -> DataFrame:
    """rank, id, lower, score, upper and whether the place is unresolved, of lines 'rank) node lower estimate upper'."""
    get = lambda i: F.regexp_extract("value", RANKED_LINE, i)
    return lines.where(F.col("value").rlike(RANKED_LINE)).select(
        get(2).cast("int").alias("rank"), get(3).cast("long").alias("id"), get(4).cast("double").alias("lower"), get(5).cast("double").alias("score"),
        get(6).cast("double").alias("upper"), (get(1) != "").alias("unresolved"),
    )


def parse_total_time(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("value").rlike(TOTAL_TIME)).select(F.regexp_extract("value", TOTAL_TIME, 1).cast("double").alias("seconds"))


#: Fields of a run's JSON object; all may be missing.
RUN_SCHEMA = (
    "parameters struct<input_file:string,algorithm:string,version:string,threads:int,k:int,topk_variant:string,seed:long,delta:double,epsilon:double,"
    "directed:boolean,parallel:boolean,stop_in_batch:boolean,consistent_pairs:boolean,check_interval_requested:int,check_interval_effective:int>,"
    "execution_time_seconds double, io_time_seconds double, num_samples long, phase2_pairs long, n_checks long,"
    "samples_over_omega double, tau_overall double, tau_topk double, overlap_topk long, max_ae double, mae double, ndcg_topk double, centralities map<string,double>"
)

#: Keys that file names carry, by the kind of run: fixed formats.
RUN_NAMES = {
    "tight": (r"tight_(cpp|julia)_(.+)\.json$", ["impl", "graph"]),
    "method": (r"bvk_([a-z]+(?:_[cg]pu)?)_(.+)\.json$", ["method", "graph"]),
    "threads": (r"(julia|cpp)_(.+)_t(\d+)_s(\d+)\.json$", ["impl", "graph", "threads", "seed"]),
    "variant": (r"kx_(.+)_k(\d+)_([a-z_]+)_s(\d+)\.json$", ["graph", "k", "variant", "seed"]),
    "reference": (r"kxc_(.+)_k(\d+)_s(\d+)\.json$", ["graph", "k", "seed"]),
    "arm": (r"sc_([^_]+)_(.+)_s(\d+)\.json$", ["arm", "graph", "seed"]),
}


def read_runs(spark: SparkSession, path: str, kind: str | None = None, lines: bool = False, more: str = "") -> DataFrame:
    """Runs from JSON files, one object a file or a line, with the keys of the file names of one kind. more names
    further fields with their types, such as an estimator's own figures."""
    runs = spark.read.schema(f"{RUN_SCHEMA}, {more}" if more else RUN_SCHEMA).json(path, multiLine=not lines).withColumn("file", F.input_file_name())
    if kind is None:
        return runs
    pattern, keys = RUN_NAMES[kind]
    named = {k: F.regexp_extract("file", pattern, i + 1).cast("int" if k in ("threads", "k", "seed") else "string") for i, k in enumerate(keys)}
    return runs.where(F.col("file").rlike(pattern)).withColumns(named)


#: Lines of a log that a task orders at once.
LINES = 1 << 17


def parse_log(lines: DataFrame, result: str, columns: list[str], header: str = r"seed\s*:\s*(\d+)", carried: str = "seed") -> DataFrame:
    """Rows of lines(log, line, value) that match result, with the last header seen before them in their log, the first
    of equal ones kept. Runs of LINES lines are windows of their own, before which the last header of earlier runs holds."""
    marked = lines.withColumns({"__h": F.when(F.col("value").rlike(header), F.regexp_extract("value", header, 1)), "__run": F.floor(F.col("line") / LINES)})
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    runs = marked.groupBy("log", "__run").agg(F.max_by("__h", F.when(F.col("__h").isNotNull(), F.col("line"))).alias("__last"))
    runs = runs.withColumn("__before", F.last("__last", ignorenulls=True).over(upto("log").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.select(F.col("log").alias("__log"), F.col("__run").alias("__of"), "__before")
    own = marked.withColumn("__own", F.last("__h", ignorenulls=True).over(upto("log", "__run").orderBy("line")))
    held = own.join(runs, F.col("log").eqNullSafe(F.col("__log")) & (F.col("__run") == F.col("__of"))).withColumn(carried, F.coalesce("__own", "__before"))
    found = held.where(F.col("value").rlike(result)).select("log", "line", carried, *(F.regexp_extract("value", result, i + 1).alias(c) for i, c in enumerate(columns)))
    firsts = found.groupBy("log", carried, *columns[:-1]).agg(F.min_by(columns[-1], "line").alias(columns[-1]), F.min("line").alias("line"))
    return firsts.select("log", "line", carried, *columns)


def last_values(lines: DataFrame, prefixes: list[str]) -> DataFrame:
    """(log, one column for each prefix): what follows the prefix in its last line."""
    out = [F.max_by(F.when(F.col("value").startswith(p), F.trim(F.substring("value", len(p) + 1, 10_000))), F.when(F.col("value").startswith(p), F.col("line"))).alias(p.strip(" :=").replace(" ", "_")) for p in prefixes]
    return lines.groupBy("log").agg(*out)


def read_wide_results(spark: SparkSession, path: str, keep_last_seed: bool = True) -> DataFrame:
    """(algorithm, seed, graph, value) of a wide CSV file with one column for each graph; what is no number is null."""
    wide = spark.read.csv(path, header=True)
    first, graphs = wide.columns[0], wide.columns[1:]
    pairs = F.explode(F.array(*(F.struct(F.lit(g).alias("graph"), F.col(f"`{g}`").try_cast("double").alias("value")) for g in graphs))).alias("x")
    seed = F.regexp_extract(first, r"_S(\d+)", 1).try_cast("int")
    return wide.withColumn("__at", F.monotonically_increasing_id()).select(F.regexp_replace(first, r"_S\d+", "").alias("algorithm"), seed.alias("seed"), "__at", pairs).groupBy("algorithm", "seed", "x.graph").agg(F.max_by("x.value", "__at").alias("value"))


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each graph of a timings CSV file, NUL characters removed."""
    raw = spark.read.csv(path, header=True).withColumn("__at", F.monotonically_increasing_id())
    named = raw.select(F.translate("Dataset", "\0", "").alias("graph"), F.col("Nodes").try_cast("long").alias("nodes"), F.col("Edges").try_cast("long").alias("edges"), F.col("Runtime_s").try_cast("double").alias("seconds"), F.col("Status").alias("status"), "__at")
    return named.groupBy("graph").agg(*(F.max_by(c, "__at").alias(c) for c in ("nodes", "edges", "seconds", "status")))
