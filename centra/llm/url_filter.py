"""URL filters: host and path rules, and for all other pages trust and distrust that spread over the host graph.

Trust starts at the hosts of pages that a rule allows and follows links; distrust starts at the hosts of pages that a
rule blocks and follows links backwards. Both are personalised PageRank over host edges, in units of ruled pages; what
reaches a host without links onwards stays there. Rounds go on until the values change by less than TOLERANCE of all seeds in
total, which ROUNDS rounds suffice for on any graph, as each shrinks the change by DAMPING. A host with more distrust
than trust is blocked, any other one allowed. DataFrame functions only.

Cases: a null url or one without :// has an empty host and path, fits no rule, and is judged as the host ''. A null html
has no links. Links within a host and links without a host do not count. Repeated pages and links count each time.
Without ruled pages all is allowed. Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from math import ceil, log
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: (verdict, host, path); the longest that fits wins.
RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]
DAMPING = 0.85
TOLERANCE = 1e-9
ROUNDS = ceil(log(TOLERANCE) / log(DAMPING))
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
#: Targets of links that name a host.
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)"""


def _lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host and path of every row of pages(page_id, url)."""
    part = lambda pattern: F.coalesce(F.regexp_extract("url", pattern, 1), F.lit(""))
    return pages.select("page_id", _lower(part(HOST)).alias("host"), part(PATH).alias("path"))


def ruled(hosts: DataFrame, rules=RULES) -> DataFrame:
    """With rule (host and path of the longest rule that fits, else null) and ruling (its verdict)."""
    rule = ruling = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, ruling = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
    return hosts.withColumn("rule", rule).withColumn("ruling", ruling)


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from pages of one host to another host."""
    links = pages.select(
        _lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst")
    )
    return links.select("src", _lower(F.col("dst")).alias("dst")).where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, kind, value) when seeds(host, kind, seed) have spread over links(src, dst, n); kind 'd' goes back."""
    out = links.groupBy("src").agg(F.sum("n").alias("all")).withColumnRenamed("src", "k")
    back = links.groupBy("dst").agg(F.sum("n").alias("all")).withColumnRenamed("dst", "k")
    forth = links.join(out, F.col("src") == F.col("k")).select(F.lit("t").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("n") / F.col("all")).alias("p"))
    rear = links.join(back, F.col("dst") == F.col("k")).select(F.lit("d").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), (F.col("n") / F.col("all")).alias("p"))
    steps = checkpointed(forth.unionByName(rear))
    first = checkpointed(seeds.select("host", "kind", (F.col("seed") * F.lit(1 - damping)).alias("value")))
    if not steps.limit(1).count():
        return first
    # What the last round has added moves on; value is the sum of all that has come so far.
    now = checkpointed(first.withColumn("fresh", F.col("value")))
    total = now.agg(F.sum("value")).first()[0] or 0.0
    for _ in range(rounds):
        moving = now.where("fresh > 0").select(F.col("host").alias("from"), "kind", "fresh")
        moved = steps.join(moving, ["from", "kind"]).select(F.col("to").alias("host"), "kind", F.lit(0.0).alias("value"), (F.col("fresh") * F.col("p") * damping).alias("fresh"))
        met = moved.unionByName(now.select("host", "kind", "value", F.lit(0.0).alias("fresh"))).groupBy("host", "kind").agg(F.sum("value").alias("value"), F.sum("fresh").alias("fresh"))
        now = checkpointed(met.select("host", "kind", (F.col("value") + F.col("fresh")).alias("value"), "fresh"))
        if (now.agg(F.sum("fresh")).first()[0] or 0.0) <= tolerance * total:
            break
    return now.select("host", "kind", "value")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages(page_id, url, html)."""
    table = ruled(parsed(pages), rules)
    kind = F.when(F.col("ruling") == "allow", "t").otherwise("d")
    seeds = table.where("ruling is not null").groupBy("host", kind.alias("kind")).agg(F.count("*").cast("double").alias("seed"))
    value = propagate(seeds, edges(pages))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("value"))), F.lit(0.0))
    blocked = value.groupBy("host").agg(of("t").alias("trust"), of("d").alias("distrust")).where("distrust > trust").select(F.col("host").alias("bad"))
    blocked = checkpointed(blocked)  # so that Spark can broadcast it if it is small, and split a host's pages if not
    met = table.join(blocked, F.col("host") == F.col("bad"), "left")
    verdict = F.coalesce("ruling", F.when(F.col("bad").isNotNull(), "block").otherwise("allow"))
    return met.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda host, path: f"((host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}'))"
    case = lambda of: "case " + " ".join(f"when {fits(h, p)} then '{of(v, h, p)}'" for v, h, p in order) + " end"
    lower = lambda x: f"translate({x}, '{ascii_uppercase}', '{ascii_lowercase}')"
    link = LINK.replace("'", "''")
    rounds = "".join(f""",
r{i} as (select host, kind, sum(value) as value from (
  select "to" as host, steps.kind, value * p * {DAMPING} as value from steps join r{i - 1} on "from" = host and steps.kind = r{i - 1}.kind
  union all select * from r0) group by all)""" for i in range(1, ROUNDS + 1))  # fmt: skip
    return rf"""
with parsed as (select page_id, html, {lower(f"coalesce(regexp_extract(url, '{HOST}', 1), '')")} as host, coalesce(regexp_extract(url, '{PATH}', 1), '') as path from pages),
ruled as (select *, {case(lambda v, h, p: h + p)} as rule, {case(lambda v, h, p: v)} as ruling from parsed),
links as (select host as src, {lower("unnest(regexp_extract_all(html, '" + link + "', 1))")} as dst from ruled),
edges as (select src, dst, count(*) as n from links where src != dst group by all),
steps as (select 't' as kind, src as "from", dst as "to", n / sum(n) over (partition by src) as p from edges
  union all select 'd', dst, src, n / sum(n) over (partition by dst) from edges),
r0 as (select host, case ruling when 'allow' then 't' else 'd' end as kind, count(*) * {1 - DAMPING} as value from ruled where ruling is not null group by all){rounds},
bad as (select host from r{ROUNDS} group by host having coalesce(sum(value) filter (kind = 'd'), 0) > coalesce(sum(value) filter (kind = 't'), 0))
select page_id, host, path, rule, coalesce(ruling, case when host in (select host from bad) then 'block' else 'allow' end) as verdict from ruled
"""


OP6_SQL = _sql()
