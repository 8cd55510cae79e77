"""Operator 9: URL rules, and a character language-model ratio where no rule fits.

Rules name a host (itself and its subdomains) and a path prefix; the longest rule
that fits decides.  The URLs that rules decide also are the examples for two
character models, of accepted and of rejected URLs: Markov models of order 0 to
2, each smoothed towards the next lower order by Witten-Bell weights, over host
and path with digits folded and rare characters joined.  Every other URL gets the
difference of both log-likelihoods, divided by its length, against a threshold
calibrated on the examples: the point as many standard deviations below the
accepted mean as above the rejected mean.

The alphabet has at most 40 characters, so that the model is a table of at most
64,000 trigrams whatever the input's size; it is broadcast with that bound.  All
work is DataFrame and SQL functions.  Log ratios are kept as whole millionths,
which makes sums exact in any order.

A null URL, or one without ``://``, has an empty host and path and is scored like
any other.  Without rejected examples everything is allowed, without accepted
ones everything else is blocked.  Repeated rows stay repeated.  An empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict) of the contract.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Characters kept; any other becomes ``*``.  With ``^`` and ``$`` for the ends: 38 symbols.
ODD = r"[^a-z0/._\-=%~]"
SYMBOLS = 40
MILLIONTHS = 1_000_000

RATIOS = """
WITH c2 AS (SELECT y, z, sum(a) AS a, sum(r) AS r FROM {g} GROUP BY y, z),
c1 AS (SELECT z, sum(a) AS a, sum(r) AS r FROM c2 GROUP BY z),
k2 AS (SELECT x, y, sum(a) AS a, sum(r) AS r, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS ta, sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS tr FROM {g} GROUP BY x, y),
k1 AS (SELECT y, sum(a) AS a, sum(r) AS r, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS ta, sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS tr FROM c2 GROUP BY y),
p1 AS (SELECT z, (a + 1) / CAST((SELECT sum(a) FROM c1) + {v} AS DOUBLE) AS pa, (r + 1) / CAST((SELECT sum(r) FROM c1) + {v} AS DOUBLE) AS pr FROM c1),
p2 AS (SELECT c2.y, c2.z,
  CASE WHEN k1.a > 0 THEN (c2.a + k1.ta * p1.pa) / CAST(k1.a + k1.ta AS DOUBLE) ELSE p1.pa END AS pa,
  CASE WHEN k1.r > 0 THEN (c2.r + k1.tr * p1.pr) / CAST(k1.r + k1.tr AS DOUBLE) ELSE p1.pr END AS pr
  FROM c2 JOIN k1 ON c2.y = k1.y JOIN p1 ON c2.z = p1.z),
p3 AS (SELECT g.gram,
  CASE WHEN k2.a > 0 THEN (g.a + k2.ta * p2.pa) / CAST(k2.a + k2.ta AS DOUBLE) ELSE p2.pa END AS pa,
  CASE WHEN k2.r > 0 THEN (g.r + k2.tr * p2.pr) / CAST(k2.r + k2.tr AS DOUBLE) ELSE p2.pr END AS pr
  FROM {g} g JOIN k2 ON g.x = k2.x AND g.y = k2.y JOIN p2 ON g.y = p2.y AND g.z = p2.z)
SELECT gram, CAST(round((ln(pa) - ln(pr)) * {m}) AS BIGINT) AS q FROM p3
"""


def split_url(rows: DataFrame) -> DataFrame:
    """``rows`` with host and path of their url."""
    rest = F.when(F.locate("://", F.col("url")) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return rows.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_columns(rules: list[tuple[str, str]]):
    """(rule, verdict) columns of the longest rule that fits host and path; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda x: len(x[0])):  # a longer one overrides
        host, slash, path = name.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams(rows: DataFrame, *keep: str) -> DataFrame:
    """One row for each character of host and path, with the two before it."""
    folded = F.regexp_replace(F.regexp_replace(F.translate(F.concat("host", "path"), UPPER, LOWER), "[0-9]", "0"), ODD, "*")
    text = F.concat(F.lit("^^"), folded, F.lit("$"))
    each = F.transform(F.sequence(F.lit(1), F.length("_t") - 2), lambda i: F.substring(F.col("_t"), i, F.lit(3)))
    return rows.select(*keep, text.alias("_t")).select(*keep, F.posexplode(each).alias("_i", "gram"))


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides), threshold."""
    spark = pages.sparkSession
    rule, ruled = rule_columns(rules)
    rows = split_url(pages.select("page_id", "url")).withColumn("rule", rule).withColumn("ruled", ruled)
    counts = grams(rows, "ruled").groupBy("gram").agg(F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("r"))
    g = staged(counts.select("gram", *(F.substring("gram", i + 1, 1).alias(c) for i, c in enumerate("xyz")), "a", "r"), "url-grams")
    ratios = spark.sql(RATIOS.replace("{v}", str(SYMBOLS)).replace("{m}", str(MILLIONTHS)), g=g)
    each = grams(rows, "page_id", "url").join(F.broadcast(ratios), "gram")  # at most SYMBOLS ** 3 rows
    scored = each.groupBy("page_id", "url").agg(F.sum("q").alias("q"), F.count("*").alias("n"), F.count_if(F.col("_i") == 0).alias("copies"))
    scored = scored.withColumn("score", F.col("q") / (F.col("n") * MILLIONTHS)).drop("q", "n")
    scored = staged(split_url(scored).withColumn("rule", rule).withColumn("ruled", ruled), "url-scores")
    part = lambda f, kind: f(F.when(F.col("ruled") == kind, F.col("score")))
    seen = scored.select("ruled", "score", F.explode(F.sequence(F.lit(1), "copies"))).agg(part(F.avg, "allow").alias("ma"), part(F.stddev_pop, "allow").alias("sa"), part(F.avg, "block").alias("mr"), part(F.stddev_pop, "block").alias("sr")).first()
    least = threshold(seen.ma, seen.sa, seen.mr, seen.sr)
    decided = F.coalesce("ruled", F.when(F.col("score") >= F.lit(least), "allow").otherwise("block"))
    out = scored.select("page_id", "host", "path", "rule", decided.alias("verdict"), F.when(F.col("ruled").isNull(), F.col("score")).alias("score"), F.lit(least).alias("threshold"), F.explode(F.sequence(F.lit(1), "copies")))
    return out.drop("col")


def threshold(ma: float | None, sa: float | None, mr: float | None, sr: float | None) -> float:
    """Where both classes' deviations from their means are equal."""
    if mr is None:
        return float("-inf")
    if ma is None:
        return float("inf")
    return (ma + mr) / 2 if sa + sr == 0 else (ma * sr + mr * sa) / (sa + sr)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``pages``."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = """
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules AS (SELECT * FROM (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')) t(rule, rh, rp, says)),
numbered AS (SELECT row_number() OVER () AS id, h.* FROM h),
fits AS (
  SELECT n.id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.says, length(r.rule)) AS says FROM numbered n JOIN rules r
    ON (n.host = r.rh OR ends_with(n.host, '.' || r.rh)) AND starts_with(n.path, r.rp) GROUP BY n.id),
rows_ AS (
  SELECT n.*, f.rule, f.says, '^^' || regexp_replace(regexp_replace(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[^a-z0/._=%~-]', '*', 'g') || '$' AS t
  FROM numbered n LEFT JOIN fits f ON n.id = f.id),
each AS (SELECT id, says, unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS gram FROM rows_),
g AS (SELECT gram, substring(gram, 1, 1) AS x, substring(gram, 2, 1) AS y, substring(gram, 3, 1) AS z,
  count(*) FILTER (says = 'allow') AS a, count(*) FILTER (says = 'block') AS r FROM each GROUP BY gram),
ratios AS (@RATIOS@),
scored AS (SELECT e.id, sum(q.q) / CAST(count(*) * 1000000 AS DOUBLE) AS score FROM each e JOIN ratios q ON e.gram = q.gram GROUP BY e.id),
judged AS (SELECT r.*, s.score FROM rows_ r JOIN scored s ON r.id = s.id),
m AS (SELECT avg(score) FILTER (says = 'allow') AS ma, stddev_pop(score) FILTER (says = 'allow') AS sa, avg(score) FILTER (says = 'block') AS mr, stddev_pop(score) FILTER (says = 'block') AS sr FROM judged)
SELECT page_id, host, path, rule, coalesce(says, CASE
  WHEN (SELECT mr FROM m) IS NULL THEN 'allow' WHEN (SELECT ma FROM m) IS NULL THEN 'block'
  WHEN score >= (SELECT CASE WHEN sa + sr = 0 THEN (ma + mr) / 2 ELSE (ma * sr + mr * sa) / (sa + sr) END FROM m) THEN 'allow' ELSE 'block' END) AS verdict
FROM judged
""".replace("@RATIOS@", RATIOS.replace("{g}", "g").replace("{v}", str(SYMBOLS)).replace("{m}", str(MILLIONTHS)))
