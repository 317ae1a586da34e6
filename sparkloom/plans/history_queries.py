"""History queries bound to order lines, documents and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.contracts import BASKETS, CHANGES, bind
from sparkloom.functions import scoring
from sparkloom.operators import history


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def line_changes(s: SparkSession, d: str) -> DataFrame:
    """Order lines as changes of parts by suppliers."""
    c = F.col
    return bind(table(s, d, "lineitem"), CHANGES, entity=c("l_partkey"), author=c("l_suppkey"), ts=c("l_shipdate"), lines=c("l_quantity"))


def hotspots(s, d):
    parts = table(s, d, "part").select(F.col("p_partkey").alias("entity"), F.col("p_size").alias("complexity"))
    out = history.hotspots(line_changes(s, d), parts)
    return out.select("entity", F.col("commits").cast("long"), "churn", F.round("weighted", 4).alias("weighted"), F.col("recent").cast("long"), F.col("authors").cast("long"), F.col("complexity").cast("long"), "risk", "category", "top_author", F.round("top_share", 6).alias("top_share"))


def churn_files(s, d):
    out = history.churn(line_changes(s, d), "entity").orderBy(F.desc("churn"), "entity").limit(30)
    return out.select("entity", F.col("commits").cast("long"), "churn", F.col("recent").cast("long"), F.col("authors").cast("long"), F.to_date("first_ts").alias("first_date"), F.to_date("last_ts").alias("last_date"))


def decayed_churn(s, d):
    return history.churn(line_changes(s, d).withColumn("entity", F.col("author")), "entity").select(F.col("entity").alias("supplier"), "churn", F.round("weighted", 4).alias("weighted"))


def recent_activity(s, d):
    rows = history.with_now(line_changes(s, d))
    return rows.where(F.col("ts") >= F.col("now") - F.expr(f"INTERVAL {scoring.RECENT_DAYS} DAYS")).groupBy("entity").agg(F.count("*").alias("recent"), F.sum("lines").alias("lines"))


def contributors(s, d):
    return history.contributors(line_changes(s, d)).select("author", "lines", F.col("commits").cast("long"), F.to_date("last_ts").alias("last_date"), F.round("share", 6).alias("share"))


def bus_factor_repo(s, d):
    per = history.contributions(line_changes(s, d).withColumn("entity", F.lit("all")), "entity")
    return history.bus_factor(per, "entity")


def bus_factor_by_entity(s, d):
    return history.bus_factor(history.contributions(line_changes(s, d), "entity"), "entity")


def knowledge_risk(s, d):
    c = F.col
    rows = bind(table(s, d, "documents"), CHANGES, entity=c("source"), author=c("lang"), ts=F.lit(None).cast("timestamp"), lines=c("n_chars"))
    return history.knowledge_risk(rows, least_share=0.6).select("entity", F.col("commits").cast("long"), F.col("churn").cast("long"), "top_author", F.round("top_share", 6).alias("top_share"))


def change_coupling(s, d):
    rows = bind(table(s, d, "events"), BASKETS, basket=F.concat_ws("|", "user_id", F.to_date("ts").cast("string")), item=F.col("event_type"))
    return _coupling(history.coupling(rows, least_degree=0.3))


def coupling_large(s, d):
    rows = bind(table(s, d, "lineitem"), BASKETS, basket=F.col("l_orderkey"), item=F.col("l_suppkey"))
    return _coupling(history.coupling(rows, least_degree=0.03))


def _coupling(rows):
    return rows.select("a", "b", F.col("co_changes").cast("long"), F.col("na").cast("long"), F.col("nb").cast("long"), F.round("degree", 6).alias("degree"), F.round("jaccard", 6).alias("jaccard"))


NOW = "(SELECT max(l_shipdate) FROM lineitem)"
DECAY = f"power(0.5, greatest(0, (epoch_us({NOW}) - epoch_us(l_shipdate)) / 86400000000.0) / 180.0)"
RECENT = f"l_shipdate >= {NOW} - INTERVAL 90 DAYS"
TOP = """top AS (
  SELECT {k} AS k, author AS top_author, lines / sum(lines) OVER (PARTITION BY {k}) AS top_share,
    row_number() OVER (PARTITION BY {k} ORDER BY lines DESC, author) AS rn FROM per
)"""


def _coupling_sql(rows: str, degree: float) -> str:
    return f"""
WITH r AS (SELECT DISTINCT * FROM ({rows})), n AS (SELECT item, count(*) AS n FROM r GROUP BY item),
ok AS (SELECT basket FROM r GROUP BY basket HAVING count(*) BETWEEN 2 AND 30),
p AS (SELECT x.item AS a, y.item AS b, count(*) AS co_changes FROM r x JOIN r y ON x.basket = y.basket AND x.item < y.item JOIN ok ON ok.basket = x.basket GROUP BY 1, 2),
q AS (SELECT a, b, co_changes, na.n AS na, nb.n AS nb, co_changes::DOUBLE / least(na.n, nb.n) AS degree, co_changes::DOUBLE / (na.n + nb.n - co_changes) AS jaccard
  FROM p JOIN n na ON na.item = a JOIN n nb ON nb.item = b)
SELECT a, b, co_changes, na, nb, round(degree, 6) AS degree, round(jaccard, 6) AS jaccard FROM q
WHERE co_changes >= 3 AND q.degree >= {degree} ORDER BY q.degree DESC, co_changes DESC, a, b LIMIT 30"""


def _bus_sql(per: str) -> str:
    return f"""
WITH per AS ({per}), r AS (
  SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY lines DESC, author) AS k,
    sum(lines) OVER (PARTITION BY entity ORDER BY lines DESC, author ROWS UNBOUNDED PRECEDING) AS upto, sum(lines) OVER (PARTITION BY entity) AS total FROM per)
SELECT entity, coalesce(min(k) FILTER (WHERE total > 0 AND upto >= total * 0.5), 0)::BIGINT AS bus_factor, count(*) AS authors FROM r GROUP BY entity"""


QUERIES = {f.__name__: f for f in (hotspots, churn_files, decayed_churn, recent_activity, contributors, bus_factor_repo, bus_factor_by_entity, knowledge_risk, change_coupling, coupling_large)}
SQL = {
    "hotspots": f"""
WITH churn AS (
  SELECT l_partkey AS entity, count(*) AS commits, sum(l_quantity) AS churn, sum(l_quantity * {DECAY}) AS weighted,
    count(*) FILTER (WHERE {RECENT}) AS recent, count(DISTINCT l_suppkey) AS authors FROM lineitem GROUP BY 1
), per AS (SELECT l_partkey AS entity, l_suppkey AS author, sum(l_quantity) AS lines FROM lineitem GROUP BY 1, 2), {TOP.format(k="entity")},
j AS (
  SELECT churn.*, p_size AS complexity, top_author, top_share, ln(1 + weighted) / ln(1 + (SELECT max(weighted) FROM churn)) * p_size / (SELECT max(p_size) FROM part) AS raw
  FROM churn JOIN part ON p_partkey = entity JOIN top ON k = entity AND rn = 1)
SELECT entity, commits, churn, round(weighted, 4) AS weighted, recent, authors, complexity::BIGINT AS complexity, round(raw * 100, 1) AS risk,
  CASE WHEN raw >= 0.5 THEN 'critical' WHEN raw >= 0.25 THEN 'high' WHEN raw >= 0.1 THEN 'moderate' ELSE 'low' END AS category, top_author, round(top_share, 6) AS top_share
FROM j ORDER BY round(raw * 100, 1) DESC, entity LIMIT 25""",
    "churn_files": f"""
SELECT l_partkey AS entity, count(*) AS commits, sum(l_quantity) AS churn, count(*) FILTER (WHERE {RECENT}) AS recent, count(DISTINCT l_suppkey) AS authors,
  min(l_shipdate)::DATE AS first_date, max(l_shipdate)::DATE AS last_date FROM lineitem GROUP BY 1 ORDER BY churn DESC, entity LIMIT 30""",
    "decayed_churn": f"SELECT l_suppkey AS supplier, sum(l_quantity) AS churn, round(sum(l_quantity * {DECAY}), 4) AS weighted FROM lineitem GROUP BY 1",
    "recent_activity": f"SELECT l_partkey AS entity, count(*) AS recent, sum(l_quantity) AS lines FROM lineitem WHERE {RECENT} GROUP BY 1",
    "contributors": """
SELECT l_suppkey AS author, sum(l_quantity) AS lines, count(*) AS commits, max(l_shipdate)::DATE AS last_date, round(sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 6) AS share
FROM lineitem GROUP BY 1 ORDER BY lines DESC, author LIMIT 15""",
    "bus_factor_repo": _bus_sql("SELECT 'all' AS entity, l_suppkey AS author, sum(l_quantity) AS lines FROM lineitem GROUP BY 1, 2"),
    "bus_factor_by_entity": _bus_sql("SELECT l_partkey AS entity, l_suppkey AS author, sum(l_quantity) AS lines FROM lineitem GROUP BY 1, 2"),
    "knowledge_risk": f"""
WITH per AS (SELECT source AS entity, lang AS author, sum(n_chars) AS lines FROM documents GROUP BY 1, 2), {TOP.format(k="entity")},
c AS (SELECT source AS entity, count(*) AS commits, sum(n_chars)::BIGINT AS churn FROM documents GROUP BY 1)
SELECT entity, commits, churn, top_author, round(top_share, 6) AS top_share FROM c JOIN top ON k = entity AND rn = 1
WHERE commits >= 2 AND top.top_share >= 0.6 ORDER BY top.top_share DESC, churn DESC, entity LIMIT 20""",
    "change_coupling": _coupling_sql("SELECT user_id || '|' || ts::DATE AS basket, event_type AS item FROM events", 0.3),
    "coupling_large": _coupling_sql("SELECT l_orderkey AS basket, l_suppkey AS item FROM lineitem", 0.03),
}
