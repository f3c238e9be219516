"""Queries of entity resolution and of event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import resolve as N
from quantloom.plans import base as B
from quantloom.plans.base import query, rounded
from quantloom.streaming import events as E

_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(upper({0}), '\b(LTD|LIMITED|LIMTED)\b', '', 'g'), '[^A-Z0-9& ]', ' ', 'g'), '\s+', ' ', 'g'))"


def named_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier names as files of statements would spell them."""
    name = F.concat(F.initcap(F.regexp_replace("s_name", "#", " no. ")), F.when(F.col("s_suppkey") % 3 == 0, " Ltd.").when(F.col("s_suppkey") % 3 == 1, " LIMITED").otherwise(" & Co"), F.when(F.col("s_suppkey") % 7 == 0, " (1)").otherwise(""))
    return B.table(spark, sf, "supplier").select("s_suppkey", "s_name", name.alias("name"))


_NAMES = "SELECT s_suppkey, s_name, array_to_string(list_transform(string_split(lower(regexp_replace(s_name, '#', ' no. ', 'g')), ' '), lambda x: upper(x[1]) || x[2:]), ' ') || CASE WHEN s_suppkey % 3 = 0 THEN ' Ltd.' WHEN s_suppkey % 3 = 1 THEN ' LIMITED' ELSE ' & Co' END || CASE WHEN s_suppkey % 7 = 0 THEN ' (1)' ELSE '' END AS name FROM supplier"


@query(f"SELECT s_suppkey, trim(regexp_replace(name, '\\s*\\(\\d+\\)\\s*$', '')) AS stem, {_NORM.format('name')} AS normal FROM ({_NAMES})")
def name_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return named_suppliers(spark, sf).select("s_suppkey", N.without_copy_suffix("name").alias("stem"), N.normalized_name("name").alias("normal"))


@query()
def fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    """Misspelled names against the names of nations: a short reference list."""
    reference = B.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("symbol"), F.col("n_name").alias("company_name"), F.col("n_nationkey").alias("ord"))
    names = B.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.concat(F.lower(F.expr("substring(n_name, 1, length(n_name) - 1)")), F.when(F.col("n_nationkey") % 2 == 0, " Ltd").otherwise(" & Co")).alias("company_name"))
    return N.fuzzy_match(names, reference)


_FILES = "SELECT s_suppkey AS k, 'supplier ' || s_suppkey // 2 || CASE WHEN s_suppkey % 2 = 1 THEN ' (1)' ELSE '' END AS dedup_raw, s_suppkey // 2 AS c FROM supplier"


@query(f"""WITH f AS (SELECT k, dedup_raw || '.xlsx' AS file, 'supplier ' || c AS dedup_key, c FROM ({_FILES})),
    m AS (SELECT *, CASE WHEN c % 10 = 0 THEN NULL WHEN c % 10 = 1 THEN 'S1' ELSE 'S' || c END AS symbol, CASE WHEN c % 10 = 0 THEN 'manual_exclude' WHEN c % 10 = 1 THEN 'override' ELSE 'fuzzy' END AS method FROM f),
    p AS (SELECT *, coalesce(substr(symbol, 2)::INT % 7 <> 0, FALSE) AS in_prices FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY symbol, in_prices ORDER BY k DESC, file) AS rank FROM p)
    SELECT file, dedup_key, symbol, method, in_prices, in_prices AND rank = 1 AS included, CASE WHEN symbol IS NULL THEN 'no symbol' WHEN NOT in_prices THEN 'no prices' WHEN rank > 1 THEN 'older download' ELSE '' END AS reason FROM r""")
def universe_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Two files a company, the second a later download; some companies are overridden, some left out, some unpriced."""
    supplier = B.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.floor(F.col("s_suppkey") / 2).alias("c"))
    stem = F.concat(F.lit("supplier "), F.col("c").cast("string"))
    name = F.concat(F.lit("Supplier No. "), F.col("c").cast("string"), F.when(F.col("k") % 2 == 1, " Ltd.").otherwise(" LIMITED"))
    files = supplier.select(F.concat(stem, F.when(F.col("k") % 2 == 1, " (1)").otherwise(""), F.lit(".xlsx")).alias("file"), F.col("k").cast("double").alias("mtime"), name.alias("company_name"))
    companies = supplier.select("c").distinct()
    reference = companies.select(F.concat(F.lit("S"), F.col("c").cast("string")).alias("symbol"), F.concat(F.lit("SUPPLIER NO "), F.col("c").cast("string")).alias("company_name"), F.col("c").alias("ord"))
    fixed = companies.where("c % 10 < 2").select(F.concat(F.lit("supplier "), F.col("c").cast("string")).alias("dedup_key"), F.when(F.col("c") % 10 == 1, "S1").alias("symbol"))
    priced = reference.where("ord % 7 <> 0").select("symbol")
    out = N.universe_mapping(files, reference, fixed, priced)
    return out.select("file", "dedup_key", "symbol", "method", "in_prices", "included", "reason")


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling windows of a day, by the operator that also runs on a stream."""
    events = B.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(E.windowed(events).select(F.to_date("start").alias("day"), "event_type", "n", "total"), "total", places=4)


@query("SELECT user_id, count(*) AS n, count(DISTINCT session) AS n_sessions FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    events = B.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.sessions(events).groupBy("user_id").agg(F.sum("n").alias("n"), F.count("*").alias("n_sessions"))
