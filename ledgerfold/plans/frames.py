"""The test tables as the domain's: orders stand for notices, order lines for awards; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nation and region; the two dimensions have a fixed few rows."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "Live").when(F.col("o_orderstatus") == "F", "Closed").otherwise("Cancelled")
    return orders.join(_placed(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("tender_id"), status.alias("status"), F.col("o_orderpriority").alias("method"), F.col("r_name").alias("ministry"), F.col("n_name").alias("procuring_entity"),
        F.col("c_nationkey").cast("string").alias("pe_id"), F.concat(F.lower("c_mktsegment"), F.lit(" supply of "), F.pmod("o_orderkey", F.lit(90)).cast("string"), F.lit(" sets 2024-2025 for "), F.col("c_name")).alias("title"),
        F.lower("c_mktsegment").alias("category"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm").alias("published_at"), F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T000000000000Z")).alias("fetched_at"), F.col("o_totalprice").alias("estimate"),
    )


#: Suppliers that are sent to every task; more are dealt out.
SENT_SUPPLIERS = 100_000


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their supplier."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    supplier = F.broadcast(supplier) if supplier.count() <= SENT_SUPPLIERS else supplier
    return table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer."""
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))


def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lines(spark, sf_dir).join(ordered(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))  # lines are dealt out once
    return joined.select(
        F.col("l_orderkey").cast("string").alias("tender_id"), F.col("l_suppkey").cast("string").alias("bidder_id"), F.col("s_name").alias("awardee"), F.col("c_nationkey").cast("string").alias("pe_id"), F.col("l_returnflag").alias("method"),
        F.col("l_linestatus").alias("district"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("signed_on"), (F.col("l_extendedprice") / 1000).alias("value_crore"), F.col("l_extendedprice").alias("lakh"), (F.col("l_quantity") * 30).alias("security_lakh"),
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("o_totalprice").alias("estimate"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("read_on"),
    )


TENDERS_SQL = """tenders AS (SELECT CAST(o_orderkey AS VARCHAR) AS tender_id, CASE o_orderstatus WHEN 'O' THEN 'Live' WHEN 'F' THEN 'Closed' ELSE 'Cancelled' END AS status, o_orderpriority AS method,
    r_name AS ministry, n_name AS procuring_entity, CAST(c_nationkey AS VARCHAR) AS pe_id, lower(c_mktsegment) || ' supply of ' || CAST(o_orderkey % 90 AS VARCHAR) || ' sets 2024-2025 for ' || c_name AS title,
    lower(c_mktsegment) AS category, strftime(o_orderdate, '%Y-%m-%dT%H:%M') AS published_at, strftime(o_orderdate, '%Y%m%d') || 'T000000000000Z' AS fetched_at, o_totalprice AS estimate
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

AWARDS_SQL = """awards AS (SELECT CAST(l_orderkey AS VARCHAR) AS tender_id, CAST(l_suppkey AS VARCHAR) AS bidder_id, s_name AS awardee, CAST(c_nationkey AS VARCHAR) AS pe_id, l_returnflag AS method,
    l_linestatus AS district, strftime(l_shipdate, '%Y-%m-%d') AS signed_on, l_extendedprice / 1000 AS value_crore, l_extendedprice AS lakh, l_quantity * 30 AS security_lakh,
    l_linenumber AS line, l_partkey AS part, o_totalprice AS estimate, strftime(o_orderdate, '%Y-%m-%d') AS read_on
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""

#: A year before the last award, where tests have no today.
SINCE_SQL = "(SELECT strftime(CAST(max(signed_on) AS DATE) - INTERVAL 365 DAY, '%Y-%m-%d') FROM awards)"


def windowed(awards_: DataFrame, days: int = 365) -> DataFrame:
    """``awards`` with ``since``: so many days before the last award; one row is broadcast."""
    last = awards_.agg(F.date_format(F.date_sub(F.max("signed_on").cast("date"), days), "yyyy-MM-dd").alias("since"))
    return awards_.crossJoin(F.broadcast(last))  # one row
