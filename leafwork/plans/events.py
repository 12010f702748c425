"""Queries on orders, line items and events: the general operators at the largest tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.operators.match import range_join
from leafwork.operators.ordered import asof, pager
from leafwork.sources.tables import table


def last_purchase(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    rows = asof(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_id"), "purchase")
    return rows.where("event_type = 'error'").select("event_id", "purchase")


def event_pager_all(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the user's events before and after."""
    return pager(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_id").select("event_id", "previous", "following")


def quantity_bands(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame([("few", 1.0, 10.0), ("some", 11.0, 30.0), ("many", 31.0, 50.0)], "band string, lo double, hi double")
    lines = table(spark, d, "lineitem").select("l_quantity", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    return range_join(lines, bands, "l_quantity", "lo", "hi", 10).groupBy("band").agg(F.count(F.lit(1)).alias("lines"), F.sum("price").cast("decimal(38,2)").alias("total"))


def priced_lines(spark: SparkSession, d: str) -> DataFrame:
    money = lambda c: F.col(c).cast("decimal(18,2)")
    t = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum(money("l_quantity")).cast("decimal(38,2)").alias("quantity"), F.sum(money("l_extendedprice")).cast("decimal(38,2)").alias("price"), F.count(F.lit(1)).alias("lines"))


def orders_by_nation(spark: SparkSession, d: str) -> DataFrame:
    o, c, n, r = (table(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == n["n_nationkey"]).join(r, F.col("n_regionkey") == r["r_regionkey"])
    return rows.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderdate").alias("latest"))


def part_types(spark: SparkSession, d: str) -> DataFrame:
    p, li = table(spark, d, "part"), table(spark, d, "lineitem")
    used = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("lines"))
    return p.join(used, p["p_partkey"] == used["l_partkey"], "left").groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


QUERIES = {f.__name__: f for f in (last_purchase, event_pager_all, quantity_bands, priced_lines, orders_by_nation, part_types)}
SQL = {
    "last_purchase": "SELECT event_id, purchase FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS purchase FROM events) WHERE event_type = 'error'",
    "event_pager_all": "SELECT event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "quantity_bands": "SELECT band, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM lineitem JOIN (VALUES ('few', 1, 10), ('some', 11, 30), ('many', 31, 50)) b(band, lo, hi) ON l_quantity BETWEEN lo AND hi GROUP BY 1",
    "priced_lines": "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS price, count(*) AS lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "orders_by_nation": "SELECT r_name, n_name, count(*) AS orders, max(o_orderdate) AS latest FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "part_types": "SELECT p_brand, count(*) AS parts, CAST(coalesce(sum(n), 0) AS BIGINT) AS lines FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey GROUP BY 1",
}
