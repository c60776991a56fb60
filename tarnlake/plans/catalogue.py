"""Registered queries: each operator of the library on the star-schema test tables, beside equivalent SQL.

The tables stand in for a bank's: orders are transactions (customer = account), suppliers merchants,
events a card stream. Faults are injected by key, alike in both forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as fx
from ..operators import aggregate, analytics, joins, project, quality, scd, star, windows
from ..sources import catalog
from ..streaming import fraud

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
DEC = "decimal(18,2)"
AS_OF = "2026-01-01 00:00:00"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql.strip()
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dbl(c: str | Column) -> Column:
    return fx.column(c).cast("double")


def total(c: str) -> Column:
    """Exact sum of amounts, as a double."""
    return F.sum(F.col(c).cast(DEC)).cast("double")


def mean(c: str) -> Column:
    return F.sum(F.col(c).cast(DEC)).cast("double") / F.count(c)


# Transactions from orders; every 50th key from 0 to 5 has a fault.
TXN = """txn AS (SELECT o_orderkey AS transaction_id, o_custkey AS account_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
 o_orderpriority AS currency, CASE o_orderstatus WHEN 'F' THEN 'POSTED' WHEN 'O' THEN 'PENDING' ELSE 'REVERSED' END AS status,
 CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS fraud_flag, o_orderdate AS transaction_timestamp FROM orders)"""
DIRTY = """dirty AS (SELECT CASE WHEN o_orderkey % 50 = 4 THEN o_orderkey + 1 ELSE o_orderkey END AS transaction_id,
 CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS account_id,
 CAST(CASE WHEN o_orderkey % 50 = 1 THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18,2)) AS amount,
 CASE WHEN o_orderkey % 50 = 2 THEN 'XXX' ELSE o_orderpriority END AS currency,
 CASE WHEN o_orderkey % 50 = 3 THEN TIMESTAMP '2027-02-04 00:00:00' ELSE o_orderdate END AS transaction_timestamp,
 CASE WHEN o_orderkey % 50 = 5 THEN NULL ELSE o_orderstatus END AS status FROM orders)"""
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def txn(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "POSTED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("REVERSED")
    return t(spark, sf, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_totalprice").cast(DEC).alias("amount"),
        F.col("o_orderpriority").alias("currency"),
        status.alias("status"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("fraud_flag"),
        F.col("o_orderdate").alias("transaction_timestamp"),
    )


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 50
    return t(spark, sf, "orders").select(
        F.when(k == 4, F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey")).alias("transaction_id"),
        F.when(k != 0, F.col("o_custkey")).alias("account_id"),
        F.when(k == 1, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).cast(DEC).alias("amount"),
        F.when(k == 2, "XXX").otherwise(F.col("o_orderpriority")).alias("currency"),
        F.when(k == 3, F.lit("2027-02-04 00:00:00").cast("timestamp_ntz")).otherwise(F.col("o_orderdate")).alias("transaction_timestamp"),
        F.when(k != 5, F.col("o_orderstatus")).alias("status"),
    )


def customers(spark: SparkSession, sf: str) -> DataFrame:
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    return t(spark, sf, "customer").join(n, "c_nationkey").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"), "country")


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 2 == 0, "CHECKING").otherwise("SAVINGS")
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_custkey").alias("customer_id"), kind.alias("account_type"))


# --- projections, filters, scalars ------------------------------------------------------------


@query(f"WITH {TXN} SELECT transaction_id, account_id, CAST(amount AS DOUBLE) AS amount, status FROM txn WHERE account_id IS NOT NULL AND amount > 1000 AND status <> 'REVERSED'")
def filter_valid(spark, sf):
    return project.filter_valid(txn(spark, sf), 1000).select("transaction_id", "account_id", dbl("amount").alias("amount"), "status")


@query("SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment FROM customer")
def select_rename(spark, sf):
    d = project.rename_columns(t(spark, sf, "customer"), {"c_custkey": "customer_id", "c_name": "name", "c_mktsegment": "segment", "nope": "x"})
    return project.select_columns(d, ["customer_id", "name", "segment"])


@query("""SELECT event_id, TRY_CAST(event_type AS INTEGER) AS bad_int, TRY_CAST(event_type AS DECIMAL(18,2)) IS NULL AS bad_decimal,
 CAST(value AS DECIMAL(18,2))::DOUBLE AS amount, CAST(ts AS DATE) AS day FROM events""")
def cast_try(spark, sf):
    d = t(spark, sf, "events").withColumns({"bad_int": F.col("event_type"), "bad_decimal": F.col("event_type"), "amount": F.col("value").cast("string"), "day": F.col("ts")})
    d = project.cast_types(d, {"bad_int": "int", "bad_decimal": "decimal", "amount": "decimal", "day": "date", "absent": "int"})
    return d.select("event_id", "bad_int", F.col("bad_decimal").isNull().alias("bad_decimal"), dbl("amount").alias("amount"), "day")


@query(f"WITH {DIRTY} SELECT transaction_id, account_id, status FROM dirty WHERE account_id IS NOT NULL AND status IS NOT NULL")
def drop_null_rows(spark, sf):
    return project.drop_null_rows(dirty(spark, sf), ["account_id", "status"]).select("transaction_id", "account_id", "status")


@query(f"WITH {DIRTY} SELECT transaction_id, COALESCE(account_id, -1) AS account_id, COALESCE(status, 'UNKNOWN') AS status FROM dirty")
def fill_nulls(spark, sf):
    return project.fill_nulls(dirty(spark, sf), {"account_id": -1, "status": "UNKNOWN"}).select("transaction_id", "account_id", "status")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'REVIEW' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def conditional_default(spark, sf):
    return project.conditional_default(t(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", "P", "REVIEW").select("o_orderkey", "o_orderpriority")


@query("SELECT event_id, CASE WHEN value >= 200 THEN 'HIGH' WHEN value >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM events")
def amount_band(spark, sf):
    return t(spark, sf, "events").select("event_id", fx.amount_band("value", 200, 50).alias("band"))


@query("""SELECT l_orderkey, l_linenumber, COALESCE(NULLIF(l_returnflag, 'N'), 'none') AS flag,
 CAST(l_extendedprice / NULLIF(l_linenumber - 1, 0) AS DOUBLE) AS ratio FROM lineitem""")
def coalesce_nullif(spark, sf):
    flag = F.coalesce(F.nullif(F.col("l_returnflag"), F.lit("N")), F.lit("none"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", flag.alias("flag"), fx.safe_ratio("l_extendedprice", F.col("l_linenumber") - 1).alias("ratio"))


@query("SELECT p_partkey, CAST(ROUND(CAST(p_size * 7 AS DECIMAL(18,2)) / 100, 2) AS DOUBLE) AS price FROM part")
def cents_to_currency(spark, sf):
    return t(spark, sf, "part").select("p_partkey", dbl(fx.cents_to_currency(F.col("p_size") * 7)).alias("price"))


@query(f"WITH {DIRTY} SELECT transaction_id, upper(currency) AS currency, CAST(amount AS DOUBLE) AS amount, transaction_timestamp AS transaction_ts FROM dirty WHERE account_id IS NOT NULL AND amount >= 0")
def staging_transactions(spark, sf):
    d = dirty(spark, sf).where("account_id IS NOT NULL AND amount >= 0")
    return d.select("transaction_id", F.upper("currency").alias("currency"), dbl("amount").alias("amount"), F.col("transaction_timestamp").alias("transaction_ts"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day FROM orders")
def date_partitions(spark, sf):
    return project.with_date_parts(t(spark, sf, "orders"), "o_orderdate", day=True).select("o_orderkey", "year", "month", "day")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def in_vocabulary(spark, sf):
    return t(spark, sf, "orders").where(project.in_vocabulary("o_orderpriority", ["1-URGENT", "5-LOW"])).select("o_orderkey", "o_orderpriority")


@query("""SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
 CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2026-01-01') AS INTEGER) AS age_days, CAST(o_orderdate AS DATE) - 90 AS cutoff,
 CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key, dayname(o_orderdate) AS weekday FROM orders""")
def date_functions(spark, sf):
    d = F.to_date("o_orderdate")
    return t(spark, sf, "orders").select(
        "o_orderkey",
        F.trunc(d, "month").alias("month_start"),
        F.quarter(d).alias("quarter"),
        F.datediff(F.lit("2026-01-01").cast("date"), d).alias("age_days"),
        F.date_sub(d, 90).alias("cutoff"),
        fx.date_key("o_orderdate").alias("date_key"),
        F.date_format(d, "EEEE").alias("weekday"),
    )


@query("""SELECT c_custkey, upper(c_name) AS upper_name, trim(concat('  ', c_name, ' ')) AS trimmed, substr(c_name, 1, 4) AS head,
 md5(c_name) AS digest, c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS tag FROM customer""")
def string_functions(spark, sf):
    return t(spark, sf, "customer").select(
        "c_custkey",
        F.upper("c_name").alias("upper_name"),
        F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("trimmed"),
        F.substring("c_name", 1, 4).alias("head"),
        F.md5(F.col("c_name").cast("binary")).alias("digest"),
        F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string")).alias("tag"),
    )


@query("""SELECT c_custkey, regexp_full_match(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE replace(c_name, '#', '@') || '.org' END, '[^@]+@[^@]+\\.[^@]+') AS is_email FROM customer""")
def regexp_match(spark, sf):
    mail = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat(F.replace("c_name", F.lit("#"), F.lit("@")), F.lit(".org")))
    return t(spark, sf, "customer").select("c_custkey", fx.email_is_valid(mail).alias("is_email"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_flatten(spark, sf):
    d = t(spark, sf, "events").select("event_id", F.from_json("props", "k int").alias("props"))
    return project.flatten(d, "_").withColumnRenamed("props_k", "k")


# --- joins ------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_inner(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    return joins.join(joins.join(t(spark, sf, "orders"), c, "o_custkey"), t(spark, sf, "nation"), "n_nationkey").select("o_orderkey", "c_name", "n_name")


# All lines; every fifth order's have another order's number, so that either side has rows without a partner.
_SOME_LINES = "(SELECT CASE WHEN l_orderkey % 5 = 0 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS o_orderkey, COUNT(*) AS lines FROM lineitem GROUP BY 1)"


def _lines(spark, sf):
    key = _shifted("l_orderkey", F.col("l_orderkey") % 5 == 0)
    return t(spark, sf, "lineitem").groupBy(key.alias("o_orderkey")).agg(F.count("*").alias("lines"))


def _shifted(key: str, where: Column, by: int = 1_000_000_000) -> Column:
    """The key, moved out of all other keys' reach where the condition holds."""
    return F.when(where, F.col(key) + F.lit(by).cast("long")).otherwise(F.col(key))


@query(f"SELECT o_orderkey, o_orderstatus, lines FROM orders LEFT JOIN {_SOME_LINES} USING (o_orderkey)")
def join_left(spark, sf):
    return joins.join(t(spark, sf, "orders"), _lines(spark, sf), "o_orderkey", "left").select("o_orderkey", "o_orderstatus", "lines")


@query(f"SELECT o_orderkey, o_orderstatus, lines FROM orders RIGHT JOIN {_SOME_LINES} USING (o_orderkey)")
def join_right(spark, sf):
    return joins.join(t(spark, sf, "orders"), _lines(spark, sf), "o_orderkey", "right").select("o_orderkey", "o_orderstatus", "lines")


@query(f"SELECT o_orderkey, o_orderstatus, lines FROM orders FULL JOIN {_SOME_LINES} USING (o_orderkey)")
def join_full(spark, sf):
    return joins.join(t(spark, sf, "orders"), _lines(spark, sf), "o_orderkey", "outer").select("o_orderkey", "o_orderstatus", "lines")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def join_semi(spark, sf):
    big = t(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.semi_join(t(spark, sf, "orders"), big, "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark, sf):
    lines = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.anti_join(t(spark, sf, "orders"), lines, "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf):
    return joins.join(t(spark, sf, "region"), t(spark, sf, "nation"), how="cross").select("r_name", "n_name")


@query(f"WITH {DIRTY} SELECT a.transaction_id, b.n FROM dirty a JOIN (SELECT account_id, COUNT(*) AS n FROM dirty GROUP BY 1) b ON a.account_id IS NOT DISTINCT FROM b.account_id")
def join_null_safe(spark, sf):
    d = dirty(spark, sf)
    return joins.join(d, d.groupBy("account_id").agg(F.count("*").alias("n")), "account_id", null_safe=True).select("transaction_id", "n")


_ACC = "acc AS (SELECT c_custkey AS account_id, c_custkey AS customer_id, CASE WHEN c_custkey % 2 = 0 THEN 'CHECKING' ELSE 'SAVINGS' END AS account_type FROM customer)"
_CUST = "cust AS (SELECT c_custkey AS customer_id, c_mktsegment AS segment, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"WITH {DIRTY}, {_ACC}, {_CUST} SELECT transaction_id, account_id, customer_id, account_type, segment, country AS customer_country FROM dirty LEFT JOIN acc USING (account_id) LEFT JOIN cust USING (customer_id)")
def enrich_two_step(spark, sf):
    d = joins.enrich(dirty(spark, sf), accounts(spark, sf), customers(spark, sf), "left")
    return d.select("transaction_id", "account_id", "customer_id", "account_type", "segment", "customer_country")


@query(f"""WITH {TXN}, spend AS (SELECT account_id, CAST(SUM(amount) AS DOUBLE) AS spend FROM txn GROUP BY 1),
 s AS (SELECT c_mktsegment AS segment, account_id, spend FROM spend JOIN customer ON account_id = c_custkey),
 a AS (SELECT segment, CAST(SUM(CAST(spend AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS avg_spend FROM s GROUP BY 1)
 SELECT account_id, segment, spend FROM s JOIN a USING (segment) WHERE spend > avg_spend""")
def above_segment_average(spark, sf):
    spend = txn(spark, sf).groupBy("account_id").agg(total("amount").alias("spend"))
    s = spend.join(t(spark, sf, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_mktsegment").alias("segment")), "account_id")
    return joins.above_group_average(s, "segment", "spend", exact=DEC).select("account_id", "segment", "spend")


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, MAX(o_totalprice) OVER (PARTITION BY o_orderpriority) AS top FROM orders) WHERE o_totalprice > 0.9 * top""")
def theta_filter(spark, sf):
    o = t(spark, sf, "orders")
    top = o.groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("top"))
    return o.join(top, "o_orderpriority").where("o_totalprice > 0.9 * top").select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT o_orderkey, y, m FROM orders CROSS JOIN LATERAL (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m)""")
def lateral_parts(spark, sf):
    t(spark, sf, "orders").createOrReplaceTempView("lateral_orders")
    return spark.sql("SELECT o_orderkey, y, m FROM lateral_orders CROSS JOIN LATERAL (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m)")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey + 1000000000 ELSE s_suppkey END FROM supplier)")
def referential_integrity(spark, sf):
    known = t(spark, sf, "supplier").withColumn("s_suppkey", _shifted("s_suppkey", F.col("s_suppkey") % 4 != 0))
    return joins.missing_parents(t(spark, sf, "lineitem"), known, "l_suppkey", "s_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""WITH d AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS k, c_acctbal AS b, c_mktsegment AS s FROM customer),
 n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS s FROM customer)
 SELECT n.k, n.s FROM n LEFT JOIN d USING (k) WHERE d.k IS NULL OR d.s IS DISTINCT FROM n.s""")
def changed_or_missing(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))
    new = c.withColumn("s", F.when(F.col("k") % 7 != 0, F.col("s")))
    return joins.changed_or_missing(new, c.withColumn("k", _shifted("k", F.col("k") % 5 == 0)), "k", ["s"])


# --- aggregation, top-k, set operations -------------------------------------------------------

_DAILY = """SELECT CAST(transaction_timestamp AS DATE) AS transaction_date, currency, COUNT(transaction_id) AS txn_count, COUNT(DISTINCT account_id) AS distinct_accounts,
 CAST(SUM(amount) AS DOUBLE) AS total_amount, CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS avg_amount, CAST(MIN(amount) AS DOUBLE) AS min_amount,
 CAST(MAX(amount) AS DOUBLE) AS max_amount, CAST(SUM(fraud_flag) AS BIGINT) AS fraud_count FROM txn GROUP BY 1, 2"""


@query(f"WITH {TXN} {_DAILY}")
def daily_summary(spark, sf):
    d = aggregate.daily_summary(txn(spark, sf))
    exact = dbl("total_amount") / F.col("txn_count")
    return d.withColumns({"avg_amount": exact, "total_amount": dbl("total_amount"), "min_amount": dbl("min_amount"), "max_amount": dbl("max_amount")})


@query(f"WITH {TXN} SELECT account_id, CAST(SUM(amount) AS DOUBLE) AS total_spend, COUNT(*) AS n FROM txn GROUP BY 1 ORDER BY total_spend DESC, account_id LIMIT 10")
def top_customers(spark, sf):
    return aggregate.top_k(txn(spark, sf).groupBy("account_id").agg(total("amount").alias("total_spend"), F.count("*").alias("n")), "total_spend", 10, "account_id")


@query("SELECT s_name, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 ORDER BY revenue DESC, s_name LIMIT 20")
def top_merchants(spark, sf):
    # Sums by key meet before names are joined.
    s = t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast(DEC)).alias("r"))
    d = s.join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_name").agg(F.sum("r").cast("double").alias("revenue"))
    return aggregate.top_k(d, "revenue", 20, "s_name")


@query(f"WITH {TXN} SELECT CAST(year(transaction_timestamp) AS INTEGER) AS year, CAST(month(transaction_timestamp) AS INTEGER) AS month, CAST(SUM(amount) AS DOUBLE) AS revenue, COUNT(*) AS n FROM txn GROUP BY 1, 2 ORDER BY 1, 2")
def monthly_revenue(spark, sf):
    return analytics.revenue_by_month(txn(spark, sf))


@query(f"WITH {TXN} SELECT currency AS channel, COUNT(*) AS n, CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS avg_value FROM txn GROUP BY 1")
def avg_by_channel(spark, sf):
    return analytics.average_by(txn(spark, sf).withColumnRenamed("currency", "channel"), "channel")


@query(f"WITH {TXN} SELECT currency, CAST(100.0 AS DOUBLE) * CAST(SUM(fraud_flag) AS DOUBLE) / COUNT(*) AS fraud_rate FROM txn GROUP BY 1")
def fraud_rate(spark, sf):
    return analytics.rate_by(txn(spark, sf), "currency", "fraud_flag", "fraud_rate")


@query(f"WITH {TXN} SELECT account_id, CAST(SUM(amount) AS DOUBLE) AS total, CAST(SUM(amount) AS DOUBLE) / NULLIF(COUNT(DISTINCT month(transaction_timestamp)), 0) AS per_month, CAST(SUM(amount) AS DOUBLE) / NULLIF(COUNT(DISTINCT strftime(transaction_timestamp, '%Y-%m')), 0) AS per_calendar_month FROM txn GROUP BY 1")
def lifetime_value(spark, sf):
    return analytics.lifetime_value(txn(spark, sf))


_CUTOFF = "TIMESTAMP '1998-05-01 00:00:00'"


@query(f"SELECT c_custkey, MAX(o_orderdate) AS last_activity FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING MAX(o_orderdate) IS NULL OR MAX(o_orderdate) < {_CUTOFF}")
def inactive_accounts(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return aggregate.inactive_since(t(spark, sf, "customer"), o, "c_custkey", "o_orderdate", F.lit("1998-05-01 00:00:00").cast("timestamp_ntz")).select("c_custkey", "last_activity")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 400000")
def high_value_transactions(spark, sf):
    return fraud.high_value(t(spark, sf, "orders"), "o_totalprice", 400000).select("o_orderkey", "o_totalprice")


@query(f"WITH {TXN} SELECT account_id, CAST(year(transaction_timestamp) AS INTEGER) AS year, CAST(month(transaction_timestamp) AS INTEGER) AS month, COUNT(*) AS n, CAST(SUM(amount) AS DOUBLE) AS spend, CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS avg_spend, CAST(SUM(fraud_flag) AS BIGINT) AS frauds FROM txn GROUP BY 1, 2, 3")
def customer_monthly_spend(spark, sf):
    return analytics.monthly_spend(txn(spark, sf))


@query("SELECT c_mktsegment AS segment, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def segment_spend(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_mktsegment").alias("segment"))
    return analytics.spend_by_group(txn(spark, sf), c, "account_id", "segment")


@query(f"""WITH {DIRTY} SELECT 'account_id' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT(account_id) AS null_count, COUNT(DISTINCT account_id) AS distinct_count, CAST(MIN(account_id) AS DOUBLE) AS min_value, CAST(MAX(account_id) AS DOUBLE) AS max_value FROM dirty
 UNION ALL SELECT 'status', COUNT(*), COUNT(*) - COUNT(status), COUNT(DISTINCT status), NULL, NULL FROM dirty
 UNION ALL SELECT 'amount', COUNT(*), COUNT(*) - COUNT(amount), COUNT(DISTINCT amount), CAST(MIN(amount) AS DOUBLE), CAST(MAX(amount) AS DOUBLE) FROM dirty""")
def column_profile(spark, sf):
    return aggregate.profile(dirty(spark, sf), ["account_id", "status", "amount"]).select("column_name", "row_count", "null_count", "distinct_count", "min_value", "max_value")


@query(f"SELECT MAX(o_orderdate) AS latest, CAST(date_diff('second', MAX(o_orderdate), TIMESTAMP '{AS_OF}') // 86400 AS BIGINT) AS age_days, date_diff('second', MAX(o_orderdate), TIMESTAMP '{AS_OF}') // 86400 <= 2 AS is_fresh FROM orders")
def freshness(spark, sf):
    return aggregate.freshness(t(spark, sf, "orders"), "o_orderdate", F.lit(AS_OF).cast("timestamp_ntz"), 2)


@query("SELECT MAX(o_orderdate) AS max_ts, MAX(o_orderkey) AS max_id, COUNT(*) AS n FROM orders")
def high_water_mark(spark, sf):
    return t(spark, sf, "orders").agg(F.max("o_orderdate").alias("max_ts"), F.max("o_orderkey").alias("max_id"), F.count("*").alias("n"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, sf):
    return t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT event_type AS level, COUNT(*) AS n FROM events WHERE value > 20 GROUP BY 1 ORDER BY n DESC, level")
def log_counts(spark, sf):
    return catalog.log_counts(t(spark, sf, "events").withColumnRenamed("event_type", "level"), F.col("value") > 20, "level")


def _keys(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), t(spark, sf, "supplier").select((F.col("s_nationkey") + F.when(F.col("s_suppkey") % 3 == 0, 100).otherwise(0)).alias("k"))


_KEYS = ("SELECT c_nationkey AS k FROM customer", "SELECT CAST(s_nationkey + CASE WHEN s_suppkey % 3 = 0 THEN 100 ELSE 0 END AS INTEGER) AS k FROM supplier")


@query(f"{_KEYS[0]} UNION {_KEYS[1]}")
def union_distinct(spark, sf):
    return aggregate.union_distinct(*_keys(spark, sf))


@query(f"{_KEYS[0]} UNION ALL {_KEYS[1]}")
def union_all(spark, sf):
    return aggregate.union_all(*_keys(spark, sf))


@query(f"{_KEYS[0]} INTERSECT {_KEYS[1]}")
def intersect(spark, sf):
    return aggregate.intersect(*_keys(spark, sf))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey + 1000000000 ELSE o_custkey END FROM orders")
def except_distinct(spark, sf):
    return aggregate.except_(t(spark, sf, "customer").select(F.col("c_custkey").alias("k")), t(spark, sf, "orders").select(_shifted("o_custkey", F.col("o_orderkey") % 4 != 0).alias("o_custkey")))


# --- windows ----------------------------------------------------------------------------------

_LI = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate"


@query(f"SELECT {_LI} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS LAST, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS rn FROM lineitem) WHERE rn = 1")
def dedup_latest(spark, sf):
    ties = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return windows.deduplicate(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", ties).select(*_LI.split(", "))


@query(f"SELECT {_LI} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate NULLS LAST, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS rn FROM lineitem) WHERE rn = 1")
def dedup_first(spark, sf):
    ties = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return windows.deduplicate(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", ties, keep="first").select(*_LI.split(", "))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def latest_record(spark, sf):
    return windows.latest_record(t(spark, sf, "orders"), "o_custkey", "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT event_id, RANK() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST) AS rank, DENSE_RANK() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST) AS dense_rank FROM events")
def rank_dense(spark, sf):
    return windows.rank_rows(t(spark, sf, "events"), "user_id", "value").select("event_id", F.col("rank").cast("long").alias("rank"), F.col("dense_rank").cast("long").alias("dense_rank"))


@query("SELECT event_id, LAG(value) OVER w AS previous, LEAD(value) OVER w AS next, CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_lead_running(spark, sf):
    d = windows.neighbours(t(spark, sf, "events").withColumn("value", F.col("value").cast(DEC)), "user_id", "ts", "value", ["event_id"])
    return d.select("event_id", *[dbl(c).alias(c) for c in ("previous", "next", "running_total")])


@query("SELECT event_id, CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS DOUBLE) AS rolling FROM events")
def rolling_7d(spark, sf):
    return windows.rolling_sum(t(spark, sf, "events").withColumn("value", F.col("value").cast(DEC)), "user_id", "ts", "value").select("event_id", dbl("rolling").alias("rolling"))


@query("SELECT event_id, CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '6 days 23 hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW) AS DOUBLE) AS rolling FROM events")
def rolling_7d_left_open(spark, sf):
    return windows.rolling_sum(t(spark, sf, "events").withColumn("value", F.col("value").cast(DEC)), "user_id", "ts", "value", left_open=True).select("event_id", dbl("rolling").alias("rolling"))


@query("SELECT event_id, FIRST_VALUE(value) OVER w AS first_value, LAST_VALUE(value) OVER w AS last_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def first_last(spark, sf):
    return windows.first_last(t(spark, sf, "events"), "user_id", "ts", "value", ["event_id"]).select("event_id", "first_value", "last_value")


@query(f"""WITH {TXN}, s AS (SELECT account_id, CAST(SUM(amount) AS DOUBLE) AS spend FROM txn GROUP BY 1)
 SELECT account_id, PERCENT_RANK() OVER (ORDER BY spend) AS pct_rank, (RANK() OVER (ORDER BY spend) + (COUNT(*) OVER (PARTITION BY spend) - 1) / CAST(2 AS DOUBLE)) / COUNT(*) OVER () AS avg_pct,
 NTILE(4) OVER (ORDER BY spend, account_id) AS quartile FROM s""")
def spending_percentile(spark, sf):
    s = txn(spark, sf).groupBy("account_id").agg(total("amount").alias("spend"))
    return windows.percentiles(s, "spend", "account_id").select("account_id", "pct_rank", "avg_pct", F.col("quartile").cast("long").alias("quartile"))


# --- star schema, dimensions, change data -----------------------------------------------------


@query("SELECT 'CUSTSK_' || substr(sha1(CAST(c_custkey AS VARCHAR)), 1, 12) AS customer_sk, c_custkey AS customer_id, c_mktsegment AS segment FROM customer")
def dim_customer(spark, sf):
    return star.dimension(t(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment")), "customer")


@query(f"WITH {_ACC} SELECT 'ACCSK_' || substr(sha1(CAST(account_id AS VARCHAR)), 1, 12) AS account_sk, account_id, customer_id, account_type FROM acc")
def dim_account(spark, sf):
    return star.dimension(accounts(spark, sf), "account")


@query("SELECT 'CARDSK_' || substr(sha1(CAST(p_partkey AS VARCHAR)), 1, 12) AS card_sk, p_partkey AS card_id, p_type AS card_type FROM part")
def dim_card(spark, sf):
    return star.dimension(t(spark, sf, "part").select(F.col("p_partkey").alias("card_id"), F.col("p_type").alias("card_type")), "card")


@query("SELECT 'MERSK_' || substr(sha1(CAST(s_suppkey AS VARCHAR)), 1, 12) AS merchant_sk, s_suppkey AS merchant_id, s_name AS merchant_name FROM supplier")
def dim_merchant(spark, sf):
    return star.dimension(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("merchant_id"), F.col("s_name").alias("merchant_name")), "merchant")


@query("SELECT 'BRSK_' || substr(sha1(CAST(n_nationkey AS VARCHAR)), 1, 12) AS branch_sk, n_nationkey AS branch_id, n_name AS branch_name FROM nation")
def dim_branch(spark, sf):
    return star.dimension(t(spark, sf, "nation").select(F.col("n_nationkey").alias("branch_id"), F.col("n_name").alias("branch_name")), "branch")


@query("""SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_sk, CAST(d AS DATE) AS date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month,
 CAST(day(d) AS INTEGER) AS day, dayname(d) AS day_of_week FROM (SELECT unnest(generate_series((SELECT MIN(CAST(o_orderdate AS DATE)) FROM orders), (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS d)""")
def dim_date(spark, sf):
    return star.date_dimension(t(spark, sf, "orders"), "o_orderdate")


@query(f"""WITH {DIRTY}, {_ACC} SELECT transaction_id, CASE WHEN a.account_id IS NULL THEN NULL ELSE 'ACCSK_' || substr(sha1(CAST(a.account_id AS VARCHAR)), 1, 12) END AS account_sk,
 CASE WHEN s.s_suppkey IS NULL THEN NULL ELSE 'MERSK_' || substr(sha1(CAST(s.s_suppkey AS VARCHAR)), 1, 12) END AS merchant_sk,
 CAST(strftime(transaction_timestamp, '%Y%m%d') AS INTEGER) AS date_sk, CAST(amount AS DOUBLE) AS amount, currency, d.status
 FROM dirty d LEFT JOIN acc a ON d.account_id = a.account_id LEFT JOIN supplier s ON d.transaction_id % 150 = s.s_suppkey""")
def fact_transaction(spark, sf):
    d = dirty(spark, sf).withColumns({"merchant_id": F.col("transaction_id") % 150, "amount": dbl("amount")})
    return star.transaction_fact(d, dim_account(spark, sf), dim_merchant(spark, sf))


# A batch of changes: every tenth customer moves, as many new ones come.
_CHG = """chg AS (SELECT c_custkey AS customer_id, 'MOVED' AS segment, c_nationkey + 100 AS nation, TIMESTAMP '2025-06-01 00:00:00' AS updated_at FROM customer WHERE c_custkey % 10 = 0
 UNION ALL SELECT c_custkey + 1000000, c_mktsegment, c_nationkey, TIMESTAMP '2025-06-02 00:00:00' FROM customer WHERE c_custkey % 10 = 1
 UNION ALL SELECT c_custkey, c_mktsegment, c_nationkey, TIMESTAMP '2025-06-03 00:00:00' FROM customer WHERE c_custkey % 10 = 2)"""
_BASE = "base AS (SELECT c_custkey AS customer_id, c_mktsegment AS segment, c_nationkey AS nation, TIMESTAMP '2025-01-01 00:00:00' AS updated_at FROM customer)"


def _base(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.lit("2025-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))


def _changes(spark, sf):
    b, at = _base(spark, sf), lambda d: F.lit(f"2025-06-0{d} 00:00:00").cast("timestamp_ntz")
    k = F.col("customer_id") % 10
    moved = b.where(k == 0).withColumns({"segment": F.lit("MOVED"), "nation": F.col("nation") + 100, "updated_at": at(1)})
    new = b.where(k == 1).withColumns({"customer_id": F.col("customer_id") + 1000000, "updated_at": at(2)})
    return moved.unionByName(new).unionByName(b.where(k == 2).withColumn("updated_at", at(3)))


@query(f"""WITH {_BASE}, {_CHG} SELECT customer_id, COALESCE(c.segment, b.segment) AS segment, COALESCE(b.nation, c.nation) AS nation FROM base b FULL JOIN chg c USING (customer_id)""")
def scd1_upsert(spark, sf):
    return scd.scd_type_1(_base(spark, sf), _changes(spark, sf), "customer_id", ["segment"]).select("customer_id", "segment", "nation")


_VERSION_OUT = ["surrogate_key", "customer_id", "segment", "nation", "effective_from", "effective_to", "is_current"]
_SK = "substr(sha1(CAST({k} AS VARCHAR) || '|' || strftime({ts}, '%Y-%m-%d %H:%M:%S')), 1, 16)"
_HIGH = "TIMESTAMP '9999-12-31 00:00:00'"


@query(f"WITH {_BASE} SELECT {_SK.format(k='customer_id', ts='updated_at')} AS surrogate_key, customer_id, segment, nation, updated_at AS effective_from, {_HIGH} AS effective_to, TRUE AS is_current FROM base")
def scd2_initial(spark, sf):
    return scd.scd_type_2(None, _base(spark, sf), "customer_id", ["segment", "nation"]).select(*_VERSION_OUT)


_SCD2 = f"""j AS (SELECT b.customer_id AS bk, b.segment AS bs, b.nation AS bn, b.updated_at AS bt, c.customer_id AS ck, c.segment AS cs, c.nation AS cn, c.updated_at AS ct,
 b.customer_id IS NOT NULL AND c.customer_id IS NOT NULL AND (b.segment IS DISTINCT FROM c.segment OR b.nation IS DISTINCT FROM c.nation) AS changed FROM base b FULL JOIN chg c ON b.customer_id = c.customer_id),
 ver AS (SELECT {_SK.format(k='bk', ts='bt')} AS surrogate_key, bk AS customer_id, bs AS segment, bn AS nation, bt AS effective_from, CASE WHEN changed THEN ct ELSE {_HIGH} END AS effective_to, NOT changed AS is_current FROM j WHERE bk IS NOT NULL
 UNION ALL SELECT {_SK.format(k='ck', ts='ct')}, ck, cs, cn, ct, {_HIGH}, TRUE FROM j WHERE bk IS NULL OR changed)"""


@query(f"WITH {_BASE}, {_CHG}, {_SCD2} SELECT * FROM ver")
def scd2_merge(spark, sf):
    return scd.scd_type_2(scd.scd_type_2(None, _base(spark, sf), "customer_id", ["segment", "nation"]), _changes(spark, sf), "customer_id", ["segment", "nation"]).select(*_VERSION_OUT)


@query(f"WITH {_BASE}, {_CHG}, {_SCD2} SELECT surrogate_key, customer_id, segment, nation, effective_from, CASE WHEN is_current AND customer_id NOT IN (SELECT customer_id FROM chg) THEN TIMESTAMP '{AS_OF}' ELSE effective_to END AS effective_to, is_current AND customer_id IN (SELECT customer_id FROM chg) AS is_current FROM ver")
def snapshot_hard_deletes(spark, sf):
    base = scd.scd_type_2(None, _base(spark, sf), "customer_id", ["segment", "nation"])
    return scd.scd_type_2(base, _changes(spark, sf), "customer_id", ["segment", "nation"], as_of=F.lit(AS_OF).cast("timestamp_ntz"), close_missing=True).select(*_VERSION_OUT)


@query(f"WITH {_BASE}, {_CHG}, {_SCD2} SELECT f.k AS probe_id, v.segment, v.nation FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2025-03-01 00:00:00' ELSE TIMESTAMP '2025-07-01 00:00:00' END AS at FROM customer) f JOIN ver v ON f.k = v.customer_id AND f.at >= v.effective_from AND f.at < v.effective_to")
def scd2_as_of(spark, sf):
    at = F.when(F.col("c_custkey") % 2 == 0, F.lit("2025-03-01 00:00:00").cast("timestamp_ntz")).otherwise(F.lit("2025-07-01 00:00:00").cast("timestamp_ntz"))
    probes = t(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), at.alias("at"))
    return joins.valid_at(probes, scd2_merge(spark, sf), "customer_id", "at").select(F.col("customer_id").alias("probe_id"), "segment", "nation")


@query("""WITH e AS (SELECT user_id, event_type, ts, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
 k AS (SELECT * FROM e WHERE before IS DISTINCT FROM event_type)
 SELECT user_id, event_type, ts AS effective_from, LEAD(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next_from FROM k""")
def scd2_history(spark, sf):
    d = scd.scd_type_2_history(t(spark, sf, "events"), "user_id", ["event_type"], "ts", ["event_id"])
    return d.select("user_id", "event_type", "effective_from", F.when(~F.col("is_current"), F.col("effective_to")).alias("next_from"))


@query("""WITH s AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS amount FROM orders),
 n AS (SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS o_orderkey, CAST(-1 AS BIGINT) AS o_custkey, 'X' AS o_orderstatus, CAST(o_totalprice AS DOUBLE) + 1 AS amount FROM orders)
 SELECT o_orderkey, COALESCE(s.o_custkey, n.o_custkey) AS o_custkey, COALESCE(n.o_orderstatus, s.o_orderstatus) AS o_orderstatus, COALESCE(n.amount, s.amount) AS amount FROM s FULL JOIN n USING (o_orderkey)""")
def merge_upsert(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").alias("amount"))
    new = o.withColumns({"o_orderkey": _shifted("o_orderkey", F.col("o_orderkey") % 3 != 0), "o_custkey": F.lit(-1).cast("long"), "o_orderstatus": F.lit("X"), "amount": F.col("amount") + 1})
    return scd.upsert(o, new, ["o_orderkey"], ["o_orderstatus", "amount"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) UNION ALL SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END, 'X' FROM orders")
def delete_insert(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return scd.delete_insert(o, o.withColumns({"o_orderkey": _shifted("o_orderkey", F.col("o_orderkey") % 3 != 0), "o_orderstatus": F.lit("X")}), ["o_orderkey"])


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > (SELECT MAX(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-01 00:00:00')")
def incremental_since_watermark(spark, sf):
    from ..sources.tables import since

    o = t(spark, sf, "orders")
    mark = o.where("o_orderdate < TIMESTAMP_NTZ'1997-06-01 00:00:00'").agg(F.max("o_orderdate").alias("m")).first()["m"]
    return since(o, "o_orderdate", mark).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 5000")
def incremental_by_id(spark, sf):
    from ..sources.tables import since

    return since(t(spark, sf, "orders"), "o_orderkey", 5000).select("o_orderkey", "o_totalprice")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'UPDATED2' WHEN c_custkey % 4 = 2 THEN 'UPDATED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 4 <> 3
 UNION ALL SELECT c_custkey + 1000000, c_mktsegment FROM customer WHERE c_custkey % 4 = 0""")
def cdc_latest_state(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")

    def events(rows, op, minute, **values):
        image = F.struct(*[values.get(n, F.col(n)).alias(n) for n in c.columns])
        key = values.get("c_custkey", F.col("c_custkey"))
        return rows.select(F.lit(op).alias("operation"), key.alias("primary_key"), image.alias("after_image"), F.lit(f"2025-01-01 00:0{minute}:00").cast("timestamp").alias("timestamp"), F.lit(minute).alias("seq"))

    k = F.col("c_custkey") % 4
    log = [events(c.where(k == 1), "UPDATE", 1, c_mktsegment=F.lit("UPDATED")), events(c.where(k == 1), "UPDATE", 2, c_mktsegment=F.lit("UPDATED2")), events(c.where(k == 2), "UPDATE", 1, c_mktsegment=F.lit("UPDATED"))]
    log += [events(c.where(k == 0), "INSERT", 3, c_custkey=F.col("c_custkey") + 1000000), events(c.where(k == 3), "UPDATE", 1, c_mktsegment=F.lit("GONE")), events(c.where(k == 3), "DELETE", 4)]
    out = log[0]
    for e in log[1:]:
        out = out.unionByName(e)
    return scd.replay(c, out, "c_custkey", ["seq"])


# --- data quality -----------------------------------------------------------------------------


def _rules():
    return quality.transaction_rules(F.lit(AS_OF).cast("timestamp_ntz"), currencies=PRIORITIES, statuses=("F", "O", "P"))


_OK = {
    "account_id_not_null": "account_id IS NOT NULL",
    "amount_non_negative": "COALESCE(amount >= 0, FALSE)",
    "currency_valid": "COALESCE(currency IN ({}), FALSE)".format(", ".join(f"'{p}'" for p in PRIORITIES)),
    "timestamp_not_future": f"COALESCE(transaction_timestamp <= TIMESTAMP '{AS_OF}', FALSE)",
    "status_valid": "COALESCE(status IN ('F', 'O', 'P'), FALSE)",
}
_ALL_OK = " AND ".join(_OK.values())
_REASON = "concat_ws(';', {})".format(", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in _OK.items()))


@query(
    f"WITH {DIRTY} SELECT 'transaction_id_unique' AS check_name, 'critical' AS severity, CASE WHEN COUNT(*) = COUNT(DISTINCT transaction_id) THEN 0 ELSE COUNT(*) END AS failed_rows, COUNT(*) AS total_rows, COUNT(*) = COUNT(DISTINCT transaction_id) AS passed FROM dirty"
    + "".join(f" UNION ALL SELECT '{n}', '{'warn' if n == 'status_valid' else 'critical'}', COUNT(*) FILTER (WHERE NOT ({c})), COUNT(*), COUNT(*) FILTER (WHERE NOT ({c})) = 0 FROM dirty" for n, c in _OK.items())
)
def dq_report(spark, sf):
    return quality.checks(dirty(spark, sf), _rules())


@query(f"WITH {DIRTY} SELECT transaction_id, {_REASON} AS reasons FROM dirty WHERE NOT ({_ALL_OK})")
def dq_reasons(spark, sf):
    return quality.split(dirty(spark, sf), _rules())[1].select("transaction_id", F.col("_dq_reason").alias("reasons"))


@query(f"WITH {DIRTY} SELECT CASE WHEN {_ALL_OK} THEN 'good' ELSE 'bad' END AS side, COUNT(*) AS n FROM dirty GROUP BY 1")
def quarantine_split(spark, sf):
    good, bad = quality.split(dirty(spark, sf), _rules())
    return good.select(F.lit("good").alias("side")).unionByName(bad.select(F.lit("bad").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


@query("""SELECT 'email_present' AS check_name, COUNT(*) FILTER (WHERE c_custkey % 9 = 0) AS failed_rows, COUNT(*) FILTER (WHERE c_custkey % 9 = 0) = 0 AS passed FROM customer
 UNION ALL SELECT 'first_name_present', COUNT(*) FILTER (WHERE c_custkey % 11 IN (0, 1)), COUNT(*) FILTER (WHERE c_custkey % 11 IN (0, 1)) = 0 FROM customer
 UNION ALL SELECT 'customer_id_unique', 0, TRUE FROM customer HAVING COUNT(*) = COUNT(DISTINCT c_custkey)""")
def dq_customers(spark, sf):
    k = F.col("c_custkey")
    d = t(spark, sf, "customer").select(k.alias("customer_id"), F.when(k % 9 != 0, F.col("c_name")).alias("email"), F.when(k % 11 == 1, "").when(k % 11 != 0, F.col("c_name")).alias("first_name"))
    return quality.checks(d, quality.customer_rules()).select("check_name", "failed_rows", "passed")


@query("""SELECT 'o_custkey_exists' AS check_name, (SELECT COUNT(*) FROM orders WHERE o_custkey NOT IN (SELECT CASE WHEN c_custkey % 20 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END FROM customer)) AS failed_rows
 UNION ALL SELECT 'o_orderstatus_accepted', (SELECT COUNT(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')) UNION ALL SELECT 'o_orderkey_not_null', 0""")
def dq_schema_tests(spark, sf):
    d, rule = quality.referential_integrity(t(spark, sf, "orders"), t(spark, sf, "customer").withColumn("c_custkey", _shifted("c_custkey", F.col("c_custkey") % 20 == 0)), "o_custkey", "c_custkey")
    return quality.checks(d, [rule, quality.accepted_values("o_orderstatus", ["F", "O"]), quality.not_null("o_orderkey")]).select("check_name", "failed_rows")


@query(f"WITH {DIRTY} SELECT transaction_id, transaction_timestamp FROM dirty WHERE transaction_timestamp > TIMESTAMP '{AS_OF}'")
def dq_future_rows(spark, sf):
    return dirty(spark, sf).where(F.col("transaction_timestamp") > F.lit(AS_OF).cast("timestamp_ntz")).select("transaction_id", "transaction_timestamp")


# --- streaming rules in batch form ------------------------------------------------------------


@query("SELECT event_id, 'HIGH_VALUE' AS rule FROM events WHERE value >= 200")
def fraud_high_value(spark, sf):
    return fraud.high_value(t(spark, sf, "events"), "value", 200).select("event_id", F.lit("HIGH_VALUE").alias("rule"))


@query("SELECT event_id, n AS events_in_window FROM (SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 21600 SECOND PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 3")
def fraud_velocity(spark, sf):
    return fraud.velocity(t(spark, sf, "events"), "user_id", "ts", 21600, 3).select("event_id", "events_in_window")


_GEO = "geo(i, city, lat, lon) AS (VALUES " + ", ".join(f"({i}, '{c}', {v[0]}::DOUBLE, {v[1]}::DOUBLE)" for i, (c, v) in enumerate(fx.CITIES.items())) + ")"


@query(f"""WITH {_GEO}, e AS (SELECT event_id, user_id, ts, city, lat, lon, LAG(ts) OVER w AS t0, LAG(city) OVER w AS previous_city, LAG(lat) OVER w AS lat0, LAG(lon) OVER w AS lon0
 FROM events JOIN geo ON event_id % 10 = i WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 d AS (SELECT *, {2 * fx.EARTH_RADIUS_KM} * asin(sqrt(pow(sin((radians(lat) - radians(lat0)) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(lon0)) / 2), 2))) AS km FROM e WHERE t0 IS NOT NULL)
 SELECT event_id, previous_city, city FROM d WHERE ts > t0 AND km / (epoch(ts - t0) / 3600) > 900""")
def fraud_impossible_travel(spark, sf):
    names = F.array(*[F.lit(c) for c in fx.CITIES])
    d = t(spark, sf, "events").withColumn("city", F.get(names, (F.col("event_id") % 10).cast("int")))
    return fraud.impossible_travel(d, "user_id", "ts", "city").select("event_id", "previous_city", "city")


_ARRIVAL = "(event_id + CASE WHEN event_id % 13 = 0 THEN 500 ELSE 0 END) * 10 + event_id % 10"


@query(f"SELECT event_id FROM (SELECT event_id, ts, MAX(ts) OVER (PARTITION BY user_id ORDER BY {_ARRIVAL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) WHERE ts < seen")
def late_events(spark, sf):
    return fraud.late_events(t(spark, sf, "events").withColumn("arrival", F.expr(_ARRIVAL)), "user_id", "ts", "arrival").select("event_id")


@query("SELECT DISTINCT event_id // 2 AS id FROM events")
def stream_dedup(spark, sf):
    d = t(spark, sf, "events").select(F.expr("event_id div 2").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return fraud.drop_duplicates(d, "id", within=None, ts="ts").select("id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, COUNT(*) AS events, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf):
    d = t(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("timestamp"), "event_type", F.col("value").cast(DEC).alias("amount"))
    out = fraud.windowed_counts(d, "timestamp", "1 hour", None, "10 minutes", "event_type")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", dbl("amount").alias("amount"))


@query("SELECT rule, COUNT(*) AS n FROM (SELECT 'HIGH_VALUE' AS rule FROM events WHERE value >= 200 UNION ALL SELECT 'VELOCITY' FROM (SELECT COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 21600 SECOND PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 3) GROUP BY 1")
def alerts_by_rule(spark, sf):
    rule = lambda d, name: d.select(F.lit(name).alias("rule"))
    return rule(fraud_high_value(spark, sf), "HIGH_VALUE").unionByName(rule(fraud_velocity(spark, sf), "VELOCITY")).groupBy("rule").agg(F.count("*").alias("n"))
