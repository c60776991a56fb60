"""Registered queries for sources, sinks, the control plane, pipelines and streams.

Each writes what its operator needs into a folder of its own (``session.work_dir``), runs the operator on whole
tables and returns rows that SQL over the same tables gives too.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..control import ControlStore, retry
from ..errors import RetryableError
from ..functions import expressions as fx
from ..operators import aggregate, analytics, quality, scd
from ..session import work_dir
from ..sinks import VersionedTable, create_table_as, create_view, land_raw, quarantine, write_zone
from ..sources import catalog, files
from ..sources.mock_rates import RatesServer, rates
from ..sources.rest import ApiClient, RatesSource
from ..sources.tables import Tables, extract_full
from ..streaming import events as ev
from ..streaming import fraud
from . import run_checks
from .catalogue import DEC, DIRTY, PRIORITIES, TXN, dbl, dirty, t, txn
from .datagen import TABLES, Bank
from .pipelines import Step, Workflow, batch, incremental, land, stream_alerts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql.strip()
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _values(names: str, rows: list[tuple]) -> str:
    """SQL for a few fixed rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS v({names})"


def _literal(v) -> str:
    if isinstance(v, bool):
        return str(v).upper()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS BIGINT)"


# --- sources ----------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def source_table_full(spark, sf):
    return extract_full(Tables(spark, sf), "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def _round_trip(spark, sf, kind: str) -> str:
    """The path of the orders, written in a format."""
    path = f"{work_dir(spark, kind)}/orders.{kind}"
    d = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    writer = d.write.option("header", True) if kind == "csv" else d.write
    (writer.option("rowTag", "order").option("rootTag", "orders") if kind == "xml" else writer).format(kind).save(path)
    return path


_ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders"


def _orders(d: DataFrame) -> DataFrame:
    return d.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), dbl("o_totalprice").alias("o_totalprice"), "o_orderpriority")


@query(_ORDERS)
def source_csv(spark, sf):
    return _orders(files.read_file(spark, _round_trip(spark, sf, "csv")))


@query(_ORDERS)
def source_json_lines(spark, sf):
    return _orders(files.read_json(spark, _round_trip(spark, sf, "json"), lines=True))


@query(_ORDERS)
def source_xml(spark, sf):
    return _orders(files.read_file(spark, _round_trip(spark, sf, "xml"), row_tag="order"))


@query(_ORDERS)
def source_orc(spark, sf):
    return _orders(files.read_file(spark, _round_trip(spark, sf, "orc")))


@query("SELECT n_nationkey AS key, n_name AS name, r_name AS region_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def source_json_document(spark, sf):
    """One document with a list of nested records."""
    d = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = d.select(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.struct(F.col("r_name").alias("name")).alias("region")).alias("r"))
    path = work_dir(spark, "document") + ".json"
    one.agg(F.to_json(F.struct(F.lit("nations").alias("kind"), F.collect_list("r").alias("records")))).coalesce(1).write.text(path)
    return files.read_json(spark, path).select(F.col("key").cast("int").alias("key"), "name", F.col("`region.name`").alias("region_name"))


@query("SELECT n_nationkey, n_name, 'part' || CAST(n_nationkey % 3 AS VARCHAR) AS piece FROM nation")
def ingest_files(spark, sf):
    """A folder swept twice, with a file that lacks a column and an empty one: every good row is landed once."""
    root = work_dir(spark, "ingest")
    store = ControlStore()
    for k in range(3):
        _one_file(t(spark, sf, "nation").where(F.col("n_nationkey") % 3 == k).select("n_nationkey", "n_name"), f"{root}/inbox", f"part{k}.csv")
    _one_file(t(spark, sf, "region").select("r_name"), f"{root}/inbox", "wrong.csv")
    files.put_file(spark, f"{root}/inbox/empty.csv", b"")
    ingestor = files.FileIngestor(spark, root, "nations", ["n_nationkey", "n_name"], store)
    first, second = ingestor.ingest_dir(f"{root}/inbox"), ingestor.ingest_dir(f"{root}/inbox")
    assert first.counts == {"PROCESSED": 3, "QUARANTINED": 2} and second.counts == {"SKIPPED_DUPLICATE": 3, "QUARANTINED": 2}, (first, second)
    d = spark.read.parquet(f"{root}/bronze/nations").where("length(_ingested_checksum) = 64")
    return d.select("n_nationkey", "n_name", F.regexp_replace("_source_file", "[.]csv$", "").alias("piece"))


def _one_file(d: DataFrame, folder: str, name: str) -> None:
    """A small table as one CSV file of the given name."""
    lines = [",".join(d.columns), *(",".join(str(v) for v in r) for r in d.orderBy(*d.columns).collect())]
    files.put_file(d.sparkSession, f"{folder}/{name}", "\n".join(lines).encode())


@query("SELECT r_regionkey, r_name, 'archived' AS state FROM region")
def ingest_inbox(spark, sf):
    root = work_dir(spark, "inbox")
    _one_file(t(spark, sf, "region").select("r_regionkey", "r_name"), f"{root}/in", "regions.csv")
    inbox = files.InboxIngestor(f"{root}/in", f"{root}/archive", files.FileIngestor(spark, root, "regions", ["r_regionkey"], ControlStore()))
    inbox.ingest()
    inbox.ingest()
    there = files.read_csv(spark, f"{root}/archive/regions.csv").select("r_regionkey", F.lit("archived").alias("state"))
    return spark.read.parquet(f"{root}/bronze/regions").select("r_regionkey", "r_name").join(there, "r_regionkey")


@query("SELECT n_nationkey, n_name FROM nation")
def ingest_on_arrival(spark, sf):
    """Files that come into a folder start their own ingestion, once each; an empty one starts nothing."""
    root, seen = work_dir(spark, "arrival"), []
    ingestor = files.FileIngestor(spark, root, "nations", ["n_nationkey"], ControlStore())
    for k in range(2):
        _one_file(t(spark, sf, "nation").where(F.col("n_nationkey") % 2 == k).select("n_nationkey", "n_name"), f"{root}/in", f"part{k}.csv")
        files.put_file(spark, f"{root}/in/empty{k}.csv", b"")
        files.watch(spark, f"{root}/in", f"{root}/checkpoint", lambda path: seen.append(ingestor.ingest_file(path).status)).awaitTermination()
    assert seen == ["PROCESSED"] * 2, seen
    return spark.read.parquet(f"{root}/bronze/nations").select("n_nationkey", "n_name")


_RATES = "SELECT id, quote, rate FROM (SELECT CAST(i AS INTEGER) AS id, ['EUR', 'GBP', 'JPY', 'AUD', 'CAD', 'CHF', 'INR', 'SGD'][1 + i % 8] AS quote, CAST(round(0.5 + i / 100, 4) AS DOUBLE) AS rate FROM range(80) AS r(i))"


@query(f"{_RATES} WHERE id > 20")
def source_rest(spark, sf):
    """Pages of an API that fails now and then, from a time on; the rows are landed raw and read back."""
    with RatesServer(rates(), "token", fault_every=3) as url:
        client = ApiClient(url, "token", page_size=25, base_delay=0)
        client.post_log({"rows": 59})
        path = land_raw(spark, list(client.pages("2025-01-01T20:00:00")), work_dir(spark, "rest"), "rates", "2025-01-05")
    d = spark.read.json(path).select(F.explode("data").alias("r")).select("r.*")
    return d.select(F.col("id").cast("int").alias("id"), "quote", "rate")


@query(_RATES)
def source_rest_partitions(spark, sf):
    """The paged API as a Spark data source; collected here, as the server ends with the query."""
    spark.dataSource.register(RatesSource)
    with RatesServer() as url:
        d = spark.read.format("rates").options(url=url, token="token", pageSize="15", baseDelay="0").load()
        path = work_dir(spark, "rates")
        d.write.parquet(path)
    return spark.read.parquet(path).select("id", "quote", "rate")


def _fresh(spark: SparkSession, name: str) -> str:
    """A table name of this application that no table has."""
    name = f"{name}_{re.sub('[^A-Za-z0-9]', '_', spark.sparkContext.applicationId)}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return name


@query("SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY 1")
def source_external_table(spark, sf):
    """A table over files that are there already; a partition that comes later is found by a repair."""
    path = work_dir(spark, "external")
    d = t(spark, sf, "nation")
    d.where("n_regionkey < 4").write.partitionBy("n_regionkey").parquet(path)
    name = _fresh(spark, "tarnlake_external")
    catalog.register_external(spark, name, path, "n_nationkey INT, n_name STRING, n_regionkey INT", ["n_regionkey"])
    d.where("n_regionkey >= 4").write.mode("append").partitionBy("n_regionkey").parquet(path)
    catalog.repair(spark, name)
    return spark.table(name).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def sink_bulk_load(spark, sf):
    """Files with columns in another order into a table, twice; with statistics."""
    path, d = work_dir(spark, "bulk"), t(spark, sf, "region")
    d.select("r_name", "r_regionkey").write.parquet(path)
    name = _fresh(spark, "tarnlake_bulk")
    create_table_as(d.select("r_regionkey", "r_name").limit(0), name)
    catalog.copy_into(spark, name, path)
    catalog.copy_into(spark, name, path)
    catalog.analyze(spark, name, ["r_regionkey"])
    return spark.table(name)


@query("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def source_seed(spark, sf):
    """A reference table from CSV, as a view that SQL reads."""
    root = work_dir(spark, "seed")
    _one_file(t(spark, sf, "region").select("r_regionkey", "r_name"), root, "regions.csv")
    catalog.seed(spark, f"{root}/regions.csv", "r_regionkey INT, r_name STRING", "tarnlake_regions")
    create_view(t(spark, sf, "nation"), "tarnlake_nations")
    return spark.sql("SELECT n_name AS name, r_name AS region FROM tarnlake_nations JOIN tarnlake_regions ON n_regionkey = r_regionkey")


@query("SELECT 'orders' AS source, TRUE AS valid, COUNT(*) AS row_count, '' AS missing FROM orders UNION ALL SELECT 'region', FALSE, NULL, 'o_orderkey' FROM region GROUP BY 1")
def source_validation(spark, sf):
    rows = [(name, catalog.validate_source(t(spark, sf, name), ["o_orderkey"])) for name in ("orders", "region")]
    return spark.createDataFrame([(n, v["valid"], v["row_count"], ",".join(v["missing"])) for n, v in rows], "source string, valid boolean, row_count long, missing string")


@query(_values("name, n, orphans", [("accounts", 400, 0), ("branches", 10, 0), ("cards", 200, 0), ("customers", 200, 0), ("employees", 50, 0), ("loans", 50, 0), ("merchants", 60, 0), ("payments", 200, 0), ("transactions", 2000, 0)]))
def generated_bank(spark, sf):
    """The synthetic bank: rows of each table, and keys without a row in the table they refer to."""
    bank = Bank(spark)
    parents = {"accounts": ("customer_id", "customers"), "cards": ("account_id", "accounts"), "employees": ("branch_id", "branches"), "loans": ("customer_id", "customers"), "payments": ("loan_id", "loans"), "transactions": ("account_id", "accounts")}
    out = None
    for name in TABLES:
        if name in ("fraud_events", "customer_changes"):
            continue
        d = bank.table(name)
        if name in parents:
            key, parent = parents[name]
            d = d.join(bank.table(parent).select(key, F.lit(1).alias("_p")), key, "left").withColumn("_o", F.col("_p").isNull())
        else:
            d = d.withColumn("_o", F.lit(False))
        one = d.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_if("_o").alias("orphans"))
        out = one if out is None else out.unionByName(one)
    return out


# --- sinks ------------------------------------------------------------------------------------


@query(f"WITH {TXN} SELECT transaction_id, CAST(amount + CASE WHEN year(transaction_timestamp) = 1997 THEN 1 ELSE 0 END AS DOUBLE) AS amount FROM txn")
def sink_partition_overwrite(spark, sf):
    """Rewriting one year of a partitioned dataset leaves the others as they are."""
    root = work_dir(spark, "zone")
    d = txn(spark, sf).withColumn("year", F.year("transaction_timestamp"))
    path = write_zone(d, root, "silver", "transactions", ["year"])
    write_zone(d.where("year = 1997").withColumn("amount", (F.col("amount") + 1).cast(DEC)), root, "silver", "transactions", ["year"])
    return spark.read.parquet(path).select("transaction_id", dbl("amount").alias("amount"))


_BAD = f"currency NOT IN ({', '.join(repr(p) for p in PRIORITIES)})"


@query(f"WITH {DIRTY} SELECT transaction_id, CASE WHEN amount < 0 THEN 'negative' ELSE 'unspecified' END AS _dq_reason FROM dirty WHERE amount < 0 OR {_BAD}")
def sink_quarantine(spark, sf):
    root, d = work_dir(spark, "quarantine"), dirty(spark, sf)
    quarantine(d.where("amount < 0").withColumn("_dq_reason", F.lit("negative")), root, "transactions")
    path = quarantine(d.where(f"not amount < 0 and {_BAD}"), root, "transactions")
    return spark.read.parquet(path).select("transaction_id", "_dq_reason")


@query("SELECT c_mktsegment, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def sink_bucketed_tables(spark, sf):
    """Two tables bucketed by the same key: their join needs no shuffle."""
    a, b = _fresh(spark, "tarnlake_orders"), _fresh(spark, "tarnlake_customers")
    create_table_as(t(spark, sf, "orders").withColumnRenamed("o_custkey", "k"), a, bucket_by=(4, "k"), sort_by=["k"])
    create_table_as(t(spark, sf, "customer").withColumnRenamed("c_custkey", "k"), b, bucket_by=(4, "k"), sort_by=["k"])
    d = spark.table(a).join(spark.table(b).hint("merge"), "k")
    return d.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast(DEC)).cast("double").alias("spend"))


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier")
def sink_versioned_table(spark, sf):
    """A table that is rewritten from itself, by versions."""
    v = VersionedTable(spark, work_dir(spark, "versions"))
    v.replace(t(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"))
    changed = v.read().where("s_suppkey % 5 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1)
    v.replace(scd.upsert(v.read(), changed, ["s_suppkey"], ["s_acctbal"]))
    v.vacuum()
    return v.read()


@query("SELECT 'land_orders' AS pipeline, 'SUCCESS' AS status, COUNT(*) AS read_rows, COUNT(*) AS written_rows, COUNT(*) AS landed FROM orders")
def sink_land(spark, sf):
    root, store = work_dir(spark, "land"), ControlStore()
    land(t(spark, sf, "orders"), root, "orders", store)
    run = dict(store.db.execute("select pipeline, status, read_rows, written_rows from runs").fetchone())
    d = spark.read.parquet(f"{root}/bronze/orders").agg(F.count("*").alias("landed"))
    return d.select(*[F.lit(run[k]).cast("string" if k in ("pipeline", "status") else "long").alias(k) for k in ("pipeline", "status", "read_rows", "written_rows")], "landed")


@query(f"""WITH {DIRTY} SELECT 'account_id_not_null' AS name, FALSE AS passed, COUNT(*) - COUNT(account_id) AS failed_rows, COUNT(*) AS total_rows FROM dirty
 UNION ALL SELECT 'amount_non_negative', FALSE, COUNT(*) FILTER (NOT coalesce(amount >= 0, FALSE)), COUNT(*) FROM dirty
 UNION ALL SELECT 'currency_valid', FALSE, COUNT(*) FILTER (NOT coalesce(NOT {_BAD}, FALSE)), COUNT(*) FROM dirty""")
def sink_quality_report(spark, sf):
    """The report of a check job, written as JSON and read back."""
    path, as_of = work_dir(spark, "report"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    rules = quality.transaction_rules(as_of, currencies=PRIORITIES)
    assert run_checks.run(dirty(spark, sf), rules, path, fail=True) == 1
    report = spark.read.schema("passed boolean, checks array<struct<name:string,passed:boolean,failed_rows:long,total_rows:long>>").json(path)
    d = report.select(F.explode("checks").alias("c")).select("c.*")
    return d.where(F.col("name").isin("account_id_not_null", "amount_non_negative", "currency_valid"))


# --- control plane ----------------------------------------------------------------------------


@query(_values("step, outcome", [("claim again", "false"), ("claim first", "true"), ("file with another checksum", "false"), ("file done", "true"), ("mark after commit", "2025-01-03T00:00:00"), ("mark before commit", "None"), ("registered id is stable", "true"), ("retry", "third"), ("run failed", "FAILED"), ("run ok", "SUCCESS")]))
def control_store(spark, sf):
    s, out, tries = ControlStore(), {}, []
    out["registered id is stable"] = str(s.register("p", "a") == s.register("p", "b")).lower()
    with s.run("p") as r:
        pass
    out["run ok"] = s.get_run(r.id)["status"]
    try:
        with s.run("p") as r:
            raise RetryableError("no")
    except RetryableError:
        out["run failed"] = s.get_run(r.id)["status"]
    s.begin_watermark("p", "t", datetime(2025, 1, 3))
    out["mark before commit"] = str(s.watermark("p", "t"))
    s.commit_watermark("p", "t")
    out["mark after commit"] = s.watermark("p", "t").isoformat()
    s.mark_file("f", "abc", "PROCESSED")
    out["file done"], out["file with another checksum"] = (str(s.file_done("f", c)).lower() for c in ("abc", "def"))
    out["claim first"], out["claim again"] = (str(s.claim_event("e")).lower() for _ in range(2))

    @retry(attempts=3, base=0)
    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise RetryableError("not yet")
        return "third"

    out["retry"] = flaky()
    return spark.createDataFrame(sorted(out.items()), "step string, outcome string")


@query("SELECT step, CAST(place AS INTEGER) AS place, n FROM (SELECT 'extract' AS step, 1 AS place, (SELECT COUNT(*) FROM orders) AS n UNION ALL SELECT 'load', 4, (SELECT COUNT(*) FROM orders WHERE o_totalprice > 1000) UNION ALL SELECT 'quality', 3, 0 UNION ALL SELECT 'transform', 2, (SELECT COUNT(*) FROM orders WHERE o_totalprice > 1000))")
def workflow_steps(spark, sf):
    """Steps declared in any order run behind those they wait for; one needs a second try."""
    order, tries = [], []
    d = t(spark, sf, "orders")

    def step(name: str, count: Callable[[], int]) -> Callable[[], int]:
        def run() -> int:
            if name == "transform" and not tries:
                tries.append(1)
                raise RetryableError("once")
            order.append(name)
            return count()

        return run

    kept = d.where("o_totalprice > 1000")
    flow = Workflow([Step("load", step("load", kept.count), ("quality",)), Step("quality", step("quality", kept.where("o_totalprice <= 1000").count), ("transform",)), Step("transform", step("transform", kept.count), ("extract",), attempts=2), Step("extract", step("extract", d.count))])
    done = flow.execute()
    return spark.createDataFrame([(s, i + 1, done[s]) for i, s in enumerate(order)], "step string, place int, n long")


# --- pipelines --------------------------------------------------------------------------------

_CODES = ("USD", "EUR", "GBP", "JPY", "INR")
_CODE = "CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN '{c}'" for p, c in zip(PRIORITIES, _CODES, strict=True)) + " END"
#: Orders as a bank's transactions with faults: one account is missing, one amount negative, one currency unknown.
_SOURCE = f"""src AS (SELECT 'T' || CAST(o_orderkey AS VARCHAR) AS transaction_id, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS account_id,
 CAST(CASE WHEN o_orderkey % 50 = 1 THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18,2)) AS amount, CASE WHEN o_orderkey % 50 = 2 THEN 'XXX' ELSE {_CODE} END AS currency, o_orderdate AS ts, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS fraud_flag FROM orders)"""


def _source(spark, sf) -> DataFrame:
    k = F.col("o_orderkey") % 50
    return t(spark, sf, "orders").select(
        F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("transaction_id"),
        F.when(k != 0, F.col("o_custkey").cast("string")).alias("account_id"),
        F.concat(F.lit("M"), (F.col("o_orderkey") % 9).cast("string")).alias("merchant_id"),
        F.when(k == 1, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("amount"),
        F.when(k == 2, "XXX").otherwise(F.expr(_CODE)).alias("currency"),
        F.lit("POS").alias("channel"),
        F.lit("POSTED").alias("status"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("fraud_flag"),
        F.col("o_orderdate").cast("timestamp").alias("transaction_timestamp"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )


def _bank_folder(spark, sf) -> Tables:
    """The five source tables of the pipelines; every tenth transaction comes twice."""
    folder = work_dir(spark, "bank")
    d = _source(spark, sf)
    d.unionByName(d.where("crc32(cast(transaction_id as binary)) % 10 = 0")).write.parquet(f"{folder}/transactions.parquet")
    c = t(spark, sf, "customer")
    c.select(F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("segment")).write.parquet(f"{folder}/customers.parquet")
    c.select(F.col("c_custkey").cast("string").alias("account_id"), F.col("c_custkey").cast("string").alias("customer_id"), F.lit("CHECKING").alias("account_type")).write.parquet(f"{folder}/accounts.parquet")
    spark.range(9).select(F.concat(F.lit("M"), F.col("id").cast("string")).alias("merchant_id"), F.lit("m").alias("merchant_name")).write.parquet(f"{folder}/merchants.parquet")
    spark.range(5).select(F.col("id").cast("string").alias("card_id"), F.col("id").cast("string").alias("account_id"), F.lit("DEBIT").alias("card_type")).write.parquet(f"{folder}/cards.parquet")
    return Tables(spark, folder)


@query(f"""WITH {_SOURCE} SELECT CAST(ts AS DATE) AS transaction_date, currency, COUNT(*) AS txn_count, COUNT(DISTINCT account_id) AS distinct_accounts, CAST(SUM(amount) AS DOUBLE) AS total_amount,
 CAST(SUM(fraud_flag) AS BIGINT) AS fraud_count FROM src WHERE account_id IS NOT NULL AND amount >= 0 AND currency <> 'XXX' GROUP BY 1, 2""")
def pipeline_batch(spark, sf):
    """Sources to bronze, checked and deduplicated silver, gold: the daily summary."""
    root = work_dir(spark, "batch")
    batch(spark, _bank_folder(spark, sf), root, ControlStore(), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    d = spark.read.parquet(f"{root}/gold/daily_transaction_summary")
    return d.select("transaction_date", "currency", "txn_count", "distinct_accounts", dbl("total_amount").alias("total_amount"), F.col("fraud_count").cast("long").alias("fraud_count"))


@query(f"""WITH {_SOURCE} SELECT (SELECT COUNT(*) FROM src WHERE account_id IS NOT NULL AND amount >= 0 AND currency <> 'XXX') AS fact_rows,
 (SELECT COUNT(*) FROM customer) AS customers, (SELECT COUNT(DISTINCT CAST(ts AS DATE)) > 0 FROM src) AS has_days,
 (SELECT COUNT(*) > 0 FROM src WHERE account_id IS NULL OR amount < 0 OR currency = 'XXX') AS has_quarantine""")
def pipeline_batch_tables(spark, sf):
    root = work_dir(spark, "batch")
    counts = batch(spark, _bank_folder(spark, sf), root, ControlStore(), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    fact = spark.read.parquet(f"{root}/gold/fact_transaction").agg(F.count("*").alias("fact_rows"))
    return fact.select("fact_rows", F.lit(counts["gold_dim_customer"]).cast("long").alias("customers"), F.lit(counts["gold_dim_date"] > 0).alias("has_days"), F.lit(counts["quarantine_transactions"] > 0).alias("has_quarantine"))


@query(f"""WITH {_SOURCE} SELECT transaction_id, CAST(amount + CASE WHEN CAST(substr(transaction_id, 2) AS BIGINT) % 7 = 0 THEN 5 ELSE 0 END AS DOUBLE) AS amount FROM src WHERE account_id IS NOT NULL""")
def pipeline_incremental(spark, sf):
    """A first load, changes of every seventh row, and a run without news."""
    folder, root, store = work_dir(spark, "changes"), work_dir(spark, "lake"), ControlStore()
    d = _source(spark, sf)
    path = f"{folder}/transactions.parquet"
    d.write.parquet(path)
    tables = Tables(spark, folder)
    incremental(spark, tables, root, store)
    changed = d.where("bigint(substr(transaction_id, 2)) % 7 = 0").withColumn("amount", F.col("amount") + 5).withColumn("updated_at", F.lit("2027-01-01 00:00:00").cast("timestamp"))
    changed.write.mode("append").parquet(path)
    incremental(spark, tables, root, store)
    assert incremental(spark, tables, root, store) == 0
    return VersionedTable(spark, f"{root}/silver/transactions_current").read().select("transaction_id", dbl("amount").alias("amount"))


@query("SELECT c_custkey, CASE WHEN op = 'U' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY substr(md5(CAST(c_custkey AS VARCHAR) || '|42'), 1, 8), c_custkey) AS r, CASE WHEN r <= 40 THEN 'U' WHEN r <= 60 THEN 'D' END AS op FROM customer) WHERE op IS DISTINCT FROM 'D' UNION ALL SELECT c_custkey + 10000000, c_acctbal FROM customer WHERE c_custkey < 10")
def change_events(spark, sf):
    """Synthetic change events of a snapshot, replayed: the lowest hashes are updated, the next ones deleted."""
    c = t(spark, sf, "customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey < 10").withColumn("c_custkey", F.col("c_custkey") + 10_000_000)
    events = scd.synthesize_changes(c, "c_custkey", {"c_acctbal": F.col("c_acctbal") + 100}, 40, 20, new)
    return scd.replay(c, events, "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE substr(md5(CAST(o_orderkey AS VARCHAR) || '|7'), 1, 8) < '40000000'")
def seeded_sample(spark, sf):
    return analytics.sample_rows(t(spark, sf, "orders"), 0.25, "o_orderkey", seed=7).select("o_orderkey")


@query("SELECT n_nationkey AS key, n_name AS name, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier")
def union_missing_columns(spark, sf):
    a = t(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return aggregate.union_all(a, t(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("key")))


# --- streams ----------------------------------------------------------------------------------

_SPEED = 2 * fx.EARTH_RADIUS_KM
_CITY = "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(fx.CITIES)) + " END"
_GEO = "geo(city, lat, lon) AS (VALUES " + ", ".join(f"('{c}', {v[0]}::DOUBLE, {v[1]}::DOUBLE)" for c, v in fx.CITIES.items()) + ")"
#: The alerts of the whole stream in order of time, one row to each.
_ALERTS = f"""{_GEO}, e AS (SELECT event_id, user_id, ts, value, city, lat, lon, LAG(ts) OVER w AS t0, LAG(lat) OVER w AS lat0, LAG(lon) OVER w AS lon0,
 COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 21600 SECOND PRECEDING AND CURRENT ROW) AS n
 FROM (SELECT *, {_CITY} AS city FROM events) JOIN geo USING (city) WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 k AS (SELECT *, {_SPEED} * asin(sqrt(pow(sin((radians(lat) - radians(lat0)) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(lon0)) / 2), 2))) AS km FROM e),
 alerts AS (SELECT event_id, 'HIGH_VALUE' AS rule FROM k WHERE value >= 200 UNION ALL SELECT event_id, 'VELOCITY' FROM k WHERE n > 3
 UNION ALL SELECT event_id, 'IMPOSSIBLE_TRAVEL' FROM k WHERE ts > t0 AND km / (epoch(ts - t0) / 3600) > 900)"""
_RULES = fraud.FraudConfig(high_value=200.0, window_seconds=21600, max_events=3)


#: Rows to a file of the streams' input, about.
_FILE_ROWS = 500_000


def _stream_events(spark, sf, parts: int = 4) -> tuple[DataFrame, str, int]:
    """The events in order of time, as JSON files that a stream reads part by part; every fifth comes twice.

    Also the files of each part, the same number for all: a stream that takes so many at a time takes one part.
    """
    d = t(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("transaction_id"), F.col("user_id").cast("string").alias("customer_id"), F.lit("A").alias("account_id"), F.col("value").alias("amount"),
        F.lit("USD").alias("currency"), F.lit("M").alias("merchant"), F.expr(_CITY).alias("city"), F.col("ts").cast("timestamp").alias("timestamp"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"),
    )
    d = d.unionByName(d.where("bigint(transaction_id) % 5 = 0").withColumn("seq", F.col("seq") + 1))
    folder = work_dir(spark, "events")
    n, cuts = d.agg(F.count("*"), F.percentile_approx("seq", [i / parts for i in range(1, parts)])).first()
    files = max(1, n // (parts * _FILE_ROWS))
    for k, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = d.where((F.lit(True) if lo is None else F.col("seq") > lo) & (F.lit(True) if hi is None else F.col("seq") <= hi))
        # Rows are dealt out in turn, so that no file stays without rows and is left out.
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").json(f"{folder}/batch-{k}")
    return d, f"{folder}/*", files


@query(f"WITH {_ALERTS} SELECT event_id, rule FROM alerts")
def stream_fraud_alerts(spark, sf):
    """The stateful rules as a stream over files: de-duplication, state by customer, alerts into a Parquet sink."""
    _, folder, files = _stream_events(spark, sf)
    out = work_dir(spark, "alerts")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream_alerts(ev.file_stream(spark, folder, files), out, f"{out}-checkpoint", _RULES, within=None).awaitTermination()
    return spark.read.parquet(out).where("rule is not null").select(F.col("transaction_id").cast("long").alias("event_id"), "rule")


@query(f"WITH {_ALERTS} SELECT (SELECT COUNT(*) FROM events) AS processed, (SELECT COUNT(*) FROM events WHERE event_id % 5 = 0) AS duplicates, COUNT(*) AS alerts, COUNT(*) FILTER (rule = 'HIGH_VALUE') AS high_value, COUNT(*) FILTER (rule = 'VELOCITY') AS velocity, COUNT(*) FILTER (rule = 'IMPOSSIBLE_TRAVEL') AS impossible_travel FROM alerts")
def stream_summary(spark, sf):
    """What a stream has consumed: processed, duplicate and late events, and alerts of each rule."""
    arrived, folder, files = _stream_events(spark, sf)
    out = work_dir(spark, "alerts")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream_alerts(ev.file_stream(spark, folder, files), out, f"{out}-checkpoint", _RULES, within=None).awaitTermination()
    return fraud.summary(arrived, spark.read.parquet(out)).drop("late")


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day FROM events UNION ALL SELECT event_id, CAST(year(ts) AS INTEGER), CAST(month(ts) AS INTEGER), CAST(day(ts) AS INTEGER) FROM events WHERE event_id % 5 = 0")
def stream_archive(spark, sf):
    """Every event that arrives, appended by year, month and day."""
    _, folder, files = _stream_events(spark, sf)
    out = work_dir(spark, "archive")
    ev.archive_stream(ev.file_stream(spark, folder, 2 * files), out, f"{out}-checkpoint", trigger={"availableNow": True}).awaitTermination()
    return spark.read.parquet(out).select(F.col("transaction_id").cast("long").alias("event_id"), "year", "month", "day")


@query(_values("rule, n", [("HIGH_VALUE", 1), ("IMPOSSIBLE_TRAVEL", 2), ("VELOCITY", 1)]))
def stream_demo(spark, sf):
    """The seeded demonstration through the sharded log: 60 events, nine planted ones, a repeated one among them."""
    log, folder, out = ev.ShardedLog(), work_dir(spark, "demo"), work_dir(spark, "demo-alerts")
    ev.produce(ev.generate(60), log)
    lines = [json.dumps(r["data"] | {"seq": r["sequence_number"]}) for r in sorted(log.read_all(), key=lambda r: r["sequence_number"])]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream_alerts(ev.file_stream(spark, folder), out, f"{out}-checkpoint").awaitTermination()
    return spark.read.parquet(out).where("rule is not null").groupBy("rule").agg(F.count("*").alias("n"))
