"""Catalogued tables, the generator, the check runner."""

import json

from pyspark.sql import functions as F

from tarnlake.operators import quality
from tarnlake.plans import run_checks
from tarnlake.plans.datagen import Bank
from tarnlake.sinks import create_table_as
from tarnlake.sources import catalog


def test_catalog(spark, tmp_path):
    for name in ("ext_sales", "bulk_sales", "bucketed_sales"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    d = spark.range(10).select("id", F.when(F.col("id") < 5, "USD").otherwise("EUR").alias("currency"))
    d.write.partitionBy("currency").parquet(f"{tmp_path}/sales")
    catalog.register_external(spark, "ext_sales", f"{tmp_path}/sales", "id bigint, currency string", ["currency"])
    assert spark.table("ext_sales").where("currency = 'USD'").count() == 5
    spark.createDataFrame([(99, "GBP")], "id bigint, currency string").write.mode("append").partitionBy("currency").parquet(f"{tmp_path}/sales")
    catalog.repair(spark, "ext_sales")
    assert spark.table("ext_sales").count() == 11
    create_table_as(d.limit(0), "bulk_sales")
    d.select("currency", "id").write.parquet(f"{tmp_path}/more")
    catalog.copy_into(spark, "bulk_sales", f"{tmp_path}/more")
    assert spark.table("bulk_sales").where("id = 7").first()["currency"] == "EUR"
    create_table_as(d, "bucketed_sales", bucket_by=(4, "id"), sort_by=["id"])
    catalog.analyze(spark, "bucketed_sales", ["id"])
    b = spark.table("bucketed_sales")
    plan = b.hint("merge").join(b.select("id", F.lit(1).alias("x")), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    (tmp_path / "seed.csv").write_text("currency_code,is_active\nUSD,true\n")
    assert catalog.seed(spark, f"{tmp_path}/seed.csv", "currency_code string, is_active boolean", "currencies").count() == 1
    assert spark.sql("SELECT * FROM currencies WHERE is_active").count() == 1
    assert catalog.log_counts(d, F.col("id") > 2, "currency").first()["n"] == 5
    assert catalog.validate_source(d, ["id", "nope"])["missing"] == ["nope"] and catalog.validate_source(d, ["id"])["valid"]
    for name in ("ext_sales", "bulk_sales", "bucketed_sales"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_generator_and_runner(spark, tmp_path):
    bank = Bank(spark)
    t = bank.table("transactions")
    assert t.count() == 2000 and t.select("transaction_id").distinct().count() == 2000
    assert sorted(map(str, t.collect())) == sorted(map(str, Bank(spark).table("transactions").repartition(7).collect()))
    assert t.join(bank.table("accounts"), "account_id", "left_anti").count() == 0
    assert bank.table("accounts").join(bank.table("customers"), "customer_id", "left_anti").count() == 0
    assert all(bank.table(n).count() == k for n, k in bank.n.items())
    bad = bank.faulty_transactions()
    rules = quality.transaction_rules(F.lit("2026-01-01").cast("timestamp"))
    failed = {o.name: o.failed_rows for o in quality.evaluate(bad, rules).outcomes}
    assert [failed[k] for k in ("account_id_not_null", "amount_non_negative", "currency_valid", "timestamp_not_future")] == [10] * 4 and failed["transaction_id_unique"] == 2000
    assert bad.where("account_id = 'ACC99999999'").count() == 10
    assert run_checks.run(bad, rules, f"{tmp_path}/report", fail=True) == 1 and run_checks.run(t, rules, f"{tmp_path}/report", fail=True) == 0
    assert json.loads(spark.read.text(f"{tmp_path}/report").first()[0])["passed"]
