"""End-to-end pipelines: batch medallion, incremental load, streaming fraud, and a small step runner."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..control import ControlStore, get_logger
from ..errors import QualityError
from ..operators import aggregate, project, quality, scd, star, windows
from ..sinks import VersionedTable, quarantine, write_zone, zone_path
from ..sources.tables import Tables, extract_by_timestamp, extract_full
from ..streaming.fraud import FraudConfig, alerts

SOURCES = ("customers", "accounts", "merchants", "cards", "transactions")
CASTS = {"amount": "decimal", "transaction_timestamp": "timestamp", "updated_at": "timestamp", "fraud_flag": "int"}


def land(df: DataFrame, root: str, dataset: str, store: ControlStore, partition_by: list[str] | None = None) -> int:
    """Write a full table to bronze under a run; its rows are counted while they are written."""
    with store.run(f"land_{dataset}") as run:
        seen = Observation(f"land_{dataset}")
        write_zone(df.observe(seen, F.count("*").alias("n")), root, "bronze", dataset, partition_by)
        run.read_rows = run.written_rows = seen.get["n"]
    return run.written_rows


def batch(spark: SparkSession, tables: Tables, root: str, store: ControlStore, as_of: Column | None = None, stop_on_failure: bool = False) -> dict[str, int]:
    """Source tables to bronze, checked and deduplicated silver, star-schema gold. Returns the rows written to each table.

    Every step reads what the one before it wrote, so a failed run restarts from the last table.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    store.register("batch", "tables", root)
    counts: dict[str, int] = {}

    def written(df: DataFrame, zone: str, name: str, partition_by: list[str] | None = None) -> DataFrame:
        seen = Observation(f"{zone}_{name}")
        path = write_zone(df.observe(seen, F.count("*").alias("n")), root, zone, name, partition_by)
        counts[f"{zone}_{name}"] = seen.get["n"]
        return spark.read.parquet(path) if seen.get["n"] else df.limit(0)

    with store.run("batch") as run:
        bronze = {name: written(extract_full(tables, name), "bronze", name) for name in SOURCES}
        run.read_rows = sum(counts.values())
        rules = quality.transaction_rules(as_of)
        report = quality.evaluate(bronze["transactions"], rules)
        get_logger("tarnlake.batch").info("quality", extra={"fields": {"passed": report.passed}})
        if stop_on_failure:
            report.raise_if_failed()
        good, bad = quality.split(bronze["transactions"], rules)
        quarantine(bad, root, "transactions")
        counts["quarantine_transactions"] = run.failed_rows = counts["bronze_transactions"] - good.count()
        silver = windows.deduplicate(project.cast_types(good, CASTS), ["transaction_id"], "updated_at", ["account_id", "amount"])
        silver = written(project.with_date_parts(silver, "transaction_timestamp", drop_null=True), "silver", "transactions", ["year", "month"])
        dims = {name: written(star.dimension(bronze[f"{name}s"], name), "gold", f"dim_{name}") for name in ("customer", "account", "merchant", "card")}
        written(star.date_dimension(silver), "gold", "dim_date")
        written(star.transaction_fact(silver, dims["account"], dims["merchant"]), "gold", "fact_transaction")
        written(aggregate.daily_summary(silver), "gold", "daily_transaction_summary")
        run.written_rows = sum(v for k, v in counts.items() if k.startswith("gold"))
    return counts


UPDATED = ["amount", "status", "fraud_flag", "updated_at"]


def incremental(spark: SparkSession, tables: Tables, root: str, store: ControlStore, pipeline: str = "incremental_transactions") -> int:
    """Merge transactions changed since the last run into the versioned silver table; the number of changed rows.

    The high-water mark is committed after the table has switched, so a crash replays the same rows,
    which the merge makes harmless.
    """
    store.register(pipeline, "transactions", "silver.transactions_current", "incremental")
    with store.run(pipeline) as run:
        rows, _ = extract_by_timestamp(tables, "transactions", pipeline, store)
        rows = project.drop_null_rows(project.cast_types(rows, CASTS), ["transaction_id", "account_id"])
        rows = windows.deduplicate(rows, ["transaction_id"], "updated_at", ["amount"])
        run.read_rows = rows.count()
        if run.read_rows:
            table = VersionedTable(spark, zone_path(root, "silver", "transactions_current"))
            before = table.read()
            table.replace(rows if before is None else scd.upsert(before, rows, ["transaction_id"], UPDATED))
            run.written_rows = run.read_rows
        store.commit_watermark(pipeline, "transactions")
    return run.written_rows


def stream_alerts(events: DataFrame, sink: str, checkpoint: str, config: FraudConfig = FraudConfig(), within: str | None = "1 hour"):
    """Score a stream and append its alerts to a Parquet sink, up to all data that is there."""
    return alerts(events, config, within).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


@dataclass
class Step:
    name: str
    run: Callable[[], object]
    after: tuple[str, ...] = ()
    attempts: int = 1


@dataclass
class Workflow:
    """Steps in dependency order; a failed step stops those behind it and is handed to ``on_failure``."""

    steps: list[Step]
    on_failure: Callable[[str, Exception], None] = lambda name, error: None
    results: dict[str, object] = field(default_factory=dict)

    def execute(self) -> dict[str, object]:
        left = {s.name: s for s in self.steps}
        while left:
            ready = [s for s in left.values() if all(a in self.results for a in s.after)]
            if not ready:
                raise ValueError(f"steps wait for each other: {sorted(left)}")
            for s in ready:
                for n in range(1, s.attempts + 1):
                    try:
                        self.results[s.name] = s.run()
                        break
                    except Exception as e:
                        if n == s.attempts or isinstance(e, QualityError):
                            self.on_failure(s.name, e)
                            raise
                del left[s.name]
        return self.results
