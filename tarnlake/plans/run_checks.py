"""python -m tarnlake.plans.run_checks TRANSACTIONS.parquet REPORT.json [--fail]: the transaction rules as a job."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from ..session import get_spark


def run(df: DataFrame, rules: list[quality.Expectation], report_path: str, fail: bool = False) -> int:
    """Write the report; 1 if ``fail`` is set and a critical rule failed, else 0."""
    report = quality.evaluate(df, rules)
    spark: SparkSession = df.sparkSession
    spark.createDataFrame([(report.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(report_path)
    return int(fail and not report.passed)


def main(args: list[str]) -> int:
    if len(args) < 2:
        sys.exit(__doc__)
    spark = get_spark("run_checks")
    return run(spark.read.parquet(args[0]), quality.transaction_rules(F.current_timestamp()), args[1], "--fail" in args)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
