"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession, functions as F

from retroledger import queries
from retroledger.functions import canonical, values
from retroledger.model import ROW
from retroledger.operators import apply, check, transactions
from retroledger.plans import plan
from retroledger.sources import changelog

HEADLINE = (
    "txn_summary", "txn_tables", "txn_filter_table", "oversize_guard", "index_entries", "index_dedup", "index_query_time_range", "index_update",
    "plan_revert_ops", "plan_reapply_from_root", "plan_key_choice", "check_conflicts", "check_status", "resolve_overwrite", "apply_revert_state", "apply_verdict", "revert_reapply_roundtrip",
)


def large_transaction(spark: SparkSession, rows: int, size: int, folder: str) -> dict[str, float]:
    """Seconds to find, plan, check and apply (revert) one transaction of so many inserts of size bytes."""
    text = F.lpad(F.col("id").cast("string"), size, "x")
    image = values.row({"id": ("bigint", F.col("id")), "payload": ("varbinary(8192)", text), "note": ("text", F.lit(None))})
    table = F.struct(F.lit("shop").alias("schema"), F.lit("large_rows").alias("name"))
    log = spark.range(1, rows + 1).select(F.lit("f1").alias("source_file"), F.col("id").alias("pos"), F.lit("srv:1").alias("txn_id"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("commit_time"), F.col("id").alias("sequence"), table.alias("table"), F.lit("insert").alias("op"), F.lit(None).cast(ROW).alias("before"), image.alias("after"))
    log.write.parquet(f"{folder}/log")
    store = apply.Store(spark, f"file://{folder}/store")
    store.bootstrap(log.select("table", F.col("after").alias("row")))
    keys = spark.createDataFrame([(["id"],)], "columns array<string>").select(table.alias("table"), F.lit("PRIMARY").alias("key"), F.lit(True).alias("is_primary"), "columns")
    took, name = {}, f"large_{rows}x{size}"

    def timed(step: str, f):
        began = time.time()
        out = f()
        took[f"{name}_{step}"] = round(time.time() - began, 3)
        return out

    found = changelog.read(spark, f"{folder}/log").where("txn_id = 'srv:1'")
    summed = timed("decode", lambda: transactions.summary(found, max_rows=rows, max_bytes=1 << 40).head().asDict())

    def planned():
        made = plan.build(summed, plan.operations(found, keys), {}, "revert", "srv", canonical.ulid(), "now", "1", rows)
        plan.write_file(made, f"{folder}/plan.json", 1 << 40)
        return made

    made = timed("plan", planned)
    ops = made.frame(spark)
    state = timed("check", lambda: check.judged(check.matched(ops, store.state())).head()["status"])
    assert state == "READY", state
    timed("apply", lambda: store.apply(made, apply.Options(canonical.ulid(), "bench", "1", made.digest), "now", "srv"))
    return took


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every, took = queries.queries(), {}
    every["txn_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the workers
    for name in HEADLINE:
        began = time.time()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr)
    for rows, size in ((1000, 512), (10_000, 512), (1000, 8192)):
        with tempfile.TemporaryDirectory() as folder:
            took |= large_transaction(spark, rows, size, folder)
    print(json.dumps({"metric": "headline queries, total time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()
