"""A value-free index of transactions: build, search, compare with the present files, and update by rescanning the tail.

On storage an index is a folder: header.json and entries (Parquet by source_file, so that searches and updates read only the
files they need). Writers never overwrite; they fill a folder beside it and rename.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..model import TABLE_REF
from .transactions import summary

FORMAT = 1
ENTRY = f"txn_id string, source_file string, start_pos long, commit_time timestamp_ntz, row_count long, tables array<{TABLE_REF}>, executable boolean"
FILE = "name string, size long, modified_at timestamp_ntz"


class Stale(RuntimeError):
    """The files changed in a way that an update cannot follow; the index must be built anew."""


def entries(changes: DataFrame) -> DataFrame:
    """Index entries of a log, before duplicates go: one for each transaction in each file."""
    per_file = changes.withColumn("txn_id", F.struct("txn_id", "source_file"))
    s = summary(per_file, max_bytes=None)
    return s.select(F.col("txn_id.txn_id").alias("txn_id"), F.col("txn_id.source_file").alias("source_file"), "start_pos", "commit_time", "row_count", "tables", "executable")


def deduplicated(found: DataFrame) -> DataFrame:
    """The first entry of each id, by file and position; entries without an id all stay."""
    named = F.nullif("txn_id", F.lit(""))
    place = F.when(named.isNull(), F.struct("source_file", "start_pos", F.monotonically_increasing_id()))
    whole = F.struct("source_file", "start_pos", *(c for c in found.columns if c not in ("source_file", "start_pos")))
    return found.groupBy(named.alias("_id"), place.alias("_place")).agg(F.min(whole).alias("e")).select(*(F.col(f"e.{c}").alias(c) for c in found.columns))


def counters(found: DataFrame) -> DataFrame:
    """files, transactions and duplicates of entries that still hold duplicates."""
    named = F.nullif("txn_id", F.lit(""))
    kept = F.count_distinct(named) + F.count(F.when(named.isNull(), 1))
    return found.agg(F.count_distinct("source_file").alias("files"), kept.alias("transactions"), (F.count(F.lit(1)) - kept).alias("duplicates"))


@dataclass(frozen=True)
class Filter:
    txn_id: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    database: str | None = None
    table: str | None = None
    limit: int = 0

    def __post_init__(self):
        if self.limit < 0:
            raise ValueError("limit is negative")
        if self.since and self.until and self.until < self.since:
            raise ValueError("until is before since")


def search(found: DataFrame, f: Filter) -> DataFrame:
    """Entries that match, both ends of the time range included; database and table must hold for one and the same table.
    With a limit the first by file and position."""
    out = found
    if f.txn_id is not None:
        out = out.where(F.col("txn_id") == f.txn_id)
    if f.since is not None:
        out = out.where(F.col("commit_time") >= F.lit(f.since))
    if f.until is not None:
        out = out.where(F.col("commit_time") <= F.lit(f.until))
    if f.database is not None or f.table is not None:
        out = out.where(F.exists("tables", lambda t: _matches(t, f.database, f.table)))
    return out.orderBy("source_file", "start_pos").limit(f.limit) if f.limit else out


def _matches(ref: Column, database: str | None, name: str | None) -> Column:
    out = F.lit(True) if database is None else ref["schema"] == database
    if name is not None:
        out = out & ((ref["name"] == name) | (F.concat_ws(".", ref["schema"], ref["name"]) == name))
    return out


def file_changes(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """name and change (added, removed, changed, unchanged) of the files of two listings: name, size, modified_at."""
    old, new = (df.select("name", F.struct("size", "modified_at").alias(alias)) for df, alias in ((indexed, "_old"), (current, "_new")))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return old.join(new, "name", "full_outer").select("name", F.col("_old.size").alias("old_size"), F.col("_new.size").alias("new_size"), change.alias("change"))


def is_current(changes: DataFrame) -> DataFrame:
    return changes.agg(F.when(F.count(F.when(F.col("change") != "unchanged", 1)) == 0, "CURRENT").otherwise("STALE").alias("status"))


def sorted_snapshot(files: DataFrame) -> DataFrame:
    """Whether file names strictly increase in the order of position n."""
    order = Window.orderBy("n")  # as many rows as log files
    return files.withColumn("_before", F.lag("name").over(order)).agg(F.coalesce(F.bool_and(F.coalesce(F.col("_before") < F.col("name"), F.lit(True))), F.lit(True)).alias("increasing"))


def update_plan(changes: DataFrame) -> DataFrame:
    """One row: accepted, and the files to scan again. Only the last indexed file may grow, and only later names may come."""
    last = F.max(F.when(F.col("change") != "added", F.col("name")))
    tail = changes.agg(last.alias("_last"))
    judged = changes.crossJoin(F.broadcast(tail))  # one row
    bad = (
        (F.col("change") == "removed")
        | ((F.col("change") == "changed") & ((F.col("name") != F.col("_last")) | (F.col("new_size") <= F.col("old_size"))))
        | ((F.col("change") == "added") & (F.col("name") <= F.col("_last")))
    )
    again = F.sort_array(F.collect_list(F.when(F.col("change").isin("added", "changed"), F.col("name"))))
    return judged.agg(F.coalesce(~F.bool_or(F.coalesce(bad, F.lit(False))), F.lit(True)).alias("accepted"), again.alias("rescan"))


def updated(old: DataFrame, changes: DataFrame, rescan: list[str]) -> DataFrame:
    """Entries of files that did not change, with those of the files scanned again, each id once."""
    kept = old.where(~F.col("source_file").isin(rescan)) if rescan else old
    fresh = entries(changes.where(F.col("source_file").isin(rescan))) if rescan else old.limit(0)
    return deduplicated(kept.unionByName(fresh))


# ---- storage --------------------------------------------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write(found: DataFrame, files: DataFrame, path: str, backend: str = "changelog", instance: str = "") -> None:
    """Writes entries (already without duplicates) and the files that they describe; the folder must not be there."""
    spark = found.sparkSession
    fs, goal = _fs(spark, path)
    if fs.exists(goal):
        raise FileExistsError(path)
    temp = f"{path}.{uuid.uuid4().hex}"
    _, made = _fs(spark, temp)
    try:
        found.select(*(c.split()[0] for c in ENTRY.split(", "))).repartition("source_file").write.partitionBy("source_file").parquet(f"{temp}/entries")
        listed = [r.asDict() for r in files.orderBy("name").collect()]  # as many as log files
        head = {"format": FORMAT, "created_at": datetime.now().isoformat(), "backend": backend, "instance": instance, "files": listed}
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{temp}/header.json"), False)
        out.write(bytearray(json.dumps(head, default=str, sort_keys=True).encode()))
        out.close()
        if fs.exists(goal) or not fs.rename(made, goal):
            raise FileExistsError(path)
    except BaseException:
        fs.delete(made, True)
        raise


def header(spark: SparkSession, path: str) -> dict:
    head = json.loads(spark.read.text(f"{path}/header.json", wholetext=True).head()[0])
    if head.get("format") != FORMAT or not isinstance(head.get("files"), list):
        raise ValueError(f"{path} is no index of format {FORMAT}")
    return head


def read(spark: SparkSession, path: str) -> DataFrame:
    header(spark, path)
    return spark.read.schema(ENTRY).parquet(f"{path}/entries")


def files_of(spark: SparkSession, path: str) -> DataFrame:
    rows = [(f["name"], f["size"], datetime.fromisoformat(f["modified_at"])) for f in header(spark, path)["files"]]
    return spark.createDataFrame(rows, FILE)


def update(spark: SparkSession, path: str, to: str, changes: DataFrame, current: DataFrame) -> str:
    """Brings an index up to date at a new place. CURRENT writes nothing; changes that cannot be followed raise Stale."""
    difference = file_changes(files_of(spark, path), current)
    plan = update_plan(difference).head()
    if not plan["accepted"]:
        raise Stale("files changed before the tail: build the index anew")
    if not plan["rescan"]:
        return "CURRENT"
    head = header(spark, path)
    write(updated(read(spark, path), changes, plan["rescan"]), current, to, head["backend"], head["instance"])
    return "UPDATED"


def table_of(found: DataFrame) -> DataFrame:
    """Entries as text columns for listings."""
    return found.select("txn_id", "commit_time", "row_count", F.array_join(F.transform("tables", lambda t: F.concat_ws(".", t["schema"], t["name"])), ",").alias("tables"), "executable", "source_file")


