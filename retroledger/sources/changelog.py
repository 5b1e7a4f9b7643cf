"""Change logs: where files lie, cursors, scans and point lookups.

A decoded log is Parquet (or JSON) of model.CHANGE rows, partitioned by source_file where it is large, so that a cursor or
an index entry prunes a read to one file and the position filter reaches its row groups.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..model import CAPABILITIES, CHANGE

#: Fixed: the first bytes of a log file, and the position after them.
MAGIC, FIRST_POSITION = b"\xfebin", 4


class NotFound(LookupError):
    pass


class Unsupported(RuntimeError):
    pass


@dataclass(frozen=True)
class Cursor:
    file: str
    start: int = FIRST_POSITION
    end: int | None = None

    def text(self) -> str:
        return json.dumps({"file": self.file, "start_pos": self.start} | ({} if self.end is None else {"end_pos": self.end}), sort_keys=True)

    @staticmethod
    def parse(text: str) -> Cursor:
        raw = json.loads(text)
        if not raw.get("file"):
            raise ValueError("a cursor names a file")
        return Cursor(raw["file"], int(raw.get("start_pos") or FIRST_POSITION), raw.get("end_pos"))


@dataclass(frozen=True)
class Scope:
    """What a scan covers: from a cursor on, one schema or table, so many transactions at most (0: all)."""

    start: Cursor | None = None
    database: str | None = None
    table: str | None = None
    limit: int = 0

    def __post_init__(self):
        if self.limit < 0:
            raise ValueError("limit is negative")


def read(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A decoded log. JSON that does not fit the schema is an error."""
    reader = spark.read.schema(CHANGE)
    return reader.option("mode", "FAILFAST").json(path) if form == "json" else reader.format(form).load(path)


def read_stream(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """A decoded log as it grows."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files).parquet(path)


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """name, size and modified_at of the regular files in a folder that begin with the log magic; four bytes of each are read.
    Links and folders are passed over; a folder without any log is an error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, found = folder.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for s in fs.listStatus(folder):
        local = s.getPath().toUri().getPath() if fs.getScheme() == "file" else None
        if not s.isFile() or s.isSymlink() or (local and os.path.islink(local)) or s.getLen() < len(MAGIC):
            continue
        stream = fs.open(s.getPath())
        try:
            begin = bytes(stream.read() for _ in MAGIC)
        finally:
            stream.close()
        if begin == MAGIC:
            found.append((s.getPath().getName(), s.getLen(), datetime.fromtimestamp(s.getModificationTime() / 1000, timezone.utc).replace(tzinfo=None)))
    if not found:
        raise NotFound(f"no log files in {path}")
    return spark.createDataFrame(sorted(found), "name string, size long, modified_at timestamp_ntz")


def confined(base: str, name: str) -> str:
    """The real path of a file below a local base folder; refuses absolute names, escapes, links out and non-files."""
    if os.path.isabs(name):
        raise ValueError(f"{name} is not a relative name")
    root, path = os.path.realpath(base), os.path.realpath(os.path.join(base, name))
    if os.path.commonpath([root, path]) != root or path == root:
        raise ValueError(f"{name} lies outside {base}")
    if not os.path.isfile(path):
        raise ValueError(f"{name} is no regular file")
    return path


def capabilities(**have: bool) -> dict[str, bool]:
    return {c: bool(have.get(c)) for c in CAPABILITIES}


def require(have: dict[str, bool]) -> None:
    """A missing capability is refused, never worked around."""
    missing = [c for c in ("before_image", "after_image", "stable_id", "event_time_schema") if not have.get(c)]
    if missing:
        raise Unsupported("the log lacks " + ", ".join(missing))


def scan(changes: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """The changes that a scope covers. The limit counts transactions in commit order."""
    out = changes
    if scope.start is not None:
        c = scope.start
        out = out.where((F.col("source_file") > c.file) | ((F.col("source_file") == c.file) & (F.col("pos") >= c.start)))
        if c.end is not None:
            out = out.where((F.col("source_file") == c.file) & (F.col("pos") < c.end))
    keep = table_filter("table", scope.database, scope.table)
    if keep is not None:
        out = out.join(out.where(keep).select("txn_id").distinct(), "txn_id", "left_semi")
    if scope.limit:
        first = out.groupBy("txn_id").agg(F.min("commit_time").alias("t")).orderBy("t", "txn_id").limit(scope.limit)
        out = out.join(first, "txn_id", "left_semi")
    return out


def table_filter(table: str, database: str | None, name: str | None) -> Column | None:
    """A table's schema is database, and its name (or schema.name) is name; what is None does not matter."""
    ref, out = F.col(table), None
    if database is not None:
        out = ref["schema"] == database
    if name is not None:
        named = (ref["name"] == name) | (F.concat_ws(".", ref["schema"], ref["name"]) == name)
        out = named if out is None else out & named
    return out


def current_cursor(changes: DataFrame) -> Cursor | None:
    """Behind the last change of the log."""
    last = changes.agg(F.max(F.struct("source_file", "pos")).alias("last")).head()["last"]
    return None if last is None else Cursor(last["source_file"], last["pos"] + 1)


def find(changes: DataFrame, txn_id: str, cursor: Cursor | None = None, instance: str | None = None) -> DataFrame:
    """The changes of one transaction, by its whole id; an error if there is none, or if it is of another instance."""
    if instance is not None and txn_id.rpartition(":")[0] != instance:
        raise NotFound(f"{txn_id} is not of instance {instance}")
    out = scan(changes, Scope(start=cursor)).where(F.col("txn_id") == txn_id)
    if not out.head(1):
        raise NotFound(txn_id)
    return out
