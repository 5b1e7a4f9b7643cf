"""Applying plans: all operations of a plan at once as new table versions, published by one manifest.

A store is a folder: tables/<name>/v<number> (Parquet) and manifests/<number>.json, each naming a version of every table and
holding the marker of the action that made it, so the manifests together are the append-only history. A manifest is written
whole under a name of its own and then gets its number, which fails if the number is taken: that is the compare-and-swap.
Of two writers one fails and nothing of it shows; a reader never sees a part of a manifest.

Against one snapshot two operations on the same key can never both hold, so one pass over each table is exact.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.canonical import digest_bytes, ulid_bytes
from ..model import contains, key_text, names, no_row, project, table_name
from ..plans.plan import Plan
from . import check

TYPES, STATES = {"revert": "REVERT", "reapply": "REAPPLY"}, {"revert": "REVERTED", "reapply": "APPLIED"}


#: Operations of one plan that are broadcast; plans with more are joined by shuffling.
FEW = 20_000


class ApplyError(RuntimeError):
    pass


class ReplayBlocked(ApplyError):
    """The plan, or another at its place in the chain, has been applied."""


class CommitUnknown(ApplyError):
    """The manifest may or may not have been published; the action id tells which, and nothing may be tried again."""

    def __init__(self, action_id: str):
        super().__init__(f"the outcome of action {action_id} is unknown; verify it, do not apply again")
        self.action_id = action_id


@dataclass(frozen=True)
class Options:
    action_id: str
    operator: str
    tool_version: str
    confirm: str
    reason: str | None = None

    def validate(self, plan: Plan) -> None:
        ulid_bytes(self.action_id), ulid_bytes(plan.plan_id), digest_bytes(plan.digest), digest_bytes(plan.root())
        if not self.operator or len(self.operator) > 255:
            raise ApplyError("an operator is needed")
        if not self.tool_version or len(self.tool_version.encode()) > 32:
            raise ApplyError("tool_version has 1 to 32 bytes")
        if plan.mode not in TYPES or not plan.source_txn:
            raise ApplyError("the plan has no mode or no source")
        confirmed(self.confirm, plan.digest)


def confirmed(prefix: str, digest: str) -> None:
    """The operator repeats at least eight hexadecimal digits of the plan's digest."""
    text = prefix.removeprefix("sha256:").lower()
    if len(text) < 8 or not digest.removeprefix("sha256:").startswith(text):
        raise ApplyError("the confirmation does not fit the plan's digest")


def marker(plan: Plan, options: Options, created_at: str) -> dict:
    return {
        "action_id": options.action_id, "plan_id": plan.plan_id, "parent_action_id": plan.parent_action, "root_plan_digest": plan.root(), "action_type": TYPES[plan.mode], "target_state": STATES[plan.mode],
        "chain_depth": plan.depth, "source_txn": plan.source_txn, "plan_digest": plan.digest, "execution_class": plan.execution_class, "reason": options.reason, "tool_version": options.tool_version,
        "operator_name": options.operator, "created_at": created_at,
    }


def _goal() -> Column:
    """The key of the row that an update writes, if that differs from the key it has now; else null."""
    goal = key_text(project(F.col("write"), names(F.col("key"))))
    return F.when((F.col("kind") == "update") & (goal != key_text(F.col("key"))), goal)


def _effect() -> Column:
    """Whether a matched operation changes exactly one row. An insert needs a free key, a delete and an update their row; an
    update that changes nothing has no effect."""
    there = F.col("current").isNotNull()
    return F.coalesce(F.when(F.col("kind") == "insert", ~there).when(F.col("kind") == "delete", there).otherwise(there & ~contains(F.col("current"), F.col("write"))), F.lit(False))


def new_state(state: DataFrame, ops: DataFrame, few: bool = False, most: int | None = None) -> DataFrame:
    """The rows of state (table, row) after operations that hold: rows under their keys go, written rows come. Columns that
    an update does not write (computed ones) stay as they were. State rows are never grouped, so equal rows all stay.
    few: the operations are known to be few and are broadcast; else the tables are shuffled to them. most: by how many sets
    of key columns a table's rows are addressed at most, if that is known."""
    small = F.broadcast if few else (lambda df: df)
    keys = ops.select("table", names(F.col("key")).alias("_c")).distinct()
    sets = keys.groupBy("table").agg(F.sort_array(F.collect_set("_c")).alias("_all"))
    if most is None:
        most = sets.agg(F.coalesce(F.max(F.size("_all")), F.lit(0))).head()[0]  # usually one
    touched = ops.where("kind <> 'insert'").select("table", names(F.col("key")).alias("_set"), key_text(F.col("key")).alias("_key"), F.when(F.col("kind") == "update", F.col("write")).alias("_w"))
    touched = touched.groupBy("table", "_set", "_key").agg(F.first("_w", True).alias("_w"))
    out = state.join(F.broadcast(sets), "table", "left").withColumn("_hit", F.lit(False)).withColumn("_write", no_row())  # one row a table
    for k in range(most):
        own = out.withColumn("_set", F.get("_all", k)).withColumn("_key", key_text(project(F.col("row"), F.col("_set"))))
        found = own.join(small(touched.withColumn("_met", F.lit(True))), ["table", "_set", "_key"], "left")
        out = found.select("table", "row", "_all", (F.col("_hit") | F.coalesce("_met", F.lit(False))).alias("_hit"), F.coalesce("_write", "_w").alias("_write"))
    value = lambda c: F.coalesce(F.get(F.filter("_write", lambda w: w["column"] == c["column"]), 0)["value"], c["value"])
    merged = F.transform("row", lambda c: F.struct(c["column"].alias("column"), value(c).alias("value")))
    left = out.where(~F.col("_hit") | F.col("_write").isNotNull()).select("table", F.when(F.col("_hit"), merged).otherwise(F.col("row")).alias("row"))
    return left.unionByName(ops.where("kind = 'insert'").select("table", F.col("write").alias("row")))


def verdict(ops: DataFrame, state: DataFrame, few: bool = False) -> DataFrame:
    """txn_id, status and affected: READY with the number of rows that change, or CONFLICT with 0 (nothing is applied in part).
    Operations that fail the check, repeat a key, move onto a taken key or change no row are conflicts.

    The state is joined once: an operation that moves its row looks up two keys. few: see new_state."""
    own = F.struct(key_text(F.col("key")).alias("key"), F.lit(False).alias("goal"))
    goal = F.when(_goal().isNotNull(), F.struct(_goal().alias("key"), F.lit(True).alias("goal")))
    keys = ops.select("table", names(F.col("key")).alias("columns")).distinct()
    now = check.keyed_state(state, keys).select("table", F.col("key").alias("_key"), F.col("row").alias("current"))
    wanted = ops.withColumn("_look", F.explode(F.array_compact(F.array(own, goal)))).withColumn("_key", F.col("_look.key"))
    if few:  # the tables are only filtered by the broadcast keys; what is left is small
        now = now.join(F.broadcast(wanted.select("table", "_key").distinct()), ["table", "_key"], "left_semi")
    found = wanted.join(now, ["table", "_key"], "left")
    is_goal = F.col("_look.goal")
    bad = F.when(is_goal, F.col("current").isNotNull()).otherwise((F.coalesce(F.size(check.listed()), F.lit(0)) > 0) | ~_effect())
    flagged = found.select("txn_id", bad.alias("bad"), F.when(~is_goal, F.struct("table", "_key")).alias("own"), (~is_goal & _effect()).cast("long").alias("effect"))
    told = flagged.groupBy("txn_id").agg(F.bool_or("bad").alias("bad"), F.sum("effect").alias("n"), F.count("own").alias("ops"), F.count_distinct("own").alias("keys"))
    failed = F.col("bad") | (F.col("ops") > F.col("keys"))
    return told.select("txn_id", F.when(failed, "CONFLICT").otherwise("READY").alias("status"), F.when(failed, 0).otherwise(F.col("n")).cast("long").alias("affected"))


class Store:
    """Table versions and action markers below a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self.fs.exists(folder):
            return []
        found = (s.getPath().getName() for s in self.fs.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in found if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def _read(self, name: str) -> dict:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The present version: its number, the folder of each table, and the marker of the action that made it."""
        found = self.versions()
        return self._read(f"manifests/{found[-1]}.json") if found else {"version": 0, "tables": {}, "marker": None}

    def state(self, tables: list[str] | None = None) -> DataFrame:
        """table and row of the present versions; only the folders of the wanted tables are read."""
        here = {t: p for t, p in self.manifest()["tables"].items() if tables is None or t in tables}
        empty = self.spark.createDataFrame([], check_schema())
        return self.spark.read.schema(check_schema()).parquet(*(f"{self.path}/{p}" for p in here.values())) if here else empty

    def publish(self, before: dict, tables: dict[str, str], action: dict | None = None) -> None:
        """The manifest after before, unless another has been published. Errors before it gets its number leave all as it was;
        after an error while it gets it, its presence is looked up, and CommitUnknown is raised if that fails too."""
        number = before["version"] + 1
        text = json.dumps({"version": number, "tables": tables, "marker": action}, sort_keys=True)
        temp, name = self._path(f"manifests/.{number}-{uuid.uuid4().hex}"), self._path(f"manifests/{number}.json")
        out = self.fs.create(temp, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self._number(temp, name)
        except Exception as e:
            try:
                if self.fs.exists(name):
                    if self._read(f"manifests/{number}.json") == json.loads(text):
                        return
                    raise ApplyError("another action was published meanwhile") from e
                if self.fs.exists(temp):
                    raise ApplyError("the manifest could not be published") from e
            except ApplyError:
                raise
            except Exception:  # the folder cannot be read: nobody knows
                pass
            raise CommitUnknown(action["action_id"] if action else "") from e
        finally:
            try:
                self.fs.delete(temp, False)
            except Exception:  # a file without a number is never read
                pass

    def _number(self, temp, name) -> None:
        """Gives a written manifest its number, and fails if that is taken."""
        if self.fs.getScheme() == "file":  # a local rename would overwrite; a second link does not
            os.link(temp.toUri().getPath(), name.toUri().getPath())
            return
        jvm = self.spark._jvm
        mode = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(mode, 1)
        none[0] = mode.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(temp, name, none)

    def bootstrap(self, state: DataFrame) -> None:
        """The first version from table and row; an existing store stays as it is."""
        if self.versions():
            return
        tables = [r[0] for r in state.select(table_name("table").alias("t")).distinct().collect()]
        self.publish(self.manifest(), {t: self._write(state.where(table_name("table") == t), t, "v0") for t in tables})

    def create(self) -> None:
        """An empty store where there is none; an existing one stays as it is."""
        if not self.versions():
            self.publish(self.manifest(), {})

    def _write(self, rows: DataFrame, table: str, version: str) -> str:
        rows.select("table", "row").write.parquet(f"{self.path}/tables/{table}/{version}")
        return f"tables/{table}/{version}"

    def actions(self) -> DataFrame:
        """All markers, one row for each action, read from the manifests."""
        from .actions import ACTION

        if not self.versions():
            return self.spark.createDataFrame([], ACTION)
        read = self.spark.read.schema(f"marker struct<{', '.join(x.replace(' ', ': ', 1) for x in ACTION.split(', '))}>")
        return read.option("pathGlobFilter", "*.json").json(f"{self.path}/manifests").where("marker is not null").select("marker.*")

    def markers(self, where: Column | None = None) -> list[dict]:
        """The markers of some actions; without a condition all."""
        return [r.asDict() for r in (self.actions() if where is None else self.actions().where(where)).orderBy("chain_depth").collect()]

    def apply(self, plan: Plan, options: Options, created_at: str, instance: str, fingerprints: dict[str, str] | None = None, max_depth: int = 20, correlate: Callable[[str], str] | None = None) -> dict:
        """Checks once more and applies the whole plan, or raises and leaves all as it was. fingerprints: the present ones;
        a planned table whose fingerprint differs, or cannot be read, is refused. correlate finds the transaction of an
        action id in the log; where it fails the result carries a warning, as the action stands all the same."""
        from . import actions

        options.validate(plan)
        if instance != plan.instance:
            raise ApplyError("the plan is of another instance")
        before = self.manifest()
        root, same = F.col("root_plan_digest") == plan.root(), (F.col("plan_id") == plan.plan_id) | (F.col("action_id") == options.action_id)
        known = self.markers(same | root)  # at most a chain
        for m in known:
            if m["plan_id"] == plan.plan_id or m["action_id"] == options.action_id or (m["root_plan_digest"], m["chain_depth"]) == (plan.root(), plan.depth):
                raise ReplayBlocked(f"action {m['action_id']} stands at this place")
        fault = actions.chain_fault(plan, known, max_depth)
        if fault:
            raise ApplyError(fault)
        drifted = [t for t, f in plan.fingerprints.items() if fingerprints is not None and fingerprints.get(t) != f]
        if drifted:
            raise ApplyError("STALE_SCHEMA: " + ", ".join(sorted(drifted)))
        ops = plan.frame(self.spark).persist()  # bounded by the policy, and read several times
        try:
            tables, affected = self._written(plan, ops, before, f"v{before['version'] + 1}-{options.action_id}")  # no two writers share a folder
        finally:
            ops.unpersist()
        self.publish(before, tables, marker(plan, options, created_at))
        result = {"action_id": options.action_id, "affected": affected, "plan": plan.digest}
        if correlate is not None:
            try:
                result["txn_id"] = correlate(options.action_id)
            except Exception as e:
                result["warning"] = f"the action is applied; its transaction was not found: {e}"
        return result

    def _written(self, plan: Plan, ops: DataFrame, before: dict, version: str) -> tuple[dict[str, str], int]:
        """The tables after a plan whose operations all hold, written beside the present ones, and the number of changed rows."""
        touched = sorted({f"{o['table']['schema']}.{o['table']['name']}" for o in plan.operations})
        state, few = self.state(touched), len(plan.operations) <= FEW
        found = verdict(ops, state, few).head()
        if found is not None and found["status"] != "READY":
            raise ApplyError(found["status"])
        by_table: dict[str, set] = {}
        for o in plan.operations:
            by_table.setdefault(f"{o['table']['schema']}.{o['table']['name']}", set()).add(tuple(c["column"] for c in o["key"]))
        after = new_state(state, ops, few, max(map(len, by_table.values()), default=0))
        tables = before["tables"] | {t: self._write(after.where(table_name("table") == t), t, version) for t in touched}
        return tables, found["affected"] if found else 0


def check_schema() -> str:
    from ..model import ROW, TABLE_REF

    return f"table {TABLE_REF}, row {ROW}"
