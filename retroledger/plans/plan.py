"""Compensation plans: operations that revert or reapply a transaction, their digests, and the plan file.

Operations are a DataFrame of model.OPERATION for any number of transactions at once. A plan file holds one plan; its size is
bounded by the policy, and it is canonical JSON with the digest of its own content.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.canonical import digest
from ..model import OPERATION, key_text, names, no_row, project, table_name, without
from ..sources import catalog

FORMAT = 1
MODES, CLASSES = ("revert", "reapply"), ("safe", "unsafe_resolved")


class Refused(RuntimeError):
    pass


def _numbered(df: DataFrame, descending: bool) -> DataFrame:
    order = F.col("sequence").desc() if descending else F.col("sequence")
    return df.withColumn("sequence", F.row_number().over(Window.partitionBy("txn_id").orderBy(order)).cast("long"))


def _keyed(changes: DataFrame, keys: DataFrame) -> DataFrame:
    """Each change with the key that addresses its row: the first by preference whose columns all hold values."""
    listed = keys.groupBy("table").agg(F.sort_array(F.collect_list(F.struct((~F.col("is_primary")).alias("rest"), "key", "columns"))).alias("_keys"))
    return changes.join(F.broadcast(listed), "table", "left")  # one row a table of the catalog


def _key(row: Column) -> Column:
    """The key columns of a row under the first usable of _keys; null if there is none."""
    held = F.transform(F.filter(row, lambda x: ~x["value"]["is_null"]), lambda x: x["column"])
    usable = F.filter("_keys", lambda k: F.size(F.array_except(k["columns"], held)) == 0)
    return F.when(row.isNotNull() & (F.size(usable) > 0), project(row, F.get(usable, 0)["columns"]))


def operations(changes: DataFrame, keys: DataFrame, columns: DataFrame | None = None, mode: str = "revert") -> DataFrame:
    """The operations of a mode for each transaction in changes. Revert runs backwards and inverts; reapply runs forwards.
    The key is taken from the row that is there before the operation, else from the one it writes. Computed columns are left
    out of what is written. key is null where no unique key fits."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    before, after = F.col("before"), F.col("after")
    if mode == "revert":
        kind = F.when(F.col("op") == "insert", "delete").when(F.col("op") == "delete", "insert").otherwise(F.col("op"))
        expect, write = after, before
    else:
        kind, expect, write = F.col("op"), before, after
    expect = F.when(kind != "insert", expect).otherwise(no_row())
    write = F.when(kind != "delete", write).otherwise(no_row())
    made = _keyed(changes, keys).withColumn("kind", kind).withColumn("expect", expect).withColumn("write", write).withColumn("key", _key(F.coalesce(expect, write)))
    if columns is not None:
        made = made.join(F.broadcast(catalog.generated(columns)), "table", "left").withColumn("write", F.when(F.size("generated") > 0, without(F.col("write"), F.col("generated"))).otherwise(F.col("write")))
    return _numbered(made, mode == "revert").select(*OPERATION.fieldNames())


def reapply_of(root: DataFrame) -> DataFrame:
    """The operations that undo a root revert: its own, backwards, each inverted; the key is read again from the row that will
    be there."""
    kind = F.when(F.col("kind") == "insert", "delete").when(F.col("kind") == "delete", "insert").otherwise(F.col("kind"))
    made = root.select("txn_id", "sequence", "table", kind.alias("kind"), "key", F.col("write").alias("expect"), F.col("expect").alias("write"))
    key = project(F.coalesce("expect", "write"), names(F.col("key")))
    return _numbered(made.withColumn("key", key), True).select(*OPERATION.fieldNames())


def tables_of(ops: DataFrame, keys: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """table, fingerprint and key columns of every table that operations touch."""
    return ops.select("table").distinct().join(fingerprints, "table", "left").join(keys.groupBy("table").agg(F.min_by("columns", F.struct(~F.col("is_primary"), "key")).alias("key_columns")), "table", "left")


def fingerprints_of(ops: DataFrame, keys: DataFrame, fingerprints: DataFrame) -> dict[str, str]:
    """The fingerprint of every table that one plan's operations touch; a table without one is refused."""
    found = {f"{r['table']['schema']}.{r['table']['name']}": r["fingerprint"] for r in tables_of(ops, keys, fingerprints).collect()}
    unread = sorted(t for t, f in found.items() if f is None)
    if unread:
        raise Refused("no schema of " + ", ".join(unread))
    return found


def faults(ops: DataFrame) -> DataFrame:
    """txn_id and reason of operations that cannot be planned."""
    reason = F.when(~F.col("kind").isin("insert", "update", "delete"), "unknown operation").when(key_text(F.col("key")).isNull(), F.concat(F.lit("no usable unique key: "), table_name("table")))
    return ops.select("txn_id", reason.alias("reason")).where("reason is not null").distinct()


# ---- plan files -----------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Plan:
    plan_id: str
    mode: str
    source_txn: str
    instance: str
    created_at: str
    tool_version: str
    operations: list[dict]
    fingerprints: dict[str, str]
    execution_class: str = "safe"
    root_digest: str | None = None
    parent_digest: str | None = None
    parent_action: str | None = None
    depth: int = 0
    resolution: dict = field(default_factory=dict)
    format: int = FORMAT
    digest: str = ""

    def sealed(self) -> Plan:
        """The plan with its digest, taken over its content with the digest left empty."""
        return replace(self, digest=digest(self.content() | {"digest": ""}))

    def content(self) -> dict:
        """All fields by name; the operations are not copied."""
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def root(self) -> str:
        return self.root_digest or self.digest

    def frame(self, spark: SparkSession) -> DataFrame:
        """The operations as a DataFrame."""
        raw = [(json.dumps(o),) for o in self.operations]
        return spark.createDataFrame(raw, "o string").select(F.from_json("o", OPERATION).alias("o")).select("o.*")


def collected(ops: DataFrame, max_rows: int) -> list[dict]:
    """Operations of one transaction, by sequence; refuses more than the policy allows."""
    told = F.to_json(F.struct(*ops.columns), {"ignoreNullFields": "false"}).alias("o")
    rows = ops.select("sequence", told).orderBy("sequence").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise Refused(f"more than {max_rows} operations")
    return [json.loads(r["o"]) for r in rows]


def build(summary_row: dict, ops: DataFrame, fingerprints: dict[str, str], mode: str, instance: str, plan_id: str, created_at: str, tool_version: str, max_rows: int = 1000) -> Plan:
    """The plan of an executable transaction; refuses others with their reasons."""
    if not summary_row["executable"]:
        raise Refused("; ".join(summary_row["reasons"]))
    listed = collected(ops, max_rows)
    bad = {told for o in listed if (told := _fault(o))}
    if bad:
        raise Refused("; ".join(sorted(bad)))
    return Plan(plan_id, mode, summary_row["txn_id"], instance, created_at, tool_version, listed, fingerprints).sealed()


def _fault(o: dict) -> str | None:
    """faults() of one operation at hand."""
    if o["kind"] not in ("insert", "update", "delete"):
        return "unknown operation"
    if not o["key"] or any(c["value"]["is_null"] for c in o["key"]):
        return f"no usable unique key: {o['table']['schema']}.{o['table']['name']}"
    return None


def next_in_chain(spark: SparkSession, root: Plan, mode: str, parent_action: str, parent_depth: int, plan_id: str, created_at: str) -> Plan:
    """After a safe root revert: a reapply (its inverse) or, after that, the revert once more (its own operations)."""
    if root.mode != "revert" or root.execution_class != "safe" or root.depth:
        raise Refused("the root of a chain is a safe revert")
    ops = collected(reapply_of(root.frame(spark)), len(root.operations)) if mode == "reapply" else root.operations
    return replace(root, plan_id=plan_id, mode=mode, created_at=created_at, operations=ops, root_digest=root.digest, parent_digest=root.digest, parent_action=parent_action, depth=parent_depth + 1).sealed()


def _text(plan: Plan) -> str:
    """Readable JSON with sorted fields: one field a line, one operation a line."""
    told = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False)
    lines = []
    for name, x in sorted(plan.content().items()):
        many = name == "operations" and x
        lines.append(f" {told(name)}: " + ("[\n  " + ",\n  ".join(map(told, x)) + "\n ]" if many else told(x)))
    return "{\n" + ",\n".join(lines) + "\n}\n"


def write_file(plan: Plan, path: str, max_bytes: int = 128 << 20) -> None:
    """The size is checked before the file is made, and nothing is overwritten."""
    text = _text(plan).encode()
    if len(text) > max_bytes:
        raise Refused(f"the plan has {len(text)} bytes; {max_bytes} are allowed")
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
        f.write(text)


def read_file(path: str) -> Plan:
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    if raw.get("format") != FORMAT:
        raise ValueError(f"plan format {raw.get('format')}")
    plan = Plan(**raw)
    if plan.sealed().digest != plan.digest:
        raise ValueError("the plan's content does not fit its digest")
    return plan
