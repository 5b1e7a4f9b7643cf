"""Checks: operations against the present state of tables, by one join on the key, and the present schema.

Every operation is compared with one snapshot, not with what earlier operations of the plan would leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.canonical import digest
from ..model import OPERATION, get, key_text, names, project, same_value, table_name

CONFLICT = "txn_id string, sequence long, table string, kind string, column string, expected string, actual string, message string"


def keyed_state(state: DataFrame, keys: DataFrame) -> DataFrame:
    """table, key and row of present rows (table, row) under each table's key columns (table, columns)."""
    chosen = keys.groupBy("table").agg(F.collect_set("columns").alias("_all"))
    rows = state.join(F.broadcast(chosen), "table")  # one row a table
    return rows.select("table", F.explode("_all").alias("_c"), "row").select("table", key_text(project(F.col("row"), F.col("_c"))).alias("key"), "row").where("key is not null")


def matched(ops: DataFrame, state: DataFrame) -> DataFrame:
    """Operations with current: the present row under their key, or null. state: table and row."""
    keys = ops.select("table", names(F.col("key")).alias("columns")).distinct()
    now = keyed_state(state, keys).select("table", F.col("key").alias("_key"), F.col("row").alias("current"))
    return ops.withColumn("_key", key_text(F.col("key"))).join(now, ["table", "_key"], "left").drop("_key")


def _difference() -> Column:
    """Of each expected column that the present row lacks or holds otherwise: column, expected, actual."""
    differs = lambda e: ~F.coalesce(same_value(e["value"], get(F.col("current"), e["column"])), F.lit(False))
    told = lambda v: F.when(v.isNull(), F.lit(None).cast("string")).when(v["is_null"], F.lit("null")).otherwise(v["data"])
    return F.transform(F.filter("expect", differs), lambda e: F.struct(e["column"].alias("column"), told(e["value"]).alias("expected"), told(get(F.col("current"), e["column"])).alias("actual")))


def listed() -> Column:
    """The conflicts of a matched operation as an array; null or empty if there is none."""
    none = F.lit(None).cast("string")

    def one(kind: str, text: str) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), none.alias("column"), none.alias("expected"), none.alias("actual"), F.lit(text).alias("message")))

    def mismatch(d: Column) -> Column:
        return F.struct(F.lit("row_mismatch").alias("kind"), d["column"].alias("column"), d["expected"].alias("expected"), d["actual"].alias("actual"), F.lit("the row holds another value").alias("message"))

    return (
        F.when(~F.coalesce(F.col("kind").isin("insert", "update", "delete"), F.lit(False)), one("unsupported_op", "unknown operation"))
        .when(key_text(F.col("key")).isNull(), one("key_missing", "no key addresses the row"))
        .when((F.col("kind") == "insert") & F.col("current").isNotNull(), one("row_exists", "a row with this key is there"))
        .when((F.col("kind") != "insert") & F.col("current").isNull(), one("row_missing", "no row with this key is there"))
        .when(F.col("kind") != "insert", F.transform(_difference(), mismatch))
    )


def conflicts(found: DataFrame) -> DataFrame:
    """The conflicts of matched operations: row_exists, row_missing, row_mismatch (one a column), key_missing,
    unsupported_op. Decimals compare by number, however long."""
    each = found.select("txn_id", "sequence", table_name("table").alias("table"), F.explode(listed()).alias("c"))
    return each.select("txn_id", "sequence", "table", "c.*").select(*(x.split()[0] for x in CONFLICT.split(", ")))


def schema_checks(planned: DataFrame, current: DataFrame) -> DataFrame:
    """table, expected, actual, matches of planned fingerprints (table, fingerprint) against the present ones; matches is
    null where the present one cannot be read."""
    now = current.select("table", F.col("fingerprint").alias("actual"))
    return planned.select("table", F.col("fingerprint").alias("expected")).join(now, "table", "left").withColumn("matches", F.col("expected") == F.col("actual"))


def status(found: DataFrame, txns: DataFrame, schemas: DataFrame | None = None, touched: DataFrame | None = None) -> DataFrame:
    """txn_id, n_conflicts and status: STALE_SCHEMA if a touched table's fingerprint differs, else CONFLICT if there is any
    conflict (an unreadable fingerprint is one), else READY. touched: txn_id and table."""
    n = found.groupBy("txn_id").agg(F.count(F.lit(1)).alias("n"))
    out = txns.select("txn_id").distinct().join(n, "txn_id", "left")
    stale, unreadable = F.lit(False), F.lit(0).cast("long")
    if schemas is not None:
        by = touched.select("txn_id", "table").distinct().join(F.broadcast(schemas), "table", "left").groupBy("txn_id").agg(F.bool_or(~F.col("matches")).alias("_stale"), F.count(F.when(F.col("matches").isNull(), 1)).alias("_unreadable"))
        out = out.join(by, "txn_id", "left")
        stale, unreadable = F.coalesce("_stale", F.lit(False)), F.coalesce("_unreadable", F.lit(0))
    total = F.coalesce("n", F.lit(0)) + unreadable
    return out.select("txn_id", total.alias("n_conflicts"), F.when(stale, "STALE_SCHEMA").when(total > 0, "CONFLICT").otherwise("READY").alias("status"))


def judged(found: DataFrame) -> DataFrame:
    """txn_id, n_conflicts and status (READY or CONFLICT) of matched operations, in one pass and without listing conflicts."""
    n = F.sum(F.greatest(F.coalesce(F.size(listed()), F.lit(0)), F.lit(0)).cast("long"))  # the size of null is -1 in some modes
    return found.groupBy("txn_id").agg(n.alias("n_conflicts")).select("txn_id", "n_conflicts", F.when(F.col("n_conflicts") > 0, "CONFLICT").otherwise("READY").alias("status"))


def instance_check(planned: str, current: str) -> list[dict]:
    """A plan of another instance is not checked further: one conflict and the status SOURCE_MISMATCH."""
    return [] if planned == current else [{"kind": "instance_mismatch", "expected": planned, "actual": current, "status": "SOURCE_MISMATCH"}]


def conflict_digest(parent: str, sequence: int, rows: list[dict]) -> str:
    """The digest of one operation's conflicts, messages left out."""
    told = [{k: v for k, v in r.items() if k != "message"} for r in rows]
    return digest({"parent": parent, "sequence": sequence, "conflicts": sorted(told, key=lambda r: (r["kind"], r.get("column") or ""))})


def repeated_keys(ops: DataFrame) -> DataFrame:
    """Transactions with several operations on one key; against one snapshot they cannot all hold."""
    return ops.groupBy("txn_id", "table", key_text(F.col("key")).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("txn_id").distinct()


FIELDS = OPERATION.fieldNames()
