"""Resolutions: audited decisions (skip or overwrite) about operations in conflict, and the plan that follows from them."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, Window, functions as F

from ..model import OPERATION, contains, names, no_row, project
from ..plans.plan import Plan, Refused
from .check import conflict_digest

VERBS = ("skip", "overwrite", "abort")
MAX_DECISION_BYTES = 4 << 20


def grouped(found: DataFrame) -> DataFrame:
    """txn_id, sequence, kind (null if the conflicts of an operation are of several kinds) and n."""
    return found.groupBy("txn_id", "sequence").agg(F.when(F.count_distinct("kind") == 1, F.first("kind")).alias("conflict"), F.count(F.lit(1)).alias("n"))


def coverage(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """What is wrong with decisions (txn_id, sequence, verb): one row for each fault."""
    times = decisions.groupBy("txn_id", "sequence").agg(F.count(F.lit(1)).alias("times"), F.first("verb").alias("verb"))
    both = grouped(found).join(times, ["txn_id", "sequence"], "full_outer")
    fault = (
        F.when(F.col("times").isNull(), "conflict without a decision")
        .when(F.col("sequence") <= 0, "sequence is not positive")
        .when(F.col("n").isNull(), "decision without a conflict")
        .when(F.col("times") > 1, "several decisions")
        .when(~F.col("verb").isin(*VERBS), "unknown verb")
        .when(F.col("verb") == "abort", "aborted")
    )
    return both.select("txn_id", "sequence", fault.alias("fault")).where("fault is not null")


def resolved(found: DataFrame, kinds: DataFrame, decisions: DataFrame) -> DataFrame:
    """Operations after decisions, with outcome: kept, skipped, dropped (there is nothing left to do) or overwritten. Those
    that go have no new sequence. found: matched operations; kinds: grouped conflicts."""
    joined = found.join(kinds, ["txn_id", "sequence"], "left").join(decisions.select("txn_id", "sequence", "verb"), ["txn_id", "sequence"], "left")
    same = F.col("current").isNotNull() & F.col("write").isNotNull() & contains(F.col("current"), F.col("write"))
    over = F.col("verb") == "overwrite"
    outcome = (
        F.when(F.col("conflict").isNull() & F.col("n").isNull(), "kept")
        .when(F.col("verb") == "skip", "skipped")
        .when(over & F.col("conflict").isin("row_mismatch", "row_exists") & (F.col("kind") != "delete") & same, "dropped")
        .when(over & (F.col("conflict") == "row_missing") & (F.col("kind") == "delete"), "dropped")
        .when(over & F.col("conflict").isin("row_mismatch", "row_exists", "row_missing"), "overwritten")
        .otherwise("undecided")
    )
    out = joined.withColumn("outcome", outcome)
    changed = F.col("outcome") == "overwritten"
    kind = F.when(changed & (F.col("conflict") == "row_exists"), "update").when(changed & (F.col("conflict") == "row_missing"), "insert").otherwise(F.col("kind"))
    expect = F.when(changed & F.col("conflict").isin("row_mismatch", "row_exists"), F.col("current")).when(changed & (F.col("conflict") == "row_missing"), no_row()).otherwise(F.col("expect"))
    key = F.when(changed & (F.col("conflict") == "row_missing"), project(F.col("write"), names(F.col("key")))).otherwise(F.col("key"))
    stays = F.col("outcome").isin("kept", "overwritten")
    rank = F.when(stays, F.row_number().over(Window.partitionBy("txn_id", stays).orderBy("sequence")).cast("long"))
    return out.select("txn_id", "sequence", rank.alias("new_sequence"), "table", kind.alias("kind"), key.alias("key"), expect.alias("expect"), "write", "outcome")


def surviving(after: DataFrame) -> DataFrame:
    """The operations of the resolved plan, numbered anew."""
    return after.where("new_sequence is not null").withColumn("sequence", F.col("new_sequence")).select(*OPERATION.fieldNames())


def read_decisions(text: bytes, parent: Plan, conflicts: dict[int, list[dict]]) -> list[dict]:
    """Decisions from JSON: sequence, verb and conflict_digest (filled in where it is missing). Unknown fields, digests that
    do not fit and files over 4 MiB are refused."""
    if len(text) > MAX_DECISION_BYTES:
        raise Refused("the decision file is too large")
    raw = json.loads(text)
    if set(raw) - {"operator", "reason", "decisions"}:
        raise Refused("unknown fields")
    for d in raw["decisions"]:
        if set(d) - {"sequence", "verb", "conflict_digest"} or "sequence" not in d:
            raise Refused("unknown fields in a decision")
        want = conflict_digest(parent.digest, d["sequence"], conflicts.get(d["sequence"], []))
        if d.setdefault("conflict_digest", want) != want:
            raise Refused(f"operation {d['sequence']} has other conflicts by now")
    return raw["decisions"]


def resolved_plan(parent: Plan, checked_digest: str, status: str, operations: list[dict], decisions: list[dict], operator: str, reason: str, plan_id: str, created_at: str) -> Plan:
    """The plan with resolved operations; it is marked as unsafe and keeps the root of its chain."""
    if checked_digest != parent.digest:
        raise Refused("the check is of another plan")
    if status != "CONFLICT":
        raise Refused(f"a plan with the status {status} has nothing to resolve")
    if not operator or not reason:
        raise Refused("an operator and a reason are needed")
    if any(d["verb"] == "abort" for d in decisions):
        raise Refused("aborted")
    return replace(parent, plan_id=plan_id, created_at=created_at, operations=operations, execution_class="unsafe_resolved", root_digest=parent.root(), parent_digest=parent.digest, resolution={"operator": operator, "reason": reason, "decisions": decisions}).sealed()
