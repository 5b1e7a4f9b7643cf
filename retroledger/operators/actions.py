"""Action history: the latest action of each root, the chain of reverts and reapplies, and verification."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.plan import Plan

ACTION = "action_id string, plan_id string, parent_action_id string, root_plan_digest string, action_type string, target_state string, chain_depth int, source_txn string, plan_digest string, execution_class string, reason string, tool_version string, operator_name string, created_at string"


def find(actions: DataFrame, action_id: str) -> DataFrame:
    return actions.where(F.col("action_id") == action_id)


def latest(actions: DataFrame) -> DataFrame:
    """The action of greatest depth of each root."""
    whole = F.struct(*actions.columns)
    return actions.groupBy("root_plan_digest").agg(F.max_by(whole, F.struct("chain_depth", "action_id")).alias("a")).select("a.*")


def chain(actions: DataFrame, max_depth: int = 20) -> DataFrame:
    """root_plan_digest, length and fault: the first thing wrong with each chain, or null. Depths run from 0 without gaps,
    reverts and reapplies alternate from a revert on, and each action names the one before as its parent."""
    order = Window.partitionBy("root_plan_digest").orderBy("chain_depth", "action_id")
    seen = actions.withColumn("_n", F.row_number().over(order) - 1).withColumn("_parent", F.lag("action_id").over(order))
    wanted = F.when(F.col("chain_depth") % 2 == 0, "REVERT").otherwise("REAPPLY")
    fault = (
        F.when(F.col("chain_depth") != F.col("_n"), "depth")
        .when(F.col("chain_depth") > max_depth, "too deep")
        .when(F.col("action_type") != wanted, "type")
        .when(F.col("target_state") != F.when(F.col("action_type") == "REVERT", "REVERTED").otherwise("APPLIED"), "state")
        .when((F.col("chain_depth") == 0) & F.col("parent_action_id").isNotNull(), "root with a parent")
        .when((F.col("chain_depth") > 0) & ~F.col("parent_action_id").eqNullSafe(F.col("_parent")), "parent")
        .when((F.col("chain_depth") == 0) & (F.col("plan_digest") != F.col("root_plan_digest")), "root digest")
    )
    return seen.withColumn("_fault", fault).groupBy("root_plan_digest").agg(F.count(F.lit(1)).alias("length"), F.min_by("_fault", F.when(F.col("_fault").isNotNull(), F.col("_n"))).alias("fault"))


def chain_fault(plan: Plan, markers: list[dict], max_depth: int = 20) -> str | None:
    """Why a plan cannot follow the markers of its root; None if it can. The markers of one root are at most max_depth."""
    own = sorted((m for m in markers if m["root_plan_digest"] == plan.root()), key=lambda m: m["chain_depth"])
    if plan.depth > max_depth:
        return f"the chain is deeper than {max_depth}"
    if plan.depth == 0:
        return "the root has been applied" if own else None
    if not own or own[-1]["chain_depth"] != plan.depth - 1:
        return "the parent is not the latest action of the chain"
    parent = own[-1]
    if plan.parent_action != parent["action_id"]:
        return "the plan names another parent"
    if (plan.mode, parent["action_type"]) not in (("reapply", "REVERT"), ("revert", "REAPPLY")):
        return "reverts and reapplies alternate"
    if own[0]["chain_depth"] == 0 and own[0]["plan_digest"] != plan.root():
        return "the root is another plan"
    return None


def parent_fault(root: Plan, action: dict, newest: dict, mode: str, max_depth: int = 20) -> str | None:
    """Why no plan of a mode can be made after an action; None if it can."""
    want = ("REVERT", "REVERTED") if mode == "reapply" else ("REAPPLY", "APPLIED")
    if (action["action_type"], action["target_state"]) != want:
        return f"a {mode} follows an action of type {want[0]}"
    if action["root_plan_digest"] != root.digest:
        return "the action is of another root"
    if action["chain_depth"] == 0 and action["plan_digest"] != root.digest:
        return "the action ran another plan"
    if newest["action_id"] != action["action_id"]:
        return "a later action stands"
    if action["chain_depth"] + 1 > max_depth:
        return f"the chain is deeper than {max_depth}"
    return None


def outcomes(wanted: DataFrame, actions: DataFrame) -> DataFrame:
    """action_id and outcome of wanted (action_id, plan_id, plan_digest, source_txn): COMMITTED if a marker fits, NOT_COMMITTED
    if there is none, INDETERMINATE if there is one that does not fit."""
    m = actions.select("action_id", F.col("plan_id").alias("_p"), F.col("plan_digest").alias("_d"), F.col("source_txn").alias("_s"))
    fits = (F.col("plan_id") == F.col("_p")) & (F.col("plan_digest") == F.col("_d")) & (F.col("source_txn") == F.col("_s"))
    return wanted.join(m, "action_id", "left").select("action_id", F.when(F.col("_p").isNull(), "NOT_COMMITTED").when(fits, "COMMITTED").otherwise("INDETERMINATE").alias("outcome"))


def verify(read: Callable[[], list[dict]], instance: str, plan: Plan, action_id: str, wait: float = 0.0, poll: float = 0.25, sleep: Callable[[float], None] = time.sleep) -> str:
    """Looks for the marker until wait has passed; errors while reading and another instance are INDETERMINATE."""
    if instance != plan.instance:
        return "INDETERMINATE"
    left = wait
    while True:
        try:
            found = [m for m in read() if m["action_id"] == action_id]
        except OSError:
            return "INDETERMINATE"
        if found:
            m = found[0]
            return "COMMITTED" if (m["plan_id"], m["plan_digest"], m["source_txn"]) == (plan.plan_id, plan.digest, plan.source_txn) else "INDETERMINATE"
        if left <= 0:
            return "NOT_COMMITTED"
        sleep(min(poll, left))
        left -= poll
