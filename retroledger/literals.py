"""Small literal fixtures: catalogs, actions, file listings, statements. The same values in Spark and in SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from .model import TABLE_REF

#: table, ordinal, name, native type, nullable, generated
COLUMNS = (
    ("orders", 1, "id", "bigint", False, False), ("orders", 2, "status", "varchar(1)", False, False), ("orders", 3, "total", "decimal(18,2)", True, False),
    ("lineitem", 1, "order_id", "bigint", False, False), ("lineitem", 2, "line", "bigint", False, False), ("lineitem", 3, "quantity", "decimal(18,2)", True, False), ("lineitem", 4, "price", "decimal(18,2)", True, False),
    ("state", 1, "user_id", "bigint", False, False), ("state", 2, "event_type", "varchar(16)", False, False), ("state", 3, "value", "decimal(18,2)", True, True),
    ("keyless", 1, "note", "text", True, False), ("loose", 1, "code", "varchar(8)", True, False), ("loose", 2, "note", "text", True, False),
    ("legacy", 1, "tenant_id", "bigint", False, False), ("legacy", 2, "row_id", "bigint", False, False), ("legacy", 3, "code", "varchar(8)", False, False),
)
#: table, key, primary, columns
KEYS = (
    ("orders", "PRIMARY", True, ("id",)), ("lineitem", "PRIMARY", True, ("order_id", "line")), ("state", "PRIMARY", True, ("user_id",)),
    ("loose", "code_u", False, ("code",)), ("legacy", "a_code", False, ("code",)), ("legacy", "PRIMARY", True, ("tenant_id", "row_id")), ("legacy", "z_code", False, ("code",)),
)
TABLES = ("orders", "lineitem", "state", "keyless", "loose", "legacy")
#: action, plan, parent, root, type, state, depth, plan digest
ACTIONS = (
    ("a0", "p0", None, "r1", "REVERT", "REVERTED", 0, "r1"), ("a1", "p1", "a0", "r1", "REAPPLY", "APPLIED", 1, "d1"), ("a2", "p2", "a1", "r1", "REVERT", "REVERTED", 2, "d2"), ("a3", "p3", "a2", "r1", "REAPPLY", "APPLIED", 3, "d3"),
    ("b0", "q0", None, "r2", "REVERT", "REVERTED", 0, "r2"),
    ("c0", "s0", None, "r3", "REVERT", "REVERTED", 0, "r3"), ("c1", "s1", "zz", "r3", "REAPPLY", "APPLIED", 1, "e1"),
    ("d0", "t0", None, "r4", "REVERT", "REVERTED", 0, "r4"), ("d1", "t1", "d0", "r4", "REAPPLY", "APPLIED", 1, "f1"), ("d2", "t2", "d1", "r4", "REVERT", "REVERTED", 2, "f2"), ("d3", "t3", "d2", "r4", "REAPPLY", "APPLIED", 3, "f3"), ("d4", "t4", "d3", "r4", "REVERT", "REVERTED", 4, "f4"),
)
#: case, side, name, size, modified (day of a month)
LISTINGS = tuple(
    (case, side, name, size, day)
    for case, old, new in (
        ("unchanged", (("f1", 10, 1), ("f2", 5, 2)), (("f1", 10, 1), ("f2", 5, 2))),
        ("tail_grew", (("f1", 10, 1), ("f2", 5, 2)), (("f1", 10, 1), ("f2", 9, 3))),
        ("appended", (("f1", 10, 1), ("f2", 5, 2)), (("f1", 10, 1), ("f2", 5, 2), ("f3", 4, 3))),
        ("old_rewritten", (("f1", 10, 1), ("f2", 5, 2)), (("f1", 12, 3), ("f2", 5, 2))),
        ("tail_shrank", (("f1", 10, 1), ("f2", 5, 2)), (("f1", 10, 1), ("f2", 3, 3))),
        ("removed", (("f1", 10, 1), ("f2", 5, 2)), (("f2", 5, 2),)),
        ("earlier_came", (("f1", 10, 1), ("f2", 5, 2)), (("f0", 1, 1), ("f1", 10, 1), ("f2", 5, 2))),
    )
    for side, rows in (("old", old), ("new", new))
    for name, size, day in rows
)
STATEMENTS = ("CREATE TABLE t (a int)\nENGINE=x", "  alter table t add b int", "TRUNCATE t", "GRANT SELECT ON t TO u", "CREATE DATABASE d", "BEGIN", "INSERT INTO t VALUES (1)")
#: native type, value as text
SCALARS = (
    ("bigint unsigned", "-1"), ("bigint unsigned", "42"), ("int", "+0017"), ("int", " -5 "), ("decimal(30,10)", "-12345678901234567890.1234567890"), ("decimal(4,2)", "1.50"), ("varchar(9)", "a\"b"),
    ("varbinary(4)", "AB"), ("date", " 2024-01-02 "), ("time(6)", "-12:34:56.654321"), ("json", "{\"b\": 1, \"a\": [2, 3]}"), ("enum('alpha','beta')", "beta"), ("double", "1.25"),
)
ENUM, SET = ("alpha", "beta", "雪"), ("red", "green", "蓝")


def _ref(name: str = "t") -> object:
    return F.struct(F.lit("shop").alias("schema"), F.col(name).alias("name")).cast(TABLE_REF).alias("table")


def columns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COLUMNS), "t string, ordinal int, name string, native string, nullable boolean, generated boolean").select(_ref(), "ordinal", "name", "native", "nullable", "generated")


def keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, k, p, list(c)) for t, k, p, c in KEYS], "t string, key string, is_primary boolean, columns array<string>").select(_ref(), "key", "is_primary", "columns")


def tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TABLES], "t string").select(_ref(), F.lit("InnoDB").alias("engine"), F.lit("utf8mb4").alias("charset"), F.lit("utf8mb4_bin").alias("collation"))


def actions(spark: SparkSession) -> DataFrame:
    from .operators.actions import ACTION

    names = [x.split()[0] for x in ACTION.split(", ")]
    rows = []
    for a, p, parent, root, kind, state, depth, digest in ACTIONS:
        row = dict(action_id=a, plan_id=p, parent_action_id=parent, root_plan_digest=root, action_type=kind, target_state=state, chain_depth=depth, source_txn=f"src-{root}", plan_digest=digest, execution_class="safe", reason=None, tool_version="1", operator_name="op", created_at="2024-01-01")
        rows.append(tuple(row[n] for n in names))
    return spark.createDataFrame(rows, ACTION)


def listings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LISTINGS), "case string, side string, name string, size long, modified_at int")


def sql_values(rows: tuple, names: str) -> str:
    """The rows as a SQL table."""

    def told(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, tuple):
            return told(",".join(x))
        if isinstance(x, bool | int):
            return json.dumps(x)
        return "'" + str(x).replace("'", "''") + "'"

    listed = ", ".join("(" + ", ".join(told(x) for x in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {listed}) v({names}))"
