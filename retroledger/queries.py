"""The engine's queries over derived logs and literal fixtures, each with the same result in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import doctor, literals
from .functions import redact, values
from .literals import sql_values
from .model import CHANGE, ROW, contains, get, same_value, table_name
from .operators import actions, apply, check, index, resolve, transactions
from .plans import plan
from .sources import catalog, derived
from .sources.changelog import Scope, current_cursor, find, read_stream, scan

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

# ---- the derived logs in SQL ----------------------------------------------------------------------------------

ORDER_LOG = """lines AS (
  SELECT l_orderkey, l_returnflag, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS rn FROM lineitem),
cl AS (
  SELECT o_orderkey AS k, 'srv:' || o_orderkey AS txn_id, o_orderdate AS commit_time, 'binlog.' || lpad(CAST(CAST(floor(o_orderkey / 1000.0) AS BIGINT) + 1 AS VARCHAR), 6, '0') AS source_file,
    CAST(1 AS BIGINT) AS sequence, 'orders' AS tbl, CASE o_orderstatus WHEN 'O' THEN 'insert' WHEN 'P' THEN 'update' ELSE 'delete' END AS op, CAST(o_orderkey AS VARCHAR) AS key_text FROM orders
  UNION ALL
  SELECT o_orderkey, 'srv:' || o_orderkey, o_orderdate, 'binlog.' || lpad(CAST(CAST(floor(o_orderkey / 1000.0) AS BIGINT) + 1 AS VARCHAR), 6, '0'), rn + 1, 'lineitem',
    CASE l_returnflag WHEN 'N' THEN 'insert' WHEN 'A' THEN 'update' ELSE 'delete' END, l_orderkey || '/' || rn FROM lines JOIN orders ON l_orderkey = o_orderkey),
txn AS (
  SELECT k, txn_id, source_file, max(commit_time) AS commit_time, count(*) AS row_count, count(DISTINCT tbl) AS n_tables, CASE WHEN count(DISTINCT tbl) = 2 THEN 'shop.orders,shop.lineitem' ELSE 'shop.orders' END AS tables,
    count(*) FILTER (op = 'insert') AS n_insert, count(*) FILTER (op = 'update') AS n_update, count(*) FILTER (op = 'delete') AS n_delete FROM cl GROUP BY k, txn_id, source_file)"""
EVENT_LOG = """seen AS (
  SELECT *, lag(event_type) OVER w AS pt, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
ev AS (
  SELECT event_id, ts, user_id, CASE WHEN event_type = 'error' THEN 'delete' WHEN pt IS NOT NULL AND pt <> 'error' THEN 'update' ELSE 'insert' END AS op, pt, CAST(pv AS DECIMAL(18,2)) AS pv, event_type AS et, CAST(value AS DECIMAL(18,2)) AS v
  FROM seen WHERE event_type <> 'error' OR (pt IS NOT NULL AND pt <> 'error')),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM ev) WHERE n = 1),
live AS (SELECT user_id, et, v FROM last WHERE op <> 'delete'),
drift AS (
  SELECT user_id, et, CASE WHEN user_id % 10 = 3 THEN v + 1 ELSE v END AS v FROM live WHERE user_id % 10 <> 5
  UNION ALL SELECT user_id, 'view', 0.00 FROM last WHERE op = 'delete' AND user_id % 3 = 0),
judged AS (
  SELECT l.*, 'evt:' || event_id AS txn_id, CASE op WHEN 'insert' THEN 'delete' WHEN 'delete' THEN 'insert' ELSE 'update' END AS kind, d.user_id IS NOT NULL AS there, d.et AS cet, d.v AS cv FROM last l LEFT JOIN drift d USING (user_id)),
bad AS (
  SELECT *, CASE WHEN kind = 'insert' AND there THEN 'row_exists' WHEN kind <> 'insert' AND NOT there THEN 'row_missing' WHEN kind <> 'insert' AND (cet <> et OR cv <> v) THEN 'row_mismatch' END AS conflict FROM judged)"""


def query(sql: str | None = None, log: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = f"WITH {log}{sql}" if log else sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _tables(column: str = "tables") -> Column:
    return F.array_join(F.transform(column, lambda t: F.concat_ws(".", t["schema"], t["name"])), ",").alias("tables")


def _plain(row: str, column: str, kind: str = "string") -> Column:
    return values.plain(get(F.col(row), column)).cast(kind)


def _user(row: Column) -> Column:
    return values.plain(get(row, "user_id")).cast("long").alias("user_id")


# ---- transactions ---------------------------------------------------------------------------------------------

@query("SELECT txn_id, row_count, n_tables, n_insert, n_update, n_delete FROM txn", ORDER_LOG)
def txn_summary(spark, sf_dir):
    s = transactions.summary(derived.order_log(spark, sf_dir), max_bytes=None)
    return s.select("txn_id", "row_count", F.size("tables").cast("long").alias("n_tables"), "n_insert", "n_update", "n_delete")


@query("SELECT txn_id, tables FROM txn", ORDER_LOG)
def txn_tables(spark, sf_dir):
    return transactions.summary(derived.order_log(spark, sf_dir), max_bytes=None).select("txn_id", _tables())


@query("SELECT txn_id, commit_time, row_count AS rows, replace(tables, ',', ', ') AS tables, 'yes' AS reversible FROM txn ORDER BY commit_time, txn_id LIMIT 100", ORDER_LOG)
def txn_list_limit(spark, sf_dir):
    return transactions.listing(derived.order_log(spark, sf_dir), Scope(limit=100))


@query("SELECT txn_id, row_count FROM txn WHERE n_tables = 2", ORDER_LOG)
def txn_filter_table(spark, sf_dir):
    log = scan(derived.order_log(spark, sf_dir), Scope(database="shop", table="lineitem"))
    return transactions.summary(log, max_bytes=None).select("txn_id", "row_count")


@query("SELECT sequence, tbl, op FROM cl WHERE k = (SELECT max(l_orderkey) FROM lineitem)", ORDER_LOG)
def txn_show_rows(spark, sf_dir):
    last = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.max("l_orderkey")).head()[0]
    return find(derived.order_log(spark, sf_dir), f"srv:{last}", instance="srv").select("sequence", F.col("table.name").alias("tbl"), "op")


@query("SELECT max(source_file) AS file, max(k * 100 + sequence) + 1 AS start FROM cl WHERE source_file = (SELECT max(source_file) FROM cl)", ORDER_LOG)
def log_cursor(spark, sf_dir):
    c = current_cursor(derived.order_log(spark, sf_dir))
    return spark.createDataFrame([(c.file, c.start)], "file string, start long")


@query("SELECT txn_id, row_count, row_count <= 10 AS executable, CASE WHEN row_count > 10 THEN 'too many rows: ' || row_count || ' > 10' ELSE '' END AS reasons, CASE WHEN row_count > 10 THEN 0 ELSE row_count END AS images FROM txn", ORDER_LOG)
def oversize_guard(spark, sf_dir):
    s = transactions.summary(derived.order_log(spark, sf_dir), max_rows=10)
    images = F.when(F.col("executable"), F.col("row_count")).otherwise(0).alias("images")
    return s.select("txn_id", "row_count", "executable", F.array_join("reasons", "; ").alias("reasons"), images)


@query("SELECT txn_id, k % 97 <> 0 AS executable, CASE WHEN k % 97 = 0 THEN 'statement: ALTER TABLE orders' ELSE '' END AS reasons FROM txn", ORDER_LOG)
def executable_flag(spark, sf_dir):
    notes = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 97 = 0").select(F.concat(F.lit("srv:"), F.col("o_orderkey").cast("string")).alias("txn_id"), F.array(F.concat(F.lit("statement: "), transactions.first_line(F.lit("ALTER TABLE orders\nADD x int")))).alias("reasons"))
    s = transactions.summary(derived.order_log(spark, sf_dir), notes, max_bytes=None)
    return s.select("txn_id", "executable", F.array_join("reasons", "; ").alias("reasons"))


@query(f"SELECT sql, CASE WHEN upper(trim(sql)) SIMILAR TO '(CREATE TABLE|ALTER TABLE|TRUNCATE|GRANT|CREATE DATABASE).*' OR sql LIKE 'CREATE TABLE%' THEN 'ddl' ELSE 'row' END AS class, split_part(sql, chr(10), 1) AS first_line FROM {sql_values(literals.STATEMENTS, 'sql')}")
def ddl_classify(spark, sf_dir):
    df = spark.createDataFrame([(s,) for s in literals.STATEMENTS], "sql string")
    return df.select("sql", transactions.statement_class(F.col("sql")).alias("class"), transactions.first_line(F.col("sql")).alias("first_line"))


SCHEMAS = ("mysql", "shop", "SYS", "retro_meta", "information_schema", "performance_schema", "sysx")


@query(f"SELECT s FROM {sql_values(SCHEMAS, 's')} WHERE s IN ('shop', 'sysx')")
def system_table_filter(spark, sf_dir):
    return spark.createDataFrame([(s,) for s in SCHEMAS], "s string").where(~transactions.is_system(F.col("s")))


MARKED = ((1, "a0" * 16), (2, "a0"), (3, "0123456789abcdef" * 2), (4, "ff" * 17), (5, ""))


@query(f" SELECT 'srv:' || n AS txn_id, id AS action_id FROM {sql_values(MARKED, 'n, id')} WHERE length(id) = 32", "")
def marker_capture(spark, sf_dir):
    """Markers among the whole log; ids of other lengths than 16 bytes do not count."""
    log = derived.order_log(spark, sf_dir)
    v = F.struct(F.lit("binary").alias("kind"), F.lit(False).alias("is_null"), F.lit("base64").alias("encoding"), values.quoted(F.base64(F.unhex("id"))).alias("data"), F.lit("binary(16)").alias("native"))
    table = F.struct(F.lit("retro_meta").alias("schema"), F.lit("action_markers").alias("name"))
    after = F.array(F.struct(F.lit("action_id").alias("column"), v.alias("value")))
    given = {"source_file": F.lit("m"), "pos": F.col("n").cast("long"), "txn_id": F.concat(F.lit("srv:"), F.col("n").cast("string")), "sequence": F.lit(0).cast("long"), "table": table, "op": F.lit("insert"), "after": after}
    marks = spark.createDataFrame(list(MARKED), "n int, id string").select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CHANGE))
    return transactions.marker_ids(log.unionByName(marks))


_SID = "-".join((derived.SID.hex()[:8], derived.SID.hex()[8:12], derived.SID.hex()[12:16], derived.SID.hex()[16:20], derived.SID.hex()[20:]))


def _decoded(spark, sf_dir):
    return transactions.decode_events(derived.raw_events(spark, sf_dir), literals.columns(spark).where("table.name = 'state'"))


@query(f"""SELECT '{_SID}:' || event_id AS txn_id, CAST(1 AS BIGINT) AS sequence, op, user_id, CASE WHEN op <> 'insert' THEN pt END AS before_type, CASE WHEN op <> 'insert' THEN pv END AS before_value,
  CASE WHEN op <> 'delete' THEN et END AS after_type, CASE WHEN op <> 'delete' THEN v END AS after_value FROM ev WHERE user_id % 11 NOT IN (1, 3, 4, 5, 6) AND NOT (user_id % 11 = 2 AND op = 'update')""", EVENT_LOG)
def raw_decode_changes(spark, sf_dir):
    """Raw row events to changes; events that cannot be read whole give none."""
    made = _decoded(spark, sf_dir)[0]
    user = F.coalesce(values.plain(get(F.col("after"), "user_id")), values.plain(get(F.col("before"), "user_id"))).cast("long").alias("user_id")
    shown = [(f"{side}_{n}", side, c, k) for side in ("before", "after") for n, c, k in (("type", "event_type", "string"), ("value", "value", "decimal(18,2)"))]
    return made.select("txn_id", "sequence", "op", user, *(_plain(side, c, k).alias(name) for name, side, c, k in shown))


@query(f"""SELECT '{_SID}:' || event_id AS txn_id, why = '' AS executable, why AS reasons, CASE WHEN why = '' THEN 1 ELSE 0 END AS row_count FROM (SELECT *, CASE
  WHEN user_id % 11 = 1 THEN 'a row of shop.state has not as many values as columns' WHEN user_id % 11 = 2 AND op = 'update' THEN 'an update of shop.state lacks an image'
  WHEN user_id % 11 = 3 THEN 'columns of shop.state differ from the catalog' WHEN user_id % 11 = 4 THEN 'unknown row event PARTIAL_UPDATE_ROWS'
  WHEN user_id % 11 = 5 THEN 'statement: TRUNCATE state' WHEN user_id % 11 = 6 THEN 'rows of an unknown table, id ' || (event_id * 100 + 7) ELSE '' END AS why FROM ev)""", EVENT_LOG)
def raw_transaction_faults(spark, sf_dir):
    """Which raw transactions can be reverted, and why the others cannot."""
    s = transactions.summary(*_decoded(spark, sf_dir), max_bytes=None)
    return s.select("txn_id", "executable", F.array_join("reasons", "; ").alias("reasons"), "row_count")


# ---- index ----------------------------------------------------------------------------------------------------

INDEX = ORDER_LOG + """,
files AS (SELECT source_file, lead(source_file) OVER (ORDER BY source_file) AS next FROM (SELECT DISTINCT source_file FROM txn)),
again AS (SELECT t.*, next FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY k DESC) AS n FROM txn) t JOIN files USING (source_file) WHERE n <= 5 AND next IS NOT NULL)"""


def _index(spark, sf_dir):
    return index.deduplicated(index.entries(derived.overlapping(derived.order_log(spark, sf_dir))))


@query("SELECT txn_id, source_file, commit_time, row_count, tables, true AS executable FROM txn", ORDER_LOG)
def index_entries(spark, sf_dir):
    return index.entries(derived.order_log(spark, sf_dir)).select("txn_id", "source_file", "commit_time", "row_count", _tables(), "executable")


@query("SELECT txn_id, source_file, row_count FROM txn", INDEX)
def index_dedup(spark, sf_dir):
    return _index(spark, sf_dir).select("txn_id", "source_file", "row_count")


@query("SELECT (SELECT count(DISTINCT source_file) FROM txn) AS files, (SELECT count(*) FROM txn) AS transactions, (SELECT count(*) FROM again) AS duplicates", INDEX)
def index_counters(spark, sf_dir):
    return index.counters(index.entries(derived.overlapping(derived.order_log(spark, sf_dir))))


@query("SELECT txn_id, source_file, row_count FROM txn WHERE k = 77", ORDER_LOG)
def index_query_id(spark, sf_dir):
    return index.search(_index(spark, sf_dir), index.Filter(txn_id="srv:77")).select("txn_id", "source_file", "row_count")


@query("SELECT txn_id, commit_time FROM txn WHERE commit_time BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-06-30'", ORDER_LOG)
def index_query_time_range(spark, sf_dir):
    return index.search(_index(spark, sf_dir), index.Filter(since=datetime(1995, 1, 1), until=datetime(1995, 6, 30))).select("txn_id", "commit_time")


@query("SELECT txn_id FROM txn WHERE n_tables = 2", ORDER_LOG)
def index_query_db_table(spark, sf_dir):
    return index.search(_index(spark, sf_dir), index.Filter(database="shop", table="shop.lineitem")).select("txn_id")


@query("SELECT txn_id, source_file FROM txn ORDER BY source_file, k LIMIT 50", ORDER_LOG)
def index_query_limit(spark, sf_dir):
    return index.search(_index(spark, sf_dir), index.Filter(limit=50)).select("txn_id", "source_file")


_OLD_NEW = f"l AS {sql_values(literals.LISTINGS, 'c, side, name, size, day')}, " + "j AS (SELECT coalesce(o.c, n.c) AS c, coalesce(o.name, n.name) AS name, o.size AS os, n.size AS ns, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' WHEN o.size = n.size AND o.day = n.day THEN 'unchanged' ELSE 'changed' END AS change FROM (SELECT * FROM l WHERE side = 'old') o FULL JOIN (SELECT * FROM l WHERE side = 'new') n ON o.c = n.c AND o.name = n.name)"


def _cases(spark):
    seen = literals.listings(spark)
    for case in dict.fromkeys(x[0] for x in literals.LISTINGS):
        yield case, *(seen.where((F.col("case") == case) & (F.col("side") == side)) for side in ("old", "new"))


def _union(frames):
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


@query(' SELECT c AS "case", name, change FROM j', _OLD_NEW)
def index_file_changes(spark, sf_dir):
    return _union(index.file_changes(o, n).select(F.lit(c).alias("case"), "name", "change") for c, o, n in _cases(spark))


@query(" SELECT c AS \"case\", CASE WHEN count(*) FILTER (change <> 'unchanged') = 0 THEN 'CURRENT' ELSE 'STALE' END AS status FROM j GROUP BY c", _OLD_NEW)
def index_check(spark, sf_dir):
    return _union(index.is_current(index.file_changes(o, n)).select(F.lit(c).alias("case"), "status") for c, o, n in _cases(spark))


@query(" SELECT c AS \"case\", c IN ('unchanged', 'tail_grew', 'appended') AS accepted FROM j GROUP BY c", _OLD_NEW)
def index_safe_append(spark, sf_dir):
    return _union(index.update_plan(index.file_changes(o, n)).select(F.lit(c).alias("case"), "accepted") for c, o, n in _cases(spark))


@query("SELECT txn_id, source_file, row_count FROM txn", INDEX)
def index_update(spark, sf_dir):
    log = derived.overlapping(derived.order_log(spark, sf_dir))
    names = sorted(r[0] for r in log.select("source_file").distinct().collect())  # as many as files
    cut = names[-2:]
    old = index.deduplicated(index.entries(log.where(~F.col("source_file").isin(cut[1:]))))
    return index.updated(old, log, cut).select("txn_id", "source_file", "row_count")


# ---- plans ----------------------------------------------------------------------------------------------------

def _last_changes(spark, sf_dir):
    return derived.event_log(spark, sf_dir).join(derived.last_event_ids(spark, sf_dir).select("txn_id"), "txn_id", "left_semi")


def _revert(spark, sf_dir, with_columns: bool = False):
    return plan.operations(_last_changes(spark, sf_dir), literals.keys(spark), literals.columns(spark) if with_columns else None)


def _shown(ops: DataFrame) -> DataFrame:
    return ops.select("txn_id", "sequence", "kind", _user(F.col("key")), _plain("expect", "event_type").alias("expect_type"), _plain("expect", "value", "decimal(18,2)").alias("expect_value"), _plain("write", "event_type").alias("write_type"), _plain("write", "value", "decimal(18,2)").alias("write_value"))


@query("""SELECT 'evt:' || strftime(ts, '%Y-%m-%d-%H') AS txn_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d-%H') ORDER BY ts DESC, event_id DESC) AS sequence, CASE op WHEN 'insert' THEN 'delete' WHEN 'delete' THEN 'insert' ELSE op END AS kind, user_id,
  CASE WHEN op <> 'delete' THEN et END AS expect_type, CASE WHEN op <> 'delete' THEN v END AS expect_value, CASE WHEN op <> 'insert' THEN pt END AS write_type, CASE WHEN op <> 'insert' THEN pv END AS write_value FROM ev""", EVENT_LOG)
def plan_revert_ops(spark, sf_dir):
    return _shown(plan.operations(derived.event_log(spark, sf_dir, "hour"), literals.keys(spark)))


@query("""SELECT 'evt:' || strftime(ts, '%Y-%m-%d-%H') AS txn_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d-%H') ORDER BY ts, event_id) AS sequence, op AS kind, user_id,
  CASE WHEN op <> 'insert' THEN pt END AS expect_type, CASE WHEN op <> 'insert' THEN pv END AS expect_value, CASE WHEN op <> 'delete' THEN et END AS write_type, CASE WHEN op <> 'delete' THEN v END AS write_value FROM ev""", EVENT_LOG)
def plan_reapply_ops(spark, sf_dir):
    return _shown(plan.operations(derived.event_log(spark, sf_dir, "hour"), literals.keys(spark), mode="reapply"))


@query(_sql["plan_reapply_ops"])
def plan_reapply_from_root(spark, sf_dir):
    return _shown(plan.reapply_of(plan.operations(derived.event_log(spark, sf_dir, "hour"), literals.keys(spark))))


@query(_sql["plan_revert_ops"])
def plan_chained_revert(spark, sf_dir):
    return _shown(plan.reapply_of(plan.reapply_of(plan.operations(derived.event_log(spark, sf_dir, "hour"), literals.keys(spark)))))


@query("SELECT tbl, key_columns FROM (SELECT * FROM (VALUES ('orders', 'id'), ('lineitem', 'order_id,line'), ('state', 'user_id'), ('legacy', 'tenant_id,row_id')) v(tbl, key_columns))")
def plan_key_choice(spark, sf_dir):
    return catalog.always_usable_keys(literals.columns(spark), literals.keys(spark)).select(F.col("table.name").alias("tbl"), F.array_join("columns", ",").alias("key_columns"))


@query("SELECT txn_id, kind, CASE WHEN kind = 'delete' THEN '' ELSE 'user_id,event_type' END AS written FROM judged", EVENT_LOG)
def plan_drop_generated(spark, sf_dir):
    return _revert(spark, sf_dir, True).select("txn_id", "kind", F.coalesce(F.array_join(F.transform("write", lambda x: x["column"]), ","), F.lit("")).alias("written"))


_LISTED = f"""c AS {sql_values(literals.COLUMNS, 't, ordinal, name, native, nullable, generated')}, k AS {sql_values(literals.KEYS, 't, name, is_primary, cols')}, t AS {sql_values(literals.TABLES, 't')},
cs AS (SELECT t, string_agg('col[' || ordinal || ']=' || name || '|' || native || '|' || CASE WHEN nullable THEN 'null' ELSE 'not null' END || '|' || CASE WHEN generated THEN 'generated' ELSE 'stored' END, chr(10) ORDER BY ordinal) AS x FROM c GROUP BY t),
ks AS (SELECT t, string_agg('key=' || name || '(' || cols || ')', chr(10) ORDER BY NOT is_primary, name) AS x FROM k GROUP BY t)"""


@query(" SELECT t AS tbl, 'sha256:' || sha256(concat_ws(chr(10), 'table=shop.' || t, 'engine=InnoDB', 'charset=utf8mb4', 'collation=utf8mb4_bin', cs.x, ks.x)) AS fingerprint FROM t LEFT JOIN cs USING (t) LEFT JOIN ks USING (t)", _LISTED)
def schema_fingerprint(spark, sf_dir):
    return catalog.fingerprints(literals.tables(spark), literals.columns(spark), literals.keys(spark)).select(F.col("table.name").alias("tbl"), "fingerprint")


@query("SELECT txn_id, 'no usable unique key: shop.keyless' AS reason FROM judged WHERE user_id % 3 = 0 UNION ALL SELECT txn_id, 'unknown operation' FROM judged WHERE user_id % 3 = 1 AND op = 'update'", EVENT_LOG)
def plan_refusals(spark, sf_dir):
    """Why operations cannot be planned: tables without a key, and operations of unknown kinds."""
    user = F.coalesce(values.plain(get(F.col("after"), "user_id")), values.plain(get(F.col("before"), "user_id"))).cast("long")
    keyless = F.struct(F.lit("shop").alias("schema"), F.lit("keyless").alias("name"))
    rows = _last_changes(spark, sf_dir).withColumn("table", F.when(user % 3 == 0, keyless).otherwise(F.col("table")))
    ops = plan.operations(rows.withColumn("op", F.when((user % 3 == 1) & (F.col("op") == "update"), "merge").otherwise(F.col("op"))), literals.keys(spark))
    return plan.faults(ops)


# ---- check ----------------------------------------------------------------------------------------------------

def _drifted(spark, sf_dir):
    return derived.state_rows(derived.event_state(spark, sf_dir, drifted=True))


def _conflicts(spark, sf_dir):
    return check.conflicts(check.matched(_revert(spark, sf_dir), _drifted(spark, sf_dir)))


@query("SELECT txn_id, conflict AS kind FROM bad WHERE conflict IS NOT NULL", EVENT_LOG)
def check_conflicts(spark, sf_dir):
    return _conflicts(spark, sf_dir).select("txn_id", "kind").distinct()


@query("SELECT txn_id, 'value' AS \"column\", CAST(v AS DECIMAL(18,2)) AS expected, CAST(cv AS DECIMAL(18,2)) AS actual FROM bad WHERE conflict = 'row_mismatch'", EVENT_LOG)
def check_column_diff(spark, sf_dir):
    told = lambda c: F.replace(c, F.lit('"'), F.lit("")).cast("decimal(18,2)")
    return _conflicts(spark, sf_dir).where("kind = 'row_mismatch'").select("txn_id", "column", told(F.col("expected")).alias("expected"), told(F.col("actual")).alias("actual"))


@query("SELECT txn_id, CASE WHEN conflict IS NULL THEN 0 ELSE 1 END AS n_conflicts, CASE WHEN conflict IS NULL THEN 'READY' ELSE 'CONFLICT' END AS status FROM bad", EVENT_LOG)
def check_status(spark, sf_dir):
    ops = _revert(spark, sf_dir)
    return check.status(check.conflicts(check.matched(ops, _drifted(spark, sf_dir))), ops)


@query("SELECT 'instance_mismatch' AS kind, 'srv-a' AS expected, 'srv-b' AS actual, 'SOURCE_MISMATCH' AS status")
def check_instance_mismatch(spark, sf_dir):
    rows = check.instance_check("srv-a", "srv-b") + check.instance_check("srv-a", "srv-a")
    return spark.createDataFrame([tuple(r[k] for k in ("kind", "expected", "actual", "status")) for r in rows], "kind string, expected string, actual string, status string")


@query("SELECT txn_id, 'STALE_SCHEMA' AS status FROM bad", EVENT_LOG)
def check_stale_schema(spark, sf_dir):
    before = catalog.fingerprints(literals.tables(spark), literals.columns(spark), literals.keys(spark))
    after = catalog.fingerprints(literals.tables(spark), literals.columns(spark).withColumn("nullable", F.lit(True)), literals.keys(spark))
    ops = _revert(spark, sf_dir)
    found = check.conflicts(check.matched(ops, _drifted(spark, sf_dir)))
    return check.status(found, ops, check.schema_checks(before, after), ops).select("txn_id", "status")


@query("SELECT txn_id FROM (SELECT 'evt:' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS txn_id, count(*) AS n FROM ev GROUP BY 1) WHERE n > 1", EVENT_LOG)
def check_repeated_keys(spark, sf_dir):
    return check.repeated_keys(plan.operations(derived.event_log(spark, sf_dir, "day"), literals.keys(spark)))


def _many(spark, sf_dir):
    """The last changes of users as transactions of many operations each."""
    user = F.coalesce(values.plain(get(F.col("after"), "user_id")), values.plain(get(F.col("before"), "user_id"))).cast("long")
    rows = _last_changes(spark, sf_dir).withColumn("sequence", user).withColumn("txn_id", F.concat(F.lit("grp:"), (user % 20).cast("string")))
    return plan.operations(rows, literals.keys(spark))


@query("SELECT 'grp:' || (user_id % 20) AS txn_id, count(conflict) AS n_conflicts, CASE WHEN count(conflict) > 0 THEN 'CONFLICT' ELSE 'READY' END AS status FROM bad GROUP BY 1", EVENT_LOG)
def check_many_operations(spark, sf_dir):
    ops = _many(spark, sf_dir)
    return check.status(check.conflicts(check.matched(ops, _drifted(spark, sf_dir))), ops)


ODD = ((1, "merge", "7"), (2, "delete", None), (3, "delete", "9"), (4, None, "9"), (5, "insert", "9"))


@query(f"SELECT CAST(n AS BIGINT) AS sequence, CASE WHEN op IS NULL OR op NOT IN ('insert', 'update', 'delete') THEN 'unsupported_op' WHEN k IS NULL THEN 'key_missing' ELSE 'row_missing' END AS kind FROM {sql_values(ODD, 'n, op, k')} WHERE op IS DISTINCT FROM 'insert'")
def check_odd_operations(spark, sf_dir):
    """Unknown operations and rows without a key, against a table that holds nothing."""
    row = values.row({"user_id": ("bigint", F.col("k"))})
    table = F.struct(F.lit("shop").alias("schema"), F.lit("state").alias("name")).alias("table")
    ops = spark.createDataFrame(list(ODD), "n long, op string, k string").select(F.lit("t").alias("txn_id"), F.col("n").alias("sequence"), table, F.col("op").alias("kind"), row.alias("key"), row.alias("expect"), row.alias("write"))
    return check.conflicts(check.matched(ops, spark.createDataFrame([], apply.check_schema()))).select("sequence", "kind").distinct()


@query("SELECT t AS tbl, CASE WHEN t = 'legacy' THEN NULL ELSE t <> 'loose' END AS matches FROM " + sql_values(literals.TABLES, "t"))
def check_unreadable_fingerprint(spark, sf_dir):
    """Planned fingerprints against a catalog that has lost one table and changed another."""
    cols, keys, tables = literals.columns(spark), literals.keys(spark), literals.tables(spark)
    now = catalog.fingerprints(tables.where("table.name <> 'legacy'"), cols.withColumn("nullable", F.when(F.col("table.name") == "loose", F.lit(False)).otherwise(F.col("nullable"))), keys)
    return check.schema_checks(catalog.fingerprints(tables, cols, keys), now).select(F.col("table.name").alias("tbl"), "matches")


NUMBERS = (("1.000000000001", "1.000000000002"), ("1.50", "1.5"), ("+007", "7"), ("-0.0", "0"), ("123456789012345678901234567890", "123456789012345678901234567891"), ("-12.340", "-12.34"), (".5", "0.50"), ("3.", "3"))


@query(f"SELECT a, b, CAST(a AS DECIMAL(38,8)) = CAST(b AS DECIMAL(38,8)) AND CAST(ltrim(split_part(a || '.', '.', 2) || '000000000000', '') AS VARCHAR)[1:12] = CAST(split_part(b || '.', '.', 2) || '000000000000' AS VARCHAR)[1:12] AS same FROM {sql_values(NUMBERS, 'a, b')}")
def check_decimal_scale(spark, sf_dir):
    """Decimals of any length and spelling, by number."""
    v = lambda c: values.value("decimal(65,30)", F.col(c))
    return spark.createDataFrame(list(NUMBERS), "a string, b string").select("a", "b", same_value(v("a"), v("b")).alias("same"))


@query(f"SELECT n.a AS expected, count(*) AS rows FROM {sql_values(NUMBERS, 'a, b')} n, {sql_values(NUMBERS, 'a, b')} m WHERE CAST(n.a AS DECIMAL(38,7)) = CAST(m.a AS DECIMAL(38,7)) GROUP BY n.a")
def key_long_decimal(spark, sf_dir):
    """Rows found under decimal keys, some longer than any fixed-point type holds with a scale."""
    table = F.struct(F.lit("shop").alias("schema"), F.lit("wide").alias("name")).alias("table")
    row = values.row({"id": ("decimal(65,30)", F.col("a"))}).alias("row")
    state = spark.createDataFrame(list(NUMBERS), "a string, b string").select(table, row)
    ops = spark.createDataFrame(list(NUMBERS), "a string, b string").select(F.col("a").alias("txn_id"), F.lit(1).cast("long").alias("sequence"), table, F.lit("delete").alias("kind"), row.alias("key"), row.alias("expect"), F.lit(None).cast(ROW).alias("write"))
    found = check.matched(ops, state).where("current is not null")
    return found.groupBy(F.col("txn_id").alias("expected")).agg(F.count(F.lit(1)).alias("rows"))


# ---- resolve --------------------------------------------------------------------------------------------------

def _resolved(spark, sf_dir, verb: str):
    found = check.matched(_revert(spark, sf_dir), _drifted(spark, sf_dir))
    kinds = resolve.grouped(check.conflicts(found))
    return resolve.resolved(found, kinds, kinds.select("txn_id", "sequence", F.lit(verb).alias("verb")))


@query("""SELECT txn_id, outcome, CASE WHEN outcome = 'overwritten' AND conflict = 'row_exists' THEN 'update' WHEN outcome = 'overwritten' AND conflict = 'row_missing' THEN 'insert' ELSE kind END AS kind FROM (
  SELECT *, CASE WHEN conflict IS NULL THEN 'kept' WHEN conflict = 'row_missing' AND kind = 'delete' THEN 'dropped' WHEN conflict IN ('row_mismatch', 'row_exists') AND kind <> 'delete' AND cet = pt AND cv = pv THEN 'dropped' ELSE 'overwritten' END AS outcome FROM bad)""", EVENT_LOG)
def resolve_overwrite(spark, sf_dir):
    return _resolved(spark, sf_dir, "overwrite").select("txn_id", "outcome", "kind")


@query("SELECT txn_id, CAST(1 AS BIGINT) AS sequence, kind FROM bad WHERE conflict IS NULL", EVENT_LOG)
def resolve_skip(spark, sf_dir):
    return resolve.surviving(_resolved(spark, sf_dir, "skip")).select("txn_id", "sequence", "kind")


@query("SELECT txn_id, CAST(1 AS BIGINT) AS sequence, CASE WHEN user_id % 2 = 0 THEN 'conflict without a decision' ELSE 'aborted' END AS fault FROM bad WHERE conflict IS NOT NULL", EVENT_LOG)
def resolve_coverage(spark, sf_dir):
    found = _conflicts(spark, sf_dir)
    users = derived.last_event_ids(spark, sf_dir)
    decided = resolve.grouped(found).join(users.where("user_id % 2 = 1"), "txn_id", "left_semi").select("txn_id", "sequence", F.lit("abort").alias("verb"))
    return resolve.coverage(found, decided)


# ---- apply ----------------------------------------------------------------------------------------------------

def _state_shown(rows: DataFrame) -> DataFrame:
    return rows.select(_user(F.col("row")), _plain("row", "event_type").alias("event_type"), _plain("row", "value", "decimal(18,2)").alias("value"))


@query("SELECT user_id, pt AS event_type, pv AS value FROM last WHERE op <> 'insert'", EVENT_LOG)
def apply_revert_state(spark, sf_dir):
    return _state_shown(apply.new_state(derived.state_rows(derived.event_state(spark, sf_dir)), _revert(spark, sf_dir)))


@query("SELECT txn_id, CASE WHEN conflict IS NULL AND NOT (kind = 'update' AND et = pt AND v = pv) THEN 'READY' ELSE 'CONFLICT' END AS status, CAST(CASE WHEN conflict IS NULL AND NOT (kind = 'update' AND et = pt AND v = pv) THEN 1 ELSE 0 END AS BIGINT) AS affected FROM bad", EVENT_LOG)
def apply_verdict(spark, sf_dir):
    return apply.verdict(_revert(spark, sf_dir), _drifted(spark, sf_dir))


@query("""SELECT 'grp:' || (user_id % 20) AS txn_id, CASE WHEN count(*) FILTER (wrong) > 0 THEN 'CONFLICT' ELSE 'READY' END AS status, CASE WHEN count(*) FILTER (wrong) > 0 THEN 0 ELSE count(*) END AS affected
  FROM (SELECT *, conflict IS NOT NULL OR (kind = 'update' AND et = pt AND v = pv) AS wrong FROM bad) GROUP BY 1""", EVENT_LOG)
def apply_many_operations(spark, sf_dir):
    return apply.verdict(_many(spark, sf_dir), _drifted(spark, sf_dir))


@query("SELECT 'grp:' || (user_id % 20) AS txn_id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY user_id DESC) AS sequence, user_id, kind FROM bad WHERE conflict IS NULL", EVENT_LOG)
def resolve_skip_many(spark, sf_dir):
    """Transactions of many operations with those in conflict skipped; the others are numbered anew."""
    found = check.matched(_many(spark, sf_dir), _drifted(spark, sf_dir))
    kinds = resolve.grouped(check.conflicts(found))
    left = resolve.surviving(resolve.resolved(found, kinds, kinds.select("txn_id", "sequence", F.lit("skip").alias("verb"))))
    return left.select("txn_id", "sequence", _user(F.col("key")), "kind")


TWINS = ((1, "a"), (2, None), (2, None), (3, "b"), (3, None), (3, None), (3, None))


@query(f"SELECT n, code, count(*) AS copies FROM {sql_values(TWINS, 'n, code')} WHERE code IS DISTINCT FROM 'a' GROUP BY ALL")
def apply_duplicate_rows(spark, sf_dir):
    """Rows that are equal, with a null in their unique key, outlive the deletion of another row."""
    table = F.struct(F.lit("shop").alias("schema"), F.lit("loose").alias("name")).alias("table")
    row = values.row({"code": ("varchar(8)", F.col("code")), "n": ("bigint", F.col("n"))}).alias("row")
    state = spark.createDataFrame(list(TWINS), "n long, code string").select(table, row)
    key = values.row({"code": ("varchar(8)", F.lit("a"))}).alias("key")
    ops = state.where(values.plain(get(F.col("row"), "code")) == "a").select(F.lit("t").alias("txn_id"), F.lit(1).cast("long").alias("sequence"), "table", F.lit("delete").alias("kind"), key, F.col("row").alias("expect"), F.lit(None).cast(ROW).alias("write"))
    left = apply.new_state(state, ops)
    return left.groupBy(_plain("row", "n", "long").alias("n"), _plain("row", "code").alias("code")).agg(F.count(F.lit(1)).alias("copies"))


@query("SELECT 'all' AS txn_id, 'CONFLICT' AS status, CAST(0 AS BIGINT) AS affected", EVENT_LOG)
def apply_atomic_conflict(spark, sf_dir):
    return apply.verdict(_revert(spark, sf_dir).withColumn("txn_id", F.lit("all")), _drifted(spark, sf_dir))


@query("SELECT user_id, et AS event_type, v AS value FROM live", EVENT_LOG)
def revert_reapply_roundtrip(spark, sf_dir):
    root = _revert(spark, sf_dir)
    reverted = apply.new_state(derived.state_rows(derived.event_state(spark, sf_dir)), root)
    return _state_shown(apply.new_state(reverted, plan.reapply_of(root)))


def _own_folder(spark, name: str) -> str:
    """A new folder below the shared one of the session; a local one only where all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        root = f"file://{tempfile.gettempdir()}/retroledger"
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


@query("SELECT * FROM (VALUES (1, 'applied', 1), (2, 'ReplayBlocked', 0), (3, 'applied', 1)) v(step, outcome, affected)")
def apply_replay_blocked(spark, sf_dir):
    """One transaction is reverted in a store, the same plan is refused, and its reapply goes through."""
    from .functions.canonical import ulid

    store = apply.Store(spark, _own_folder(spark, "store"))
    store.bootstrap(derived.state_rows(derived.event_state(spark, sf_dir)))
    live = derived.last_event_ids(spark, sf_dir).join(derived.event_state(spark, sf_dir), "user_id", "left_semi").agg(F.min("user_id").alias("u")).head()["u"]
    txn = derived.last_event_ids(spark, sf_dir).where(F.col("user_id") == live).head()["txn_id"]
    log = derived.event_log(spark, sf_dir).where(F.col("txn_id") == txn)
    made = plan.build(transactions.summary(log).head().asDict(), plan.operations(log, literals.keys(spark)), {}, "revert", "srv", ulid(1, bytes(10)), "2024-01-01", "1")
    first, out = ulid(2, bytes(10)), []
    again = plan.next_in_chain(spark, made, "reapply", first, 0, ulid(4, bytes(10)), "2024-01-01")
    for step, (p, action) in enumerate(((made, first), (made, ulid(3, bytes(10))), (again, ulid(5, bytes(10)))), 1):
        try:
            out.append((step, "applied", store.apply(p, apply.Options(action, "op", "1", p.digest), "2024-01-01", "srv")["affected"]))
        except apply.ApplyError as e:
            out.append((step, type(e).__name__, 0))
    return spark.createDataFrame(out, "step int, outcome string, affected int")


# ---- actions --------------------------------------------------------------------------------------------------

_ACTIONS = f"a AS {sql_values(literals.ACTIONS, 'action_id, plan_id, parent, root, type, state, depth, digest')}"


@query(" SELECT root AS root_plan_digest, arg_max(action_id, depth) AS action_id, CAST(max(depth) AS INTEGER) AS chain_depth FROM a GROUP BY root", _ACTIONS)
def action_latest(spark, sf_dir):
    return actions.latest(literals.actions(spark)).select("root_plan_digest", "action_id", "chain_depth")


@query(" SELECT root AS root_plan_digest, count(*) AS length, CASE root WHEN 'r3' THEN 'parent' WHEN 'r4' THEN 'too deep' END AS fault FROM a GROUP BY root", _ACTIONS)
def action_chain_valid(spark, sf_dir):
    return actions.chain(literals.actions(spark), max_depth=3)


@query("SELECT * FROM (VALUES ('a1', 'COMMITTED'), ('b0', 'INDETERMINATE'), ('x9', 'NOT_COMMITTED')) v(action_id, outcome)")
def action_verify(spark, sf_dir):
    wanted = spark.createDataFrame([("a1", "p1", "d1", "src-r1"), ("b0", "q0", "other", "src-r2"), ("x9", "p9", "d9", "src-r1")], "action_id string, plan_id string, plan_digest string, source_txn string")
    return actions.outcomes(wanted, literals.actions(spark))


# ---- values and redaction -------------------------------------------------------------------------------------

@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'NULL' WHEN strlen(text) > 32 THEN '<text len=' || strlen(text) || '>' ELSE text END AS shown FROM documents")
def redact_rows(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", redact.text_summary("text", F.col("text")).alias("shown"))


@query("SELECT * FROM (VALUES (0, '', ''), (1, 'alpha', 'red'), (2, 'beta', 'green'), (3, '雪', 'red,green'), (4, NULL, '蓝'), (5, NULL, 'red,蓝'), (8, NULL, NULL)) v(n, label, labels)")
def value_enum_set(spark, sf_dir):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 8)], "n int")
    lists = [F.array(*map(F.lit, x)) for x in (literals.ENUM, literals.SET)]
    return df.select("n", values.enum_label(F.col("n"), lists[0]).alias("label"), values.set_labels(F.col("n"), lists[1]).alias("labels"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 2 = 0 AND l_partkey > 0 THEN CAST(18446744073709551616 - l_partkey AS DECIMAL(20,0)) ELSE CAST(l_partkey AS DECIMAL(20,0)) END AS n FROM lineitem")
def value_unsigned(spark, sf_dir):
    signed = F.when(F.col("l_partkey") % 2 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", values.unsigned(signed).alias("n"))


DECIMALS = ("1.50", "+2", "-.5", "3.", " 7.25 ", "abc", "1e5", "", ".")


@query(f"SELECT s, CASE WHEN regexp_matches(trim(s), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN trim(s) END AS d FROM {sql_values(DECIMALS, 's')}")
def value_decimal(spark, sf_dir):
    return spark.createDataFrame([(s,) for s in DECIMALS], "s string").select("s", values.decimal_text(F.col("s")).alias("d"))


@query("SELECT p_partkey, to_base64(CAST(p_name AS BLOB)) AS b FROM part")
def value_base64(spark, sf_dir):
    v = values.value("varbinary(255)", F.col("p_name"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", values.unquoted(v["data"]).alias("b"))


@query("SELECT p_partkey, p_name AS name, CAST(p_partkey % 256 AS INTEGER) AS bits FROM part")
def value_raw_bytes(spark, sf_dir):
    """Binary and bit values, encoded and read back as bytes."""
    name, bits = values.value("varbinary(255)", F.col("p_name")), values.value("bit(8)", (F.col("p_partkey") % 256).cast("string"))
    number = F.conv(F.hex(values.raw_bytes(bits)), 16, 10).cast("int").alias("bits")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", values.raw_bytes(name).cast("string").alias("name"), number)


@query("SELECT event_id, make_timestamp(event_id * 1000003) AS at FROM events")
def value_micros(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", values.from_micros(F.col("event_id") * 1_000_003).alias("at"))


@query("SELECT event_id, true AS same FROM events")
def value_json_equal(spark, sf_dir):
    """JSON columns are compared by content, whatever the order of fields and the white space."""
    spaced = F.concat(F.lit(' {"z": 1,  "p": '), F.col("props"), F.lit("}"))
    tight = F.concat(F.lit('{"p":'), F.col("props"), F.lit(',"z":1}'))
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", spaced.alias("doc"), tight.alias("other"))
    return df.select("event_id", values.predicate([{"doc": F.col("other")}], {"doc": "json"}).alias("same"))


@query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS j FROM events")
def value_json_canonical(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", values.json_text(F.col("props")).alias("j"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(native, '^({names})') THEN '{kind}'" for kind, names in values.PREFIXES) + " END"


@query(f"""SELECT native, raw, kind, CASE kind WHEN 'integer' THEN 'json' WHEN 'text' THEN 'utf8' WHEN 'binary' THEN 'base64' WHEN 'json' THEN 'json-canonical' ELSE 'string' END AS encoding,
  CASE kind WHEN 'integer' THEN plain ELSE CAST(to_json(plain) AS VARCHAR) END AS data, plain, true AS valid FROM (
  SELECT native, raw, kind, CASE kind WHEN 'integer' THEN CAST(CASE WHEN native LIKE '%unsigned' AND raw LIKE '-%' THEN CAST(raw AS HUGEINT) + 18446744073709551616 ELSE CAST(trim(raw) AS HUGEINT) END AS VARCHAR)
    WHEN 'binary' THEN to_base64(encode(raw)) WHEN 'json' THEN '{{"a":' || CAST(raw -> 'a' AS VARCHAR) || ',"b":' || CAST(raw -> 'b' AS VARCHAR) || '}}' WHEN 'text' THEN raw ELSE trim(raw) END AS plain
  FROM (SELECT native, raw, {_KIND} AS kind FROM {sql_values(literals.SCALARS, 'native, raw')}))""")
def value_scalars(spark, sf_dir):
    """All kinds of values, encoded and read back."""
    df = spark.createDataFrame(list(literals.SCALARS), "native string, raw string")
    return df.withColumn("v", values.value(F.col("native"), F.col("raw"))).select("native", "raw", "v.kind", "v.encoding", "v.data", values.plain(F.col("v")).alias("plain"), values.valid(F.col("v")).alias("valid"))


# ---- streaming, environment -----------------------------------------------------------------------------------

@query("SELECT 'evt:' || strftime(ts, '%Y-%m-%d-%H') AS txn_id, count(*) AS row_count, CAST(1 AS BIGINT) AS n_tables, count(*) FILTER (op = 'insert') AS n_insert, count(*) FILTER (op = 'update') AS n_update, count(*) FILTER (op = 'delete') AS n_delete, count(*) <= 1000 AS executable, CASE WHEN count(*) <= 1000 THEN count(*) ELSE 0 END AS images, CASE WHEN count(*) <= 1000 THEN '' ELSE 'too many rows: ' || count(*) || ' > 1000' END AS reasons FROM ev GROUP BY 1", EVENT_LOG)
def stream_txn_assembly(spark, sf_dir):
    """The hourly log as a stream over files, assembled until all is read; the result is what a batch gives."""
    from .streaming import assembly

    folder = _own_folder(spark, "stream")
    rows = assembly.with_commits(derived.event_log(spark, sf_dir, "hour"))
    rows.write.parquet(f"{folder}/log")
    made = assembly.assemble(spark.readStream.schema(rows.schema).parquet(f"{folder}/log"))
    made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    counts = [transactions.rows_of(F.col("row_count"), F.col("rows")).alias("row_count"), "n_insert", "n_update", "n_delete"]
    return out.select("txn_id", *counts, F.size("tables").cast("long").alias("n_tables"), "executable", F.size("rows").cast("long").alias("images"), F.array_join("reasons", "; ").alias("reasons"))


@query("SELECT op, count(*) AS n FROM ev GROUP BY op", EVENT_LOG)
def stream_log_rows(spark, sf_dir):
    """The event log read as it grows."""
    folder = _own_folder(spark, "log")
    derived.event_log(spark, sf_dir).write.parquet(f"{folder}/log")
    rows = read_stream(spark, f"{folder}/log").select("op")
    rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('clean', false), ('warned', false), ('broken', true)) v(report, fatal)")
def doctor_severity(spark, sf_dir):
    reports = (("clean", ("OK", "OK")), ("warned", ("OK", "WARN")), ("broken", ("WARN", "ERROR")))
    return _union(doctor.fatal(spark.createDataFrame([(s,) for s in lines], "severity string")).select(F.lit(name).alias("report"), "fatal") for name, lines in reports)


@query("SELECT user_id, true AS same FROM live", EVENT_LOG)
def row_contains(spark, sf_dir):
    """A row holds itself, also with its decimals spelled otherwise."""
    rows = derived.state_rows(derived.event_state(spark, sf_dir))
    longer = F.transform("row", lambda x: F.when(x["value"]["kind"] == "decimal", x.withField("value.data", F.concat(F.left(x["value"]["data"], F.length(x["value"]["data"]) - 1), F.lit('00"')))).otherwise(x))
    return rows.select(_user(F.col("row")), contains(F.col("row"), longer).alias("same"))


@query("SELECT DISTINCT 'shop.' || tbl AS name FROM cl", ORDER_LOG)
def touched_tables(spark, sf_dir):
    return derived.order_log(spark, sf_dir).select(table_name("table").alias("name")).distinct()
