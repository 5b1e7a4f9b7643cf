"""From change streams to transactions: event dispatch, decoding, grouping, guards and marker capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import values
from ..model import CHANGE, OPS, table_name
from ..sources.changelog import Scope, scan

#: Fixed: events that carry rows (old and new type numbers alike), and those that begin, end or describe.
ROW_EVENTS = {"WRITE_ROWS": "insert", "UPDATE_ROWS": "update", "DELETE_ROWS": "delete"}
KNOWN_EVENTS = ("GTID", "QUERY", "TABLE_MAP", "XID", *ROW_EVENTS)
SYSTEM_SCHEMAS = ("mysql", "information_schema", "performance_schema", "sys")
METADATA_SCHEMA, MARKER_TABLE = "retro_meta", "action_markers"
#: Fixed: statements that commit by themselves.
STATEMENTS = ("CREATE TABLE", "ALTER TABLE", "DROP TABLE", "TRUNCATE", "RENAME TABLE", "CREATE INDEX", "DROP INDEX", "CREATE DATABASE", "DROP DATABASE", "ALTER DATABASE", "CREATE VIEW", "DROP VIEW", "GRANT", "REVOKE", "CREATE USER", "DROP USER", "ALTER USER")
MAX_ROWS, MAX_BYTES = 1000, 64 << 20


def op_of(event: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, op in ROW_EVENTS.items():
        out = F.when(event.startswith(name), F.lit(op)).otherwise(out)
    return out


def txn_id_of(sid: Column, number: Column) -> Column:
    """uuid:number from 16 raw bytes."""
    h = F.lower(F.hex(sid))
    return F.concat(F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(":"), number.cast("string"))


def statement_class(sql: Column) -> Column:
    """'ddl' for statements that commit by themselves, else 'row'."""
    text = F.regexp_replace(F.upper(F.trim(sql)), r"\s+", " ")
    return F.when(text.rlike("^(" + "|".join(STATEMENTS) + r")\b"), "ddl").otherwise("row")


def first_line(sql: Column) -> Column:
    return F.split(sql, "\n")[0]


def is_system(schema: Column, metadata: str = METADATA_SCHEMA) -> Column:
    return F.lower(schema).isin(*SYSTEM_SCHEMAS, metadata)


def decode_events(events: DataFrame, columns: DataFrame, metadata: str = METADATA_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Changes, and what each transaction's events say besides rows (txn_id, reasons, marker_ids, committed).

    events: source_file, pos, event_type, event_time, sid, gno, table_id, schema, table, columns (names), rows (arrays of text
    cells; an update has before and after in turn) and sql. Row events find their table by table_id, so statements over
    several tables are read right. columns: the catalog. What cannot be read whole makes its transaction not executable and
    gives no changes: a table whose column names differ from the catalog's, a row with more or fewer cells than columns, an
    update with an image too few, an event without rows or whose table is not known, and an unknown event that carries
    rows."""
    order = Window.partitionBy("source_file").orderBy("pos")
    gtid = F.when(F.col("event_type") == "GTID", txn_id_of(F.col("sid"), F.col("gno")))
    of_table = Window.partitionBy("source_file", "table_id").orderBy("pos")
    mapped = F.when(F.col("event_type") == "TABLE_MAP", F.struct(F.col("schema"), F.col("table").alias("name"), F.col("columns")))
    seen = events.withColumn("txn_id", F.last(gtid, True).over(order)).withColumn("_map", F.when(F.col("table_id").isNotNull(), F.last(mapped, True).over(of_table)))
    known = columns.groupBy("table").agg(F.sort_array(F.collect_list(F.struct("ordinal", "name", "native"))).alias("_cols"))
    rows = seen.where(F.col("event_type").rlike("_ROWS")).withColumn("_t", F.struct(F.col("_map.schema").alias("schema"), F.col("_map.name").alias("name"))).join(known.withColumnRenamed("table", "_t"), "_t", "left").withColumn("op", op_of(F.col("event_type")))
    fits = F.col("_map.columns") == F.transform("_cols", lambda c: c["name"])
    marker = (F.col("_t.schema") == metadata) & (F.col("_t.name") == MARKER_TABLE)
    ours = ~is_system(F.col("_t.schema"), metadata)
    pair = F.when(F.col("op") == "update", F.transform(F.sequence(F.lit(0), F.floor(F.size("rows") / 2).cast("int") - 1), lambda i: F.struct(F.get("rows", 2 * i).alias("b"), F.get("rows", 2 * i + 1).alias("a"))))
    single = F.transform("rows", lambda r: F.struct(F.when(F.col("op") == "delete", r).alias("b"), F.when(F.col("op") == "insert", r).alias("a")))
    broad = F.exists("rows", lambda r: F.coalesce(F.size(r), F.lit(-1)) != F.size("_cols"))
    odd = (F.col("op") == "update") & (F.size("rows") % 2 != 0)
    reason = (
        F.when(F.col("op").isNull(), F.concat(F.lit("unknown row event "), "event_type"))
        .when(F.col("_map").isNull(), F.concat(F.lit("rows of an unknown table, id "), F.coalesce(F.col("table_id").cast("string"), F.lit("null"))))
        .when(ours & ~F.coalesce(fits, F.lit(False)), F.concat(F.lit("columns of "), table_name("_t"), F.lit(" differ from the catalog")))
        .when(ours & (F.coalesce(F.size("rows"), F.lit(0)) <= 0), F.concat(F.lit("an event of "), table_name("_t"), F.lit(" holds no rows")))
        .when(ours & broad, F.concat(F.lit("a row of "), table_name("_t"), F.lit(" has not as many values as columns")))
        .when(ours & odd, F.concat(F.lit("an update of "), table_name("_t"), F.lit(" lacks an image")))
    )
    good = rows.withColumn("_reason", reason).where(F.col("_reason").isNull() & ours)
    each = good.select("source_file", "pos", "txn_id", "event_time", "_t", "_cols", "op", F.posexplode(F.coalesce(pair, single)).alias("_i", "_p"))
    number = F.row_number().over(Window.partitionBy("txn_id").orderBy("source_file", "pos", "_i")).cast("long")
    ends = seen.where(F.col("event_type") == "XID").groupBy("txn_id").agg(F.max("event_time").alias("_end"))
    changes = each.join(ends, "txn_id", "left").select("source_file", "pos", "txn_id", F.coalesce("_end", "event_time").alias("commit_time"), number.alias("sequence"), F.col("_t").alias("table"), "op", values.decode_row(F.col("_cols"), F.col("_p.b")).alias("before"), values.decode_row(F.col("_cols"), F.col("_p.a")).alias("after"))
    ids = F.flatten(F.collect_set(F.when(marker & (F.col("op") == "insert"), F.filter(F.transform("rows", lambda r: F.get(r, 0)), lambda x: F.octet_length(x) == 16))))
    of_rows = rows.groupBy("txn_id").agg(F.collect_set(reason).alias("reasons"), ids.alias("marker_ids"))
    ddl = seen.where((F.col("event_type") == "QUERY") & (statement_class(F.col("sql")) == "ddl")).groupBy("txn_id").agg(F.min_by(F.concat(F.lit("statement: "), first_line(F.col("sql"))), "pos").alias("ddl"))
    every = seen.where("txn_id is not null").select("txn_id").distinct().join(of_rows, "txn_id", "left").join(ddl, "txn_id", "left").join(ends, "txn_id", "left")
    none = F.array().cast("array<string>")
    notes = every.select("txn_id", F.concat(F.coalesce("reasons", none), F.array_compact(F.array("ddl"))).alias("reasons"), F.coalesce("marker_ids", none).alias("marker_ids"), (F.col("_end").isNotNull() | F.col("ddl").isNotNull()).alias("committed"))
    return changes.select(*CHANGE.fieldNames()), notes


def rows_of(count: Column, rows: Column) -> Column:
    """The number of rows of a transaction: as counted, else as many as are at hand."""
    return F.coalesce(F.nullif(count, F.lit(0)), F.nullif(F.size(rows).cast("long"), F.lit(-1)), F.lit(0)).cast("long")


def change_bytes() -> Column:
    """The size of a change as JSON; nulls are written."""
    return F.octet_length(F.to_json(F.struct("sequence", "table", "op", "before", "after"), {"ignoreNullFields": "false"})).cast("long")


def summary(changes: DataFrame, notes: DataFrame | None = None, max_rows: int = MAX_ROWS, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """One row a transaction, without images: txn_id, source_file, start_pos, commit_time, row_count, byte_count, n_insert,
    n_update, n_delete, tables (in the order in which they come up), executable and reasons.

    Counts come from partial sums by transaction and table, so no task holds a transaction's rows. Without max_bytes the
    sizes (which need the images) are not read."""
    user = changes.where(~is_system(F.col("table.schema")))
    size = change_bytes() if max_bytes is not None else F.lit(0).cast("long")
    by_table = user.groupBy("txn_id", "table").agg(
        F.count(F.lit(1)).alias("n"), F.min("sequence").alias("first"), F.min(F.struct("source_file", "pos")).alias("at"), F.max("commit_time").alias("commit_time"), F.sum(size).alias("bytes"),
        *(F.count(F.when(F.col("op") == o, 1)).alias(f"n_{o}") for o in OPS), F.count(F.when(~F.col("op").isin(*OPS), 1)).alias("bad"),
    )
    txn = by_table.groupBy("txn_id").agg(
        F.min("at").alias("at"), F.max("commit_time").alias("commit_time"), F.sum("n").alias("row_count"), F.sum("bytes").alias("byte_count"), *(F.sum(f"n_{o}").alias(f"n_{o}") for o in OPS), F.sum("bad").alias("bad"),
        F.transform(F.sort_array(F.collect_list(F.struct("first", "table"))), lambda t: t["table"]).alias("tables"),
    )
    too_many = F.when(F.col("row_count") > max_rows, F.concat(F.lit("too many rows: "), F.col("row_count").cast("string"), F.lit(f" > {max_rows}")))
    too_large = F.when(F.col("byte_count") > (max_bytes or 1 << 62), F.concat(F.lit("too many bytes: "), F.col("byte_count").cast("string"), F.lit(f" > {max_bytes}")))
    unknown = F.when(F.col("bad") > 0, F.lit("unknown operation"))
    found = F.array_compact(F.array(too_many, too_large, unknown))
    if notes is not None:
        txn = txn.join(notes.select("txn_id", "reasons"), "txn_id", "full_outer")
        found = F.concat(found, F.coalesce("reasons", F.array().cast("array<string>")))
    return txn.select("txn_id", F.col("at.source_file").alias("source_file"), F.col("at.pos").alias("start_pos"), "commit_time", F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"), "byte_count", *(F.coalesce(f"n_{o}", F.lit(0)).cast("long").alias(f"n_{o}") for o in OPS), "tables", (F.size(found) == 0).alias("executable"), found.alias("reasons"))


def images(changes: DataFrame, summaries: DataFrame) -> DataFrame:
    """The changes of executable transactions; those over a limit, or otherwise refused, lose their images here."""
    return changes.where(~is_system(F.col("table.schema"))).join(summaries.where("executable").select("txn_id"), "txn_id", "left_semi")


def listing(changes: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Transactions in commit order: txn_id, commit_time, rows, tables (text), reversible."""
    s = summary(scan(changes, scope), max_bytes=None)
    named = F.array_join(F.transform("tables", lambda t: F.concat_ws(".", t["schema"], t["name"])), ", ")
    return s.select("txn_id", "commit_time", F.col("row_count").alias("rows"), named.alias("tables"), F.when(F.col("executable"), "yes").otherwise("no").alias("reversible")).orderBy("commit_time", "txn_id")


def marker_ids(changes: DataFrame, metadata: str = METADATA_SCHEMA) -> DataFrame:
    """txn_id and action_id of inserts into the marker table; only 16-byte ids count (here as 32 hexadecimal digits)."""
    ours = changes.where((F.col("table.schema") == metadata) & (F.col("table.name") == MARKER_TABLE) & (F.col("op") == "insert"))
    raw = F.unbase64(values.unquoted(F.filter("after", lambda x: x["column"] == "action_id")[0]["value"]["data"]))
    return ours.select("txn_id", F.lower(F.hex(raw)).alias("action_id"), F.octet_length(raw).alias("_n")).where("_n = 16").drop("_n")


def correlate(changes: DataFrame, action_id: str, since=None) -> str:
    """The transaction that wrote exactly this marker, from a cursor on."""
    found = marker_ids(scan(changes, Scope(start=since))).where(F.col("action_id") == action_id.lower()).head()
    if found is None:
        raise LookupError(f"no transaction holds action {action_id}")
    return found["txn_id"]
