"""Change logs derived from the driver's tables, which serve as the engine's test input (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import values
from ..model import CHANGE, no_row

MONEY = "decimal(18,2)"


def _table(name: str) -> Column:
    return F.struct(F.lit("shop").alias("schema"), F.lit(name).alias("name"))


def _images(op: Column, row: Column) -> tuple[Column, Column]:
    return F.when(op == "insert", no_row()).otherwise(row).alias("before"), F.when(op == "delete", no_row()).otherwise(row).alias("after")


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction an order: the order itself, then its lines."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag")
    file = F.concat(F.lit("binlog."), F.lpad((F.floor(F.col("o_orderkey") / 1000.0) + 1).cast("string"), 6, "0"))
    op = F.when(F.col("o_orderstatus") == "O", "insert").when(F.col("o_orderstatus") == "P", "update").otherwise("delete")
    row = values.row({"id": ("bigint", F.col("o_orderkey")), "status": ("varchar(1)", F.col("o_orderstatus")), "total": (MONEY, F.col("o_totalprice").cast(MONEY))})
    head = orders.select(file.alias("source_file"), "o_orderkey", F.col("o_orderdate").alias("commit_time"), F.lit(1).cast("long").alias("sequence"), _table("orders").alias("table"), op.alias("op"), *_images(op, row))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    numbered = lines.withColumn("rn", F.row_number().over(order).cast("long")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    op = F.when(F.col("l_returnflag") == "N", "insert").when(F.col("l_returnflag") == "A", "update").otherwise("delete")
    row = values.row({"order_id": ("bigint", F.col("l_orderkey")), "line": ("bigint", F.col("rn")), "quantity": (MONEY, F.col("l_quantity").cast(MONEY)), "price": (MONEY, F.col("l_extendedprice").cast(MONEY))})
    body = numbered.select(file.alias("source_file"), "o_orderkey", F.col("o_orderdate").alias("commit_time"), (F.col("rn") + 1).alias("sequence"), _table("lineitem").alias("table"), op.alias("op"), *_images(op, row))
    both = head.unionByName(body)
    return both.withColumn("pos", F.col("o_orderkey") * 100 + F.col("sequence")).withColumn("txn_id", F.concat(F.lit("srv:"), F.col("o_orderkey").cast("string"))).select(*CHANGE.fieldNames())


def overlapping(changes: DataFrame, last: int = 5) -> DataFrame:
    """The log with the last transactions of each file repeated in the file after it."""
    ranked = changes.select("source_file", "txn_id", "pos").groupBy("source_file", "txn_id").agg(F.min("pos").alias("pos"))
    ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("source_file").orderBy(F.col("pos").desc())))
    files = changes.select("source_file").distinct().withColumn("next", F.lead("source_file").over(Window.orderBy("source_file")))  # as many rows as files
    again = changes.join(ranked.where(F.col("n") <= last).select("source_file", "txn_id"), ["source_file", "txn_id"], "left_semi").join(files.where("next is not null"), "source_file").withColumn("source_file", F.col("next")).select(*changes.columns)
    return changes.unionByName(again)


def _grouping(name: str) -> Column:
    if name == "event":
        return F.col("event_id").cast("string")
    if name == "hour":
        return F.date_format("ts", "yyyy-MM-dd-HH")
    return F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))


def _event_row(kind: Column, value: Column) -> Column:
    return values.row({"user_id": ("bigint", F.col("user_id")), "event_type": ("varchar(16)", kind), "value": (MONEY, value.cast(MONEY))})


def event_log(spark: SparkSession, sf_dir: str, grouping: str = "event") -> DataFrame:
    """One row of state a user, changed by events; 'error' deletes it. Transactions by event, hour, or user and day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seen = events.withColumn("pt", F.lag("event_type").over(order)).withColumn("pv", F.lag("value").over(order))
    live = F.col("pt").isNotNull() & (F.col("pt") != "error")
    op = F.when(F.col("event_type") == "error", F.when(live, "delete")).when(live, "update").otherwise("insert")
    made = seen.withColumn("op", op).where("op is not null")
    txn = F.concat(F.lit("evt:"), _grouping(grouping))
    within = Window.partitionBy("txn_id").orderBy("ts", "event_id")
    return made.select(
        F.lit("events.000001").alias("source_file"), F.col("event_id").alias("pos"), txn.alias("txn_id"), F.col("ts").alias("commit_time"), _table("state").alias("table"), "op",
        F.when(F.col("op") != "insert", _event_row(F.col("pt"), F.col("pv"))).otherwise(no_row()).alias("before"), F.when(F.col("op") != "delete", _event_row(F.col("event_type"), F.col("value"))).otherwise(no_row()).alias("after"), "ts", "event_id",
    ).withColumn("sequence", F.row_number().over(within).cast("long")).select(*CHANGE.fieldNames())


def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("e")).select("user_id", "e.event_id", "e.event_type", "e.value")


def last_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions (by event) that hold each user's last change."""
    log = event_log(spark, sf_dir).select(F.col("pos"), F.get(F.col("after"), 0).alias("_a"), F.get(F.col("before"), 0).alias("_b"), "commit_time", "txn_id")
    user = F.coalesce("_a.value.data", "_b.value.data").cast("long").alias("user_id")
    return log.groupBy(user).agg(F.max_by("txn_id", F.struct("commit_time", "pos")).alias("txn_id")).select("user_id", "txn_id")


def event_state(spark: SparkSession, sf_dir: str, drifted: bool = False) -> DataFrame:
    """user_id, event_type and value of the live users; drifted: some values changed, rows removed and rows added."""
    last = _last(spark, sf_dir)
    value = F.col("value").cast(MONEY)
    live = last.where("event_type <> 'error'").select("user_id", "event_type", value.alias("value"))
    if not drifted:
        return live
    moved = live.where("user_id % 10 <> 5").withColumn("value", F.when(F.col("user_id") % 10 == 3, (F.col("value") + 1).cast(MONEY)).otherwise(F.col("value")))
    again = last.where("event_type = 'error' and user_id % 3 = 0").select("user_id", F.lit("view").alias("event_type"), F.lit(0).cast(MONEY).alias("value"))
    return moved.unionByName(again)


def state_rows(state: DataFrame) -> DataFrame:
    """A state table in the generic form that checks read: table, row."""
    return state.select(_table("state").alias("table"), _event_row(F.col("event_type"), F.col("value")).alias("row"))


SID = bytes(range(16))
STATE_COLUMNS = ("user_id", "event_type", "value")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as raw row events: for each change a transaction of GTID, TABLE_MAP, rows and XID. Every eleventh user
    or so has faults: rows too narrow (user % 11 = 1), updates with one image (2), other columns (3), unknown row events (4),
    a statement instead of rows (5), and rows of a table that no map names (6)."""
    log = event_log(spark, sf_dir).select("pos", "commit_time", "op", "before", "after")
    cell = lambda row, n: values.plain(F.get(F.filter(F.col(row), lambda x: x["column"] == n), 0)["value"])
    image = lambda row: F.when(F.col(row).isNotNull(), F.array(*(cell(row, n) for n in STATE_COLUMNS)))
    seen = log.withColumn("_b", image("before")).withColumn("_a", image("after")).withColumn("fault", F.coalesce(F.get("_a", 0), F.get("_b", 0)).cast("long") % 11)
    rows = F.array_compact(F.array("_b", "_a"))
    rows = F.when(F.col("fault") == 1, F.transform(rows, lambda r: F.slice(r, 1, 2))).when((F.col("fault") == 2) & (F.col("op") == "update"), F.slice(rows, 1, 1)).otherwise(rows)
    kind = F.when(F.col("op") == "insert", "WRITE_ROWSv2").when(F.col("op") == "update", "UPDATE_ROWSv2").otherwise("DELETE_ROWSv1")
    kind = F.when(F.col("fault") == 4, "PARTIAL_UPDATE_ROWS").when(F.col("fault") == 5, "QUERY").otherwise(kind)
    names = F.when(F.col("fault") == 3, F.array(*map(F.lit, ("user_id", "kind", "value")))).otherwise(F.array(*map(F.lit, STATE_COLUMNS)))
    none = F.lit(None)
    table = F.when(F.col("fault") == 6, F.col("pos") * 100 + 7).otherwise(F.lit(7)).cast("long")

    def event(step: int, event_type: Column, **given: Column) -> Column:
        fields = {"sid": none.cast("binary"), "gno": none.cast("long"), "table_id": none.cast("long"), "schema": none.cast("string"), "table": none.cast("string"), "columns": none.cast("array<string>"), "rows": none.cast("array<array<string>>"), "sql": none.cast("string")} | given
        return F.struct((F.col("pos") * 10 + step).cast("long").alias("pos"), event_type.alias("event_type"), *(v.alias(k) for k, v in fields.items()))

    listed = F.array(
        event(0, F.lit("GTID"), sid=F.lit(SID), gno=F.col("pos").cast("long")), event(1, F.lit("TABLE_MAP"), table_id=F.lit(7).cast("long"), schema=F.lit("shop"), table=F.lit("state"), columns=names),
        event(2, kind, table_id=F.when(F.col("fault") != 5, table), rows=F.when(F.col("fault") != 5, rows), sql=F.when(F.col("fault") == 5, "TRUNCATE state\nnow")), event(3, F.lit("ROTATE")), event(4, F.lit("XID")),
    )
    one = seen.select("commit_time", F.explode(listed).alias("e"))
    return one.select(F.lit("binlog.000001").alias("source_file"), "e.pos", "e.event_type", F.col("commit_time").alias("event_time"), *(F.col(f"e.{c}") for c in ("sid", "gno", "table_id", "schema", "table", "columns", "rows", "sql")))
