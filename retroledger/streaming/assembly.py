"""Transactions from a growing log: each is put out when its commit arrives, once, with its rows, tables and reasons.

The state of an open transaction is its counts, its table list and its changes (as JSON) while they are within the limits;
beyond them the images go and only counts stay, so the state is bounded. What remains of a finished transaction is a mark of
a few bytes, by which rows that come after the commit are told and put out as a fault instead of being lost. Results need no
watermark; with ``idle_ms`` (our addition) a transaction that gets nothing for so long is put out as never committed, and
marks of finished ones are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.transactions import MAX_BYTES, MAX_ROWS, is_system

OUTPUT = "txn_id string, commit_time timestamp, row_count long, n_insert long, n_update long, n_delete long, tables array<string>, rows array<string>, executable boolean, reasons array<string>"
STATE = "kept string, time timestamp"
COMMIT = "COMMIT"
_OPS = ("insert", "update", "delete")


def with_commits(changes: DataFrame) -> DataFrame:
    """Changes as stream rows, and a commit row after the last change of each transaction (for logs that have only changes)."""
    told = F.to_json(F.struct("sequence", "table", "op", "before", "after"), {"ignoreNullFields": "false"})
    body = changes.where(~is_system(F.col("table.schema"))).select("txn_id", "pos", F.col("commit_time").cast("timestamp").alias("time"), "op", F.concat_ws(".", "table.schema", "table.name").alias("table"), told.alias("change"))
    ends = body.groupBy("txn_id").agg(F.max("pos").alias("pos"), F.max("time").alias("time"))
    return body.unionByName(ends.select("txn_id", "pos", "time", F.lit(COMMIT).alias("op"), F.lit("").alias("table"), F.lit(None).cast("string").alias("change")))


class _Open:
    """An open transaction, and what goes into the state of it."""

    def __init__(self, kept: str | None = None):
        raw = json.loads(kept) if kept else {}
        self.count, self.ops, self.bytes = raw.get("count", 0), raw.get("ops", {}), raw.get("bytes", 0)
        self.tables, self.rows, self.done = raw.get("tables", []), raw.get("rows", []), raw.get("done", False)

    def kept(self) -> str:
        return json.dumps({"done": True} if self.done else vars(self))

    def add(self, body: pd.DataFrame, max_rows: int, max_bytes: int) -> None:
        body = body.sort_values("pos", kind="stable")
        self.count += len(body)
        for op, n in body["op"].value_counts().items():
            self.ops[op] = self.ops.get(op, 0) + int(n)
        self.bytes += int(body["change"].fillna("").str.encode("utf-8").str.len().sum())
        self.tables += [t for t in dict.fromkeys(body["table"]) if t not in self.tables]
        over = self.count > max_rows or self.bytes > max_bytes
        self.rows = None if over or self.rows is None else self.rows + [[int(p), c] for p, c in zip(body["pos"], body["change"])]

    def out(self, txn_id: str, time: object, more: list[str], max_rows: int, max_bytes: int) -> pd.DataFrame:
        reasons = [f"too many rows: {self.count} > {max_rows}"] if self.count > max_rows else []
        reasons += [f"too many bytes: {self.bytes} > {max_bytes}"] if self.bytes > max_bytes else []
        reasons += [f"unknown operation {op}" for op in sorted(set(self.ops) - set(_OPS))] + more
        rows = [c for _, c in sorted(self.rows or [])]
        made = (txn_id, time, self.count, *(self.ops.get(o, 0) for o in _OPS), self.tables, rows, not reasons, reasons)
        return pd.DataFrame([made], columns=[c.split()[0] for c in OUTPUT.split(", ")])


def assemble(stream: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, idle_ms: int | None = None) -> DataFrame:
    """One row for each committed transaction of a stream of txn_id, pos, time, op, table and change, where op COMMIT ends
    it. A transaction that is not executable says why in reasons; over a limit it has no rows."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, last = state.get if state.exists else (None, None)
        now = _Open(kept)
        if state.hasTimedOut:
            state.remove()
            if not now.done:
                yield now.out(key[0], last, ["never committed"], max_rows, max_bytes)
            return
        ended, late = False, None
        for batch in batches:
            body, ends = batch[batch["op"] != COMMIT], batch[batch["op"] == COMMIT]
            if now.done:
                late = (late or _Open()) if len(body) else late
                if len(body):
                    late.add(body, max_rows, max_bytes)
            else:
                now.add(body, max_rows, max_bytes)
                ended = ended or len(ends) > 0
            time = batch["time"].max()
            last = time if last is None else max(pd.Timestamp(last), time)
        if late is not None:
            yield late.out(key[0], last, ["rows after the commit"], max_rows, max_bytes)
        if ended:
            yield now.out(key[0], last, [], max_rows, max_bytes)
            now.done = True
        state.update((now.kept(), last))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy("txn_id").applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)


def read_for(query: StreamingQuery, seconds: float) -> bool:
    """Lets a stream run for so long and ends it normally; whether it ended by itself before."""
    ended = query.awaitTermination(seconds)
    if not ended:
        query.stop()
    return bool(ended)
