"""Raw events, the index on storage, the store with its action chain, and inversion over random logs."""

import io
import json
import random
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from retroledger import cli, literals
from retroledger.functions import canonical, values
from retroledger.model import CHANGE
from retroledger.operators import actions, apply, check, index, transactions
from retroledger.plans import config, plan
from retroledger.sources import catalog, changelog
from retroledger.streaming import assembly

T = datetime(2024, 1, 1)
EVENT = "source_file string, pos long, event_type string, event_time timestamp_ntz, sid binary, gno long, table_id long, schema string, table string, columns array<string>, rows array<array<string>>, sql string"


def row(user, kind, value):
    cell = lambda native, x: {"kind": {"bigint": "integer", "varchar(16)": "text"}.get(native, "decimal"), "is_null": False, "encoding": "", "data": str(x) if native == "bigint" else json.dumps(str(x)), "native": native}
    return [{"column": "user_id", "value": cell("bigint", user)}, {"column": "event_type", "value": cell("varchar(16)", kind)}, {"column": "value", "value": cell("decimal(18,2)", value)}]


TABLE = {"schema": "shop", "name": "state"}


def change(n, txn, op, before, after, file="f1"):
    return (file, n, txn, T, n, TABLE, op, before, after)


def events(spark, rows):
    names = [c.split()[0] for c in EVENT.split(", ")]
    return spark.createDataFrame([tuple(({"source_file": "f", "event_time": T} | r).get(n) for n in names) for r in rows], EVENT)


def test_decode_events(spark):
    sid = bytes(range(16))
    names = ["user_id", "event_type", "value"]
    df = events(spark, [
        {"pos": 1, "event_type": "GTID", "sid": sid, "gno": 7},
        {"pos": 2, "event_type": "TABLE_MAP", "table_id": 1, "schema": "shop", "table": "state", "columns": names},
        {"pos": 3, "event_type": "TABLE_MAP", "table_id": 2, "schema": "shop", "table": "legacy", "columns": ["other"]},
        {"pos": 4, "event_type": "UPDATE_ROWSv2", "table_id": 1, "rows": [["1", "view", "1.00"], ["1", "click", "2.00"], ["2", "view", "3.00"], ["2", "view", "4.00"]]},
        {"pos": 5, "event_type": "WRITE_ROWSv1", "table_id": 1, "rows": [["3", "view", None]]},
        {"pos": 6, "event_type": "ROTATE"},
        {"pos": 7, "event_type": "XID"},
        {"pos": 8, "event_type": "GTID", "sid": sid, "gno": 8},
        {"pos": 9, "event_type": "WRITE_ROWSv2", "table_id": 2, "rows": [["x"]]},
        {"pos": 10, "event_type": "XID"},
        {"pos": 11, "event_type": "GTID", "sid": sid, "gno": 9},
        {"pos": 12, "event_type": "QUERY", "sql": "drop table t\nmore"},
        {"pos": 13, "event_type": "GTID", "sid": sid, "gno": 10},
        {"pos": 14, "event_type": "PARTIAL_UPDATE_ROWS", "table_id": 1, "rows": [["1", "a", "1"]]},
        {"pos": 15, "event_type": "XID"},
    ])
    changes, notes = transactions.decode_events(df, literals.columns(spark).where("table.name in ('state', 'legacy')"))
    got = [(r.sequence, r.op, r.before and r.before[1].value.data, r.after and r.after[1].value.data, r.after[2].value.is_null) for r in changes.orderBy("sequence").collect()]
    assert got == [(1, "update", '"view"', '"click"', False), (2, "update", '"view"', '"view"', False), (3, "insert", None, '"view"', True)]
    found = {r.txn_id.rpartition(":")[2]: (r.executable, r.reasons, r.row_count) for r in transactions.summary(changes, notes).collect()}
    assert found["7"] == (True, [], 3)
    assert found["8"] == (False, ["columns of shop.legacy differ from the catalog"], 0)
    assert found["9"] == (False, ["statement: drop table t"], 0)
    assert not found["10"][0] and "unknown row event" in found["10"][1][0]


def test_limits_and_lookup(spark):
    log = spark.createDataFrame([change(i, "srv:1", "insert", None, row(i, "view", i)) for i in range(1, 6)], CHANGE)
    assert transactions.summary(log, max_rows=5).head().executable
    over = transactions.summary(log, max_rows=4).head()
    assert over.reasons == ["too many rows: 5 > 4"] and transactions.images(log, transactions.summary(log, max_rows=4)).count() == 0
    assert "too many bytes" in transactions.summary(log, max_bytes=10).head().reasons[0]
    assert changelog.find(log, "srv:1", changelog.Cursor("f1", 2), "srv").count() == 4
    for wrong in (("srv:2", None), ("srv:1", "other")):
        with pytest.raises(changelog.NotFound):
            changelog.find(log, wrong[0], instance=wrong[1])


def test_index_storage(spark, tmp_path):
    rows = [change(1, "srv:1", "insert", None, row(1, "view", 1)), change(2, "srv:1", "insert", None, row(2, "view", 1), "f2"), change(3, "srv:2", "insert", None, row(3, "view", 1), "f2")]
    listing = lambda *x: spark.createDataFrame([(n, s, T) for n, s in x], index.FILE)
    found = index.entries(spark.createDataFrame(rows, CHANGE))
    assert index.counters(found).head().asDict() == {"files": 2, "transactions": 2, "duplicates": 1}
    path = str(tmp_path / "ix")
    index.write(index.deduplicated(found), listing(("f1", 1), ("f2", 2)), path)
    with pytest.raises(FileExistsError):
        index.write(index.deduplicated(found), listing(("f1", 1)), path)
    assert {(r.txn_id, r.source_file) for r in index.read(spark, path).collect()} == {("srv:1", "f1"), ("srv:2", "f2")}
    longer = spark.createDataFrame([*rows, change(4, "srv:3", "insert", None, row(4, "view", 1), "f2"), change(5, "srv:4", "insert", None, row(5, "view", 1), "f3")], CHANGE)
    assert index.update(spark, path, path + "2", longer, listing(("f1", 1), ("f2", 2))) == "CURRENT"
    assert index.update(spark, path, path + "2", longer, listing(("f1", 1), ("f2", 3), ("f3", 1))) == "UPDATED"
    assert index.read(spark, path + "2").count() == 4
    with pytest.raises(index.Stale):
        index.update(spark, path, path + "3", longer, listing(("f1", 9), ("f2", 2)))


def reverted(spark, log, n):
    return plan.build(transactions.summary(log).head().asDict(), plan.operations(log, literals.keys(spark)), {}, "revert", "srv", canonical.ulid(n, bytes(10)), "now", "1")


def test_store_and_chain(spark, tmp_path):
    log = spark.createDataFrame([change(1, "srv:1", "insert", None, row(1, "view", 1)), change(2, "srv:1", "update", row(2, "view", 1), row(2, "click", 2)), change(3, "srv:1", "delete", row(3, "view", 1), None)], CHANGE)
    start = spark.createDataFrame([(TABLE, row(1, "view", "1.0")), (TABLE, row(2, "click", 2)), (TABLE, row(9, "view", 9))], apply.check_schema())
    store = apply.Store(spark, f"file://{tmp_path}/store")
    store.bootstrap(start)
    shown = lambda: sorted((int(r.row[0].value.data), json.loads(r.row[1].value.data)) for r in store.state().collect())
    before = shown()
    root = reverted(spark, log, 1)
    act = lambda n: canonical.ulid(100 + n, bytes(10))
    go = lambda p, n: store.apply(p, apply.Options(act(n), "op", "1", p.digest), "now", "srv")
    assert go(root, 0)["affected"] == 3
    assert shown() == [(2, "view"), (3, "view"), (9, "view")]
    with pytest.raises(apply.ReplayBlocked):
        go(root, 1)
    again = plan.next_in_chain(spark, root, "reapply", act(0), 0, canonical.ulid(2, bytes(10)), "now")
    with pytest.raises(apply.ApplyError):
        store.apply(again, apply.Options(act(1), "op", "1", again.digest), "now", "other")
    go(again, 1)
    assert shown() == before
    third = plan.next_in_chain(spark, root, "revert", act(1), 1, canonical.ulid(3, bytes(10)), "now")
    go(third, 2)
    assert actions.chain(store.actions()).head().asDict() == {"root_plan_digest": root.digest, "length": 3, "fault": None}
    markers = store.markers()
    assert actions.verify(lambda: markers, "srv", third, act(2)) == "COMMITTED"
    assert actions.verify(lambda: markers, "srv", root, act(2)) == "INDETERMINATE"
    waits = []
    assert actions.verify(lambda: markers, "srv", root, act(9), 0.5, sleep=waits.append) == "NOT_COMMITTED" and waits == [0.25, 0.25]
    assert actions.parent_fault(root, markers[2], markers[2], "reapply") is None
    assert actions.parent_fault(root, markers[0], markers[2], "reapply") == "a later action stands"
    with pytest.raises(apply.ApplyError):  # two writers from one version: the second finds its number taken
        store.publish({"version": len(store.versions()) - 1}, {})


def test_conflict_changes_nothing(spark, tmp_path):
    log = spark.createDataFrame([change(1, "srv:1", "insert", None, row(1, "view", 1)), change(2, "srv:1", "insert", None, row(2, "view", 1))], CHANGE)
    store = apply.Store(spark, f"file://{tmp_path}/store")
    store.bootstrap(spark.createDataFrame([(TABLE, row(1, "view", 1)), (TABLE, row(2, "view", 7))], apply.check_schema()))
    p = reverted(spark, log, 1)
    with pytest.raises(apply.ApplyError, match="CONFLICT"):
        store.apply(p, apply.Options(canonical.ulid(5, bytes(10)), "op", "1", p.digest), "now", "srv")
    assert store.state().count() == 2 and store.versions() == [1] and not store.markers()
    assert [r.kind for r in check.conflicts(check.matched(p.frame(spark), store.state())).collect()] == ["row_mismatch"]


class Broken:
    """A store whose numbering of manifests fails, before or after it takes effect."""

    def __init__(self, store, after):
        self.store, self.after, self.number = store, after, store._number

    def __enter__(self):
        def fail(temp, name):
            if self.after:
                self.number(temp, name)
            raise OSError("lost")

        self.store._number = fail
        return self.store

    def __exit__(self, *_):
        self.store._number = self.number


def test_a_manifest_is_published_whole_or_not(spark, tmp_path):
    store = apply.Store(spark, f"file://{tmp_path}/store")
    store.create()
    store.create()
    assert store.versions() == [1] and store.manifest()["tables"] == {} and store.markers() == []
    with Broken(store, after=False), pytest.raises(apply.ApplyError, match="could not be published"):
        store.publish(store.manifest(), {"a": "b"})
    assert store.versions() == [1]
    with Broken(store, after=True):
        store.publish(store.manifest(), {"a": "b"})  # the number was taken by this very manifest
    assert store.manifest()["tables"] == {"a": "b"} and store.versions() == [1, 2]
    with pytest.raises(apply.ApplyError, match="another action"):
        store.publish({"version": 1}, {"c": "d"})
    (tmp_path / "store/manifests/.9-crashed").write_text("")  # what a writer leaves that dies before it publishes
    assert store.manifest()["version"] == 2 and not list(tmp_path.glob("store/manifests/.[0-8]*-*"))
    broken = apply.Store(spark, f"file://{tmp_path}/store")

    class Unreadable:
        def __getattr__(self, name):
            return getattr(store.fs, name)

        def exists(self, path):
            raise OSError("gone")

    with Broken(broken, after=True):
        broken.fs = Unreadable()
        with pytest.raises(apply.CommitUnknown):
            broken.publish({"version": 2}, {}, {"action_id": "x"})


def test_malformed_row_events(spark):
    names = ["user_id", "event_type", "value"]
    begin = lambda n, g: [{"pos": n, "event_type": "GTID", "sid": bytes(16), "gno": g}, {"pos": n + 1, "event_type": "TABLE_MAP", "table_id": 1, "schema": "shop", "table": "state", "columns": names}]
    end = lambda n: [{"pos": n, "event_type": "XID"}]
    df = events(spark, [
        *begin(1, 1), {"pos": 3, "event_type": "UPDATE_ROWSv2", "table_id": 1, "rows": [["1", "view", "1"]]}, *end(4),
        *begin(11, 2), {"pos": 13, "event_type": "WRITE_ROWSv2", "table_id": 1, "rows": [["1", "view"]]}, *end(14),
        *begin(21, 3), {"pos": 23, "event_type": "WRITE_ROWSv2", "table_id": 1, "rows": []}, *end(24),
        *begin(31, 4), {"pos": 33, "event_type": "WRITE_ROWSv2", "table_id": 5, "rows": [["1", "view", "1"]]}, *end(34),
    ])
    changes, notes = transactions.decode_events(df, literals.columns(spark).where("table.name = 'state'"))
    assert changes.count() == 0
    told = {r.txn_id.rpartition(":")[2]: (r.executable, r.reasons[0].split(",")[0]) for r in transactions.summary(changes, notes).collect()}
    assert told == {"1": (False, "an update of shop.state lacks an image"), "2": (False, "a row of shop.state has not as many values as columns"), "3": (False, "an event of shop.state holds no rows"), "4": (False, "rows of an unknown table")}
    cells = spark.createDataFrame([(["1"],)], "v array<string>").select(values.decode_row(F.array(F.struct(F.lit("a").alias("name"), F.lit("int").alias("native")), F.struct(F.lit("b").alias("name"), F.lit("int").alias("native"))), F.col("v")))
    with pytest.raises(PySparkException, match="1 values for 2 columns"):
        cells.collect()


def test_stream_of_transactions(spark, tmp_path):
    """Rows, tables and reasons; rows after the commit and transactions that never end are told."""
    rows = [("t1", 1, T, "insert", "s.a", "{1}"), ("t1", 2, T, "update", "s.b", "{2}"), ("t1", 3, T, "COMMIT", "", None), ("t2", 4, T, "insert", "s.a", "{3}"), ("t3", 5, T, "insert", "s.a", "{4}"), ("t3", 6, T, "insert", "s.a", "{5}"), ("t3", 7, T, "insert", "s.a", "{6}"), ("t3", 8, T, "COMMIT", "", None)]
    schema = "txn_id string, pos long, time timestamp, op string, table string, change string"
    log, out = f"{tmp_path}/log", f"{tmp_path}/out"

    def step(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(log)
        made = assembly.assemble(spark.readStream.schema(schema).parquet(log), max_rows=2)
        q = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert assembly.read_for(q, 120)
        return {(r.txn_id, tuple(r.rows), tuple(r.tables), r.executable, tuple(r.reasons)) for r in spark.read.parquet(out).collect()}

    first = step(rows)
    assert first == {("t1", ("{1}", "{2}"), ("s.a", "s.b"), True, ()), ("t3", (), ("s.a",), False, ("too many rows: 3 > 2",))}
    again = step([("t1", 9, T, "delete", "s.a", "{9}"), ("t2", 10, T, "COMMIT", "", None)])
    assert again - first == {("t1", ("{9}",), ("s.a",), False, ("rows after the commit",)), ("t2", ("{3}",), ("s.a",), True, ())}


def test_catalog_and_log_files(spark, tmp_path):
    lines = lambda name, rows: (tmp_path / "schema").mkdir(exist_ok=True) or (tmp_path / f"schema/{name}.json").write_text("\n".join(map(json.dumps, rows)))
    lines("tables", [{"TABLE_SCHEMA": "shop", "TABLE_NAME": "state", "ENGINE": "InnoDB", "TABLE_COLLATION": "utf8mb4_bin"}, {"TABLE_SCHEMA": "shop", "TABLE_NAME": "old", "ENGINE": "MyISAM", "TABLE_COLLATION": "utf8mb4_bin"}])
    lines("columns", [{"TABLE_SCHEMA": "shop", "TABLE_NAME": "state", "COLUMN_NAME": n, "ORDINAL_POSITION": k, "COLUMN_TYPE": c, "IS_NULLABLE": null, "EXTRA": extra} for k, (n, c, null, extra) in enumerate((("user_id", "bigint", "NO", ""), ("event_type", "varchar(16)", "NO", ""), ("value", "decimal(18,2)", "YES", "STORED GENERATED")), 1)])
    lines("statistics", [{"TABLE_SCHEMA": "shop", "TABLE_NAME": "state", "INDEX_NAME": i, "NON_UNIQUE": u, "SEQ_IN_INDEX": n, "COLUMN_NAME": c} for i, u, n, c in (("PRIMARY", 0, 1, "user_id"), ("twice", 0, 2, "value"), ("twice", 0, 1, "event_type"), ("plain", 1, 1, "value"))])
    found = catalog.read(spark, f"{tmp_path}/schema")
    assert {(r.key, r.is_primary, tuple(r.columns)) for r in found.keys.collect()} == {("PRIMARY", True, ("user_id",)), ("twice", False, ("event_type", "value"))}
    assert [(r.name, r.nullable, r.generated) for r in found.columns.orderBy("ordinal").collect()] == [("user_id", False, False), ("event_type", False, False), ("value", True, True)]
    assert [r.table.name for r in catalog.refused_engines(found.tables).collect()] == ["old"] and found.fingerprints().count() == 2
    logs = tmp_path / "logs"
    logs.mkdir()
    with pytest.raises(changelog.NotFound):
        changelog.log_files(spark, str(logs))
    (logs / "b.2").write_bytes(changelog.MAGIC + b"12345")
    (logs / "b.1").write_bytes(changelog.MAGIC)
    (logs / "other").write_bytes(b"text, no log")
    (logs / "tiny").write_bytes(b"x")
    (logs / "folder").mkdir()
    (logs / "link").symlink_to(logs / "b.1")
    assert [(r["name"], r["size"]) for r in changelog.log_files(spark, str(logs)).collect()] == [("b.1", 4), ("b.2", 9)]
    order = spark.createDataFrame([(0, "b.1"), (1, "b.2")], "n int, name string")
    assert index.sorted_snapshot(order).head().increasing and not index.sorted_snapshot(order.withColumn("n", -F.col("n"))).head().increasing


def test_moved_keys_and_refusals(spark):
    log = spark.createDataFrame([change(1, "srv:1", "update", row(1, "view", 1), row(2, "view", 1))], CHANGE)
    ops = plan.operations(log, literals.keys(spark))
    assert ops.head().key[0].value.data == "2"  # the row that is there now
    state = lambda *users: spark.createDataFrame([(TABLE, row(u, "view", 1)) for u in users], apply.check_schema())
    assert apply.verdict(ops, state(2)).head().status == "READY"
    assert apply.verdict(ops, state(1, 2)).head().status == "CONFLICT"  # the key that it moves to is taken
    assert [r.row[0].value.data for r in apply.new_state(state(2), ops).collect()] == ["1"]
    keyless = plan.operations(log.withColumn("table", F.struct(F.lit("shop").alias("schema"), F.lit("keyless").alias("name"))), literals.keys(spark))
    with pytest.raises(plan.Refused, match="no usable unique key"):
        plan.build({"executable": True, "reasons": [], "txn_id": "srv:1"}, keyless, {}, "revert", "srv", canonical.ulid(), "now", "1")
    with pytest.raises(plan.Refused, match="because"):
        plan.build({"executable": False, "reasons": ["because"], "txn_id": "srv:1"}, ops, {}, "revert", "srv", canonical.ulid(), "now", "1")


def test_revert_undoes_random_transactions(spark):
    rng = random.Random(5)
    users = {u: ("view", 1) for u in range(40) if u % 2}
    start, rows = dict(users), []
    for n, u in enumerate(rng.sample(range(40), 30), 1):
        op = "insert" if u not in users else rng.choice(["update", "delete"])
        before, after = users.get(u), None if op == "delete" else ("click", n)
        rows.append(change(n, "srv:1", op, before and row(u, *before), after and row(u, *after)))
        users.pop(u, None)
        if after:
            users[u] = after
    ops = plan.operations(spark.createDataFrame(rows, CHANGE), literals.keys(spark))
    state = spark.createDataFrame([(TABLE, row(u, *x)) for u, x in users.items()], apply.check_schema())
    assert apply.verdict(ops, state).head().asDict() == {"txn_id": "srv:1", "status": "READY", "affected": 30}
    left = {int(r.row[0].value.data): (json.loads(r.row[1].value.data), int(json.loads(r.row[2].value.data))) for r in apply.new_state(state, ops).collect()}
    assert left == start


def test_stale_schema_and_markers(spark):
    raw = values.quoted(F.base64(F.unhex(F.lit("ab" * 16))))
    marker = F.array(F.struct(F.lit("action_id").alias("column"), F.struct(F.lit("binary").alias("kind"), F.lit(False).alias("is_null"), F.lit("base64").alias("encoding"), raw.alias("data"), F.lit("binary(16)").alias("native")).alias("value")))
    log = spark.createDataFrame([change(1, "srv:1", "insert", None, row(1, "view", 1))], CHANGE).withColumn("table", F.struct(F.lit("retro_meta").alias("schema"), F.lit("action_markers").alias("name"))).withColumn("after", marker)
    assert transactions.correlate(log, "AB" * 16) == "srv:1"
    assert transactions.summary(log).count() == 0  # metadata is no user's change
    with pytest.raises(LookupError):
        transactions.correlate(log, "00" * 16)


def test_command_line(spark, tmp_path):
    log, state = f"{tmp_path}/log", f"file://{tmp_path}/store"
    spark.createDataFrame([change(1, "srv:1", "insert", None, row(1, "view", 1))], CHANGE).write.parquet(log)
    literals.keys(spark).write.parquet(f"{tmp_path}/keys")
    apply.Store(spark, state).bootstrap(spark.createDataFrame([(TABLE, row(1, "view", 1))], apply.check_schema()))
    config.save(f"{tmp_path}/c.json", {"p": config.Profile("changelog", log, state, "srv")})

    def run(*argv):
        out = io.StringIO()
        code = cli.main(["--config", f"{tmp_path}/c.json", *argv], spark, out)
        return code, out.getvalue()

    assert "srv:1" in run("txn", "list")[1] and "user_id=1" in run("txn", "show", "srv:1")[1]
    assert run("index", "build", f"{tmp_path}/ix")[0] == 0 and run("index", "check", f"{tmp_path}/ix")[1] == "CURRENT\n"
    assert "shop.state" in run("index", "query", f"{tmp_path}/ix", "--id", "srv:1")[1]
    digest = run("plan", "create", "srv:1", "--keys", f"{tmp_path}/keys", "--out", f"{tmp_path}/p.json")[1].strip()
    assert run("plan", "check", f"{tmp_path}/p.json")[1].startswith("READY")
    code, said = run("plan", "apply", f"{tmp_path}/p.json", "--confirm", digest, "--operator", "me")
    assert code == 0 and run("action", "verify", json.loads(said)["action_id"], f"{tmp_path}/p.json")[1] == "COMMITTED\n"
    assert run("plan", "check", f"{tmp_path}/p.json")[0] == 1
    assert "warning" in json.loads(said)  # the log holds no marker of the action
    root, action = f"{tmp_path}/p.json", json.loads(said)["action_id"]
    again = run("action", "reapply", action, root, "--out", f"{tmp_path}/again.json")[1].strip()
    with pytest.raises(plan.Refused):
        run("action", "revert", action, root, "--out", f"{tmp_path}/x.json")
    code, said = run("plan", "apply", f"{tmp_path}/again.json", "--confirm", again, "--operator", "me")
    assert code == 0 and "affected" in said and "REAPPLY" in run("--format", "json", "action", "show", json.loads(said)["action_id"])[1]
    assert run("action", "revert", json.loads(said)["action_id"], root, "--out", f"{tmp_path}/third.json")[0] == 0
    assert run("index", "update", f"{tmp_path}/ix", f"{tmp_path}/ix2")[1] == "CURRENT\n"
    assert run("txn", "list", "--max-time", "60")[0] == 0
    assert run("doctor")[0] == 0 and run("version")[1] == cli.VERSION + "\n"


def test_command_line_with_a_catalog(spark, tmp_path):
    """Fingerprints are planned, drift is seen, and a conflicting plan is resolved by decisions."""
    log, state, schema = f"{tmp_path}/log", f"file://{tmp_path}/store", f"{tmp_path}/schema"
    spark.createDataFrame([change(1, "srv:1", "insert", None, row(1, "view", 1)), change(2, "srv:1", "insert", None, row(2, "view", 2))], CHANGE).write.parquet(log)
    for name in ("tables", "columns", "keys"):
        getattr(literals, name)(spark).write.parquet(f"{schema}/{name}")
    apply.Store(spark, state).bootstrap(spark.createDataFrame([(TABLE, row(1, "view", 1)), (TABLE, row(2, "click", 2))], apply.check_schema()))

    def run(*argv):
        out = io.StringIO()
        code = cli.main(["--config", f"{tmp_path}/c.json", *argv], spark, out)
        return code, out.getvalue()

    said = run("init", "--log", log, "--target", state, "--instance", "srv", "--catalog", schema, "--schema", "shop")[1]
    assert "REPLICATION" in said and "`shop`" in said and config.load(f"{tmp_path}/c.json")["default"].server_id >= 10_000
    run("plan", "create", "srv:1", "--out", f"{tmp_path}/p.json")
    assert list(plan.read_file(f"{tmp_path}/p.json").fingerprints) == ["shop.state"]
    assert run("plan", "check", f"{tmp_path}/p.json")[1].startswith("CONFLICT")
    decide = lambda **d: (tmp_path / "d.json").write_text(json.dumps({"operator": "me", "reason": "why", "decisions": [d] if d else []}))
    decide()
    with pytest.raises(plan.Refused, match="without a decision"):
        run("plan", "resolve", f"{tmp_path}/p.json", "--decisions", f"{tmp_path}/d.json", "--out", f"{tmp_path}/r.json")
    decide(sequence=1, verb="skip")
    digest = run("plan", "resolve", f"{tmp_path}/p.json", "--decisions", f"{tmp_path}/d.json", "--out", f"{tmp_path}/r.json")[1].strip()
    made = plan.read_file(f"{tmp_path}/r.json")
    assert made.execution_class == "unsafe_resolved" and [o["sequence"] for o in made.operations] == [1] and run("plan", "check", f"{tmp_path}/r.json")[1].startswith("READY")
    literals.columns(spark).withColumn("nullable", F.lit(True)).write.parquet(f"{schema}2/columns")
    for name in ("tables", "keys"):
        getattr(literals, name)(spark).write.parquet(f"{schema}2/{name}")
    known = config.load(f"{tmp_path}/c.json")["default"]
    config.save(f"{tmp_path}/c.json", {"default": replace(known, catalog=f"{schema}2")})
    assert run("plan", "check", f"{tmp_path}/r.json")[1].startswith("STALE_SCHEMA")
    with pytest.raises(apply.ApplyError, match="STALE_SCHEMA"):
        run("plan", "apply", f"{tmp_path}/r.json", "--confirm", digest, "--operator", "me")
    config.save(f"{tmp_path}/c.json", {"default": known})
    assert run("plan", "apply", f"{tmp_path}/r.json", "--confirm", digest, "--operator", "me")[0] == 0
    config.save(f"{tmp_path}/c.json", {"default": replace(known, lacks=["before_image"])})
    with pytest.raises(changelog.Unsupported):
        run("txn", "list")
