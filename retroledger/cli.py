"""Command line over the engine: txn list and show, log list, index build, query, check and update, plan create, check,
apply and resolve, action show, verify, reapply and revert, doctor, init, version."""

from __future__ import annotations

import argparse
import json
import os
import sys
import threading
from datetime import datetime, timezone

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import doctor, registry
from .functions.canonical import ulid, ulid_bytes
from .functions.redact import row_summary
from .model import CAPABILITIES, table_name
from .operators import actions, apply, check, index, resolve, transactions
from .plans import config, plan
from .sources import catalog, changelog

VERSION = "0.2"


class Backend:
    """A decoded change log, a catalog and a store of tables, as a profile names them."""

    def __init__(self, spark: SparkSession, p: config.Profile):
        self.spark, self.profile = spark, p

    def log(self) -> DataFrame:
        changelog.require(changelog.capabilities(**{c: c not in self.profile.lacks for c in CAPABILITIES}))
        return changelog.read(self.spark, self.profile.log)

    def store(self) -> apply.Store:
        return apply.Store(self.spark, self.profile.target)

    def catalog(self) -> catalog.Catalog | None:
        return catalog.read(self.spark, self.profile.catalog) if self.profile.catalog else None

    def fingerprints(self) -> dict[str, str] | None:
        """The present fingerprint of every table of the catalog; None without a catalog."""
        known = self.catalog()
        return None if known is None else {r["t"]: r["fingerprint"] for r in known.fingerprints().select(table_name("table").alias("t"), "fingerprint").collect()}

    def files(self) -> DataFrame:
        """The files of the log, as the index compares them."""
        return self.log().groupBy(F.col("source_file").alias("name")).agg(F.count(F.lit(1)).alias("size"), F.max("commit_time").alias("modified_at"))

    def correlate(self, action_id: str) -> str:
        return transactions.correlate(self.log(), ulid_bytes(action_id).hex())


if "changelog" not in registry.names():
    registry.register("changelog", lambda p: lambda spark: Backend(spark, p))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="retroledger")
    p.add_argument("--config", default="retroledger.json")
    p.add_argument("--profile")
    p.add_argument("--format", choices=("table", "json"), default="table")
    sub = p.add_subparsers(dest="group", required=True)
    txn = sub.add_parser("txn").add_subparsers(dest="verb", required=True)
    listed = txn.add_parser("list")
    listed.add_argument("--from-cursor")
    listed.add_argument("--database")
    listed.add_argument("--table")
    listed.add_argument("--limit", type=int, default=100)
    listed.add_argument("--max-time", type=float, help="seconds after which the output ends, normally")
    txn.add_parser("show").add_argument("txn")
    sub.add_parser("log").add_subparsers(dest="verb", required=True).add_parser("list").add_argument("path")
    ix = sub.add_parser("index").add_subparsers(dest="verb", required=True)
    for verb in ("build", "check"):
        ix.add_parser(verb).add_argument("path")
    up = ix.add_parser("update")
    up.add_argument("path")
    up.add_argument("to")
    q = ix.add_parser("query")
    q.add_argument("path")
    for name in ("id", "since", "until", "database", "table"):
        q.add_argument(f"--{name}")
    q.add_argument("--limit", type=int, default=0)
    pl = sub.add_parser("plan").add_subparsers(dest="verb", required=True)
    create = pl.add_parser("create")
    create.add_argument("txn")
    create.add_argument("--mode", choices=plan.MODES, default="revert")
    create.add_argument("--keys", help="Parquet of catalog keys, where the profile names no catalog")
    create.add_argument("--out", required=True)
    pl.add_parser("check").add_argument("path")
    ap = pl.add_parser("apply")
    ap.add_argument("path")
    ap.add_argument("--confirm", required=True)
    ap.add_argument("--operator", required=True)
    ap.add_argument("--reason")
    rs = pl.add_parser("resolve")
    rs.add_argument("path")
    rs.add_argument("--decisions", required=True)
    rs.add_argument("--out", required=True)
    ac = sub.add_parser("action").add_subparsers(dest="verb", required=True)
    ac.add_parser("show").add_argument("action")
    verify = ac.add_parser("verify")
    verify.add_argument("action")
    verify.add_argument("plan")
    verify.add_argument("--wait", type=float, default=0)
    for verb in plan.MODES:
        following = ac.add_parser(verb)
        following.add_argument("action")
        following.add_argument("root", help="the plan file of the root revert")
        following.add_argument("--out", required=True)
    sub.add_parser("doctor")
    new = sub.add_parser("init")
    for name in ("log", "target", "instance"):
        new.add_argument(f"--{name}", required=True)
    new.add_argument("--catalog", default="")
    new.add_argument("--user", default="retroledger")
    new.add_argument("--schema", action="append", default=[])
    sub.add_parser("version")
    return p


def show(df: DataFrame, form: str, out=sys.stdout, seconds: float | None = None) -> bool:
    """Rows as JSON lines or columns; rows are fetched a partition at a time. After so many seconds the output ends, which is
    no error; whether all rows were shown."""
    spark, late = df.sparkSession, threading.Event()

    def stop() -> None:
        late.set()
        spark.interruptTag("show")

    timer = threading.Timer(seconds, stop) if seconds else None
    spark.addTag("show")
    try:
        if timer:
            timer.start()
        if form == "json":
            rows = ((r["j"],) for r in df.select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator())
        else:
            print("\t".join(c.upper() for c in df.columns), file=out)
            rows = df.toLocalIterator()
        for r in rows:
            if late.is_set():
                return False
            print("\t".join("-" if v is None or v == "" else str(v) for v in r), file=out)
    except (PySparkException, Py4JError):
        if not late.is_set():
            raise
        return False
    finally:
        spark.removeTag("show")
        if timer:
            timer.cancel()
    return True


def planned(found: Backend, made: plan.Plan) -> tuple[str, DataFrame]:
    """The status of a plan against the present tables and schemas, and its conflicts."""
    spark = found.spark
    mismatch = check.instance_check(made.instance, found.profile.instance)
    ops = made.frame(spark)
    matched = check.matched(ops, found.store().state(sorted({f"{o['table']['schema']}.{o['table']['name']}" for o in made.operations})))
    conflicts = check.conflicts(matched)
    if mismatch:
        return mismatch[0]["status"], conflicts
    now, schemas = found.fingerprints(), None
    if now is not None and made.fingerprints:
        rows = [(t, f, now.get(t), None if t not in now else now[t] == f) for t, f in made.fingerprints.items()]
        schemas = spark.createDataFrame(rows, "table string, expected string, actual string, matches boolean")
    told = (check.judged(matched) if schemas is None else check.status(conflicts, ops, schemas, ops.select("txn_id", table_name("table").alias("table")))).head()
    return told["status"] if told else "READY", conflicts


def resolved(found: Backend, parent: plan.Plan, text: bytes, now: str) -> plan.Plan:
    """The plan that follows from a conflicting plan and decisions about all its conflicts."""
    spark, raw = found.spark, json.loads(text)
    status, conflicts = planned(found, parent)
    by_operation: dict[int, list[dict]] = {}
    for r in conflicts.orderBy("sequence", "column").collect():  # a plan's operations are bounded
        by_operation.setdefault(r["sequence"], []).append({k: v for k, v in r.asDict().items() if k not in ("txn_id", "sequence")})
    decisions = resolve.read_decisions(text, parent, by_operation)
    ops = parent.frame(spark)
    txn = parent.operations[0]["txn_id"] if parent.operations else parent.source_txn
    listed = spark.createDataFrame([(txn, d["sequence"], d.get("verb")) for d in decisions], "txn_id string, sequence long, verb string")
    faults = [f"operation {r['sequence']}: {r['fault']}" for r in resolve.coverage(conflicts, listed).orderBy("sequence").limit(20).collect()]
    if faults:
        raise plan.Refused("; ".join(faults))
    state = found.store().state()
    after = resolve.resolved(check.matched(ops, state), resolve.grouped(conflicts), listed)
    mixed = [r["sequence"] for r in after.where("outcome = 'undecided'").select("sequence").limit(20).collect()]
    if mixed:
        raise plan.Refused(f"operations with conflicts of several kinds: {mixed}")
    left = plan.collected(resolve.surviving(after), found.profile.policy.max_transaction_rows)
    return resolve.resolved_plan(parent, parent.digest, status, left, decisions, raw.get("operator", ""), raw.get("reason", ""), ulid(), now)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    if a.group == "version":
        print(VERSION, file=out)
        return 0
    if a.group == "init":
        made = config.init(a.config, a.profile or "default", config.Profile("changelog", a.log, a.target, a.instance, a.catalog))
        print(f"server id {made.server_id}", *config.grants(a.user, a.schema), sep="\n", file=out)
        return 0
    p = config.profile(config.load(a.config), a.profile)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = datetime.now(timezone.utc).isoformat()
    if a.group == "doctor":
        lines = doctor.run(spark, p)
        show(spark.createDataFrame([(x.check, x.severity, x.message) for x in lines], "check string, severity string, message string"), a.format, out)
        return int(any(x.severity == "ERROR" for x in lines))
    if a.group == "log":
        show(changelog.log_files(spark, a.path).orderBy("name"), a.format, out)
        return 0
    found = registry.resolve(p)(spark)
    log, store, files = found.log, found.store, found.files
    if (a.group, a.verb) == ("txn", "list"):
        start = changelog.Cursor.parse(a.from_cursor) if a.from_cursor else None
        show(transactions.listing(log(), changelog.Scope(start, a.database, a.table, a.limit)), a.format, out, a.max_time)
    elif (a.group, a.verb) == ("txn", "show"):
        rows = changelog.find(log(), a.txn, instance=p.instance or None).orderBy("sequence")
        show(rows.select("sequence", F.concat_ws(".", "table.schema", "table.name").alias("table"), "op", row_summary(F.col("before")).alias("before"), row_summary(F.col("after")).alias("after")), a.format, out)
    elif (a.group, a.verb) == ("index", "build"):
        index.write(index.deduplicated(index.entries(log())), files(), a.path, p.backend, p.instance)
    elif (a.group, a.verb) == ("index", "update"):
        print(index.update(spark, a.path, a.to, log(), files()), file=out)
    elif (a.group, a.verb) == ("index", "check"):
        status = index.is_current(index.file_changes(index.files_of(spark, a.path), files())).head()["status"]
        print(status, file=out)
        return int(status != "CURRENT")
    elif (a.group, a.verb) == ("index", "query"):
        when = lambda x: datetime.fromisoformat(x) if x else None
        show(index.table_of(index.search(index.read(spark, a.path), index.Filter(a.id, when(a.since), when(a.until), a.database, a.table, a.limit))), a.format, out)
    elif (a.group, a.verb) == ("plan", "create"):
        rows = changelog.find(log(), a.txn, instance=p.instance or None)
        summed = transactions.summary(rows, max_rows=p.policy.max_transaction_rows, max_bytes=p.policy.max_transaction_bytes).head().asDict()
        known = found.catalog()
        if known is None and not a.keys:
            raise plan.Refused("the profile names no catalog, and no keys are given")
        keys = spark.read.parquet(a.keys) if known is None else known.keys
        ops = plan.operations(rows, keys, None if known is None else known.columns, a.mode)
        prints: dict[str, str] = {}
        if known is not None:
            bad = catalog.refused_engines(known.tables.join(rows.select("table").distinct(), "table", "left_semi")).collect()
            if bad:
                raise plan.Refused("not transactional: " + ", ".join(f"{r['table']['schema']}.{r['table']['name']}" for r in bad))
            prints = plan.fingerprints_of(ops, keys, known.fingerprints())
        made = plan.build(summed, ops, prints, a.mode, p.instance, ulid(), now, VERSION, p.policy.max_transaction_rows)
        plan.write_file(made, a.out, p.policy.max_plan_bytes)
        print(made.digest, file=out)
    elif (a.group, a.verb) == ("plan", "check"):
        status, conflicts = planned(found, plan.read_file(a.path))
        print(json.dumps({"status": status}) if a.format == "json" else status, file=out)
        show(conflicts, a.format, out)
        return int(status != "READY")
    elif (a.group, a.verb) == ("plan", "resolve"):
        if os.path.getsize(a.decisions) > resolve.MAX_DECISION_BYTES:
            raise plan.Refused("the decision file is too large")
        with open(a.decisions, "rb") as f:
            made = resolved(found, plan.read_file(a.path), f.read(), now)
        plan.write_file(made, a.out, p.policy.max_plan_bytes)
        print(made.digest, file=out)
    elif (a.group, a.verb) == ("plan", "apply"):
        made, action = plan.read_file(a.path), ulid()
        try:
            print(json.dumps(store().apply(made, apply.Options(action, a.operator, VERSION, a.confirm, a.reason), now, p.instance, found.fingerprints(), p.policy.max_chain_depth, found.correlate)), file=out)
        except apply.CommitUnknown as e:
            print(f"{e}\nretroledger action verify {action} {a.path}", file=out)
            return 3
    elif (a.group, a.verb) == ("action", "show"):
        show(actions.find(store().actions(), a.action), a.format, out)
    elif a.group == "action" and a.verb in plan.MODES:
        root, listed = plan.read_file(a.root), store().actions()
        own = actions.find(listed, a.action).head()
        if own is None:
            raise LookupError(f"no action {a.action}")
        newest = actions.latest(listed.where(F.col("root_plan_digest") == own["root_plan_digest"])).head().asDict()
        fault = actions.parent_fault(root, own.asDict(), newest, a.verb, p.policy.max_chain_depth)
        if fault:
            raise plan.Refused(fault)
        made = plan.next_in_chain(spark, root, a.verb, a.action, own["chain_depth"], ulid(), now)
        plan.write_file(made, a.out, p.policy.max_plan_bytes)
        print(made.digest, file=out)
    else:
        told = actions.verify(lambda: store().markers(F.col("action_id") == a.action), p.instance, plan.read_file(a.plan), a.action, a.wait)
        print(told, file=out)
        return {"COMMITTED": 0, "NOT_COMMITTED": 1}.get(told, 2)
    return 0


if __name__ == "__main__":
    sys.exit(main())
