"""Identifiers, digests, configuration, paths, the registry and plan files."""

import json
import os
import stat

import pytest

from retroledger import registry
from retroledger.functions import canonical
from retroledger.operators import apply, resolve
from retroledger.plans import config, plan
from retroledger.sources import changelog


def sample(**changes):
    given = dict(plan_id=canonical.ulid(1, bytes(10)), mode="revert", source_txn="srv:1", instance="srv", created_at="now", tool_version="1", operations=[], fingerprints={})
    return plan.Plan(**(given | changes)).sealed()


def test_canonical():
    assert canonical.canonical({"b": 9007199254740993, "a": [None, "<é>"]}) == '{"a":[null,"<é>"],"b":9007199254740993}'
    raw = bytes(range(16))
    assert canonical.ulid_bytes(canonical.ulid_text(raw)) == raw
    assert canonical.digest_text(canonical.digest_bytes("sha256:" + "ab" * 32)) == "sha256:" + "ab" * 32
    assert canonical.short("sha256:0123456789ab") == "01234567"
    for bad in ("x" * 26, "8" + "Z" * 25, "0"):
        with pytest.raises(ValueError):
            canonical.ulid_bytes(bad)
    with pytest.raises(ValueError):
        canonical.digest_bytes("sha256:12")


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    config.save(path, {"a": config.Profile("changelog", "/log", "/target")})
    assert stat.S_IMODE(os.stat(path).st_mode) == 0o600
    assert config.profile(config.load(path), None).policy == config.Policy()
    raw = json.loads(open(path).read())
    for change in ({"version": 2}, {"more": 1}):
        with open(path, "w") as f:
            json.dump(raw | change, f)
        with pytest.raises(ValueError):
            config.load(path)
    with pytest.raises(ValueError):
        config.Policy(max_plan_bytes=0)
    with pytest.raises(LookupError):
        config.profile({}, "x")


def test_paths(tmp_path):
    base = tmp_path / "logs"
    base.mkdir()
    (base / "f").write_text("x")
    (tmp_path / "out").write_text("x")
    os.symlink(tmp_path / "out", base / "link")
    assert changelog.confined(str(base), "f") == str(base / "f")
    for bad in ("../out", "link", str(base / "f"), ".", "none"):
        with pytest.raises(ValueError):
            changelog.confined(str(base), bad)


def test_cursor_scope_capabilities():
    assert changelog.Cursor.parse('{"file": "f"}').start == 4
    c = changelog.Cursor("f", 7, 9)
    assert changelog.Cursor.parse(c.text()) == c
    with pytest.raises(ValueError):
        changelog.Cursor.parse("{}")
    with pytest.raises(ValueError):
        changelog.Scope(limit=-1)
    with pytest.raises(changelog.Unsupported):
        changelog.require(changelog.capabilities(before_image=True))


def test_registry():
    registry.register("test", lambda p: p.log)
    assert registry.resolve(config.Profile("test", "/l", "/t")) == "/l"
    with pytest.raises(ValueError):
        registry.register("test", lambda p: p)
    with pytest.raises(LookupError):
        registry.resolve(config.Profile("other", "", ""))


def test_plan_file(tmp_path):
    p, path = sample(), str(tmp_path / "p.json")
    plan.write_file(p, path)
    assert plan.read_file(path) == p and stat.S_IMODE(os.stat(path).st_mode) == 0o600
    with pytest.raises(FileExistsError):
        plan.write_file(p, path)
    with pytest.raises(plan.Refused):
        plan.write_file(p, path + "2", max_bytes=10)
    assert not os.path.exists(path + "2")
    with open(path) as f:
        raw = json.load(f)
    with open(path, "w") as f:
        json.dump(raw | {"source_txn": "srv:2"}, f)
    with pytest.raises(ValueError):
        plan.read_file(path)


def test_options():
    p = sample()
    good = dict(action_id=canonical.ulid(2, bytes(10)), operator="o", tool_version="1", confirm=p.digest[:17])
    apply.Options(**good).validate(p)
    for change in ({"action_id": "x"}, {"operator": ""}, {"tool_version": "x" * 33}, {"confirm": p.digest[:12]}, {"confirm": "sha256:" + "0" * 8}):
        with pytest.raises((apply.ApplyError, ValueError)):
            apply.Options(**(good | change)).validate(p)


def test_decisions():
    p = sample()
    conflicts = {1: [{"kind": "row_exists", "column": None, "message": "a"}]}
    read = resolve.read_decisions(b'{"operator": "o", "reason": "r", "decisions": [{"sequence": 1, "verb": "skip"}]}', p, conflicts)
    assert read[0]["conflict_digest"].startswith("sha256:")
    for bad in (b'{"decisions": [{"sequence": 1, "verb": "skip", "x": 1}]}', b'{"decisions": [], "x": 1}', b'{"decisions": [{"sequence": 1, "verb": "skip", "conflict_digest": "sha256:0"}]}', b" " * (resolve.MAX_DECISION_BYTES + 1)):
        with pytest.raises(plan.Refused):
            resolve.read_decisions(bad, p, conflicts)
    made = resolve.resolved_plan(p, p.digest, "CONFLICT", [], read, "o", "r", p.plan_id, "now")
    assert made.execution_class == "unsafe_resolved" and made.root() == p.digest
    for bad in (("sha256:0", "CONFLICT", "o"), (p.digest, "READY", "o"), (p.digest, "CONFLICT", "")):
        with pytest.raises(plan.Refused):
            resolve.resolved_plan(p, bad[0], bad[1], [], read, bad[2], "r", p.plan_id, "now")
