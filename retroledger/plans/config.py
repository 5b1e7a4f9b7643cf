"""Profiles and policy: where a log and its targets are, and what limits hold."""

from __future__ import annotations

import json
import os
import random
from dataclasses import asdict, dataclass, field, fields, replace

VERSION = 1


@dataclass(frozen=True)
class Policy:
    max_transaction_rows: int = 1000
    max_transaction_bytes: int = 64 << 20
    max_plan_bytes: int = 128 << 20
    max_chain_depth: int = 20
    lock_wait_seconds: int = 5
    check_rows: int = 1_000_000
    index_files: int = 100_000
    read_seconds: int = 3600

    def __post_init__(self):
        for f in fields(self):
            if getattr(self, f.name) <= 0:
                raise ValueError(f"{f.name} must be positive")


@dataclass(frozen=True)
class Profile:
    backend: str
    log: str
    target: str
    instance: str = ""
    catalog: str = ""
    server_id: int = 0
    lacks: list[str] = field(default_factory=list)
    policy: Policy = field(default_factory=Policy)


def _known(kind: type, raw: dict, where: str) -> dict:
    extra = set(raw) - {f.name for f in fields(kind)}
    if extra:
        raise ValueError(f"unknown fields in {where}: {', '.join(sorted(extra))}")
    return raw


def load(path: str) -> dict[str, Profile]:
    """Profiles by name. Unknown fields and other versions are errors; a policy without max_transaction_rows gets all the
    defaults, one with it must state valid limits."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    if set(raw) - {"version", "profiles"} or raw.get("version") != VERSION:
        raise ValueError(f"not a configuration of version {VERSION}")
    out = {}
    for name, p in raw.get("profiles", {}).items():
        policy = _known(Policy, p.get("policy") or {}, f"policy of {name}")
        limits = Policy(**policy) if policy.get("max_transaction_rows") else Policy()
        out[name] = Profile(**(_known(Profile, p, name) | {"policy": limits}))
    return out


def save(path: str, profiles: dict[str, Profile]) -> None:
    text = json.dumps({"version": VERSION, "profiles": {k: asdict(p) for k, p in profiles.items()}}, indent=1, sort_keys=True)
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        f.write(text + "\n")


def grants(user: str, schemas: list[str], metadata: str = "retro_meta") -> list[str]:
    """Statements that give an account what reading the log and applying plans need."""
    quoted = "'" + user.replace("'", "''") + "'"
    log = [f"GRANT REPLICATION SLAVE, REPLICATION CLIENT ON *.* TO {quoted};"]
    return log + [f"GRANT SELECT, INSERT, UPDATE, DELETE ON `{s.replace('`', '``')}`.* TO {quoted};" for s in [*schemas, metadata]]


def new_server_id(rng: random.Random | None = None) -> int:
    """A random replica number, above those that people give by hand."""
    return (rng or random.SystemRandom()).randrange(10_000, 1 << 32)


def init(path: str, name: str, new: Profile) -> Profile:
    """Adds a profile to a configuration file, which is made if need be; a profile that is there is never replaced."""
    known = load(path) if os.path.exists(path) else {}
    if name in known:
        raise FileExistsError(f"profile {name}")
    made = new if new.server_id else replace(new, server_id=new_server_id())
    save(path, known | {name: made})
    return made


def profile(profiles: dict[str, Profile], name: str | None) -> Profile:
    """The named profile; without a name the only one."""
    if name is None and len(profiles) == 1:
        return next(iter(profiles.values()))
    if name not in profiles:
        raise LookupError(f"no profile {name}; there are: {', '.join(sorted(profiles))}")
    return profiles[name]
