"""Canonical JSON, digests and identifiers. Plans and decisions are bounded, so this runs on the driver."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time

#: Fixed: the alphabet of ULIDs (Crockford's base 32).
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def canonical(value: object) -> str:
    """Compact JSON with sorted keys; integers of any size keep all digits."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value: object) -> str:
    return "sha256:" + hashlib.sha256(canonical(value).encode()).hexdigest()


def short(text: str) -> str:
    """The first eight hexadecimal digits of a digest."""
    return text.removeprefix("sha256:")[:8]


def digest_bytes(text: str) -> bytes:
    if not re.fullmatch(r"sha256:[0-9a-fA-F]{64}", text):
        raise ValueError(f"not a sha256 digest: {text}")
    return bytes.fromhex(text[7:])


def digest_text(raw: bytes) -> str:
    if len(raw) != 32:
        raise ValueError(f"a sha256 digest has 32 bytes, not {len(raw)}")
    return "sha256:" + raw.hex()


def ulid(now: float | None = None, entropy: bytes | None = None) -> str:
    """A new ULID: 48 bits of milliseconds and 80 random bits."""
    return ulid_text(int((time.time() if now is None else now) * 1000).to_bytes(6, "big") + (os.urandom(10) if entropy is None else entropy))


def ulid_text(raw: bytes) -> str:
    if len(raw) != 16:
        raise ValueError(f"an identifier has 16 bytes, not {len(raw)}")
    n = int.from_bytes(raw, "big")
    return "".join(ALPHABET[n >> 5 * i & 31] for i in range(25, -1, -1))


def ulid_bytes(text: str) -> bytes:
    n = 0
    for c in text.upper():
        n = n << 5 | ALPHABET.index(c)
    if len(text) != 26 or n >> 128:
        raise ValueError(f"not an identifier: {text}")
    return n.to_bytes(16, "big")
