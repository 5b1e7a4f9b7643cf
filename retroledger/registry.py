"""Backends by name: a factory takes a profile and gives what reads and applies for it."""

from __future__ import annotations

from collections.abc import Callable

from .plans.config import Profile

_factories: dict[str, Callable[[Profile], object]] = {}


def register(name: str, factory: Callable[[Profile], object]) -> None:
    if name in _factories:
        raise ValueError(f"backend {name} is registered already")
    _factories[name] = factory


def resolve(profile: Profile) -> object:
    if profile.backend not in _factories:
        raise LookupError(f"no backend {profile.backend}; there are: {', '.join(names())}")
    return _factories[profile.backend](profile)


def names() -> list[str]:
    return sorted(_factories)
