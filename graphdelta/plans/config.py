"""Rules and views as declared in TOML. Unknown keys, undeclared layers and bad globs are errors."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from graphdelta.functions.ids import glob_to_regex

RULES = ("layering", "cycles", "unreachable_state", "terminal_state_without_exit", "new_state_cycle", "io_in_hot_path", "destructive_migration")


class ConfigError(ValueError):
    """What is wrong with a configuration."""


@dataclass
class Config:
    order: list[str] = field(default_factory=list)
    layers: list[tuple[str, str]] = field(default_factory=list)  # (glob, layer), first fit wins
    forbid: list[tuple[str, str]] = field(default_factory=list)  # (from layer, to layer)
    enabled: list[str] = field(default_factory=list)
    entry: str | None = None
    deny: list[str] = field(default_factory=list)
    warn: list[str] = field(default_factory=list)
    new_only: bool = True
    hot: list[str] = field(default_factory=list)
    io: list[str] = field(default_factory=list)

    def severity(self, rule: str) -> str | None:
        return "deny" if rule in self.deny else "warn" if rule in self.warn else None

    def check(self) -> Config:
        for layer in [*(layer for _, layer in self.layers), *(x for pair in self.forbid for x in pair)]:
            if layer not in self.order:
                raise ConfigError(f"layer {layer!r} is not in layers.order")
        for glob in [*(g for g, _ in self.layers), *self.hot, *self.io]:
            try:
                glob_to_regex(glob)
            except ValueError as e:
                raise ConfigError(str(e)) from e
        return self


#: What holds without a configuration: the module view, and a warning on module cycles.
DEFAULT = Config(enabled=["modules"], warn=["cycles"])

_SECTIONS = {"layers": {"order", "map", "forbid"}, "views": {"enabled", "entry"}, "lint": {"deny", "warn"}, "ratchet": {"mode"}, "calls": {"hot", "io"}}


def _only(found: dict, known: set[str], where: str) -> None:
    if unknown := sorted(set(found) - known):
        raise ConfigError(f"unknown key {unknown[0]!r} in {where}")


def _strings(value: object, where: str) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ConfigError(f"{where} must be a list of strings")
    return list(value)


def parse(text: str) -> Config:
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    _only(raw, set(_SECTIONS), "the file")
    for name, keys in _SECTIONS.items():
        if not isinstance(raw.setdefault(name, {}), dict):
            raise ConfigError(f"{name} must be a table")
        _only(raw[name], keys, name)
    rows = {}
    for name, keys in (("map", ("glob", "layer")), ("forbid", ("from", "to"))):
        rows[name] = []
        for row in raw["layers"].get(name, []):
            _only(row, set(keys), f"layers.{name}")
            if set(row) != set(keys) or not all(isinstance(x, str) for x in row.values()):
                raise ConfigError(f"layers.{name} needs {' and '.join(keys)}")
            rows[name].append(tuple(row[k] for k in keys))
    mode = raw["ratchet"].get("mode", "new-only")
    if mode not in ("new-only", "all"):
        raise ConfigError(f"ratchet.mode {mode!r} is neither new-only nor all")
    lists = {f"{s}.{k}": _strings(raw[s].get(k, []), f"{s}.{k}") for s, k in (("layers", "order"), ("views", "enabled"), ("lint", "deny"), ("lint", "warn"), ("calls", "hot"), ("calls", "io"))}
    return Config(
        order=lists["layers.order"], layers=rows["map"], forbid=rows["forbid"], enabled=lists["views.enabled"], entry=raw["views"].get("entry"),
        deny=lists["lint.deny"], warn=lists["lint.warn"], new_only=mode == "new-only", hot=lists["calls.hot"], io=lists["calls.io"],
    ).check()
