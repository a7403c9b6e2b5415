"""Configuration: consumers and their rules, user-defined categories, limits; presets, validation, files."""

from __future__ import annotations

import copy
import json
import os
import re
import tempfile
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from veilframe.functions.masks import STRATEGIES, TOKEN_SALT
from veilframe.functions.types import NAMES

DEFAULT_FLOOR = 0.7
STRATEGY_NAMES = frozenset(STRATEGIES) | {"synthetic"}


@dataclass
class Rule:
    enabled: bool = True
    strategy: str = "stars_keep2"
    requires_companion: list[str] = field(default_factory=list)
    min_confidence: float = DEFAULT_FLOOR


@dataclass
class System:
    id: str
    name: str = ""
    enabled: bool = True
    api_key: str = ""
    demask: bool = True
    types: dict[str, Rule] = field(default_factory=dict)


@dataclass
class CustomType:
    name: str
    pattern: str
    anchors: list[str] = field(default_factory=list)
    window: int = 0
    strategy: str = "stars_keep2"
    label: str = ""
    min_confidence: float = DEFAULT_FLOOR


@dataclass
class Store:
    shards: int = 64
    ttl_ms: int = 1_800_000
    max_entries: int = 1_000_000
    max_value_bytes: int = 1 << 20
    max_bytes: int = 512 << 20


@dataclass
class Llm:
    base_url: str = ""
    model: str = ""
    strategy: str = "token"
    requests_per_minute: int = 60


@dataclass
class Config:
    systems: list[System] = field(default_factory=list)
    custom_types: list[CustomType] = field(default_factory=list)
    store: Store = field(default_factory=Store)
    llm: Llm = field(default_factory=Llm)
    default_system: str = "default"
    require_system: bool = False
    expand_labels: bool = False
    chunk_bytes: int = 64 << 10
    chunk_overlap: int = 256
    ref_year: int = 2025  # dates later than the year after this aren't plausible
    token_salt: str = TOKEN_SALT  # equal salts give equal tokens
    on_error: str = "fail"  # or "echo": a payload that a detector fails on stays as it is
    words: str = ""  # a folder of additional word lists
    mailboxes: str = "personal"  # or "ascii": e-mail addresses of roles and institutions, too, but ASCII ones only

    def system(self, id_: str | None) -> System | None:
        """The named system if it is enabled; else the default one, unless a system is required."""
        named = next((s for s in self.systems if s.id == id_ and s.enabled), None)
        if named or self.require_system:
            return named
        return next((s for s in self.systems if s.id == self.default_system and s.enabled), None)


def default_rules(strategy: str | None = None) -> dict[str, Rule]:
    """A rule for each category. CVV and PIN need no companion."""
    own = {"FIO": "initials", "CARD_HOLDER": "initials_latin", "CVV": "stars_all", "PIN": "stars_all"}
    return {t: Rule(strategy=strategy or own.get(t, "stars_keep2")) for t in NAMES}


def default() -> Config:
    return Config(
        systems=[
            System("default", "Default consumer", types=default_rules()),
            System("chat-assistant", "Chat assistant", types=default_rules()),
            System("analytics", "Analytics", demask=False, types=default_rules()),
        ]
    )


def preset(name: str) -> Config:
    """The default configuration with another strategy for every category."""
    made = default()
    whole = {"keep2": "stars_keep2", "stars-all": "stars_all", "labels": "label", "tokens": "token", "synthetic": "synthetic", "span-with-labels": "stars_keep2"}
    if name == "keep-domain":
        for s in made.systems:
            s.types["EMAIL"].strategy = "keep_domain"
    elif name in whole:
        for s in made.systems:
            s.types = default_rules(whole[name])
        made.expand_labels = name == "span-with-labels"
    else:
        raise ValueError(f"unknown preset {name!r}")
    return made


PRESETS = ["keep2", "stars-all", "labels", "tokens", "synthetic", "keep-domain", "span-with-labels"]

# what a linear-time matcher lacks, and what makes a backtracking one slow
RISKY = re.compile(r"\(\?[=!<]|\\[1-9]|\(\?>|[*+?}]\+|\([^()]*[*+][^()]*\)[*+{]")


def problems(c: Config) -> list[str]:
    """What is wrong with a configuration."""
    out, known = [], set(NAMES)
    ids = [s.id for s in c.systems]
    out += [f"system id {i!r} is not unique" for i in sorted({i for i in ids if ids.count(i) > 1})]
    out += [f"system id {i!r} is malformed" for i in ids if not re.fullmatch(r"[a-z0-9][a-z0-9_-]{0,63}", i)]
    custom = [t.name for t in c.custom_types]
    for t in c.custom_types:
        if not re.fullmatch(r"[A-Z][A-Z0-9_]{1,40}", t.name) or t.name in known:
            out.append(f"custom type {t.name!r}: bad or built-in name")
        if custom.count(t.name) > 1:
            out.append(f"custom type {t.name!r} is not unique")
        try:
            if re.compile(t.pattern).match("") or not t.pattern or len(t.pattern) > 512:
                out.append(f"custom type {t.name!r}: pattern is empty, too long or matches nothing")
            if RISKY.search(t.pattern):
                out.append(f"custom type {t.name!r}: pattern needs look-around, references or nested repeats")
        except re.error as e:
            out.append(f"custom type {t.name!r}: {e}")
        if not 0 <= t.window <= 200:
            out.append(f"custom type {t.name!r}: window must be 0 to 200 bytes")
        if not 0 <= t.min_confidence <= 1:
            out.append(f"custom type {t.name!r}: confidence must be 0 to 1")
        if t.strategy not in STRATEGY_NAMES:
            out.append(f"custom type {t.name!r}: unknown strategy {t.strategy!r}")
    for s in c.systems:
        for name, r in s.types.items():
            if name not in known and name not in custom:
                out.append(f"system {s.id!r}: unknown type {name!r}")
            if r.strategy not in STRATEGY_NAMES:
                out.append(f"system {s.id!r}, {name}: unknown strategy {r.strategy!r}")
            if not 0 <= r.min_confidence <= 1:
                out.append(f"system {s.id!r}, {name}: confidence must be 0 to 1")
            out += [f"system {s.id!r}, {name}: unknown companion {x!r}" for x in r.requires_companion if x not in known]
    if c.on_error not in ("fail", "echo"):
        out.append(f"unknown on_error {c.on_error!r}")
    if c.mailboxes not in ("personal", "ascii"):
        out.append(f"unknown mailboxes {c.mailboxes!r}")
    if c.store.max_bytes < 2 * c.store.max_value_bytes:
        out.append("store: max_bytes must be twice max_value_bytes at least")
    if c.store.ttl_ms <= 0 or c.store.shards <= 0 or c.store.max_entries <= 0:
        out.append("store: limits must be positive")
    if c.llm.strategy not in STRATEGY_NAMES:
        out.append(f"llm: unknown strategy {c.llm.strategy!r}")
    return out


def checked(c: Config) -> Config:
    if found := problems(c):
        raise ValueError("; ".join(found))
    return c


def from_dict(d: dict) -> Config:
    d = copy.deepcopy(d)
    d["systems"] = [System(**{**s, "types": {k: Rule(**r) for k, r in s.get("types", {}).items()}}) for s in d.get("systems", [])]
    d["custom_types"] = [CustomType(**t) for t in d.get("custom_types", [])]
    d["store"], d["llm"] = Store(**d.get("store", {})), Llm(**d.get("llm", {}))
    return Config(**d)


def load(path: str) -> Config:
    """The configuration of a JSON file; the default one if there is none."""
    if not os.path.exists(path):
        return default()
    with open(path, encoding="utf-8") as f:
        return checked(from_dict(json.load(f)))


def save(c: Config, path: str) -> None:
    """Writes the file whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(asdict(checked(c)), f, ensure_ascii=False, indent=2)
    os.replace(f.name, path)


def redacted(c: Config) -> dict:
    """The configuration without its secrets."""
    out = asdict(c)
    for s in out["systems"]:
        s["api_key"] = "***" if s["api_key"] else ""
    return out


def with_secrets(new: Config, old: Config) -> Config:
    """new, where redacted secrets are those of old."""
    keys = {s.id: s.api_key for s in old.systems}
    for s in new.systems:
        if s.api_key == "***":
            s.api_key = keys.get(s.id, "")
    return new


RULES = "system_id string, type string, enabled boolean, strategy string, requires_companion array<string>, min_confidence double"


def rules_table(spark: SparkSession, c: Config) -> DataFrame:
    return spark.createDataFrame([(s.id, t, r.enabled, r.strategy, r.requires_companion, r.min_confidence) for s in c.systems for t, r in s.types.items()], RULES)


def systems_table(spark: SparkSession, c: Config) -> DataFrame:
    return spark.createDataFrame([(s.id, s.name, s.enabled, s.demask) for s in c.systems], "system_id string, name string, enabled boolean, demask boolean")
