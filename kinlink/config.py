"""Configuration of a match: field rules, scope, source filter, decision.

Plain dataclasses, validated when built; `from_dict` reads the JSON form.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass

from kinlink.errors import ConfigError

MATCHERS = ("exact", "contains", "fuzzy", "hybrid", "numeric", "semantic")


@dataclass(frozen=True)
class Side:
    """Where a rule's text comes from: columns joined, the first filled one, or each for itself; or a fixed value."""

    columns: tuple[str, ...] = ()
    combine: str = "concat"
    separator: str = " "
    processors: tuple[Mapping, ...] = ()
    fixed_value: str | None = None

    def __post_init__(self):
        if self.combine not in ("concat", "coalesce", "best_of"):
            raise ConfigError("COMBINE_INVALID", self.combine)
        if bool(self.columns) == (self.fixed_value is not None):
            raise ConfigError("FIELD_SIDE_INVALID", "either columns or a fixed value")


@dataclass(frozen=True)
class Rule:
    id: str
    source: Side
    target: Side
    matcher: str = "exact"
    weight: int = 0
    critical: bool = False
    veto_threshold: float | None = None
    matcher_options: Mapping = field(default_factory=dict)
    value_mapping: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.matcher not in MATCHERS:
            raise ConfigError("MATCHER_NOT_FOUND", self.matcher)
        if not 0 <= self.weight <= 100:
            raise ConfigError("WEIGHT_INVALID", self.id)
        if self.veto_threshold is not None and not 0 <= self.veto_threshold <= 100:
            raise ConfigError("VETO_INVALID", self.id)
        if self.veto_threshold is not None and self.semantic:
            raise ConfigError("VETO_INVALID", f"{self.id}: a semantic rule cannot veto")

    @property
    def semantic(self) -> bool:
        return self.matcher == "semantic" or (self.matcher == "hybrid" and bool(self.matcher_options.get("include_semantic")))


@dataclass(frozen=True)
class SourceFilter:
    column: str
    values: tuple[str, ...]
    mode: str = "include"
    match: str = "exact"

    def __post_init__(self):
        if self.mode not in ("include", "exclude") or self.match not in ("exact", "contains"):
            raise ConfigError("SOURCE_FILTER_INVALID")


@dataclass(frozen=True)
class Scope:
    mode: str = "GLOBAL"
    source_column: str | None = None
    target_column: str | None = None
    mapping: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        if self.mode not in ("GLOBAL", "STRICT", "MAPPED"):
            raise ConfigError("SCOPE_INVALID", self.mode)
        if self.mode != "GLOBAL" and not (self.source_column and self.target_column):
            raise ConfigError("SCOPE_INVALID", "columns")


@dataclass(frozen=True)
class Decision:
    """score >= success: MATCHED; else above 0 and reviews enabled: REVIEW; else UNMATCHED."""

    success_threshold: float = 88.0
    review_enabled: bool = True
    top_n: int = 5
    minimum_compared_fields: int = 0
    minimum_weight_coverage: float = 0.0
    tie_break: str = "top1"

    def __post_init__(self):
        if not 0 < self.success_threshold <= 100 or self.top_n < 1:
            raise ConfigError("DECISION_INVALID")


@dataclass(frozen=True)
class Retrieval:
    mode: str = "auto"
    top_k: int = 50
    oversample: int = 4
    source: Side | None = None
    target: Side | None = None


@dataclass(frozen=True)
class MatchConfig:
    rules: tuple[Rule, ...]
    group_code_column: str
    source_id_column: str | None = None
    scope: Scope = field(default_factory=Scope)
    source_filter: SourceFilter | None = None
    decision: Decision = field(default_factory=Decision)
    retrieval: Retrieval = field(default_factory=Retrieval)

    def __post_init__(self):
        if not self.rules or sum(r.weight for r in self.rules) <= 0:
            raise ConfigError("WEIGHT_SUM_INVALID")
        if len({r.id for r in self.rules}) != len(self.rules):
            raise ConfigError("RULE_ID_DUPLICATE")

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    def sha256(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    def text_signature(self, role: str) -> str:
        """Digest of all that a side's retrieval text follows from: its own definition, or the sides of the weighted rules (with value mappings of the source)."""
        own = getattr(self.retrieval, role)
        if own is not None:
            what: object = {"explicit": asdict(own)}
        else:
            rules = [r for r in self.rules if r.weight > 0]
            mapped = role == "source" and any(r.value_mapping for r in rules)
            what = {"derived_from_rules": [{"side": asdict(getattr(r, role)), "value_mapping": dict(r.value_mapping)} if mapped else asdict(getattr(r, role)) for r in rules]}
        return hashlib.sha256(json.dumps(what, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def source_columns(self) -> list[str]:
        own = [c for r in self.rules for c in r.source.columns]
        own += [c for c in (self.source_id_column, self.scope.source_column, self.source_filter.column if self.source_filter else None) if c]
        return list(dict.fromkeys(own))

    def target_columns(self) -> list[str]:
        own = [c for r in self.rules for c in r.target.columns]
        own += [c for c in (self.group_code_column, self.scope.target_column) if c]
        return list(dict.fromkeys(own))


def from_dict(cls, d):
    """Builds a configuration dataclass from its JSON form; unknown keys are refused."""
    kinds = {"source": Side, "target": Side, "scope": Scope, "source_filter": SourceFilter, "decision": Decision, "retrieval": Retrieval}
    known = {f.name for f in fields(cls)}
    if extra := set(d) - known:
        raise ConfigError("CONFIG_INVALID", f"unknown {sorted(extra)}")
    out = {}
    for k, v in d.items():
        if k == "rules":
            v = tuple(x if is_dataclass(x) else from_dict(Rule, x) for x in v)
        elif k in kinds and isinstance(v, Mapping):
            v = from_dict(kinds[k], v)
        elif isinstance(v, list):
            v = tuple(v)
        out[k] = v
    return cls(**out)


def require_columns(have: list[str], need: list[str]) -> None:
    """Plan-time check that the configured columns exist."""
    missing = [c for c in need if c not in have]
    if missing:
        raise ConfigError("COLUMN_NOT_FOUND", ", ".join(missing))
