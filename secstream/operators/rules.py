"""Detection rules as data: loading, checking, and compiling a match to a Column."""

from __future__ import annotations

import json
from dataclasses import dataclass, field as default
from functools import reduce
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from secstream.functions.fields import ENTITY_TYPES, FIELD_COLUMNS, field
from secstream.functions.scalar import SEVERITIES, seconds

try:
    import yaml
except ImportError:  # rule files may then only be JSON
    yaml = None

PACKS = Path(__file__).resolve().parent.parent / "rules"


@dataclass(frozen=True)
class Rule:
    """Fires once per entity and window, when the observation reaches the threshold."""

    id: str
    name: str
    severity: str
    group_by: str
    entity_type: str
    window: str
    threshold: int
    technique: str | None = None
    description: str | None = None
    enabled: bool = True
    match: dict[str, str] = default(default_factory=dict)
    match_any: dict[str, list[str]] = default(default_factory=dict)
    grace: str = "PT1M"
    distinct: str | None = None
    context_fields: list[str] = default(default_factory=list)

    def __post_init__(self) -> None:
        for name in ("id", "name", "severity", "group_by", "entity_type"):
            self._check(bool(str(getattr(self, name) or "").strip()), f"{name} is required")
        self._check(self.severity in SEVERITIES, f"unknown severity '{self.severity}'")
        self._check(self.entity_type in ENTITY_TYPES, f"unknown entity_type '{self.entity_type}'")
        self._check(self.window_seconds > 0, "window must be a positive duration like PT5M")
        self._check(self.threshold > 0, "threshold must be > 0")
        named = {
            "group_by": [self.group_by],
            "distinct": [self.distinct] if self.distinct else [],
            "match": self.match,
            "match_any": self.match_any,
            "context": self.context_fields,
        }
        for part, paths in named.items():
            for path in paths:
                self._check(path in FIELD_COLUMNS, f"unknown {part} field '{path}'")
        self._check(self.grace_seconds <= self.window_seconds, "grace must not exceed the window")

    def _check(self, holds: bool, message: str) -> None:
        if not holds:
            raise ValueError(f"rule '{self.id}': {message}")

    @property
    def window_seconds(self) -> int:
        return seconds(self.window)

    @property
    def grace_seconds(self) -> int:
        return seconds(self.grace)


def parse_rule(entry: dict) -> Rule:
    try:
        return Rule(**{key: value for key, value in entry.items() if value is not None})
    except TypeError as problem:  # an unknown or a missing key
        raise ValueError(f"rule '{entry.get('id')}': {problem}") from None


def load_rules(directory: str | Path = PACKS / "standard") -> list[Rule]:
    """All rules of a directory; ids must be unique. Disabled rules are kept, not evaluated."""
    rules: list[Rule] = []
    for path in sorted(Path(directory).iterdir()):
        if path.suffix == ".json":
            content = json.loads(path.read_text())
        elif path.suffix in (".yaml", ".yml") and yaml is not None:
            content = yaml.safe_load(path.read_text())
        else:
            continue
        rules += [parse_rule(entry) for entry in (content if isinstance(content, list) else [content])]
    if not rules:
        raise ValueError(f"no rules in {directory}")
    ids = [rule.id for rule in rules]
    repeated = sorted({i for i in ids if ids.count(i) > 1})
    if repeated:
        raise ValueError(f"duplicate rule ids: {repeated}")
    return rules


def compile_match(rule: Rule) -> Column:
    """All equality and any-of conditions; a null value never matches."""
    conditions = [field(path) == F.lit(wanted) for path, wanted in rule.match.items()]
    conditions += [field(path).isin(list(wanted)) for path, wanted in rule.match_any.items()]
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
