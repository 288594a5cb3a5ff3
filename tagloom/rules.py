"""Prompt rules: the argument of ``build_prompts``, checked when the plan is built."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from tagloom import fixed

CONFIDENCE = "confidence"
NAME = "name"


@dataclass(frozen=True)
class GroupRule:
    group_id: str
    enabled: bool = True
    sort: str = CONFIDENCE


@dataclass(frozen=True)
class PromptRules:
    """Defaults: no explicit group order, one global threshold, underscores to spaces, no weights."""

    groups: Sequence[GroupRule] = ()
    use_global_threshold: bool = True
    group_thresholds: Mapping[str, float] = field(default_factory=dict)
    underscore_to_space: bool = True
    escape_parens: bool = True
    excluded: Sequence[str] = ()
    replacements: Mapping[str, str | None] = field(default_factory=dict)
    weights: bool = False
    min_weight: float = 1.00
    max_weight: float = 1.30
    tag_separator: str = ", "
    group_separator: str = ", "
    prefix: str = ""
    suffix: str = ""
    max_tags: int = 100
    trailing_separator: bool = False
    quality: str = "none"
    custom_quality: str = ""

    def check(self) -> "PromptRules":
        if not self.tag_separator or not self.group_separator:
            raise ValueError("separators must not be empty")
        if not 1 <= self.max_tags <= 500:
            raise ValueError("max_tags must lie in 1..500")
        for group, value in self.group_thresholds.items():
            check_threshold(value, f"threshold of group {group!r}")
        for weight in (self.min_weight, self.max_weight):
            if not math.isfinite(weight) or not 0.5 <= weight <= 5:
                raise ValueError("weights must lie in 0.5..5")
        if self.min_weight > self.max_weight:
            raise ValueError("min_weight must not exceed max_weight")
        for rule in self.groups:
            if not rule.group_id:
                raise ValueError("a group rule needs a group id")
            if rule.sort not in (CONFIDENCE, NAME):
                raise ValueError(f"unknown sort mode {rule.sort!r}")
        if self.quality not in (*fixed.QUALITY_TAGS, "custom"):
            raise ValueError(f"unknown quality preset {self.quality!r}")
        return self

    def quality_text(self) -> str:
        if self.quality == "custom":
            return (self.custom_quality or "").strip()
        return fixed.QUALITY_TAGS[self.quality]


def default_rules(group_ids: Sequence[str]) -> PromptRules:
    """Rules naming every declared group in reverse declaration order, all enabled."""
    return PromptRules(groups=tuple(GroupRule(g) for g in reversed(list(group_ids)) if g))


def check_threshold(value: float, what: str = "threshold") -> float:
    if not math.isfinite(value) or not 0 <= value <= 1:
        raise ValueError(f"{what} must be finite and lie in 0..1")
    return float(value)
