"""The choices a caller makes; everything else is data."""

from __future__ import annotations

import re
from dataclasses import dataclass

ETA_METHODS = ("net-rate", "simple")
PAIRINGS = ("consecutive", "disjoint")


def check_pattern(pattern: str | None) -> str | None:
    """Reject a bad regular expression while the plan is built, not when it runs."""
    if not pattern:
        return None
    try:
        re.compile(pattern)
    except re.error as exc:
        raise ValueError(f"invalid pattern {pattern!r}: {exc}") from exc
    return pattern


@dataclass(frozen=True)
class Options:
    """
    include / exclude  unanchored regular expressions on the group id; empty = no filter
    show_empty         keep groups whose state is EMPTY
    eta_method         "net-rate": lag / (consumption - arrival); "simple": lag / consumption
    pairing            "consecutive": (0,1),(1,2),...; "disjoint": (0,1),(2,3),...
    max_pairs          stop after that many pairs of the history; None or -1 = all of them
    only_issues        keep only report rows that have an issue
    anonymize          show hashed group and topic names in reports
    group_filter / topic_filter
                       regular expressions applied to finished report rows
    legacy             results of the first-generation tool (see README)
    """

    include: str | None = None
    exclude: str | None = None
    show_empty: bool = False
    eta_method: str = "net-rate"
    pairing: str = "consecutive"
    max_pairs: int | None = None
    only_issues: bool = False
    anonymize: bool = False
    group_filter: str | None = None
    topic_filter: str | None = None
    legacy: bool = False

    def __post_init__(self):
        for name in ("include", "exclude", "group_filter", "topic_filter"):
            check_pattern(getattr(self, name))
        if self.eta_method not in ETA_METHODS:
            raise ValueError(f"eta_method must be one of {ETA_METHODS}")
        if self.pairing not in PAIRINGS:
            raise ValueError(f"pairing must be one of {PAIRINGS}")

    @property
    def pair_limit(self) -> int | None:
        return None if self.max_pairs is None or self.max_pairs < 0 else self.max_pairs
