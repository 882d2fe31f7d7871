"""Thresholds, as plain values that become literals of a plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class RuleGates:
    """Limits of the rule gates; what exceeds a maximum is rejected, the word counts are inclusive."""

    garbage_ratio_max: float = 0.15
    max_run_no_space: int = 200
    min_words: int = 20
    max_words: int = 4000


@dataclass(frozen=True)
class GapGate:
    """Limits of the counterfactual gate; None turns a limit off."""

    gap: float = 1.5
    min_orig: float | None = 2.0
    hedge: float | None = 0.5
    on_missing: str = "pass"


def number_or_none(text: str) -> float | None:
    """A command line's threshold: ``none``, ``off`` and an empty text turn it off."""
    return None if text.strip().lower() in ("none", "off", "") else float(text)


#: Where a file of several stages keeps each kind's thresholds, and what it calls them.
SECTIONS = {"RuleGates": ("c1_filters",), "GapGate": ("proposal_filters", "counterfactual")}
NAMES = {"gap_threshold": "gap", "min_orig_score": "min_orig", "hedge_gap_threshold": "hedge"}


def parse(text: str, path: str = "") -> dict:
    """A mapping from JSON or YAML text."""
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:  # JSON is YAML too
        try:
            return json.loads(text)
        except ValueError:
            raise ImportError("reading YAML needs the yaml package") from e
    return yaml.safe_load(text) or {}


def load(kind: type, path: str | None = None, missing_ok: bool = True, spark: object = None):
    """Thresholds from a JSON or YAML file; a missing file gives the defaults unless it must be there.

    A file may hold the thresholds themselves or have them in the kind's section.  With a session the path
    may be in any store that Spark reads.
    """
    if spark is not None and path is not None:
        from tracemill.workspace import exists, read_text

        text = read_text(spark, path) if exists(spark, path) else None
    else:
        text = Path(path).read_text(encoding="utf-8") if path is not None and Path(path).exists() else None
    if text is None:
        if path is not None and not missing_ok:
            raise FileNotFoundError(path)
        return kind()
    found = parse(text, path)
    part = found
    for name in SECTIONS.get(kind.__name__, ()):
        part = part.get(name) if isinstance(part, dict) else None
    found = part if isinstance(part, dict) else found
    known = {f.name for f in fields(kind)}
    return kind(**{NAMES.get(k, k): v for k, v in found.items() if NAMES.get(k, k) in known})
