"""Scorers by configuration: a name or ``module:function`` and its options, as drivers and commands take them.

A factory gets the options (model, reasoning on or off, what else the backend takes) and returns a function
of a row.  Backends are registered by whoever has them; ``stub`` is always there.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from tracemill.operators.scoring import stub_grade

Factory = Callable[..., Callable[[dict], object]]
_FACTORIES: dict[str, Factory] = {}


def register(name: str) -> Callable[[Factory], Factory]:
    """Make a backend known by name."""

    def add(factory: Factory) -> Factory:
        _FACTORIES[name] = factory
        return factory

    return add


def scorer(spec: str, **options: object) -> Callable[[dict], object]:
    """The function of a row that ``spec`` names, made with its options; options that are None are left out."""
    given = {k: v for k, v in options.items() if v is not None}
    if ":" in spec:
        module, _, name = spec.partition(":")
        return getattr(import_module(module), name)(**given)
    if spec not in _FACTORIES:
        raise ValueError(f"no scorer {spec!r}; there are {', '.join(sorted(_FACTORIES))}")
    return _FACTORIES[spec](**given)


@register("stub")
def _stub(role: str = "judge", model: str = "stub", reasoning: bool = True) -> Callable[[dict], object]:
    """Stands in for a judge (an answer with a grade and a letter) or a writer of counterfactuals, by the row alone."""
    if role == "judge":

        def judge(row: dict) -> str:
            grade = stub_grade(model, row["cot"])
            return f'{{"supported_letter": "{"ABCDE"[grade - 1]}", "score": {grade}, "justification": {grade}, "coherence": {grade}, "clarity": {grade}}}'

        return judge

    def write(row: dict) -> dict:
        said = f"option {row['target_idx']} of {row['question']}"
        return {"cf_cot": f"<think>{said}</think>" if reasoning else said, "regen_model": model}

    return write
