"""Scores from judges' free-text answers, in tiers from valid JSON to broken text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.text import or_empty, strip

# Names of grades and patterns of answers that results depend on.
AXES = ("justification", "coherence", "clarity")
SCORED_OBJECT = r'\{[^{}]*"score"\s*:\s*[0-9]+[^{}]*\}'
ANY_OBJECT = r"\{[^{}]*\}"
BROKEN_SCORE = r'"score"\s*:\s*([1-5])'
POINTS = r"(\d)\s*점\s*(?:기준|에 해당|입니다|[:.])"
FENCE_OPEN, FENCE_CLOSE = r"^```[a-zA-Z]*\n", r"\n```$"
LOOSE_GRADE = r'"%s"\s*:\s*([1-5])'


def unfenced(text: Column) -> Column:
    """Without a code fence around the answer."""
    body = strip(or_empty(text))
    inner = F.regexp_replace(F.regexp_replace(body, FENCE_OPEN, ""), FENCE_CLOSE, "")
    return F.when(body.startswith("```"), inner).otherwise(body)


def _number(obj: Column, path: str) -> Column:
    """A field that is a number; digits in quotes are none."""
    plain = obj.rlike(rf'"{path}"\s*:\s*[-0-9]')
    return F.when(plain, F.get_json_object(obj, f"$.{path}").try_cast("double"))


def _grade(obj: Column, path: str) -> Column:
    value = _number(obj, path)
    return F.when(value.between(1, 5), value)


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def judge_object(text: Column) -> Column:
    """The last JSON object with a score of 1 to 5, as text; null without one."""
    found = F.regexp_extract_all(unfenced(text), F.lit(SCORED_OBJECT), F.lit(0))
    return _last(F.filter(found, lambda o: _grade(o, "score").isNotNull()))


def judge_score(text: Column) -> Column:
    """The score: of the last valid object, else of the last ``"score": n``, else of a phrase in points."""
    body = unfenced(text)
    broken = _last(F.regexp_extract_all(body, F.lit(BROKEN_SCORE), F.lit(1))).try_cast("double")
    points = _last(F.regexp_extract_all(body, F.lit(POINTS), F.lit(1)))
    points = points.try_cast("double")
    return F.coalesce(_grade(judge_object(text), "score"), broken, F.when(broken.isNull() & points.between(1, 5), points))


def judge_letter(text: Column) -> Column:
    """The supported letter of the last valid object."""
    return F.get_json_object(judge_object(text), "$.supported_letter")


def composite(justification: Column, coherence: Column, clarity: Column, score: Column | None = None) -> Column:
    """Mean of three grades if all are valid, else a valid single score, else null."""
    valid = lambda c: F.when(c.between(1, 5), c.cast("double"))
    mean = (valid(justification) + valid(coherence) + valid(clarity)) / 3
    return mean if score is None else F.coalesce(mean, valid(score))


def _composite_of(obj: Column) -> Column:
    return composite(*(_number(obj, a) for a in AXES), _number(obj, "score"))


def quality_score(text: Column) -> Column:
    """The composite of the last object that has one, else of grades found in broken JSON."""
    body = unfenced(text)
    objects = F.filter(F.regexp_extract_all(body, F.lit(ANY_OBJECT), F.lit(0)), lambda o: _composite_of(o).isNotNull())
    loose = lambda name: _last(
        F.regexp_extract_all(body, F.lit(LOOSE_GRADE % name), F.lit(1))
    ).try_cast("double")
    return F.coalesce(_composite_of(_last(objects)), composite(*(loose(a) for a in AXES), loose("score")))


def mean_of_valid(scores: Column) -> Column:
    """Mean over repeats that gave a score; null if none did."""
    valid = F.filter(scores, lambda s: s.isNotNull())
    total = F.aggregate(valid, F.lit(0.0), lambda a, s: a + s.cast("double"))
    return F.when(F.size(valid) > 0, total / F.size(valid))
