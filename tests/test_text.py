import pytest
from pyspark.sql import functions as F

from tracemill.functions import judge as J
from tracemill.functions import text as X


def value(spark, make, *args):
    names = [f"c{i}" for i in range(len(args))]
    kinds = ", ".join(f"{n} {'string' if isinstance(a, str) or a is None else 'double' if isinstance(a, float) else 'int'}" for n, a in zip(names, args, strict=True))
    return spark.createDataFrame([args], kinds).select(make(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "make, args, want",
    [
        (X.ko_hedges, ("하지만 다시 생각 하면",), 2),
        (X.hedge_rate, ("하지만 다시 생각 하면",), 50.0),
        (X.en_hedges, ("distribute button but",), 1),
        (X.en_hedges, ("but하지만 but",), 1),
        (X.ko_hedges, ("but하지만 but",), 1),
        (X.en_hedges, ("this is not right",), 2),
        (X.hedge_rate, ("",), 0.0),
        (X.hedge_rate, (None,), 0.0),
        (X.parse_answer, ("정답: A … 정답: C",), "C"),
        (X.parse_answer, ("the choice is (D).",), "D"),
        (X.parse_answer, ("없음",), None),
        (X.parse_answer, (None,), None),
        (X.parse_answer, ("정답： B",), "B"),
        (X.parse_answer, ("A" + "x" * 100,), None),
        (X.parse_answer_lenient, ("따라서 (C) 그리고" + " 가" * 100,), "C"),
        (X.parse_answer_lenient, ("답은 B 아니다. 답은 D" + " 가" * 100,), "D"),
        (X.parse_answer_lenient, ("답은 B 아니다." + " 가" * 100,), None),
        (X.parse_answer_lenient, (None,), None),
        (lambda t: X.think_text(F.lit(None).cast("string"), t), ("x<think> a </think>y",), "a"),
        (X.think_block, ("x<think> a </think>y",), " a "),
        (X.internal_reasoning, ("x<think> a </think>y",), "a"),
        (X.internal_reasoning, ("<think>" + "b" * 8000 + "</think>",), "<think>" + "b" * 7993),
        (X.without_think, ("x<think> a </think>y",), "xy"),
        (X.without_trailing_answer, ("reason\nThus, 정답: (B).",), "reason"),
        (X.without_trailing_answer, ("reason 정답： E",), "reason"),
        (X.letter, (" b ",), "B"),
        (X.letter, ("F",), None),
        (X.letter_of_number, (1,), "A"),
        (X.letter_of_number, (0,), "A"),
        (X.letter_of_number, (6,), None),
        (X.answer_index, ("3",), 3),
        (X.answer_index, ("d",), 3),
        (X.answer_index_from_one, ("3",), 2),
        (X.answer_index_from_one, ("0",), 0),
        (X.answer_index_from_one, ("9",), None),
        (X.word_count, ("a　b c  d",), 4),
        (X.word_count, ("",), 0),
        (X.longest_run, ("ab abcd a",), 4),
        (X.longest_run, (None,), 0),
        (X.garbage_ratio, ("가a漢字",), 0.5),
        (X.garbage_ratio, ("",), 0.0),
        (X.en_ratio, ("ab 가나 a b",), 0.25),
        (X.reasoning_part, ("because \n정답: B",), "because"),
        (X.reasoning_part, ("정답: B",), "정답: B"),
        (X.first_letter, ("x B A",), "B"),
        (X.first_grade, ("none",), 1),
        (X.first_grade, ("is 4",), 4),
        (X.answer_after, ("t 답: one 답: two ",), "two"),
        (X.says_yes, ("yes.",), True),
        (X.says_yes, ("eyes",), False),
        (X.think_language, ("가나다 abc",), "mixed"),
        (X.think_language, ("가나다",), "korean"),
        (X.think_language, ("",), None),
        (X.think_language, ("123",), "undetermined"),
        (lambda t: X.prefix_share(t, 0.5), ("a b c d e",), "a b"),
        (J.judge_score, ('{"score": 9} {"score": 4}',), 4.0),
        (J.judge_score, ('{"score": 3, "reason": "x',), 3.0),
        (J.judge_score, ("```json\n{\"score\": 2}\n```",), 2.0),
        (J.judge_score, ("4점 입니다",), 4.0),
        (J.judge_score, ("",), None),
        (J.judge_score, (None,), None),
        (J.composite, (4.0, 3.0, 5.0), 4.0),
        (J.composite, (4.0, None, 5.0), None),
        (J.quality_score, ('{"justification": 4, "coherence": 3, "clarity": 5}',), 4.0),
        (J.quality_score, ('{"justification": 4, "coherence": 3, "clarity": 5, "r": "cut',), 4.0),
        (J.quality_score, ('{"score": 2}',), 2.0),
    ],
)
def test_values(spark, make, args, want):
    if any(a is None for a in args) and len(args) > 1:
        df = spark.createDataFrame([args], ", ".join(f"c{i} double" for i in range(len(args))))
        assert df.select(make(*df.columns and map(F.col, df.columns)).alias("x")).first()["x"] == want
    else:
        assert value(spark, make, *args) == want


def test_format_check(spark):
    text = " ".join(X.STEP_LABELS) + " 정답: A"
    assert value(spark, X.format_check, text).all_steps_present
    assert not value(spark, X.format_check, "").all_steps_present


def test_question_block(spark):
    df = spark.createDataFrame([("q", ["x", "y"])], "q string, c array<string>")
    assert df.select(X.question_block(F.col("q"), F.col("c"))).first()[0] == "[Question]\nq\n\n[Options]\nA. x\nB. y"
