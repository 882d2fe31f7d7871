"""Scalar expressions over texts: every function takes and returns columns and stays in the JVM.

All are total: null and empty inputs have a defined result, so gates may run in any order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.schemas import LETTERS

# Word lists, phrases and character classes that results depend on.
KO_HEDGES = (
    "하지만", "그러나", "다시 생각", "확실하지", "정정",
    "아닌 것 같", "다른 것 같", "혹시", "잠깐", "재고",
    "다시 보면", "다시 살펴", "재확인", "아닐 수도",
    "맞는지", "맞지 않", "수정", "틀렸", "잘못",
    "오히려", "그렇지 않", "아닌가",
)
EN_HEDGE_WORDS = (
    "but", "however", "wait", "actually", "reconsider", "rethink",
    "uncertain", "maybe", "perhaps", "rather", "recheck", "reexamine",
    "incorrect", "wrong", "mistake", "mistaken", "correction", "hmm", "though",
)
EN_HEDGE_PHRASES = (
    "not sure", "on second thought", "double-check", "double check",
    "re-check", "re-examine", "on the other hand", "does not seem",
    "doesn't seem", "is not right", "isn't right", "not right",
    "second-guess", "second guess",
)
ORDINARY_CHARS = (
    r"0-9A-Za-z가-힣ㄱ-ㅎㅏ-ㅣ\s.,;:!?()\[\]{}<>/+\-*=%·…“”‘’\"'`~@#&^|\\$_°±×÷→←↑↓°℃μ㎎㎍㎖㎗ℓ"
)
STEP_LABELS = ("[Step 1]", "[Step 2]", "[Step 3]", "[Step 4]")
ANSWER_WORD = "정답"
LENIENT_ANSWERS = (
    r"정답\s*[은는이가]?\s*[:：]?\s*\(?\s*([A-E])\s*\)?\s*번?",
    r"답\s*[은는이가]?\s*[:：]?\s*\(?\s*([A-E])\s*\)?\s*번?",
    r"\(?\s*([A-E])\s*\)?\s*번?\s*(?:이다|입니다)",
    r"따라서\s*[,\s]*\(?\s*([A-E])\s*\)?",
)
NEGATION = r"\s*[가-힣]{0,3}?\s*(?:아니|틀리|제외|배제|아님)"
CONNECTIVES = r"(?:thus,?\s*|so,?\s*|따라서\s*|그러므로\s*)?"

# The answer line takes an ASCII or a full-width colon.
ANSWER_LINE = rf"(?U){ANSWER_WORD}\s*[:：]\s*\(?\s*([A-E])\s*\)?"
TRAILING_ANSWER = rf"(?iU)\s*{CONNECTIVES}{ANSWER_WORD}\s*[:：]\s*\(?[A-E]\)?\.?\s*$"
THINK = r"(?is)<think>(.*?)</think>"


#: The characters that Unicode calls white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


#: The white space of ASCII.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def strip(text: Column, white: str = WHITE_SPACE) -> Column:
    """Without white space, by default that of Unicode, at both ends; only the ends are looked at."""
    return F.btrim(text, F.lit(white))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def tokens(text: Column) -> Column:
    """Tokens between Unicode white space; none for null."""
    return F.filter(F.split(or_empty(text), r"(?U)\s+"), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def think_text(reasoning_content: Column, body: Column) -> Column:
    """The text that gates judge: trimmed reasoning, else the first think block of the body, else the body."""
    own, body = strip(or_empty(reasoning_content)), or_empty(body)
    block = F.when(body.rlike(THINK), F.regexp_extract(body, THINK, 1)).otherwise(body)
    return F.when(own != "", own).otherwise(strip(block))


def think_block(text: Column) -> Column:
    """The first think block as it stands; empty without one."""
    return F.regexp_extract(or_empty(text), THINK, 1)


def internal_reasoning(text: Column, limit: int = 8000) -> Column:
    """What a judge sees: the first think block within ``limit`` characters, else these characters."""
    head = F.left(or_empty(text), F.lit(limit))
    return strip(F.when(head.rlike(THINK), F.regexp_extract(head, THINK, 1)).otherwise(head))


def without_think(text: Column) -> Column:
    return F.regexp_replace(or_empty(text), r"(?is)<think>.*?</think>", "")


def joined_cot(reasoning: Column, final: Column) -> Column:
    """``<think>reasoning</think>``, a line break and the final text; only what is there."""
    r, f = or_empty(reasoning), or_empty(final)
    return F.when((r != "") & (f != ""), F.concat(F.lit("<think>"), r, F.lit("</think>\n"), f)).when(
        f != "", f
    ).otherwise(r)


def letter(value: Column) -> Column:
    """A letter A to E from a letter in any case, or null."""
    up = F.upper(strip(value))
    return F.when(up.isin(*LETTERS), up)


def letter_of_number(value: Column) -> Column:
    """A letter from 1 to 5, 0 also being A; others null."""
    return F.when(value.between(1, 5), F.substr(F.lit(LETTERS), value.cast("int"), F.lit(1))).when(value == 0, F.lit("A"))


def index_of_letter(value: Column) -> Column:
    """0 to 4 from a letter."""
    return F.when(letter(value).isNotNull(), F.instr(F.lit(LETTERS), letter(value)) - 1)


def answer_index(value: Column) -> Column:
    """0-based index from a letter, or from digits taken as they are."""
    return F.coalesce(index_of_letter(value), strip(value).try_cast("int"))


def answer_index_from_one(value: Column) -> Column:
    """0-based index from a letter or from 1 to 5; 0 stays 0, others are null."""
    n = strip(value).try_cast("int")
    return F.coalesce(index_of_letter(value), F.when(n.between(1, 5), n - 1).when(n == 0, F.lit(0)))


def garbage_count(text: Column) -> Column:
    """Characters that are not ordinary; ordinary ones go in whole runs, which takes a fraction of the time."""
    return F.length(F.regexp_replace(or_empty(text), f"(?U)[{ORDINARY_CHARS}]++", ""))


def garbage_ratio(text: Column) -> Column:
    """Share of characters outside ordinary ones; 0 for an empty text."""
    return F.when(F.length(or_empty(text)) > 0, garbage_count(text) / F.length(text)).otherwise(0.0)


def longest_run(text: Column) -> Column:
    """Length of the longest run without white space."""
    return F.coalesce(F.array_max(F.transform(tokens(text), F.length)), F.lit(0))


def en_ratio(text: Column) -> Column:
    """Share of tokens with two Latin letters in a row; 0 without tokens."""
    t = tokens(text)
    return F.when(F.size(t) > 0, F.size(F.filter(t, lambda x: x.rlike("[A-Za-z]{2,}"))) / F.size(t)).otherwise(0.0)


def _occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def bound(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, also inside conditions and functions of list items."""
    return F.transform(F.array(value), use)[0]


def ko_hedges(text: Column) -> Column:
    return bound(F.lower(or_empty(text)), _ko_hedges)


def _ko_hedges(low: Column) -> Column:
    return reduce(Column.__add__, [_occurrences(low, p) for p in KO_HEDGES])


def en_hedges(text: Column) -> Column:
    """Whole words, and phrases anywhere (one phrase may count within another)."""
    return bound(F.lower(or_empty(text)), _en_hedges)


def _en_hedges(low: Column) -> Column:
    words = F.size(F.filter(F.split(low, r"(?U)\W+"), lambda w: w.isin(*EN_HEDGE_WORDS)))
    return reduce(Column.__add__, [_occurrences(low, p) for p in EN_HEDGE_PHRASES], words)


def hedge_rate(text: Column) -> Column:
    """Hedges per hundred words; 0 for an empty text, which has none."""
    found = bound(F.lower(or_empty(text)), lambda low: _ko_hedges(low) + _en_hedges(low)).cast("double")
    return found / F.greatest(word_count(text), F.lit(1)) * 100


def parse_answer(text: Column) -> Column:
    """The last answer line's letter, else the last A to E in the last 80 characters of the trimmed text."""
    lines = F.regexp_extract_all(or_empty(text), F.lit(ANSWER_LINE), F.lit(1))
    tail = F.regexp_extract(F.right(strip(or_empty(text)), F.lit(80)), r"(?s)([A-E])[^A-E]*$", 1)
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.when(tail != "", tail))


def parse_answer_lenient(text: Column) -> Column:
    """``parse_answer``, else the latest lenient phrase that no negation follows within eight characters."""
    body = or_empty(text)
    found = None
    for pattern in LENIENT_ANSWERS:
        # a match with what follows it; the negation must be complete within eight characters
        hits = F.regexp_extract_all(body, F.lit(f"(?U)({pattern})"), F.lit(0))
        starts = _starts(body, hits)
        rows = F.transform(
            F.arrays_zip(hits.alias("hit"), starts.alias("at")),
            lambda x: F.struct(
                x["at"].alias("at"),
                F.regexp_extract(x["hit"], f"(?U){pattern}", 1).alias("letter"),
                F.substr(body, x["at"] + F.length(x["hit"]), F.lit(8)).alias("after"),
            ),
        )
        rows = F.filter(rows, lambda x: ~x["after"].rlike(f"(?U)^{NEGATION}"))
        found = rows if found is None else F.concat(found, rows)
    latest = F.reduce(
        found,
        F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("letter")),
        lambda acc, x: F.when(x["at"] > acc["at"], F.struct(x["at"].alias("at"), x["letter"].alias("letter"))).otherwise(acc),
    )
    return F.coalesce(parse_answer(text), latest["letter"])


def _starts(body: Column, hits: Column) -> Column:
    """1-based starts of successive matches, found one after another."""
    begin = F.struct(F.lit(1).alias("to"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, hit: Column) -> Column:
        at = F.call_function("locate", hit, body, acc["to"])
        return F.struct((at + F.length(hit)).alias("to"), F.concat(acc["starts"], F.array(at)).alias("starts"))

    return F.reduce(hits, begin, step, lambda acc: acc["starts"])


def format_check(text: Column) -> Column:
    """Which of four step labels and the answer line are there, and whether all are."""
    body = or_empty(text)
    parts = [body.contains(s) for s in STEP_LABELS] + [body.rlike(ANSWER_LINE)]
    names = ["has_step1", "has_step2", "has_step3", "has_step4", "has_answer_line"]
    return F.struct(*(p.alias(n) for p, n in zip(parts, names, strict=True)), reduce(Column.__and__, parts).alias("all_steps_present"))


def degenerate(predicted: Column, length: Column, limit: int = 6000) -> Column:
    """No prediction, or an output of ``limit`` characters or more."""
    return predicted.isNull() | F.coalesce(length >= limit, F.lit(False))


def kept_choices(*choices: Column) -> Column:
    """Options that are not empty, in order."""
    return F.filter(F.array(*choices), lambda c: c.isNotNull() & (c != ""))


def choice_count(*choices: Column) -> Column:
    """Options that are not empty; 5 where none is known."""
    n = F.size(kept_choices(*choices))
    return F.when(n > 0, n).otherwise(5)


def choice_lines(choices: Column, none: str = "") -> Column:
    lines = F.transform(
        F.slice(choices, 1, 5), lambda c, i: F.concat(F.substr(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(". "), or_empty(c))
    )
    return F.when(F.coalesce(F.size(choices), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(F.lit(none))


def question_block(question: Column, choices: Column, head: str = "[Question]", options: str = "[Options]") -> Column:
    return F.concat(F.lit(f"{head}\n"), or_empty(question), F.lit(f"\n\n{options}\n"), choice_lines(choices))


def without_trailing_answer(text: Column) -> Column:
    return strip(F.regexp_replace(or_empty(text), TRAILING_ANSWER, ""))


def reasoning_part(text: Column) -> Column:
    """What stands before the last answer word, if anything does; without white space at the end."""
    body = or_empty(text)
    head = F.regexp_extract(body, rf"(?s)^(.+){ANSWER_WORD}", 1)
    return F.regexp_replace(F.when(head != "", head).otherwise(body), r"(?U)\s+$", "")


def first_letter(text: Column) -> Column:
    found = F.regexp_extract(or_empty(text), "([A-E])", 1)
    return F.when(found != "", found)


def first_grade(text: Column, default: int = 1) -> Column:
    found = F.regexp_extract(or_empty(text), "([1-5])", 1)
    return F.coalesce(found.try_cast("int"), F.lit(default))


def answer_after(text: Column, marker: str = "답:", limit: int = 600) -> Column:
    """What follows the last marker, or the whole text, trimmed and cut."""
    return F.left(strip(F.substring_index(or_empty(text), marker, -1)), F.lit(limit))


def says_yes(text: Column) -> Column:
    return or_empty(text).rlike(r"(?iU)\b(YES|Y|예|일치)\b")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(or_empty(text)), r"[^a-z0-9]+", "_")


def cut(text: Column, limit: int, mark: str = "...") -> Column:
    """The first ``limit`` characters and a mark."""
    return F.concat(F.left(or_empty(text), F.lit(limit)), F.lit(mark))


def prefix_share(text: Column, share: float) -> Column:
    """The first share of a text's tokens (half-even rounding), joined by spaces."""
    t = tokens(text)
    n = F.bround(F.size(t) * F.lit(share)).cast("int")
    return F.array_join(F.slice(t, F.lit(1), n), " ")


def script_shares(text: Column) -> Column:
    """Shares of Hangul and Latin letters among both; a stand-in for a language detector."""
    return shares_of(hangul_count(text), latin_count(text))


def hangul_count(text: Column) -> Column:
    """Hangul letters; what comes before all Hangul goes first, in whole runs of one range, which is far faster."""
    later = F.regexp_replace(or_empty(text), "[\\x00-\\u10FF]++", "")
    return F.length(F.regexp_replace(later, "[^가-힣ㄱ-ㅎㅏ-ㅣ]++", ""))


def latin_count(text: Column) -> Column:
    return F.length(F.regexp_replace(or_empty(text), "[^A-Za-z]++", ""))


def shares_of(ko: Column, en: Column) -> Column:
    both = F.nullif(ko + en, F.lit(0))
    return F.struct((ko / both).alias("ko"), (en / both).alias("en"))


def think_language(text: Column, shares: Column | None = None, mixed: float = 0.2, white: str = WHITE_SPACE) -> Column:
    """korean, english, mixed, other or undetermined from language shares; null for a text of ``white`` only."""
    if shares is None:
        # both counts in a list of one: an inlined count would be taken again for each field that reads it
        counts = F.struct(hangul_count(text).alias("ko"), latin_count(text).alias("en"))
        found = bound(counts, lambda c: language_of_counts(c["ko"], c["en"], mixed))
    else:
        found = bound(shares, lambda s: language_of(s, mixed))
    return F.when(strip(or_empty(text), white) != "", found)


def language_of_counts(ko: Column, en: Column, mixed: float = 0.2) -> Column:
    return language_of(shares_of(ko, en), mixed)


def language_of(shares: Column, mixed: float = 0.2) -> Column:
    ko, en = F.coalesce(shares["ko"], F.lit(0.0)), F.coalesce(shares["en"], F.lit(0.0))
    return (
        F.when(shares["ko"].isNull() & shares["en"].isNull(), "undetermined")
        .when((ko >= mixed) & (en >= mixed), "mixed")
        .when((ko > 0) & (ko >= en), "korean")
        .when(en > 0, "english")
        .otherwise("other")
    )
