"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, plus signs, digits, ``://`` and
identifier cues.  Each anchor starts a deterministic local parser that expands to the bounds of what
stands there and validates it:

* ``email``  from an at-sign: local part to the left, labels with at least one dot to the right;
* ``ip``     from a run of digits: four dotted parts, each at most 255;
* ``card``   from a run of digits: digits with single spaces or hyphens, 14 to 19 of them, Luhn;
* ``phone``  from a plus sign: digits, spaces, dots, brackets and hyphens, 10 to 15 digits.

Of one kind, matches do not overlap: the leftmost stands, and what fails validation is passed over
without a second attempt inside it.  Beyond these the method adds spans of three kinds:

* ``login``   from ``://``: a scheme, user information with a colon, an at-sign and a host;
* ``account`` from a cue such as ``iban`` or ``account no``, perhaps with ``is`` behind it: the identifier
  after it, 6 to 34 letters and digits with at least 6 digits, in groups that each have one.  What is
  built like an IBAN must have its check digits; dates and rows of years are none;
* ``account`` without a cue, from the first digit behind a country's two capitals: an IBAN of that
  country's length with valid check digits, in one piece or in groups;
* ``secret``  from a cue such as ``token`` or ``api key``: 16 or more signs of keys, a letter and a
  digit among them; parts of eight signs or more may follow behind full stops, as in signed tokens.

Cues are found in any case and only where no letter or digit stands before them.  Offsets count code
points, ends are exclusive.  Nulls: a null text is empty; other columns may be null.  Ties: spans that
begin together are in the order of the kinds above.  Very long texts are read whole, once, and long runs
of one kind's signs are not read again from each of their places.  Columns are selected by name and
renamed, so extra ones may have any name.  Repeated rows give repeated results, an empty table an empty one.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, batch_of, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "account", "secret")
CUES = (
    "iban", "account number", "account no", "account nr", "acct no", "acct. no", "acct number", "acct. number", "acct", "a/c no",
    "passport no", "passport number", "tax id", "ssn", "kontonummer", "numéro de compte", "número de cuenta",
)
SECRETS = (
    "token", "secret", "password", "passwd", "api key", "api_key", "api-key", "apikey", "access key", "access_key",
    "secret_key", "secret key", "private_key", "bearer",
)
#: The countries that issue IBANs, and how long theirs are.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24,
    "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: A date, or years in a row, where a cue promised an identifier.
_DATE = re.compile(r"(19|20)[0-9]{2}([ -](19|20)[0-9]{2})+|(19|20)[0-9]{2}[ -][01]?[0-9][ -][0-3]?[0-9]|[0-3]?[0-9][ -][0-3]?[0-9][ -](19|20)[0-9]{2}")
_DIGIT = frozenset("0123456789")
_ALNUM = _DIGIT | frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGIT | frozenset(" ().-")
_USER = _ALNUM | frozenset("._~%!$&'()*+,;=-")
_KEY = _ALNUM | frozenset("_+/-")
#: Capital letters of ASCII and Latin-1, one to one, so that places stay.
_LOWER = {c: c + 32 for c in (*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF))}


@cache
def _anchors() -> object:
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ("@", "+", "://", *_DIGIT):
        found.add_word(word, word)
    for kind, words in (("account", CUES), ("secret", SECRETS)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _run(text: str, at: int, chars: frozenset[str]) -> int:
    """End of the run of ``chars`` from ``at`` on."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def _email(text: str, at: int, least: int) -> tuple[int, int] | None:
    start = at
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    stop = end
    while stop < len(text) and text[stop] == "." and (more := _run(text, stop + 1, _LABEL)) > stop + 1:
        stop = more
    return (start, stop) if stop > end else None


def _ip(text: str, at: int) -> tuple[int, list[str]] | None:
    parts, end = [], at
    for i in range(4):
        if i:
            if end >= len(text) or text[end] != ".":
                return None
            end += 1
        to = _run(text, end, _DIGIT)
        if to == end:
            return None
        parts.append(text[end:to])
        end = to
    return end, parts


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _card(text: str, at: int) -> tuple[int, list[int]]:
    digits, end = [int(text[at])], at + 1
    while True:
        to = end + 1 if end < len(text) and text[end] in " -" else end
        if to >= len(text) or text[to] not in _DIGIT:
            return end, digits
        digits.append(int(text[to]))
        end = to + 1


def luhn(digits: list[int]) -> bool:
    total = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _phone(text: str, at: int) -> int | None:
    if at + 1 >= len(text) or text[at + 1] not in _DIGIT:
        return None
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGIT:
        end -= 1
    return end if end > at + 3 and text[end - 1] in _DIGIT else None


def _login(text: str, at: int, least: int) -> tuple[int, int] | None:
    start = at
    while start > least and text[start - 1] in _ALNUM:
        start -= 1
    user = _run(text, at + 3, _USER)
    if start == at or user == at + 3 or user >= len(text) or text[user] != ":":
        return None
    word = _run(text, user + 1, _USER)
    if word == user + 1 or word >= len(text) or text[word] != "@":
        return None
    host = _run(text, word + 1, _LABEL | {"."})
    while host > word + 1 and text[host - 1] == ".":
        host -= 1
    return (start, host) if host > word + 1 else None


def iban(code: str) -> bool:
    if not (15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _between(text: str, at: int, signs: str, most: int) -> int:
    """End of at most ``most`` of the signs from ``at`` on."""
    end = at
    while end < len(text) and end < at + most and text[end] in signs:
        end += 1
    return end


def _account(text: str, at: int) -> tuple[int, int] | None:
    """The identifier after a cue that ends before ``at``, at most three signs and perhaps ``is`` between them."""
    start = _between(text, at, ".:#= ", 3)
    if start > at and text[start : start + 2] in ("is", "Is", "IS", "iS"):
        behind = _between(text, start + 2, ".:#= ", 3)
        start = behind if behind > start + 2 else start
    if start == at or start >= len(text) or text[start] not in _ALNUM:
        return None
    end = start
    while end < len(text):  # groups of letters and digits, as in a printed IBAN
        to = _run(text, end, _ALNUM)
        group = text[end:to]
        if not any(c in _DIGIT for c in group):
            break
        last, end = to, to + 1
        if to >= len(text) or text[to] not in " -":
            break
    if end == start or _DATE.fullmatch(text, start, last):
        return None
    code = "".join(c for c in text[start:last] if c in _ALNUM).upper()
    if len(code) >= 15 and code[:2].isalpha() and code[2:4].isdigit():
        return (start, last) if iban(code) else None
    return (start, last) if 6 <= len(code) <= 34 and sum(c in _DIGIT for c in code) >= 6 else None


_CAPITAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _plain_iban(text: str, at: int) -> tuple[int, int] | None:
    """The IBAN whose first digit stands at ``at``; of capitals and digits, with single spaces or hyphens between groups."""
    size = IBAN_LENGTHS.get(text[at - 2 : at]) if at >= 2 else None
    if size is None or at > 2 and text[at - 3].isalnum():
        return None
    code, end = text[at - 2 : at], at
    while len(code) < size:
        if end < len(text) and text[end] in " -":
            end += 1
        if end >= len(text) or not (text[end] in _DIGIT or text[end] in _CAPITAL):
            return None
        code += text[end]
        end += 1
    return (at - 2, end) if not (end < len(text) and text[end].isalnum()) and iban(code) else None


def _secret(text: str, at: int) -> tuple[int, int] | None:
    """The key after a cue that ends before ``at``, at most five signs between them."""
    start = _between(text, at, " :=\"'", 5)
    end = _run(text, start, _KEY)
    while end > start and end < len(text) and text[end] == "." and (more := _run(text, end + 1, _KEY)) >= end + 9:
        end = more
    code = text[start:end]
    if start == at or len(code) < 16 or not any(c in _DIGIT for c in code) or not any(c in _ALNUM - _DIGIT for c in code):
        return None
    return start, end


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start, then kind as listed."""
    out = []
    to = dict.fromkeys(KINDS, 0)  # where the next search of a kind begins
    run_end = 0
    for last, what in _anchors().iter(text.translate(_LOWER)):
        if type(what) is tuple:
            kind, size = what
            before = last - size
            if last >= to[kind] and (before < 0 or not text[before].isalnum()):
                span = (_account if kind == "account" else _secret)(text, last + 1)
                if span:
                    out.append((kind, *span))
                    to[kind] = span[1]
        elif what == "@":
            if last >= to["email"] and (span := _email(text, last, to["email"])):
                out.append(("email", *span))
                to["email"] = span[1]
        elif what == "+":
            if last >= to["phone"] and (end := _phone(text, last)):
                to["phone"] = end
                if 10 <= sum(c in _DIGIT for c in text[last:end]) <= 15:
                    out.append(("phone", last, end))
        elif what == "://":
            if last - 2 >= to["login"] and (span := _login(text, last - 2, to["login"])):
                out.append(("login", *span))
                to["login"] = span[1]
        elif last >= run_end:  # the first digit of a run
            run_end = _run(text, last, _DIGIT)
            if last - 2 >= to["account"] and (span := _plain_iban(text, last)):
                out.append(("account", *span))
                to["account"] = span[1]
            if last >= to["ip"] and (found := _ip(text, last)):
                to["ip"] = found[0]
                if all(_small(p) for p in found[1]):
                    out.append(("ip", last, found[0]))
            if last >= to["card"]:
                end, digits = _card(text, last)
                if len(digits) > 1:
                    to["card"] = end
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append(("card", last, end))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, marks: dict[str, str] | None = None) -> str:
    """``text`` with each stretch of overlapping spans replaced by the mark of its first span's kind."""
    at, out = 0, []
    spans = find(text)
    i = 0
    while i < len(spans):
        kind, a, b = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < b:
            i += 1
            b = max(b, spans[i][2])
        out += [text[at:a], (marks or {}).get(kind, f"[{kind}]")]
        at, i = b, i + 1
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_FOUND = pa.schema([
    ("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()),
    *((f"n_{k}", pa.int64()) for k in KINDS[len(BASE) :]), ("n_spans", pa.int64()),
])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: counts by kind, a digest of the base kinds' spans, and all spans."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1):
            spans = find(text.as_py() or "")
            base = [s for s in spans if s[0] in BASE]
            counts = [sum(s[0] == k for s in spans) for k in KINDS]
            digest = hashlib.sha256(_joined(base).encode()).hexdigest()
            rows.append((*counts[: len(BASE)], digest, _joined(spans), *counts[len(BASE) :], len(spans)))
        return batch_of(_FOUND, batch.column(0), *(list(x) for x in zip(*rows, strict=True)))

    schema = (
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
        "n_login long, n_account long, n_secret long, n_spans long"
    )
    return arrow_map(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, schema)


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with spans replaced by marks; a null text stays null."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at)
        out = pa.array([redact(t.as_py()) if t.is_valid else None for t in texts], texts.type)
        columns = [out if i == at else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return arrow_map(docs, run, docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
