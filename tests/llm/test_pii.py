import hashlib
import random
import re

import pytest
from pyspark.sql import types as T

from tracemill.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


LOGIN = re.compile(r"[A-Za-z0-9]+://[A-Za-z0-9._~%!$&'()*+,;=-]+:[A-Za-z0-9._~%!$&'()*+,;=-]+@[A-Za-z0-9.-]*[A-Za-z0-9-]")
GROUP = r"[A-Za-z]*[0-9][A-Za-z0-9]*(?![A-Za-z0-9])"
AFTER = {
    "account": re.compile(rf"[.:#= ]{{1,3}}(?:[iI][sS][.:#= ]{{1,3}})?({GROUP}(?:[ -]{GROUP})*)"),
    "secret": re.compile(r"[ :=\"']{1,5}([A-Za-z0-9_+/-]+(?:\.[A-Za-z0-9_+/-]{8,})*)"),
}
YEAR = "(?:19|20)[0-9][0-9]"
DATES = re.compile(rf"{YEAR}(?:[ -]{YEAR})+|{YEAR}[ -][01]?[0-9][ -][0-3]?[0-9]|[0-3]?[0-9][ -][0-3]?[0-9][ -]{YEAR}")


def checks(code):
    return int("".join(str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)) for c in code[4:] + code[:4])) % 97 == 1


def valid(kind, value):
    code = re.sub(r"[^A-Za-z0-9]", "", value).upper()
    if kind == "secret":
        return len(value) >= 16 and bool(re.search("[0-9]", value) and re.search("[A-Za-z]", value))
    if DATES.fullmatch(value):
        return False
    if re.match(r"[A-Z]{2}[0-9]{2}", code) and len(code) >= 15:
        return len(code) <= 34 and checks(code)
    return 6 <= len(code) <= 34 and len(re.findall("[0-9]", code)) >= 6


def plain_ibans(text):
    """All IBANs of their country's length, whatever stands before them but letters and digits."""
    for at in range(len(text)):
        size = pii.IBAN_LENGTHS.get(text[at : at + 2])
        if size and not (at and text[at - 1].isalnum()):
            m = re.compile(rf"[A-Z][A-Z][0-9](?:[ -]?[A-Z0-9]){{{size - 3}}}").match(text, at)
            if m and not (m.end() < len(text) and text[m.end()].isalnum()) and re.fullmatch("[A-Z]{2}[0-9]{2}.*", code := re.sub("[ -]", "", m[0])) and checks(code):
                yield m.span()


def brute_added(text):
    """The spans that the method adds, from patterns tried at every place."""
    out = [("login", *m.span()) for m in LOGIN.finditer(text)]
    low = "".join(c.lower() if len(c.lower()) == 1 and ord(c) < 0xDF else c for c in text)
    for kind, cues in (("account", pii.CUES), ("secret", pii.SECRETS)):
        end = 0
        # by the place of the anchor's last sign: of a cue its last letter, of a plain IBAN its first digit
        found = {(i + len(c) - 1, i + len(c), None) for c in cues for i in range(len(low)) if low.startswith(c, i) and not (i and low[i - 1].isalnum())}
        found |= {(a + 2, a, b) for a, b in plain_ibans(text)} if kind == "account" else set()
        for last, at, upto in sorted(found, key=lambda f: f[0]):
            if upto is not None:
                if at >= end:
                    out.append((kind, at, upto))
                    end = upto
                continue
            m = AFTER[kind].match(text, at)
            if last >= end and m and valid(kind, m[1]):
                out.append((kind, *m.span(1)))
                end = m.end(1)
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_added_spans_match_brute_force():
    rng = random.Random(7)
    parts = [
        *pii.CUES, *pii.SECRETS, "IBAN", "Account No", "iBaN", "NÚMERO DE CUENTA", "Caliban", "hib", "x", " ", " ", ": ", "=", '"', "-",
        "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "12345678", "1234567", "998877", "12-34-56", "AB123456", "a1b2c3d4e5f6a7b8",
        "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde", "://", "ftp", "joe", " is ", ". ", "2023 2024", "2024-05-06", "BE71 0961 2345 6769", ".eyJzdWIiOiIx", "AB1234567", ":", "pw", "@", "host.example", ".", "é", "\n", "word",
    ]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert [s for s in pii.find(text) if s[0] not in pii.BASE] == brute_added(text), text


def base(text):
    return [s for s in pii.find(text) if s[0] in pii.BASE]


def test_random_texts_match_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("aZ@@..+-0123456789 ()é%_:/") for _ in range(rng.randint(0, 40)))
        assert base(text) == brute(text), text
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789. +-") for _ in range(rng.randint(10, 60)))
        assert base(text) == brute(text), text


@pytest.mark.parametrize(
    "text, spans",
    [
        ("", []),
        ("a@b.c@d.e", [("email", 0, 5)]),
        ("é a.b+c@x-y.co.uk.", [("email", 2, 17)]),
        ("4111 1111 1111 1111", [("card", 0, 19)]),
        ("10.0.0.256 10.0.0.1", [("ip", 11, 19)]),
        ("1.2.3.4.5.6.7.8", [("ip", 0, 7), ("ip", 8, 15)]),
        ("call +49 (30) 1234-5678", [("phone", 5, 23)]),
        ("ftp://joe:secret@host.example/x", [("login", 0, 29), ("email", 10, 29)]),
        ("IBAN: DE89 3704 0044 0532 0130 00.", [("account", 6, 33)]),
        ("account no 12345678", [("account", 11, 19)]),
        ("account no twelve", []),
        ("Caliban: 1234567", []),
        ("hibanacct 998877", []),
        ("my iBAN DE89370400440532013000", [("account", 8, 30)]),
        ("NÚMERO DE CUENTA: 123456789", [("account", 18, 27)]),
        ('token = "2abc3ff2ca8fb1e4c565"', [("secret", 9, 29)]),
        ("a token of 12345678901234567890", []),
        ("the secret internationalisation", []),
        ("a://b:c@d://e:f@g", [("login", 0, 9)]),
        ("passport no AB1234567", [("account", 12, 21)]),
        ("Acct. No. 12345678", [("account", 10, 18)]),
        ("account number is 12345678", [("account", 18, 26)]),
        ("tax id 2023 2024", []),
        ("acct 2024-05-06", []),
        ("DE89 3704 0044 0532 0130 00", [("account", 0, 27)]),
        ("DE88 3704 0044 0532 0130 00", []),
        ("pay to BE71096123456769, now", [("account", 7, 23)]),
        ("iban DE88370400440532013000", []),
        ("bearer eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVPmB92. End", [("secret", 7, 64)]),
        ("token www.example2.com/12", []),
    ],
)
def test_spans(text, spans):
    assert [s for s in pii.find(text)] == spans


def test_documents_match_the_patterns(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in rows}
    want = {k: brute(t or "") for k, t in texts.items()}
    found = {r.doc_id: r for r in pii.op8_pii(spark, sf_small).collect()}
    assert found.keys() == want.keys()
    for k, spans in want.items():
        assert [tuple(found[k][f"n_{kind}"] for kind in pii.BASE)] == [
            tuple(sum(s[0] == kind for s in spans) for kind in pii.BASE)
        ]
        both = sorted(spans + brute_added(texts[k] or ""), key=lambda s: (s[1], pii.KINDS.index(s[0])))
        assert found[k].spans == ",".join(f"{a}:{b}:{c}" for a, b, c in both)
        assert found[k].n_spans == len(both) == sum(found[k][f"n_{kind}"] for kind in pii.KINDS)
        assert found[k].base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in spans).encode()).hexdigest()


def test_nulls_repeats_and_extra_columns(spark):
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", T.StringType())
    ])
    docs = spark.createDataFrame([(1, None, "x"), (None, "a@b.cd", None), (1, "", "x"), (1, "", "x")], schema)
    rows = pii.personal_data(docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "1", "None"]
    assert sum(r.n_email for r in rows) == 1
    assert pii.personal_data(docs.limit(0)).collect() == []
    assert [r.text for r in pii.redact_documents(docs).collect()] == [None, "[email]", "", ""]
    long = spark.createDataFrame([(1, "1" * 300_000 + " a@b.cd " + "x@" * 100_000 + "+4" * 100_000 + " token=" * 50_000)], "doc_id long, text string")
    (row,) = pii.personal_data(long).collect()
    assert row.n_email == 1
    assert pii.redact("x " * 50_000 + "a@b.cd").endswith("[email]")
