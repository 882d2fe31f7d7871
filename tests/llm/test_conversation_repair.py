import re
import zlib
from hashlib import sha256
from itertools import product

import duckdb
import pytest
from helpers import oracle, same
from pyspark.sql import functions as F

from tracemill.llm import conversation_repair as R

RULE = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(turns):
    """All edits tried: for each choice of kept, reroled and deleted turns, all insertions of up to two turns in each gap."""
    seen, choices = set(), []
    for role, text in turns:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        must = not re.search(r"[^\x20\x09-\x0D]", text) or (role, text) in seen
        seen.add((role, text))
        cut = 0 if must else int(body[-1] not in ".!?")
        choices.append([("D", 3, None)] + ([] if must else [("K", cut, role), ("R", 2 + cut, "user"), ("R", 2 + cut, "assistant")]))
    best = None
    extra = [()] + [(a,) for a in ("user", "assistant")] + [(a, b) for a in ("user", "assistant") for b in ("user", "assistant")]
    for edits in product(*choices):
        # insertions only matter next to a turn that stays, or at the end: try all places all the same
        for more in product(extra, repeat=len(turns) + 1):
            out, audit, cost = [], "", 0
            for i, (name, price, role) in enumerate([*edits, ("", 0, None)]):
                for r in more[i]:
                    out.append((r, ""))
                    audit, cost = audit + "I", cost + 2
                audit, cost = audit + name, cost + price
                if role is not None and name in ("K", "R"):
                    out.append((role, turns[i][1]))
            if RULE.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                key = (cost, audit)
                if best is None or key < best[0]:
                    best = (key, out)
    return best[0][0], best[0][1], best[1]


def plain(turns):
    """The same by a walk over states that appends one edit at a time, for longer conversations."""
    seen, held = set(), {"-": (0, "", ())}
    steps = {("-", "s"), ("-", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    def inserted(held):
        done = False
        while not done:
            done = True
            for s, (c, a, out) in list(held.items()):
                for r in ("user", "assistant"):
                    own = (c + 2, a + "I", (*out, (r, "")))
                    if (s, r[0]) in steps and (r[0] not in held or own[:2] < held[r[0]][:2]):
                        held[r[0]], done = own, False
        return held

    for role, text in turns:
        body = text.rstrip(" \t\n\v\f\r")
        must = not body or (role, text) in seen
        seen.add((role, text))
        new = {}

        def add(state, own, new=new):
            if state not in new or own[:2] < new[state][:2]:
                new[state] = own

        for s, (c, a, out) in held.items():
            add(s, (c + 3, a + "D", out))
        if not must:
            cut = int(body[-1] not in ".!?")
            for s, (c, a, out) in inserted(dict(held)).items():
                if (s, role[:1]) in steps:
                    add(role[:1], (c + cut, a + "K", (*out, (role, text))))
                for r in ("user", "assistant"):
                    if (s, r[0]) in steps:
                        add(r[0], (c + 2 + cut, a + "R", (*out, (r, text))))
        held = new
    held = inserted(held)
    c, a, out = min((v for s, v in held.items() if s in "-a"), key=lambda v: v[:2])
    return c, a, list(out)


def brute(rows, solve=plain):
    """Conversations as the query gives them, from damaged rows (conv_id, turn, role, text, absent)."""
    out = []
    for conv in {r[0] for r in rows}:
        there = sorted(((t is not None, t or 0, r, x, t) for c, t, r, x, gone in rows if c == conv and not gone), key=lambda r: r[:4])
        turns = [(r, x) for _, _, r, x, _ in there]
        known = [t for *_, t in there if t is not None]
        seen, counts = set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for turn in turns:
            body = turn[1].rstrip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if turn in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add(turn)
            if fault:
                counts[fault] += 1
        pairs = [a[:1] + b[:1] for (a, _), (b, _) in zip(turns, turns[1:], strict=False)]
        cost, audit, done = solve(turns)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        digest = sha256("\n".join(f"{r}:{x}" for r, x in done).encode()).hexdigest()
        out.append((conv, gaps, *counts.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return sorted(out, key=repr)


def damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x, kind == 0)] * (2 if kind == 3 else 1)
    return out


def found(frame):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in frame.select(names).collect()), key=repr)


def conversations(n, seed=1):
    """Conversations of many shapes: few texts, so that turns repeat, and any roles."""
    from random import Random

    draw, out = Random(seed), []
    for c in range(n):
        for t in range(draw.randint(0, 9)):
            role = draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = draw.choice(["Yes.", "no", "What? ", " ", "", None, "Fine!\n", f"unique {t}.", f"{t} é", "a.b"])
            out.append((c, draw.choice([t, t, 2 * t, None]), role, text))
    return out


def test_programme_against_all_edits():
    texts = ["A.", "b", " ", "C?"]
    for n in range(4):
        for roles in product(["system", "user", "assistant", "x"], repeat=n):
            turns = [(r, texts[(i * 7 + len(r)) % 4]) for i, r in enumerate(roles)]
            marks = R.faults(turns, set())
            cost, audit = R.closed(R.best_paths(turns, marks, "-"))
            want = cheapest(turns) if n < 3 else plain(turns)
            assert (cost, audit, R.edited(turns, audit, "-")) == want
            if n < 3:
                assert plain(turns) == want


def test_query_against_brute_force(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = found(R.op12_conversation_repair(spark, sf_small))
    assert got == brute(damage(rows)) and len(got) == len({r[0] for r in rows})


@pytest.mark.parametrize("limits", [(1024, 1 << 20), (3, 1 << 20), (1, 1 << 20), (1024, 12)])
def test_blocks_of_any_size(spark, limits):
    """Conversations in one block, in several, in blocks of one turn, and over partitions give the same."""
    data = [*conversations(60), (None, 1, "user", "Hi."), (None, None, "assistant", "Yo."), (1000, 5, "user", "Same.")] + [(1000, 5, "user", "Same.")] * 4
    data += [(2000, t, "user" if t % 3 else "assistant", f"{t % 17}.") for t in range(60)]
    table = spark.createDataFrame(data, SCHEMA).repartition(3).withColumns({n: F.lit("x") for n in ("kind", "copy", "piece", "turns", "absent", "audit")})
    got = R.repaired(R.damaged(table), absent="absent", block_rows=limits[0], block_bytes=limits[1])
    assert found(R.report(got)) == brute(damage(data))


def test_a_hot_conversation_is_cut(spark):
    """One conversation of 5000 turns, half of all: blocks of 100 turns, none larger, and the same repair."""
    data = [(7, t, ["user", "assistant"][t % 2 if t % 10 else 0], f"turn {t % 900}." if t % 4 else f"turn {t}") for t in range(5000)]
    data += [(8 + t // 5, t % 5, ["user", "assistant"][t % 2], f"{t}.") for t in range(5000)]
    rows = spark.createDataFrame(data, SCHEMA)
    blocks = R.repaired(rows, block_rows=100)
    assert blocks.where("conv_id = 7").count() >= 50 and blocks.agg(F.max(F.length("audit"))).first()[0] < 250
    assert found(R.report(blocks)) == brute([(*r, False) for r in data])


def test_edges(spark):
    long = "word " * 400_000
    data = [(1, None, "user", long + "."), (1, 0, "assistant", long), (2, 3, "user", ""), (3, 1, "system", "Be good.")]
    data += [(4, 0, "umbrella", "Yes."), (4, 9, "aide", "No.")]
    got = found(R.report(R.repaired(spark.createDataFrame(data, SCHEMA))))
    assert got == brute([(*r, False) for r in data])
    assert [r[7] for r in got] == ["KK", "D", "D", "KK"] and got[3][1] == 8
    gone = spark.createDataFrame([(5, 1, "user", "x", True)], SCHEMA + ", absent boolean")
    assert found(R.report(R.repaired(gone, absent="absent"))) == [(5, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]
    assert R.report(R.repaired(gone.limit(0))).collect() == []


def test_oracle(spark, sf_small):
    same(R.op12_conversation_repair(spark, sf_small).toPandas(), oracle(R.ORACLE, sf_small))


def test_oracle_of_odd_conversations():
    data = [*conversations(200, 5), (None, 1, "user", "Hi."), (None, None, "assistant", "Yo.")]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", data)
    got = con.execute(R.ORACLE).fetchall()
    assert sorted(got, key=repr) == brute(damage(data))


def test_repaired_turns(spark):
    data = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Again."), (1, 2, "user", "Bye.")]
    rows = R.repaired(spark.createDataFrame(data, SCHEMA)).select("audit", F.explode("turns").alias("t")).select("audit", "t.*").collect()
    assert {r.audit for r in rows} == {"DDKI"} or RULE.fullmatch("".join(r.role[0] for r in rows))
    assert (sum({"D": 3, "I": 2, "R": 2, "K": 0}[c] for c in rows[0].audit), rows[0].audit) == plain([r[2:] for r in data])[:2]
