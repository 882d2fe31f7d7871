"""Streams against loops that drop and forget exactly what the watermark says, over restarts."""

from datetime import datetime, timedelta, timezone
from random import Random

from pyspark.sql import functions as F

from tracemill.operators import temporal
from tracemill.plans.events import _arrivals
from tracemill.plans.fixtures import Tables
from tracemill.streaming import windows as S

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "event_id long, ts timestamp, user_id long, kind string"


def at(minutes):
    return START + timedelta(minutes=minutes)


def frames(spark, batches):
    return [spark.createDataFrame([(i, None if m is None else at(m), u, k) for i, m, u, k in b], SCHEMA) for b in batches]


def marks(batches, delay):
    """Minutes of each batch's watermark; None before any."""
    out, most = [], None
    for b in batches:
        out.append(None if most is None else most - delay)
        most = max([most or 0, *(m for _, m, *_ in b if m is not None)])
    return out


def draw_batches(seed, n=60, batches=5):
    draw, out, i = Random(seed), [], 0
    for b in range(batches):
        own = []
        for _ in range(n):
            minute = b * 100 + draw.randint(0, 100) - draw.choice([0, 0, 0, 60, 150, 320])
            own.append((i, max(0, minute), draw.randint(0, 3), draw.choice("xy")))
            i += 1
        out.append(own)
    return out


def test_sliding_windows_drop_what_is_late(spark):
    batches, delay = draw_batches(1), 50
    late = [None, *marks(batches, delay)[:-1]]
    want, dropped = {}, 0
    for mark, batch in zip(late, batches, strict=True):
        for _, m, _, k in batch:
            for begin in range(m // 10 * 10 - 20, m + 1, 10):
                if begin + 30 > m and (mark is None or begin + 30 > mark):
                    want[begin, k] = want.get((begin, k), 0) + 1
                elif begin + 30 > m:
                    dropped += 1
    final = marks(batches, delay)[-1]
    want = {(at(b), k): n for (b, k), n in want.items() if b + 30 <= final}
    plan = lambda s: S.sliding(s, "ts", "50 minutes", "30 minutes", "10 minutes", ["kind"], n=F.count(F.lit(1)))
    got = S.run_batches(spark, frames(spark, batches), plan).collect()
    assert {(r.started.astimezone(timezone.utc), r.kind): r.n for r in got} == want and len(got) == len(want)
    assert dropped > 20 and len(want) > 20


def test_queries_drop_rows(spark, sf_small):
    """The registered arrivals hold rows that come after their windows were emitted."""
    parts = _arrivals(Tables(spark, sf_small))
    days = [p.agg(F.min("ts"), F.max("ts"), F.count("*")).first() for p in parts]
    assert all(d[2] for d in days) and days[2][0] < days[0][1] - timedelta(days=3)


def test_a_late_row_joins_two_sessions(spark):
    batches = [[(0, 0, 1, "x"), (1, 50, 1, "x"), (2, 10, 2, "x")], [(3, 25, 1, "x"), (4, 300, 2, "x")], [(5, 400, 2, "x")], [(6, 401, 2, "x")]]
    plan = lambda s: S.session_stream(s, "ts", "100 minutes", "30 minutes", ["user_id"], n=F.count(F.lit(1)))
    got = S.run_batches(spark, frames(spark, batches), plan).collect()
    minutes = lambda t: int((t.astimezone(timezone.utc) - START).total_seconds() // 60)
    assert sorted((r.user_id, minutes(r.started), minutes(r.ended), r.n) for r in got) == [(1, 0, 80, 3), (2, 10, 40, 1)]


def test_stream_and_batch_agree(spark):
    """A gap of exactly the width parts no session, in the stream as in the batch form."""
    rows = [(i, m, 1, "x") for i, m in enumerate([0, 29, 59, 90, 120, 300])]
    last = [(9, 9000, 2, "x")]
    plan = lambda s: S.session_stream(s, "ts", "1 minute", "30 minutes", ["user_id"], n=F.count(F.lit(1)))
    got = S.run_batches(spark, frames(spark, [rows, last, last]), plan).where("user_id = 1")
    batch = temporal.sessions(frames(spark, [rows])[0], ["user_id"], "ts", 30 * 60_000_000, n=F.count(F.lit(1)))
    key = lambda r: (r[0], r[1])
    assert sorted(map(key, got.select("started", "n").collect())) == sorted(map(key, batch.select("began", "n").collect()))
    assert [r.n for r in batch.orderBy("began").collect()] == [3, 2, 1]


def test_first_seen_forgets(spark):
    """State goes when the watermark passes its time; a key seen again after that is new.  Nulls are keys, rows without a time are not."""
    batches = [
        [(0, 10, 1, "x"), (1, 5, 1, "x"), (2, 5, 1, "y"), (3, 7, None, "x"), (4, None, 3, "x")],
        [(5, 20, 1, "x"), (6, 200, 2, "x")],
        [(7, 210, 1, "x"), (8, 190, 2, "x")],  # the watermark is at 190 now: what was seen until 90 goes after this batch
        [(9, 220, 1, "x"), (10, 215, 1, "y"), (11, 221, 2, "x")],
        [(12, 230, 1, "x"), (13, 230, 1, "x")],
    ]
    progress = []
    plan = lambda s: S.first_seen(s, ["user_id", "kind"], "ts", "10 minutes", 100 * 60_000)
    got = S.run_batches(spark, frames(spark, batches), plan, progress=progress)
    assert got.columns == ["event_id", "ts", "user_id", "kind"]
    ids = sorted(r.event_id for r in got.collect())
    assert ids == [1, 2, 3, 6, 9, 10]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert held[1] > held[2] and len(progress) == 5
