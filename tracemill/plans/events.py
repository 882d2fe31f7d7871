"""Queries in time over events and orders, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import tables
from tracemill.operators import rollups, temporal
from tracemill.operators.ranges import as_long
from tracemill.plans.fixtures import Tables
from tracemill.plans.queries import query
from tracemill.streaming import windows
from tracemill.workspace import Workspace

# --- joins in time


@query("""SELECT e.event_id, o.o_orderkey AS last_order, o.price, date_diff('day', o.o_orderdate, e.ts) AS days
 FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS price
  FROM orders GROUP BY o_custkey, o_orderdate) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""")
def asof_orders(t: Tables):
    """The last order of an event's customer."""
    take = {"last_order": "o_orderkey", "price": "o_totalprice", "ordered": "o_orderdate"}
    rows = temporal.asof_join(t["events"], t["orders"], [("user_id", "o_custkey")], ("ts", "o_orderdate"), take, ("o_orderkey",))
    return rows.select("event_id", "last_order", "price", F.datediff("ts", "ordered").cast("long").alias("days"))


@query("""WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'),
 v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
 SELECT p.event_id, p.value, v.view_id, CAST(floor(epoch_us(p.ts - v.ts) / 1000000) AS BIGINT) AS seconds
 FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts > v.ts""")
def asof_views(t: Tables):
    """The user's last view before each purchase."""
    events = t["events"]
    bought = events.where("event_type = 'purchase'")
    take = {"view_id": "event_id", "seen": "ts"}
    rows = temporal.asof_join(bought, events.where("event_type = 'view'"), [("user_id", "user_id")], ("ts", "ts"), take, ("event_id",), strict=True)
    return rows.select("event_id", "value", "view_id", F.floor((as_long(rows, "ts") - as_long(rows, "seen")) / 1_000_000).alias("seconds"))


@query("""WITH i AS (SELECT o_orderkey, o_custkey, o_orderdate AS s, max(l_shipdate) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  GROUP BY o_orderkey, o_custkey, o_orderdate)
 SELECT a.o_orderkey AS one, b.o_orderkey AS other, date_diff('day', greatest(a.s, b.s), least(a.e, b.e)) AS days
 FROM i a JOIN i b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.s <= b.e AND b.s <= a.e
 WHERE a.s <= a.e AND b.s <= b.e""")
def overlapping_orders(t: Tables):
    """Orders of one customer that were open (from order to last shipment) at the same time."""
    ends = t["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("e"))
    spans = t["orders"].join(ends, "o_orderkey").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("s"), "e")
    met = temporal.interval_join(spans, spans, [("o_custkey", "o_custkey")], ("s", "e"), ("s", "e"))
    met = met.where("left.o_orderkey < right.o_orderkey")
    days = F.datediff(F.least("left.e", "right.e"), F.greatest("left.s", "right.s")).cast("long")
    return met.select(F.col("left.o_orderkey").alias("one"), F.col("right.o_orderkey").alias("other"), days.alias("days"))


@query("""SELECT x.event_id AS error_id, p.event_id AS purchase_id FROM events x JOIN events p
 ON x.user_id = p.user_id AND p.ts BETWEEN x.ts AND x.ts + INTERVAL 6 HOURS WHERE x.event_type = 'error' AND p.event_type = 'purchase'""")
def purchases_after_errors(t: Tables):
    """Purchases of a user within six hours of an error."""
    events = t["events"]
    errors = events.where("event_type = 'error'").withColumn("until", F.col("ts") + F.expr("INTERVAL 6 HOURS"))
    bought = events.where("event_type = 'purchase'")
    met = temporal.interval_join(errors, bought, [("user_id", "user_id")], ("ts", "until"), ("ts", "ts"))
    return met.select(F.col("left.event_id").alias("error_id"), F.col("right.event_id").alias("purchase_id"))


# --- sessions

GAP_MICROS = 30 * 60 * 1_000_000
#: Sessions as SQL sees them: a row more than the gap after its predecessor begins one.
SESSIONS = """
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS new_one
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(new_one) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM g),
ses AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n_events,
 count(*) FILTER (event_type = 'purchase') AS purchases FROM n GROUP BY user_id, nth)"""


@query(f"WITH {SESSIONS} SELECT user_id, epoch_us(session_start) AS started, epoch_us(session_end) AS ended, n_events, purchases FROM ses")
def user_sessions(t: Tables):
    """Sessions of users, by gaps of half an hour."""
    out = temporal.sessions(
        t["events"], ["user_id"], "ts", GAP_MICROS, n_events=F.count(F.lit(1)), purchases=F.count_if(F.col("event_type") == "purchase")
    )
    ended = as_long(out, "last") + GAP_MICROS
    return out.select("user_id", as_long(out, "began").alias("started"), ended.alias("ended"), "n_events", "purchases")


# --- streams: events arrive in four batches, some one or two batches late

_ARRIVAL = "least(3, (extract(day FROM ts) - 1) // 10 + CASE WHEN event_id % 10 = 3 THEN 1 WHEN event_id % 50 = 7 THEN 2 ELSE 0 END)"
#: The watermark by which a batch's rows are late: that of the batch before it.
_LATE = """
a AS (SELECT *, CAST({arrival} AS INT) AS batch FROM events),
w AS (SELECT b.batch, coalesce((SELECT date_trunc('milliseconds', max(ts)) FROM a WHERE a.batch < b.batch) - INTERVAL {delay}, TIMESTAMP '1970-01-01') AS mark
  FROM (SELECT unnest([-1, 0, 1, 2, 3]) AS batch) b),
m AS (SELECT a.*, w.mark AS late FROM a JOIN w ON w.batch = a.batch - 1),
z AS (SELECT mark AS final FROM w WHERE batch = 3)"""


def _arrivals(t: Tables, late: bool = True):
    """Batches of events, with time zones as streams need them."""
    events = t["events"].select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    day = F.floor((F.dayofmonth("ts") - 1) / 10)
    more = F.when(F.col("event_id") % 10 == 3, 1).when((F.col("event_id") % 50 == 7) & F.lit(late), 2).otherwise(0)
    batch = F.least(F.lit(3), day + more)
    return [events.where(batch == i) for i in range(4)]


@query(f"""WITH {_LATE.format(arrival=_ARRIVAL, delay='2 DAYS')},
 x AS (SELECT *, time_bucket(INTERVAL 6 HOURS, ts) - k * INTERVAL 6 HOURS AS started FROM m, (SELECT unnest([0, 1, 2, 3]) AS k))
 SELECT epoch_us(started) AS started, event_type, count(*) AS n, max(event_id) AS greatest FROM x, z
 WHERE started + INTERVAL 24 HOURS > late AND started + INTERVAL 24 HOURS <= final GROUP BY started, event_type""")
def sliding_windows(t: Tables):
    """Events of a day, every six hours, with rows dropped that come after their window was emitted."""
    plan = lambda s: windows.sliding(
        s, "ts", "2 days", "24 hours", "6 hours", ["event_type"], n=F.count(F.lit(1)), greatest=F.max("event_id")
    )
    out = windows.run_batches(t.spark, _arrivals(t), plan, "sliding")
    return out.select(F.unix_micros("started").alias("started"), "event_type", "n", "greatest")


@query(f"""WITH {SESSIONS}, {_LATE.format(arrival=_ARRIVAL.replace('WHEN event_id % 50 = 7 THEN 2 ', ''), delay='21 DAYS')}
 SELECT user_id, epoch_us(session_start) AS started, epoch_us(session_end) AS ended, n_events, purchases FROM ses, z WHERE session_end <= final""")
def session_stream(t: Tables):
    """Sessions as a stream emits them: those that the watermark has passed, late rows included."""
    plan = lambda s: windows.session_stream(
        s, "ts", "21 days", "30 minutes", ["user_id"], n_events=F.count(F.lit(1)), purchases=F.count_if(F.col("event_type") == "purchase")
    )
    out = windows.run_batches(t.spark, _arrivals(t, late=False), plan, "sessions")
    return out.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n_events", "purchases")


@query()
def first_sightings(t: Tables):
    """The first event of each user and type, and again a week later."""
    plan = lambda s: windows.first_seen(s, ["user_id", "event_type"], "ts", "1 day", 7 * 86_400_000)
    out = windows.run_batches(t.spark, _arrivals(t), plan, "first-seen")
    return out.select("user_id", "event_type", "event_id", F.unix_micros("ts").alias("first"))


# --- cubes, sketches, table functions


@query("""SELECT CAST(GROUPING(o_orderstatus, priority, year) AS INT) AS level, o_orderstatus, priority, year,
 count(DISTINCT o_custkey) AS "distinct", count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity
 FROM (SELECT *, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority, CAST(extract(year FROM o_orderdate) AS INT) AS year
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY CUBE (o_orderstatus, priority, year)""")
def cube_customers(t: Tables):
    """Distinct customers, lines and quantity by status, priority (null: not specified) and year, with all totals."""
    orders = t["orders"].select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.year("o_orderdate").alias("year"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"),
    )
    rows = t["lineitem"].select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity").join(orders, "o_orderkey")
    lines, quantity = F.lit(1).cast("long"), F.col("l_quantity").cast("long")
    return rollups.cube_distinct(rows, ["o_orderstatus", "priority", "year"], F.col("o_custkey"), lines=lines, quantity=quantity)


def _day_sketches(t: Tables):
    """Sketches by day and type, stored."""
    events = t["events"].withColumn("day", F.to_date("ts"))
    return Workspace(t.spark, "sketches").save(rollups.sketches(events, ["day", "event_type"], "user_id", "value", "props"), "by-day")


@query()
def sketch_rollups(t: Tables):
    """Estimates by type and by day, from one stored table of sketches by day and type."""
    stored = _day_sketches(t)
    by_type = rollups.estimates(rollups.rolled_up(stored, ["event_type"])).withColumn("day", F.lit(None).cast("date"))
    by_day = rollups.estimates(rollups.rolled_up(stored, ["day"])).withColumn("event_type", F.lit(None).cast("string"))
    return by_type.unionByName(by_day)


@query("""SELECT event_type, count(*) AS n, true AS distinct_holds, true AS quantiles_hold, true AS counts_hold FROM events GROUP BY event_type""")
def sketch_errors(t: Tables):
    """Whether rolled-up sketches keep their bounds against exact numbers: distinct users, ranks of quantiles, counts of items."""
    found = rollups.estimates(rollups.rolled_up(_day_sketches(t), ["event_type"]))
    rows = t["events"].join(F.broadcast(found.select("event_type", "quantiles")), "event_type")  # a row for each type
    exact = rows.groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("rows"),
        *(F.count_if(F.col("value") < F.col("quantiles")[i]).alias(f"under{i}") for i in (0, 1)),
        *(F.count_if(F.col("value") <= F.col("quantiles")[i]).alias(f"upto{i}") for i in (0, 1)),
    )
    held = lambda i, q: (F.col(f"under{i}") <= F.col("rows") * (q + 0.01)) & (F.col(f"upto{i}") >= F.col("rows") * (q - 0.01))
    items = t["events"].groupBy("event_type", "props").agg(F.count(F.lit(1)).alias("c"))
    wrong = found.select("event_type", F.inline("top")).withColumnRenamed("item", "props").join(items, ["event_type", "props"], "left")
    wrong = wrong.groupBy("event_type").agg(F.bool_and(F.col("count").eqNullSafe(F.col("c"))).alias("counts_hold"))
    out = found.join(exact, "event_type").join(wrong, "event_type")
    return out.select(
        "event_type", "n", (F.abs(F.col("distinct") - F.col("users")) <= F.col("users") * 0.05).alias("distinct_holds"),
        (held(0, 0.5) & held(1, 0.9)).alias("quantiles_hold"), "counts_hold",
    )


@query("""SELECT event_id, k AS path, props ->> k AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""")
def event_properties(t: Tables):
    """A row for each property of an event, by a lateral table function."""
    tables.register(t.spark)
    return t.spark.sql("SELECT e.event_id, p.path, p.value FROM {events} e, LATERAL json_paths(e.props) p", events=t["events"])


@query("""WITH o AS (SELECT *, row_number() OVER w AS i, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new_one
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 r AS (SELECT *, sum(new_one) OVER (PARTITION BY user_id ORDER BY i) AS nth FROM o)
 SELECT user_id, CAST(nth AS BIGINT) AS nth, event_type, count(*) AS n, arg_min(event_id, i) AS first_id, arg_max(event_id, i) AS last_id
 FROM r GROUP BY user_id, nth, event_type""")
def event_runs(t: Tables):
    """Runs of one type in a user's events, by a table function over ordered rows."""
    tables.register(t.spark)
    rows = t["events"].select("user_id", "event_id", "event_type", "ts")
    return t.spark.sql(
        "SELECT key AS user_id, nth, kind AS event_type, n, first_id, last_id "
        "FROM event_runs(TABLE(SELECT * FROM {rows}) PARTITION BY user_id ORDER BY (ts, event_id))", rows=rows
    )
