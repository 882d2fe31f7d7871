"""Conversation structure repair: the cheapest edits that make a conversation alternate.

Turns are kept (cost 0), given another role (2) or deleted (3), and empty turns are inserted (2), so
that the roles' initials read ``(s?(ua)+)?``.  Blank turns and turns whose role and text came before must
be deleted; a turn that is cut off costs 1 more wherever it stays.  The edits' initials, in order, are
the audit; among the cheapest, the least audit in ASCII order wins.

The dynamic programme runs over retained turns.  Prefix sums of deletions price the gap between two of
them, so the best predecessors are held as running minima, one for each state (nothing yet, after a
system, user or assistant turn); the pair of roles says how many turns must be inserted between.  A
minimum is a cost with its audit, so audits break ties while it runs.  Within a gap deletions are
written before insertions, which is the least order.

Rows are range-partitioned by conversation, turn, role and the text's beginning, put in order, and
packed into blocks of at most ``BLOCK_ROWS`` rows or about ``BLOCK_BYTES``.  A conversation that is one block
inside a partition is repaired there.  One that spans blocks, however large, is never gathered: each
block learns which of its turns came in earlier blocks, and is priced from every state to every state.
These tables, without texts, are chained in order, and each block is then edited along the chosen path.
Results are blocks too, in order within a conversation; sums over blocks are the conversation's.  Only
the audit, and a digest over all of a conversation, which is serial by nature, pass through one task.

Nulls: a null role or text is one space, null turn numbers come first and leave no gap, a null id is a
conversation of its own.  Ties: rows of one number are ordered by role, then text; equal rows are
duplicates of the first.  Repeated rows are turns of their own (and so duplicates).  Very long texts
are a block of their own.  A conversation of no turns is repaired by no edits.  Columns are selected by
name, so extra ones may have any name.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, arrow_map, batch_of, map_batches, table
from .sharding import CRC, bytes_sql, crc32_sql

BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
SPACE = " \t\n\v\f\r"
NAMES = {"u": "user", "a": "assistant"}
#: By state (nothing yet, system, user, assistant) and the next role: the turns to insert before it, or at the end.
NEEDS = {
    "-": {"s": "", "u": "", "a": "u", "": ""},
    "s": {"u": "", "a": "u", "": "ua"},
    "u": {"u": "a", "a": "", "": "a"},
    "a": {"u": "", "a": "u", "": ""},
}
Best = dict[str, tuple[int, str]]


def faults(turns: list[tuple[str, str]], seen: set[object], key: object = lambda t: t) -> list[str]:
    """Each turn's first fault: ``b``lank, ``d``uplicate, ``t``runcated or none.  ``seen`` gathers the turns' keys."""
    out = []
    for turn in turns:
        text, own = turn[1].rstrip(SPACE), key(turn)
        out.append("b" if not text else "d" if own in seen else "t" if text[-1] not in ".!?" else "")
        seen.add(own)
    return out


def best_paths(turns: list[tuple[str, str]], found: list[str], start: str) -> Best:
    """The cheapest (cost, audit) from a state to each state, over all turns."""
    held: Best = {start: (0, "")}  # costs without what deleting all turns so far would be
    gone = 0
    for (role, _), fault in zip(turns, found, strict=True):
        best: Best = {}
        if fault not in ("b", "d"):
            for to in "sua":
                if role[:1] == to:
                    cost, edit = KEEP, "K"
                elif to != "s":
                    cost, edit = REROLE, "R"
                else:
                    continue
                cost += gone + (CUT_OFF if fault else 0)
                from_ = [(c + INSERT * len(more), a + "I" * len(more)) for s, (c, a) in held.items() if (more := NEEDS[s].get(to)) is not None]
                if from_:
                    before, audit = min(from_)
                    best[to] = (before + cost - gone - DELETE, audit + edit)
        gone += DELETE
        for state, (cost, audit) in held.items():
            best[state] = min(best.get(state, (cost, audit + "D")), (cost, audit + "D"))
        held = best
    return {state: (cost + gone, audit) for state, (cost, audit) in held.items()}


def closed(held: Best) -> tuple[int, str]:
    """The cheapest way to end, with the turns that the end needs."""
    return min((c + INSERT * len(NEEDS[s][""]), a + "I" * len(NEEDS[s][""])) for s, (c, a) in held.items())


def edited(turns: list[tuple[str, str]], audit: str, state: str) -> list[tuple[str, str]]:
    """The turns after the audit's edits, from a state on."""
    out, rest, after = [], iter(turns), {"-": "u", "s": "u", "u": "a", "a": "u"}
    for edit in audit:
        if edit == "I":
            role, text = NAMES[after[state]], ""
        else:
            role, text = next(rest)
            if edit == "D":
                continue
            if edit == "R":
                role = NAMES[after[state]]
        out.append((role, text))
        state = role[0]
    return out


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def gaps_of(numbers: list[int | None]) -> tuple[int, int | None, int | None]:
    """Numbers missing between the least and the greatest, and these two."""
    known = {n for n in numbers if n is not None}
    return (max(known) - min(known) + 1 - len(known), min(known), max(known)) if known else (0, None, None)


# Blocks

_TURN = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_BLOCKS = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("turns", pa.list_(_TURN)), ("whole", pa.bool_())])
_BLOCKS_SQL = "conv_id long, piece long, turns array<struct<turn: long, role: string, text: string>>, whole boolean"


class _Packer:
    """Blocks of a partition's sorted rows.  The first and the last conversation may go on in other partitions."""

    def __init__(self, partition: int, rows: int, size: int):
        self.next, self.rows, self.size = partition << 32, rows, size
        self.rest: pa.Table | None = None
        self.whole = False  # whether the rest is all there is so far of its conversation, and not the partition's first

    def add(self, batch: pa.RecordBatch, last: bool = False) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([batch]) if batch is not None else None
        if self.rest is not None:
            held = pa.concat_tables([self.rest, *([held] if held is not None else [])])
        if held is None or not held.num_rows:
            return
        held = held.combine_chunks()
        ids = held.column("conv_id")
        known = ids.is_valid().to_numpy()
        ids = ids.fill_null(0).to_numpy()
        starts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (known[1:] != known[:-1])) + 1).tolist(), len(ids)]
        upto = np.concatenate([[0], np.cumsum(held.column("text").combine_chunks().cast(pa.binary()).fill_null(b"").to_pandas().str.len())])
        cuts: list[tuple[int, int, bool]] = []
        for at, (begin, end) in enumerate(zip(starts, starts[1:], strict=False)):
            open_ = end == len(ids)  # further batches, or the next partition, may go on with it
            whole = self.whole if not at else True
            while end - begin > self.rows or upto[end] - upto[begin] > self.size:
                stop = min(begin + self.rows, int(np.searchsorted(upto, upto[begin] + self.size, "right")) - 1)
                stop = max(stop, begin + 1)
                if stop >= end:
                    break
                cuts.append((begin, stop, False))
                begin, whole = stop, False
            if open_ and not last:
                self.rest, self.whole = held.slice(begin), whole
            else:
                cuts.append((begin, end, whole and not open_))
        if cuts:
            yield self._blocks(held, cuts)

    def _blocks(self, held: pa.Table, cuts: list[tuple[int, int, bool]]) -> pa.RecordBatch:
        there = ~held.column("absent").to_numpy()
        upto = np.concatenate([[0], np.cumsum(there)])
        items = held.slice(0, cuts[-1][1]).filter(pa.array(there[: cuts[-1][1]])).combine_chunks()
        items = pa.StructArray.from_arrays([items.column(n).combine_chunks() for n in ("turn", "role", "text")], fields=list(_TURN))
        turns = pa.ListArray.from_arrays(pa.array([0, *(int(upto[end]) for _, end, _ in cuts)], pa.int32()), items)
        begins = [b for b, _, _ in cuts]
        pieces = range(self.next, self.next + len(cuts))
        self.next += len(cuts)
        return batch_of(
            _BLOCKS, held.column("conv_id").take(pa.array(begins)).combine_chunks(), list(pieces), turns.cast(pa.list_(_TURN)), [w for *_, w in cuts]
        )


def packed(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, absent: str | None, limits: tuple[int, int]) -> DataFrame:
    """Blocks of rows in order: ``conv_id``, ``piece`` (blocks' order), ``turns``, and whether they are a ``whole`` conversation."""
    space = F.lit(" ")
    rows = rows.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), space).alias("role"), F.coalesce(F.col(text_col).cast("string"), space).alias("text"),
        (F.coalesce(F.col(absent), F.lit(False)) if absent else F.lit(False)).alias("absent"),
    )
    # boundaries are sampled on the driver: of a long text its beginning is enough
    rows = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32))
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId(), *limits)
        for batch in batches:
            yield from packer.add(batch)
        yield from packer.add(None, last=True)

    return map_batches(rows, run, _BLOCKS_SQL)


def _turns(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[tuple[str, str]]]]:
    """Numbers, and (role, text), of each block."""
    for block in batch.column("turns"):
        items = block.values
        yield items.field("turn").to_pylist(), list(zip(items.field("role").to_pylist(), items.field("text").to_pylist(), strict=True))


# What a block says of its turns, before and after repair

_DONE = pa.schema(
    [("conv_id", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_())]
    + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
)
_DONE_SQL = (
    "conv_id long, piece long, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, turns array<struct<role: string, text: string>>"
)
SUMS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _repair_whole(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for numbers, turns in _turns(batch):
        found = faults(turns, set())
        cost, audit = closed(best_paths(turns, found, "-"))
        rows.append(
            (gaps_of(numbers)[0], *(found.count(c) for c in "bdt"), illegal_pairs([r[:1] for r, _ in turns]), cost, audit, edited(turns, audit, "-"))
        )
    return batch_of(_DONE, batch.column("conv_id"), batch.column("piece"), [True] * len(rows), *map(list, zip(*rows, strict=True)))


_PATH = pa.struct([("start", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
_PRICED = pa.schema(
    [("conv_id", pa.int64()), ("piece", pa.int64())] + [(n, pa.int64()) for n in ("gaps", "least", "most", "blank", "duplicate", "truncated", "illegal")]
    + [("first", pa.string()), ("last", pa.string()), ("paths", pa.list_(_PATH))]
)
_PRICED_SQL = (
    "conv_id long, piece long, gaps long, least long, most long, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, paths array<struct<start: string, end: string, cost: long, audit: string>>"
)


def _price(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each block's paths from every state to every state, and what its neighbours need to know."""
    rows = []
    for conv, known, (numbers, turns) in zip(batch.column("conv_id").to_pylist(), batch.column("known").to_pylist(), _turns(batch), strict=True):
        name = "" if conv is None else conv
        found = faults(turns, set(known or ()), lambda t, n=name: hashlib.md5(f"{n}:{len(t[0])}:{t[0]}{t[1]}".encode()).hexdigest())
        paths = [(s, e, c, a) for s in NEEDS for e, (c, a) in best_paths(turns, found, s).items()]
        initials = [r[:1] for r, _ in turns]
        ends = (initials[0], initials[-1]) if initials else (None, None)
        rows.append((*gaps_of(numbers), *(found.count(c) for c in "bdt"), illegal_pairs(initials), *ends, paths))
    return batch_of(_PRICED, batch.column("conv_id"), batch.column("piece"), *map(list, zip(*rows, strict=True)))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows in order, each with whether it begins a conversation."""
    before: object = ()
    for batch in batches:
        for at in range(batch.num_rows):  # one by one: a row may hold a block's texts
            row = batch.slice(at, 1).to_pylist()[0]
            yield (row["conv_id"],) != before, row
            before = (row["conv_id"],)


_CHOSEN = pa.schema([("piece", pa.int64()), ("start", pa.string()), ("audit", pa.string())] + [(n, pa.int64()) for n in SUMS])
_CHOSEN_SQL = "piece long, start string, audit string, " + ", ".join(f"{n} long" for n in SUMS)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best path through a conversation's blocks.  Audits of blocks are joined by bars, which end at the same turns in all paths."""
    pieces: list[list[int]] = []
    held: dict[str, tuple[int, str, str]] = {}
    most, last = None, None

    def end() -> pa.RecordBatch:
        cost, audit, starts = min((c + INSERT * len(NEEDS[s][""]), a + "I" * len(NEEDS[s][""]), p) for s, (c, a, p) in held.items())
        shares = [cost] + [0] * (len(pieces) - 1)
        columns = [list(x) for x in zip(*pieces, strict=True)]
        return batch_of(_CHOSEN, columns[0], list(starts), audit.split("|"), *columns[1:], shares)

    for begins, row in _grouped(batches):
        if begins:
            if pieces:
                yield end()
            pieces, held, most, last = [], {"-": (0, "", "")}, None, None
        bar = "|" if pieces else ""
        best: dict[str, tuple[int, str, str]] = {}
        for path in row["paths"]:
            if path["start"] in held:
                cost, audit, starts = held[path["start"]]
                own = (cost + path["cost"], f"{audit}{bar}{path['audit']}", starts + path["start"])
                best[path["end"]] = min(best.get(path["end"], own), own)
        held = best
        between = max(0, row["least"] - most - 1) if most is not None and row["least"] is not None else 0
        joint = int(last is not None and row["first"] is not None and last + row["first"] not in ("su", "ua", "au"))
        pieces.append([row["piece"], row["gaps"] + between, row["blank"], row["duplicate"], row["truncated"], row["illegal"] + joint])
        most = row["most"] if row["most"] is not None else most
        last = row["last"] if row["last"] is not None else last
    if pieces:
        yield end()


def _edit(batch: pa.RecordBatch) -> pa.RecordBatch:
    audits, starts = batch.column("audit").to_pylist(), batch.column("start").to_pylist()
    turns = [edited(t, a, s) for (_, t), a, s in zip(_turns(batch), audits, starts, strict=True)]
    return batch_of(
        _DONE, batch.column("conv_id"), batch.column("piece"), [False] * len(turns), *(batch.column(n) for n in SUMS), audits, turns
    )


def _repair_parts(parts: DataFrame, space: Workspace) -> DataFrame:
    """Blocks of conversations that span several."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"))
    turn = parts.select("piece", "conv_id", F.explode("turns").alias("t"))
    key = F.md5(F.concat(name, F.length("t.role").cast("string"), F.lit(":"), F.col("t.role"), F.col("t.text")))
    keys = space.save(turn.select("piece", key.alias("key")).distinct(), "keys")
    first = keys.groupBy("key").agg(F.min("piece").alias("first"), F.count(F.lit(1)).alias("blocks")).where("blocks > 1")
    known = keys.join(first.hint("merge"), "key").where(F.col("piece") > F.col("first"))
    known = known.groupBy("piece").agg(F.collect_list("key").alias("known"))  # no more than a block has rows
    priced = space.save(arrow_map(parts.join(known.hint("merge"), "piece", "left"), _price, _PRICED_SQL), "priced")
    chosen = map_batches(priced.repartition("conv_id").sortWithinPartitions("conv_id", "piece"), _chain, _CHOSEN_SQL)
    chosen = space.save(chosen, "chosen")
    return arrow_map(parts.join(chosen.hint("merge"), "piece"), _edit, _DONE_SQL)


def repaired(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    absent: str | None = None, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Repaired conversations in blocks: ``conv_id``, ``piece``, ``turns`` after repair, their ``audit``, and counts.

    ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal`` and ``cost`` add up over a conversation's blocks.
    ``whole`` says that a block is all of its conversation.  ``absent`` names a boolean column of rows that are no turns
    but keep their conversation in the result.
    """
    space = Workspace(rows.sparkSession, "conversation-repair")
    blocks = packed(rows, id_col, turn_col, role_col, text_col, absent, (block_rows, block_bytes))
    blocks = space.save(blocks, "blocks", ["whole"])
    columns = ["conv_id", "piece", "turns"]
    whole = arrow_map(blocks.where("whole").select(columns), _repair_whole, _DONE_SQL)
    return whole.unionByName(_repair_parts(blocks.where("NOT whole").select(columns), space))


_REPORT_SQL = "conv_id long, " + ", ".join(f"{n} long" for n in SUMS) + ", audit string, repaired_sha256 string"
_REPORT = pa.schema([("conv_id", pa.int64())] + [(n, pa.int64()) for n in SUMS] + [("audit", pa.string()), ("repaired_sha256", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from blocks in order; a text is held only while its block is."""
    conv, sums, audits, sha, empty = None, None, [], None, True

    def end() -> pa.RecordBatch:
        return batch_of(_REPORT, [conv], *([s] for s in sums), ["".join(audits)], [sha.hexdigest()])

    for begins, row in _grouped(batches):
        if begins:
            if sums:
                yield end()
            conv, sums, audits, sha, empty = row["conv_id"], [0] * len(SUMS), [], hashlib.sha256(), True
        sums = [s + row[n] for s, n in zip(sums, SUMS, strict=True)]
        audits.append(row["audit"])
        for turn in row["turns"]:
            sha.update(f"{'' if empty else chr(10)}{turn['role']}:{turn['text']}".encode())
            empty = False
    if sums:
        yield end()


def report(blocks: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost, audit, and the SHA-256 of ``role:text``, joined by new lines."""
    blocks = Workspace(blocks.sparkSession, "conversation-report").save(blocks, "blocks", ["whole"])
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = blocks.where("whole").select("conv_id", *SUMS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    parts = blocks.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return whole.unionByName(map_batches(parts.select("conv_id", "piece", "turns", "audit", *SUMS), _digest, _REPORT_SQL))


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with turns dropped (marked ``absent``), emptied, unpunctuated, repeated or given to the user, by a checksum."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    out = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), out.alias("text"),
        (F.col("kind") == 0).alias("absent"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(repaired(damaged(table(spark, sf_dir, "conversations")), absent="absent"))


def _least(*found: str) -> str:
    return f"list_sort(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL))[1]"


def _step_sql(to: str) -> str:
    """A turn that stays with an initial, from each state that may stand before it."""
    edit = f"CASE WHEN m.role[1:1] = '{to}' THEN 'K' ELSE 'R' END"
    cost = f"CASE WHEN m.role[1:1] = '{to}' THEN 0 ELSE 2 END + CASE WHEN m.fault = 't' THEN 1 ELSE 0 END"
    name = "m.role" if to == "s" else f"CASE WHEN m.role[1:1] = '{to}' THEN m.role ELSE '{NAMES[to]}' END"
    out = []
    for state, more in ((s, n[to]) for s, n in NEEDS.items() if to in n):
        own = {"-": "h0", "s": "h1", "u": "h2", "a": "h3"}[state]
        turns = ", ".join([*(f"'{NAMES[c]}:'" for c in more), f"({name}) || ':' || m.text"])
        out.append(
            f"CASE WHEN {own} IS NOT NULL THEN {{c: {own}.c + {2 * len(more)} + {cost}, a: {own}.a || '{'I' * len(more)}' || {edit}, "
            f"o: list_concat({own}.o, [{turns}])}} END"
        )
    rule = "m.role[1:1] = 's' AND " if to == "s" else ""
    return f"CASE WHEN {rule}m.fault NOT IN ('b', 'd') THEN {_least(*out)} END"


def _gone_sql(own: str) -> str:
    return f"CASE WHEN {own} IS NOT NULL THEN {{c: {own}.c + 3, a: {own}.a || 'D', o: {own}.o}} END"


def _end_sql(own: str, more: str) -> str:
    return (
        f"CASE WHEN {own} IS NOT NULL THEN {{c: {own}.c + {2 * len(more)}, a: {own}.a || '{'I' * len(more)}', "
        f"o: list_concat({own}.o, {[f'{NAMES[c]}:' for c in more]}::VARCHAR[])}} END"
    )


_BEST = "STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH RECURSIVE {CRC},
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
k AS (SELECT r.*, {crc32_sql(bytes_sql('name'))} % 20 AS kind FROM r, crc),
x AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  rtrim(text, {_WHITE}) AS body FROM x),
m AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
  WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  lag(role) OVER (PARTITION BY conv_id ORDER BY i)[1:1] || role[1:1] AS pair FROM n),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, max(i) AS last,
  count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{c: 0, a: '', o: []}}::{_BEST} AS h0, NULL::{_BEST} AS h1, NULL::{_BEST} AS h2, NULL::{_BEST} AS h3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT w.conv_id, w.i + 1, {_gone_sql('h0')}, {_least(_gone_sql('h1'), _step_sql('s'))},
    {_least(_gone_sql('h2'), _step_sql('u'))}, {_least(_gone_sql('h3'), _step_sql('a'))}
  FROM walk w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1),
e AS (SELECT w.conv_id, s.* EXCLUDE (conv_id, last),
  {_least(*(_end_sql(h, NEEDS[c]['']) for h, c in zip(('h0', 'h1', 'h2', 'h3'), NEEDS, strict=True)))} AS best
  FROM walk w LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(s.last, 0))
SELECT conv_id, coalesce(CAST(gaps AS BIGINT), 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
  sha256(array_to_string(best.o, chr(10))) AS repaired_sha256 FROM e
"""
