"""Exact n-gram Jaccard join: size-banded tiles, bitmap signatures, sorted-array intersection.

A document's set holds the distinct hashes of its 5-word shingles (words are split at ASCII white
space, A-Z lower-cased); with fewer words the whole sequence is its one shingle; without words the
set is empty and linked with nothing.  Two documents link when 100 * intersection >= 75 * union.

1. ``sets``: one pass hashes every text to its set's size and 128-bit digest.  Equal sets form one
   class, represented by its smallest id, so copies are never compared or expanded.  The same pass
   counts shingles that several sets of a block share; the counts order shingles from rare to common.
   The order decides only how much work there is: any order that all documents share is exact.
2. Sharing a shingle among the first ``n - ceil(0.75 n) + 1`` in that order is necessary for a link.
   Each shingle has a leader, and each class becomes a member of the groups of its prefix shingles'
   leaders, so two classes that share a prefix shingle meet in at least one group.  The leader of a
   common shingle is known from the first pass: the holder with the smallest digest.  So members of
   its group are written where their prefix is found, and no task gathers a hot shingle.  All other
   prefixes meet by shingle, packed in binary blocks, and the class with most common shingles leads.
3. Groups are cut in tiles: bands of sizes, each with a factor of 4/3, so that a link joins equal or
   neighbouring bands, and blocks of bounded size within a band.  A band of one block meets its
   neighbours in a tile.  In a band of many, each block first meets by itself with a few pivots of the
   band, which joins most of a cluster of near copies in as many tiles as it has blocks.  Only the rows
   that this leaves outside the group's largest component then meet all blocks of their own and the
   neighbouring bands.  So tiles grow with the square of a cluster only where most pairs do not link.
4. First the tiles hold bitmap signatures.  Bits set in one and not in the other bound the overlap
   from above.  A tile returns a spanning forest of the pairs that may still link; closed to
   components, these are clusters that no link leaves.
5. Then the clusters' tiles hold the sorted arrays, each document's once or twice.  Pairs that pass a
   wider signature and are not yet connected are decided by exact intersection, and a tile returns a
   spanning forest of its links, never all pairs.  Links are closed to components piece by piece, and
   pieces are joined by alternating large-star and small-star steps.

Nulls: a null text has an empty set; a null id is its own class member and takes part as the id of
no other, its component is null unless its class has an id.  Repeated rows give repeated results.
Ties: shingles equally common are in the order of their hashes, sets of equal size in that of ids.
Very long texts are whole, at some 60 bytes of memory a byte.  Columns added on the way take names
that the input does not have.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.session import ship_package

from . import textkit as tk
from .shared import Workspace, arrow_map, batch_of, columns, map_batches, table, unused

SIZE, PERCENT = 5, 75
#: Shingles held at once while counting which ones sets of a block share.
BLOCK = 4_000_000
#: Shingles known as common, at most, with their rank and leader: 24 bytes each in the broadcast table.
COMMON_MAX = 200_000
#: Links of a piece that one task closes.
PIECE = 1_000_000
#: Array elements in a tile's block, and rows in it, at most.
TILE_ELEMENTS, TILE_ROWS = 2_000_000, 1024
#: Bits of a signature, at most; it has twice as many as the set has shingles.
SIGNATURE_MAX = 1 << 16


def shingle_sets(column: pa.Array, size: int = SIZE) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text."""
    for chunk in tk.chunks(column, 1 << 19):
        words = tk.words(chunk, tk.SPACE)
        value, at = words.window(size)
        bounds = np.searchsorted(at, words.rows)
        for i, n in enumerate(words.count().tolist()):
            if n >= size:
                yield chunk.first + i, np.unique(value[bounds[i] : bounds[i + 1]])
            elif n:
                a = int(words.rows[i])
                one = tk.Words(None, None, words.hash[a : a + n], np.array([0, n]), None).window(n)[0]
                yield chunk.first + i, one
            else:
                yield chunk.first + i, np.zeros(0, tk.U)


def _digest(values: np.ndarray) -> tuple[int, int]:
    two = np.frombuffer(hashlib.blake2b(values.tobytes(), digest_size=16).digest(), np.int64)
    return int(two[0]), int(two[1])


_SETS = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
    ("token", pa.int64()), ("held", pa.int64()), ("leader", pa.int64()), ("signature", pa.binary()),
])
_SETS_SQL = "doc_id long, n long, d1 long, d2 long, token long, held long, leader long, signature binary"


def signature(values: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Bitmap of a set: a power of two of bits, at least twice the size; the hash's low bits choose one."""
    bits = bits or min(SIGNATURE_MAX, 1 << max(6, int(2 * len(values) - 1).bit_length()))
    out = np.zeros(bits, bool)
    out[(values & tk.U(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(tk.U)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """Rows of documents (token null), and of shingles: how many sets of a block hold one, and the first of these."""

    def shared(block: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        value, count = np.unique(np.concatenate([x for _, x in block]), return_counts=True)
        value, count = value[count >= 3], count[count >= 3]
        leader = np.zeros(len(value), np.int64)
        if len(value):
            for digest, own in sorted(block, key=lambda x: -x[0]):  # the smallest digest has the last word
                at = np.minimum(np.searchsorted(value, own), len(value) - 1)
                leader[at[value[at] == own]] = digest
        nulls = pa.nulls(len(value), pa.int64())
        none = pa.nulls(len(value), pa.binary())
        return batch_of(_SETS, nulls, nulls, nulls, nulls, tk.as_long(value), count.astype(np.int64), leader, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[int, np.ndarray]] = []
        held, seen = 0, set()
        for batch in batches:
            rows = []
            for _, values in shingle_sets(batch.column(1), size):
                digest = _digest(values) if len(values) else (None, None)
                rows.append((len(values), *digest, signature(values).tobytes() if len(values) else None))
                if len(values) and digest not in seen:
                    seen.add(digest)
                    block.append((digest[0], values))
                    held += len(values)
                    if held >= BLOCK:
                        yield shared(block)
                        block, held, seen = [], 0, set()
            if rows:
                nulls = pa.nulls(len(rows), pa.int64())
                n, d1, d2, maps = (list(x) for x in zip(*rows, strict=True))
                yield batch_of(_SETS, batch.column(0), n, d1, d2, nulls, nulls, nulls, maps)
        if block:
            yield shared(block)

    return map_batches(docs, run, _SETS_SQL)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


_PACK = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])
_PACK_SQL = "bucket int, kind int, block binary"
#: Kinds of blocks: entries that meet by shingle, and members of the groups of common shingles' leaders.
MEETS, JOINS = 0, 1
_ENTRY = np.dtype([("token", "<u8"), ("set", "<i8"), ("common", "u1")])
_PAIR = np.dtype([("leader", "<i8"), ("set", "<i8")])


def _prefixes(docs: DataFrame, common: object, buckets: int, size: int, percent: int) -> DataFrame:
    """Packed entries by hash bucket: (shingle, set, share of common shingles), and (leader, set) of common ones."""

    def pack(parts: list[np.ndarray], kind: int) -> pa.RecordBatch:
        entries = np.concatenate(parts)
        key = entries["token"] if kind == MEETS else tk.mix(entries["leader"].view(tk.U) ^ tk.mix(entries["set"].view(tk.U)))
        bucket = (key % tk.U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        entries, bucket = entries[order], bucket[order]
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        blocks = [x.tobytes() for x in np.split(entries, first[1:])]
        return batch_of(_PACK, bucket[first], np.full(len(first), kind, np.int32), blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, rank, leader = common.value
        parts: list[list[np.ndarray]] = [[], []]
        held, seen = 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (MEETS, JOINS):
                if parts[kind]:
                    yield pack(parts[kind], kind)
                    parts[kind] = []

        for batch in batches:
            for _, values in shingle_sets(batch.column(0), size):
                n = len(values)
                if not n or (key := _digest(values)) in seen:
                    continue
                seen.add(key)
                at = np.minimum(np.searchsorted(table_, values), len(table_) - 1)
                known = table_[at] == values
                level = np.where(known, rank[at], 0)
                order = np.argsort(level, kind="stable")[: prefix_length(n, percent)]  # ties: by hash
                rare, shared = order[~known[order]], order[known[order]]
                own = np.empty(len(rare), _ENTRY)
                own["token"], own["set"] = values[rare], key[0]
                own["common"] = int((level > 0).mean() * 255)
                groups = np.unique(leader[at[shared]])
                joins = np.empty(len(groups), _PAIR)
                joins["leader"], joins["set"] = groups, key[0]
                for kind, x in ((MEETS, own), (JOINS, joins)):
                    if len(x):
                        parts[kind].append(x)
                held += len(own) + len(joins)
                if held >= 1_000_000:
                    yield from flush()
                    held = 0
                if len(seen) >= 1_000_000:
                    seen = set()
        yield from flush()

    return map_batches(docs, run, _PACK_SQL)


_MEMBER = pa.schema([("leader", pa.int64()), ("set", pa.int64())])


def _repeated(ordered: np.ndarray) -> np.ndarray:
    """Which values of a sorted array occur more than once."""
    same = ordered[1:] == ordered[:-1]
    return np.concatenate([[False], same])[: len(ordered)] | np.concatenate([same, [False]])[: len(ordered)]


def _members(packed: DataFrame) -> DataFrame:
    """(leader, set): for each shingle that sets share, its leader with all of its sets."""

    def lead(blocks: list[bytes]) -> pa.RecordBatch | None:
        entries = np.concatenate([np.frombuffer(b, _ENTRY) for b in blocks])
        entries = entries[np.argsort(entries["token"])]
        entries = entries[_repeated(entries["token"])]  # few are left
        entries = entries[np.lexsort((entries["set"], -entries["common"].astype(np.int64), entries["token"]))]
        token, held = entries["token"], entries["set"]
        same = token[1:] == token[:-1]
        entries = entries[np.concatenate([[True], ~(same & (held[1:] == held[:-1]))])[: len(entries)]]  # copies
        entries = entries[_repeated(entries["token"])]
        if not len(entries):
            return None
        first = np.flatnonzero(np.concatenate([[True], entries["token"][1:] != entries["token"][:-1]]))
        leader = np.repeat(entries["set"][first], np.diff(np.append(first, len(entries))))
        order = np.lexsort((entries["set"], leader))
        leader, held = leader[order], entries["set"][order]
        new = np.concatenate([[True], (leader[1:] != leader[:-1]) | (held[1:] != held[:-1])])
        return batch_of(_MEMBER, leader[new], held[new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks = None, []
        for batch in batches:
            for b, kind, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind == JOINS:
                    pairs = np.unique(np.frombuffer(block.as_py(), _PAIR))
                    yield batch_of(_MEMBER, pairs["leader"], pairs["set"])
                    continue
                if b != bucket and blocks:
                    if (out := lead(blocks)) is not None:
                        yield out
                    blocks = []
                bucket = b
                blocks.append(block.as_py())
        if blocks and (out := lead(blocks)) is not None:
            yield out

    return map_batches(packed, run, "leader long, set long")


_KEY = ["key", "low", "a", "b"]
_TILE_SQL = "struct<key: bigint, low: int, a: int, b: int>"
#: Rows of a band that meet every block of it.
PIVOTS = 4


def _tile(low: Column, a: Column, b: Column) -> Column:
    return F.struct(F.col("key"), low.cast("int").alias("low"), a.cast("int").alias("a"), b.cast("int").alias("b"))


def _numbers(n: Column) -> Column:
    """0 to n - 1; none for 0 or null."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _blocks(rows: Column, most: Column) -> Column:
    limit = F.greatest(F.lit(64), F.least(F.lit(TILE_ROWS), F.floor(F.lit(TILE_ELEMENTS) / most)))
    return F.ceil(rows / limit).cast("int")


def _beside(counts: DataFrame, value: str) -> DataFrame:
    """One row by (``key``, ``band``) with the values of the band below and above; a key has few bands."""
    near = lambda step: F.max(value).over(W.partitionBy("key").orderBy("band").rangeBetween(step, step))
    return counts.withColumn(f"{value}_below", near(-1)).withColumn(f"{value}_above", near(1))


def _banded(members: DataFrame) -> DataFrame:
    """Rows (``key``, ``node``, ``n``) of groups of two or more with band, blocks of it and beside it, own block, whether a
    pivot, and whether some band of the group has many blocks (``wide``)."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))).cast("int")
    members = members.withColumn("band", band)
    pick = lambda i: F.min_by("node", F.xxhash64("node", F.lit(i)))
    counts = members.groupBy("key", "band").agg(
        F.count(F.lit(1)).alias("rows"), F.max("n").alias("most"), F.array(*(pick(i) for i in range(PIVOTS))).alias("pivots")
    )
    own = W.partitionBy("key")
    counts = counts.withColumn("whole", F.sum("rows").over(own)).where("whole > 1")
    counts = counts.select("key", "band", _blocks(F.col("rows"), F.col("most")).alias("blocks"), "pivots")
    shape = _beside(counts, "blocks").withColumn("wide", F.max("blocks").over(own) > 1)
    m = members.join(shape, ["key", "band"])
    m = m.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return m.withColumn("pivot", F.array_contains("pivots", F.col("node"))).drop("pivots")


def _first_tiles(banded: DataFrame) -> DataFrame:
    """The tiles of each row: its block, for pivots all blocks of the band, and the band below where both are one block."""
    block = _tile(F.col("band") * 2, F.col("mine"), F.col("mine"))
    every = F.transform(_numbers(F.col("blocks")), lambda j: _tile(F.col("band") * 2, j, j))
    down = F.when((F.col("blocks") == 1) & (F.col("blocks_below") == 1), F.array(_tile(F.col("band") * 2 - 2, F.lit(0), F.lit(0))))
    none = F.array().cast(f"array<{_TILE_SQL}>")
    tiles = F.concat(F.when(F.col("pivot"), every).otherwise(F.array(block)), F.coalesce(down, none))
    return banded.select("node", "n", F.explode(tiles).alias("tile"), F.col("node").alias("root"))


def _second_tiles(
    banded: DataFrame, roots: DataFrame, save: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> DataFrame | None:
    """The tiles of pairs that have not met: rows outside their group's largest component, with blocks beside them.

    None if every band is one block and so are the bands beside it.
    """
    wide = banded.where("wide")
    if wide.isEmpty():
        return None
    rows = wide.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("c", -F.col("root"))).alias("largest"))
    # saved, since the counts of what is left read them as well as the tiles
    rows = save(rows.join(largest, "key").withColumn("out", F.col("root") != F.col("largest")))
    left = rows.groupBy("key", "band").agg(F.count_if("out").alias("c"), F.max(F.when(F.col("out"), F.col("n"))).alias("most"))
    left = left.select("key", "band", F.when(F.col("c") > 0, _blocks(F.col("c"), F.col("most"))).alias("left"))
    rows = rows.join(_beside(left, "left"), ["key", "band"])
    spot = F.pmod(F.xxhash64("node", F.lit(1)), F.greatest("left", F.lit(1))).cast("int")
    low = lambda of, to: of * 4 + to - of + 1  # noqa: E731  # a band and the one it meets
    band = F.col("band")

    def beside(step: int, blocks: str, count: str) -> tuple[Column, Column]:
        meets = F.transform(_numbers(F.col(blocks)), lambda j: _tile(low(band, band + step), spot, j))
        return meets, F.transform(_numbers(F.col(count)), lambda i: _tile(low(band + step, band), i, F.col("mine")))

    sides = (-1, "blocks_below", "left_below"), (0, "blocks", "left"), (1, "blocks_above", "left_above")
    meets, met = zip(*(beside(*x) for x in sides), strict=True)
    none = F.array().cast(f"array<{_TILE_SQL}>")
    tiles = F.array_distinct(F.concat(F.when(F.col("out"), F.concat(*meets)).otherwise(none), *met))
    return rows.select("node", "n", F.explode(tiles).alias("tile"), "root")


_TILED = pa.schema([
    ("key", pa.int64()), ("low", pa.int32()), ("a", pa.int32()), ("b", pa.int32()),
    ("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("values", pa.binary()),
])
_TILED_SQL = "key long, low int, a int, b int, node long, n long, root long, values binary"


def _tiled(docs: DataFrame, size: int) -> DataFrame:
    """The sorted shingle array of each document, once for each tile that needs it."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tiles, roots = batch.column(2), batch.column(3).to_pylist()
        ids = batch.column(0).to_pylist()
        rows, held = [], 0
        for i, values in shingle_sets(batch.column(1), size):
            raw = values.tobytes()
            for t in tiles[i].as_py():
                rows.append((t["key"], t["low"], t["a"], t["b"], ids[i], len(values), roots[i], raw))
                held += len(raw)
                if held >= 8 << 20:
                    yield batch_of(_TILED, *(list(x) for x in zip(*rows, strict=True)))
                    rows, held = [], 0
        if rows:
            yield batch_of(_TILED, *(list(x) for x in zip(*rows, strict=True)))

    return arrow_map(docs, run, _TILED_SQL)


class _Maps:
    """Signatures of a tile by width, so that sets of unequal widths meet at the smaller one."""

    def __init__(self, maps: list[np.ndarray]):
        self.width = np.array([len(m) for m in maps])
        self.rows: dict[int, np.ndarray] = {}
        self.maps: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            rows = np.flatnonzero((self.width == w) | (self.width == 2 * w))
            self.rows[w] = rows
            self.maps[w] = np.stack([maps[r] if len(maps[r]) == w else maps[r][:w] | maps[r][w:] for r in rows])

    def may_link(self, n: np.ndarray, i: int, to: int, root: np.ndarray, percent: int) -> np.ndarray:
        """Rows j with i < j < ``to``, not connected with i, whose overlap with i is not bounded too low."""
        w = int(self.width[i])
        rows, maps = self.rows[w], self.maps[w]
        a, b = np.searchsorted(rows, [i + 1, to])
        others = rows[a:b]
        free = root[others] != root[i]
        others, near = others[free], maps[a:b][free]
        own = maps[np.searchsorted(rows, i)]
        lost = np.bitwise_count(own & ~near).sum(1, dtype=np.int64)
        gained = np.bitwise_count(near & ~own).sum(1, dtype=np.int64)
        most = np.minimum(n[i] - lost, n[others] - gained)
        return others[100 * most >= percent * (n[i] + n[others] - most)]


def tile_links(
    ids: list[int], n: list[int], values: list[bytes], exact: bool, percent: int = PERCENT, roots: list[int] | None = None
) -> list[tuple[int, int]]:
    """A spanning forest of a tile's links (``values`` are arrays), or of what may link (signatures).

    Rows of equal ``roots`` are connected already.
    """
    order = sorted(range(len(ids)), key=lambda i: (n[i], ids[i]))
    known = np.arange(len(ids)) if roots is None else np.unique([roots[i] for i in order], return_inverse=True)[1]
    ids, n = [ids[i] for i in order], np.array([n[i] for i in order], np.int64)
    values = [np.frombuffer(values[i], tk.U) for i in order]
    maps = _Maps([signature(v, 1 << max(8, int(4 * len(v) - 1).bit_length())) for v in values] if exact else values)
    root = known
    links = []
    for i in range(len(ids) - 1):
        to = int(np.searchsorted(n, n[i] * 100 // percent, "right"))  # larger sets cannot link
        if to <= i + 1:
            continue
        for j in maps.may_link(n, i, to, root, percent).tolist():
            if root[i] != root[j]:
                if exact:
                    k = _overlap(values[i], values[j])
                    if 100 * k < percent * (n[i] + n[j] - k):
                        continue
                links.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]
    return links


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(tiled: DataFrame, exact: bool, percent: int) -> DataFrame:
    """Links found in tiles, some by several; a task sees a tile's rows one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []

        def found() -> Iterator[pa.RecordBatch]:
            links = []
            if len(rows) > 1:
                ids, n, roots, values = (list(x) for x in zip(*rows, strict=True))
                if len(set(roots)) > 1:
                    links = tile_links(ids, n, values, exact, percent, roots)
            if links:
                yield batch_of(_LINK, [min(x) for x in links], [max(x) for x in links])

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            held = zip(*(batch.column(i).to_pylist() for i in range(4, 8)), strict=True)
            for key, row in zip(keys, held, strict=True):
                if key != tile:
                    yield from found()
                    tile, rows = key, []
                rows.append(row)
        yield from found()

    return map_batches(tiled, run, "a long, b long")


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some links but the smallest of its component, with the smallest."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        # roots take the smallest root that a link shows them, and nodes follow their roots
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _pieces(links: DataFrame, pieces: int) -> DataFrame:
    """The same components with fewer links: each piece of the links is closed by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for batch in batches:
            u.append(np.asarray(batch.column(0)))
            v.append(np.asarray(batch.column(1)))
        if u:
            yield batch_of(_EDGE, *forest(np.concatenate(u), np.concatenate(v)))

    return map_batches(links.repartition(pieces), run, "u long, v long")


def components(links: DataFrame, space: Workspace, name: str, most_rounds: int = 60, piece: int = PIECE) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of a link but the smallest ones.

    Pieces of ``piece`` links are closed by themselves.  If there is one piece, that is all; else pieces
    are joined by alternating stars, until no node has both a smaller neighbour and another one.  Each
    round is written out, so a lost executor costs one round.  A node's neighbours are never gathered: both
    steps need only the minimum over them.
    """
    pieces = max(1, -(-links.count() // piece))
    edges = space.save(_pieces(links.where("a <> b").select("a", "b"), pieces), f"{name}-0")
    for i in range(1, most_rounds + 1):
        if pieces == 1:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("far"))
        if near.where("m < u AND far <> m").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        least = near.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").dropDuplicates()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = space.save(small.union(low.select("u", F.col("m").alias("v"))).dropDuplicates(), f"{name}-{i}")
        space.drop(f"{name}-{i - 1}")
    raise RuntimeError(f"links did not close to components in {most_rounds} rounds")


def _closed(
    space: Workspace, name: str, members: DataFrame, fill: Callable[[DataFrame], DataFrame], exact: bool, percent: int, buckets: int
) -> DataFrame:
    """(node, root) of the components that rows of equal ``key`` form by their links; ``fill`` adds sets to tiles."""
    banded = space.save(_banded(members), f"{name}-banded")
    dealt = lambda tiles: fill(tiles).repartition(buckets, *_KEY).sortWithinPartitions(*_KEY)
    links = space.save(_links(dealt(_first_tiles(banded)), exact, percent), f"{name}-links")
    roots = components(links, space, name)
    more = _second_tiles(banded, roots, lambda rows: space.save(rows, f"{name}-out"))
    if more is not None:
        later = space.save(_links(dealt(more), exact, percent), f"{name}-later")
        roots = components(links.unionByName(later), space, f"{name}-all")
    return roots


#: Shingles for which there are four buckets; partitions at most: the driver holds a status for each and every task before it.
BUCKET_SHINGLES, MOST_PARTITIONS = 8_000_000, 20_000


def document_components(
    docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each document row."""
    spark = docs.sparkSession
    ship_package(spark)
    space = Workspace(spark, "jaccard-join")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = space.save(_sets(docs, size), "sets")
    sets = found.where("token IS NULL")
    classes = sets.where("n > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("signature").alias("signature")
    )
    reps = space.save(classes, "classes")

    held = found.where("token IS NOT NULL").groupBy("token").agg(F.sum("held").alias("held"), F.min("leader").alias("leader"))
    top = columns(held.orderBy(F.col("held").desc(), "token").limit(COMMON_MAX))
    order = np.argsort(top["token"].view(tk.U))
    end = np.uint64(2**64 - 1)  # so that a search always has a place
    common = spark.sparkContext.broadcast(
        (np.append(top["token"].view(tk.U)[order], end), np.append(top["held"][order], 0), np.append(top["leader"][order], 0))
    )

    total = found.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = max(16, int(total // BUCKET_SHINGLES) * 4)  # about a MB of entries from each of many tasks
    parts = min(buckets, MOST_PARTITIONS)
    packed = _prefixes(docs.select("text"), common, buckets, size, percent)
    # a task takes its buckets one by one, so that its memory is that of one, however many it has
    packed = packed.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket", "kind")
    members = space.save(_members(packed), "members")
    common.unpersist()
    nodes = reps.where("doc_id IS NOT NULL")
    groups = members.dropDuplicates().join(nodes, members["set"] == nodes["d1"])
    groups = space.save(groups.select(F.col("leader").alias("key"), F.col("doc_id").alias("node"), "n"), "groups")
    maps = nodes.select(F.col("doc_id").alias("node"), F.col("signature").alias("values"))

    def signatures(tiles: DataFrame) -> DataFrame:
        return tiles.select("node", "n", "root", "tile.*").join(maps, "node").select(*_KEY, "node", "n", "root", "values")

    def arrays(tiles: DataFrame) -> DataFrame:
        each = space.save(tiles.groupBy("node").agg(F.collect_list("tile").alias("tiles"), F.first("root").alias("root")), f"tiles-{uuid.uuid4().hex}")
        return _tiled(docs.join(each.hint("merge"), docs["doc_id"] == each["node"]).select("doc_id", "text", "tiles", "root"), size)

    clusters = _closed(space, "clusters", groups, signatures, False, percent, parts)
    # every node of a cluster has its root, and the root itself
    firsts = clusters.select(F.col("root").alias("node"), "root").dropDuplicates()
    clusters = clusters.unionByName(firsts).select("node", F.col("root").alias("key"))
    clusters = space.save(clusters.join(nodes.select(F.col("doc_id").alias("node"), "n"), "node"), "cluster-rows")
    roots = _closed(space, "components", clusters, arrays, True, percent, parts)
    space.drop("members", "groups", "cluster-rows")

    named = reps.join(roots, reps["doc_id"] == roots["node"], "left").select(
        F.col("d1"), F.col("d2"), F.coalesce("root", "doc_id").alias("component_id")
    )
    return sets.join(named, ["d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(
    docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id."""
    found = document_components(docs, size, percent, id_col, text_col)
    name = unused(docs, "__tm_gone")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).dropDuplicates()
    return docs.join(gone, docs[id_col].cast("long") == gone[name], "left_anti")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_components(table(spark, sf_dir, "documents"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[p : p + least(5, len(w)) - 1], ' ')) AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
e AS (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT u, min(v) AS component_id FROM r GROUP BY u) c ON c.u = d.doc_id
"""
