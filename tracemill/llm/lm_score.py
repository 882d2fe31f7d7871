"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Tokens are words between ASCII white space, A-Z lower-cased, then one end.  Counts of all training
tokens are exact and give the base score, an add-0.1 unigram model.  The model factors a token's
probability along a tree of classes, four levels of sixteen, with 65 536 leaves:

* the ``OWN`` most frequent words (the end is always one) have a leaf each if they occur ``OWN_LEAST``
  times; every other word shares a leaf with the words whose last three bytes fall in its bucket.  The tree is found by bisecting the
  leaves along the principal direction of which frequent words precede them, so words used alike share
  classes;
* at each level a softmax over sixteen classes is taken, given the class above and the context: the
  word before, the word two before and the word three before (skips), and the pair of words before.  A
  context is the hash of whole words, of any word, and with the class above it chooses a row of sixteen
  weights in a table of 2**18 rows; each class above also has a row of its own, its bias;
* in a shared leaf, a known word's share is its count less one half, and one outcome, standing for
  unknown words, has what all words of the leaf lost by that.

Training is by two rounds of distributed gradient updates that visit every training text once.  Texts
are dealt by a hash of id and text to shards whose number follows the number of tokens, and are put in
order there; each shard takes Adagrad steps of a fixed number of tokens from the last round's weights,
and the changes are averaged by how often a shard used a row, shards in order.  So neither files, nor
partitions, nor lost executors play a part in the result (but for the rounding of sums).  Scoring computes a chunk's tokens in sparse
numpy batches.

The table of counts grows with the corpus and stays a table.  The ``KNOWN`` most frequent words and
their counts are broadcast (16 bytes each, at any size of the corpus); occurrences of other words are
joined with the table by hash.  Such a word has less than one in ``KNOWN`` of all tokens, so no key of
that join is hot.

Nulls: a null text is empty and has the end only; a null id is in the fold of the empty text.  Repeated
rows are texts of their own.  Ties: of equally frequent words those with the smaller hash come first.
Very long texts are whole; a chunk holds one by itself, at some 60 bytes of memory a byte.  Columns are
selected by name and renamed, so extra ones may have any name.  Without training rows all words are
unknown and the score is the base's.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import ship_package

from . import textkit as tk
from .shared import Workspace, arrow_map, batch_of, columns, fold, map_batches, table

WAYS, LEVELS = 16, 4
LEAVES = WAYS**LEVELS
#: Words that are leaves of the second and of the third level, and places of the fourth that such a leaf takes.
SECOND, THIRD, WIDE, MIDDLE = 48, 768, WAYS**2, WAYS
ENDINGS = 16_384
OWN = SECOND + THIRD + LEAVES - SECOND * WIDE - THIRD * MIDDLE - ENDINGS
ITEMS = OWN + ENDINGS
#: The first node of each level; below them are the classes of the level above.
NODE = np.cumsum([0, *(WAYS**i for i in range(LEVELS))])
#: Occurrences that a word needs for a leaf of its own, and what words of a shared leaf lose to unknown ones.
OWN_LEAST, DISCOUNT = 20, 0.5
ROW_BITS = 18
ROWS = (1 << ROW_BITS) + int(NODE[-1])
CONTEXTS = 4
KNOWN = 1 << 18
#: Frequent words that tell classes apart, the start of a text and all other words.
NEAR = 32
STEP_TOKENS = 8192
#: Tokens of a shard: few while there are less than ``SHARDS`` shards, and at most so many beyond.
FEW_TOKENS, MOST_TOKENS, SHARDS = 250_000, 8_000_000, 12
ADD = 0.1
_END_HASH = np.int64(-1)
_START = tk.U(0x5851F42D4C957F2D)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], tk.U)
_LOG10 = float(np.log(10))


def ending(words: tk.Words, own: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Bucket of the last three bytes of each word, or of some."""
    start, end = words.start[own], words.end[own]
    size, at = end - start, end - 1
    code = words.lower[at].astype(np.int64)
    for back in (1, 2):
        code = code * 257 + np.where(size > back, words.lower[at - back].astype(np.int64) + 1, 0)
    return (tk.mix(code.astype(tk.U)) % tk.U(ENDINGS)).astype(np.int64)


_FIRST_BITS = 19


class Vocabulary:
    """The most frequent words by hash, with their counts, and the leaf of each item.

    Item 0 is the end, items 1 to OWN - 1 are the most frequent words, and OWN + e is ending e.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.item = np.where((order < OWN - 1) & (self.counts >= OWN_LEAST), order + 1, -1).astype(np.int32)
        self.leaf = np.zeros(ITEMS, np.int32)  # the first place of the fourth level that an item's leaf takes
        edges = np.arange(1 << _FIRST_BITS, dtype=tk.U) << tk.U(64 - _FIRST_BITS)
        self.first = np.append(np.searchsorted(self.hashes, edges), len(hashes)).astype(np.int32)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Place of each hash among the known ones, or -1."""
        part = (value >> tk.U(64 - _FIRST_BITS)).astype(np.int64)
        at, stop = self.first.take(part), self.first.take(part + 1)
        out = np.full(len(value), -1, np.int64)
        live = np.flatnonzero(at < stop)
        while len(live):
            spot = at[live]
            own = self.hashes[spot]
            hit = own == value[live]
            out[live[hit]] = spot[hit]
            at[live] += 1
            live = live[(own < value[live]) & (spot + 1 < stop[live])]
        return out


@dataclass
class Tokens:
    """All tokens of a chunk, ends included: items, places among the known words, contexts and rows' bounds."""

    item: np.ndarray
    known: np.ndarray
    context: np.ndarray
    rows: np.ndarray
    own: np.ndarray  # places of the words among the tokens


def sequences(words: tk.Words, vocabulary: Vocabulary, with_context: bool = True) -> Tokens:
    rows = words.rows + np.arange(len(words.rows))
    n = int(rows[-1])
    own = np.ones(n, bool)
    own[rows[1:] - 1] = False
    own = np.flatnonzero(own)
    found = vocabulary.find(words.hash)
    item = np.zeros(n, np.int64)
    frequent = np.where(found >= 0, vocabulary.item[found] if len(vocabulary.item) else -1, -1).astype(np.int64)
    other = np.flatnonzero(frequent < 0)
    frequent[other] = OWN + ending(words, other)
    item[own] = frequent
    known = np.full(n, -1, np.int64)
    known[own] = found
    if not with_context:
        return Tokens(item, known, np.zeros((0, n), tk.U), rows, own)
    value = np.zeros(n, tk.U)
    value[own] = words.hash
    place = np.arange(n) - np.repeat(rows[:-1], np.diff(rows))
    context = np.full((CONTEXTS, n), _START)
    for k in (1, 2, 3):
        inside = np.flatnonzero(place >= k)
        context[k - 1, inside] = value[inside - k]
    context[3] = tk.mix(context[0] * _ODD[0] + context[1])
    return Tokens(item, known, context * _ODD[:, None], rows, own)


def _level(
    context: np.ndarray, leaf: np.ndarray, depth: np.ndarray, level: int
) -> tuple[np.ndarray | slice, np.ndarray, np.ndarray]:
    """Tokens that go on at a level, their rows of the table by feature, and the classes chosen."""
    on = slice(None)
    if depth.min(initial=LEVELS) <= level:
        on = np.flatnonzero(depth > level)
        context, leaf = context.take(on, 1), leaf[on]
    node = NODE[level] + (leaf >> 4 * (LEVELS - level))
    spread = node.astype(tk.U) * tk.U(0x9E3779B97F4A7C15)
    rows = np.empty((CONTEXTS + 1, len(leaf)), np.int64)
    rows[:CONTEXTS] = (context ^ spread) * tk.U(0xD6E8FEB86659FD93) >> tk.U(64 - ROW_BITS)
    rows[CONTEXTS] = (1 << ROW_BITS) + node
    return on, rows, leaf >> 4 * (LEVELS - 1 - level) & WAYS - 1


_ONES = np.ones(WAYS, np.float32)
#: Tokens and rows that are taken at a time, so that what is at work stays in the processor's cache.
_STRETCH = 2048


def _shares(weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the classes' sums of weights, by token, and their totals; sums stay within +-60."""
    out = np.empty((rows.shape[1], WAYS), np.float32)
    more = np.empty((min(_STRETCH, len(out)), WAYS), np.float32)
    for a in range(0, len(out), _STRETCH):
        z = out[a : a + _STRETCH]
        term = more[: len(z)]
        weights.take(rows[0, a : a + _STRETCH], 0, z, "clip")  # without a copy; all rows are of the table
        for r in rows[1:]:
            z += weights.take(r[a : a + _STRETCH], 0, term, "clip")
        np.exp(np.clip(z, -60, 60, out=z), out=z)
    return out, out @ _ONES


def depth_of(item: np.ndarray) -> np.ndarray:
    """The level of an item's leaf."""
    return LEVELS - (item < SECOND).astype(np.int8) - (item < SECOND + THIRD)


def log_leaf(weights: np.ndarray, context: np.ndarray, leaf: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each leaf in its context."""
    out = np.ones(len(leaf))  # four shares of e**-123 at least stay above the least number
    for level in range(LEVELS):
        on, rows, choice = _level(context, leaf, depth, level)
        share, total = _shares(weights, rows)
        out[on] *= share.ravel()[np.arange(0, share.size, WAYS) + choice] / total
    return np.log(out)


#: A row of weights as one element.
_CELL = f"V{4 * WAYS}"


class Trainer:
    """Adagrad steps over a shard's tokens, from given weights; each step has ``STEP_TOKENS`` tokens."""

    def __init__(self, weights: np.ndarray, vocabulary: Vocabulary, rate: float):
        self.first, self.now, self.vocabulary, self.rate = weights, weights.copy(), vocabulary, rate
        self.cells = self.now.view(_CELL).ravel()  # the same memory: whole rows are written at once
        self.state = np.ones(len(weights), np.complex64)  # by row: one mean square, and the number of uses
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def learn(self, words: tk.Words) -> None:
        found = sequences(words, self.vocabulary)
        self.held.append((found.context, found.item))
        self.size += len(found.item)
        if self.size >= STEP_TOKENS:
            self._steps(last=False)

    def _steps(self, last: bool) -> None:
        context = np.concatenate([c for c, _ in self.held], 1)
        item = np.concatenate([x for _, x in self.held])
        at = 0
        while len(item) - at >= (1 if last else STEP_TOKENS):
            self._step(context[:, at : at + STEP_TOKENS], item[at : at + STEP_TOKENS])
            at += STEP_TOKENS
        self.held, self.size = [(context[:, at:], item[at:])], max(0, len(item) - at)

    def _step(self, context: np.ndarray, item: np.ndarray) -> None:
        leaf, depth = self.vocabulary.leaf[item].astype(np.int64), depth_of(item)
        for level in range(LEVELS):
            _, rows, choice = _level(context, leaf, depth, level)
            if not len(choice):
                continue
            runs = Runs(rows)
            now = self.now.take(runs.row, 0)
            error, total = _shares(now, runs.number)
            error *= (1 / total)[:, None]
            error.ravel()[np.arange(0, error.size, WAYS) + choice] -= 1
            more, total = runs.sums(error)
            token = runs.token.take(runs.first)
            token[more] = len(error) + np.arange(len(more))  # the sums stand behind the tokens' own errors
            error = np.concatenate([error, total])
            square = np.einsum("ij,ij->i", error, error) / WAYS
            for a in range(0, len(token), _STRETCH):
                row, own = runs.row[a : a + _STRETCH], token[a : a + _STRETCH]
                state = self.state.take(row)
                state.real += square.take(own)
                state.imag += runs.size[a : a + _STRETCH]
                self.state[row] = state
                gradient = error.take(own, 0)
                gradient *= (-self.rate / np.sqrt(state.real))[:, None]
                gradient += now[a : a + _STRETCH]
                self.cells[row] = gradient.view(_CELL).ravel()

    def changes(self) -> tuple[np.ndarray, np.ndarray]:
        """Changes of all weights, and how often each row was used."""
        if self.held:
            self._steps(last=True)
        return self.now - self.first, self.state.imag.copy()


class Runs:
    """The different rows that tokens use, in order, so that each is read and written once a step."""

    def __init__(self, rows: np.ndarray):
        # rows in order, each with its places (feature and token), by one sort of packed numbers
        packed = rows.view(tk.U) << tk.U(20)
        packed |= np.arange(rows.shape[1], dtype=tk.U) + (np.arange(len(rows), dtype=tk.U) * tk.U(STEP_TOKENS))[:, None]
        packed = np.sort(packed, axis=None)
        place = (packed & tk.U((1 << 20) - 1)).view(np.int64)
        packed >>= tk.U(20)
        new = np.ones(len(packed), bool)
        np.not_equal(packed[1:], packed[:-1], out=new[1:])
        self.first = np.flatnonzero(new)
        self.size = np.append(self.first[1:], len(packed)) - self.first
        self.row = packed[self.first].view(np.int64)
        self.number = np.empty((len(rows), STEP_TOKENS), np.int64)  # of each place's row among the different ones
        self.number.ravel()[place] = np.cumsum(new) - 1
        self.number = self.number[:, : rows.shape[1]]
        self.token = place & (STEP_TOKENS - 1)

    def sums(self, error: np.ndarray, many: int = 48) -> tuple[np.ndarray, np.ndarray]:
        """Rows that more than one place has, and sums of the errors of their tokens: long runs each by itself,
        short ones all in step, the longest first."""
        more = np.flatnonzero(self.size > 1)
        more = more[np.argsort(-self.size[more])]
        first, size = self.first[more], self.size[more]
        stops = np.searchsorted(-size, -np.arange(1, many)).tolist()  # how many runs are longer than 1, 2 and so on
        long = stops[-1]
        out = error.take(self.token.take(first), 0)
        for u in range(long):
            own = error.take(self.token[first[u] : first[u] + size[u]], 0)
            if len(own) > 1024:  # in wide rows, which is faster
                even = len(own) & -WAYS
                wide = own[:even].reshape(-1, WAYS * WAYS).sum(0)
                own = np.concatenate([wide.reshape(WAYS, WAYS), own[even:]])
            own.sum(0, out=out[u])
        short = out[long:]
        for k, stop in enumerate(stops[:-1], 1):
            if stop <= long:
                break
            short[: stop - long] += error.take(self.token.take(first[long:stop] + k), 0)
        return more, out


_COUNTS = pa.schema([("hash", pa.int64()), ("ending", pa.int32()), ("count", pa.int64())])


def token_counts(docs: DataFrame) -> DataFrame:
    """(hash, ending, count) of all tokens of a text column; the end has hash -1 and ending -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, held, parts = 0, 0, []

        def flush() -> pa.RecordBatch:
            value, ends_in = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            # in order of their first bits, with places below them: words of the same first bits may come in pieces
            low = tk.U((1 << len(value).bit_length()) - 1)
            place = (np.sort(value & ~low | np.arange(len(value), dtype=tk.U)) & low).view(np.int64)
            value = value.take(place)
            first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            count = np.append(first[1:], len(value)) - first
            return batch_of(_COUNTS, tk.as_long(value[first]), ends_in[place[first]].astype(np.int32), count)

        for batch in batches:
            for chunk in tk.chunks(batch.column(0)):
                words = tk.words(chunk, tk.SPACE)
                ends += chunk.rows
                parts.append((words.hash, ending(words)))
                held += len(words.hash)
                if held >= 2_000_000:
                    yield flush()
                    held, parts = 0, []
        if held:
            yield flush()
        if ends:
            yield batch_of(_COUNTS, [_END_HASH], [-1], [ends])

    counts = map_batches(docs, run, "hash long, ending int, count long")
    return counts.groupBy("hash").agg(F.max("ending").alias("ending"), F.sum("count").alias("count"))


_NEAR = pa.schema([("block", pa.int32()), ("values", pa.binary())])
_BLOCK = 1024
_BLOCKS = -(-ITEMS // _BLOCK)
_LEAF = pa.schema([("item", pa.int32()), ("leaf", pa.int32())])


def _tree(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The leaf of each item: by bisection of the items' counts of preceding frequent words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(_BLOCKS * _BLOCK * NEAR, np.int32)
        for batch in batches:
            for chunk in tk.chunks(batch.column(0)):
                found = sequences(tk.words(chunk, tk.SPACE), vocabulary, with_context=False)
                before = np.zeros(len(found.item), np.int64)
                before[1:] = np.minimum(found.item[:-1], NEAR - 1)
                before[found.rows[:-1]] = 0  # the start of a text, as an end goes before nothing
                np.add.at(out, found.item * NEAR + before, np.int32(1))
        out = out.reshape(-1, _BLOCK * NEAR)
        for b in np.flatnonzero(out.any(1)).tolist():
            yield batch_of(_NEAR, [b], [out[b].tobytes()])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BLOCK * NEAR, np.int64)
        for batch in batches:
            for x in batch.column("values"):
                raw = np.frombuffer(x.as_py(), np.uint8)
                total += raw.view(np.int64 if raw.size == 8 * len(total) else np.int32)
        yield batch_of(_NEAR, [key[0].as_py()], [total.tobytes()])

    def bisect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.zeros((_BLOCKS, _BLOCK * NEAR), np.int64)
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                near[b] = np.frombuffer(x.as_py(), np.int64)
        item = np.arange(ITEMS)
        size = np.where(item < SECOND, WIDE, np.where(item < SECOND + THIRD, MIDDLE, 1))
        yield batch_of(_LEAF, item, bisected(near.reshape(-1, NEAR)[:ITEMS].astype(np.float64), size))

    sql = "block int, values binary"
    # the counts of a fixed number of items: one task can hold them
    near = map_batches(texts, count, sql).groupBy("block").applyInArrow(add, sql).repartition(1)
    found = columns(map_batches(near, bisect, "item int, leaf int"))
    out = np.zeros(ITEMS, np.int32)
    out[found["item"]] = found["leaf"]
    return out


def bisected(near: np.ndarray, size: np.ndarray, least: int = 32) -> np.ndarray:
    """Each item's first place, so that halves, quarters and so on of all places hold items with like profiles.

    Sizes are powers of two, their sum is one, and no item crosses the bounds of a stretch as long as itself.
    """
    total = near.sum(1)
    x = np.sqrt(near / np.maximum(total, 1)[:, None])
    weight = np.maximum(np.log1p(total), 1e-9)
    place = np.empty(len(near), np.int32)
    todo = [(np.arange(len(near)), 0, int(size.sum()))]
    while todo:
        own, first, room = todo.pop()
        if len(own) == 1:
            place[own] = first
            continue
        mass = weight[own]
        part = x[own] - np.average(x[own], axis=0, weights=mass)
        _, axes = np.linalg.eigh((part * mass[:, None]).T @ part)
        axis = axes[:, -1] * (1 if axes[np.abs(axes[:, -1]).argmax(), -1] > 0 else -1)
        own = own[np.lexsort((own, np.round(part @ axis, 9)))]
        wide = size[own]
        if room <= least and wide.max() == 1:
            place[own] = first + np.arange(room)
            continue
        left = _filling(wide, room // 2)
        todo += [(own[~left], first + room // 2, room // 2), (own[left], first, room // 2)]
    return place


def _filling(size: np.ndarray, room: int) -> np.ndarray:
    """Which items, taken in order, fill the room exactly; one that is too large for what is left is passed over."""
    out = np.zeros(len(size), bool)
    for i, wide in enumerate(size.tolist()):
        if wide <= room:
            out[i] = True
            room -= wide
            if not room:
                break
    return out


def _priors(mass: np.ndarray) -> np.ndarray:
    """Weights before training: biases are the logs of the shares of classes, everything else is 0."""
    weights = np.zeros((ROWS, WAYS), np.float32)
    for level in range(LEVELS):
        own = mass.reshape(WAYS**level, WAYS, -1).sum(2) + ADD
        at = (1 << ROW_BITS) + int(NODE[level])
        weights[at : at + len(own)] = np.log(own / own.sum(1, keepdims=True))
    return weights


_DENSE = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("values", pa.binary()), ("used", pa.binary())])
_DENSE_SQL = "block int, part int, values binary, used binary"


def _round(texts: DataFrame, shards: int, work: Callable[[], Trainer], weights: np.ndarray) -> np.ndarray:
    """The weights after each shard of ``texts`` (key, text) has learnt from its texts, in their order."""
    parts = max(1, int(np.ceil(np.sqrt(shards))))
    shard = F.pmod("__tm_key", F.lit(shards)).cast("int")
    dealt = texts.select(shard.alias("__tm_shard"), "__tm_key", "__tm_text")
    dealt = dealt.repartitionById(shards, "__tm_shard").sortWithinPartitions("__tm_shard", "__tm_key", "__tm_text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, own = work(), None
        for batch in batches:
            own = batch.column(0)[0].as_py()
            for chunk in tk.chunks(batch.column(2), 1 << 18):
                trainer.learn(tk.words(chunk, tk.SPACE))
        if own is None:
            return
        values, used = trainer.changes()
        for b in range(0, len(values), _BLOCK):
            if used[b : b + _BLOCK].any():
                raw = values[b : b + _BLOCK].astype(np.float16).tobytes()
                yield batch_of(_DENSE, [b // _BLOCK], [own], [raw], [used[b : b + _BLOCK].tobytes()])

    def combine(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        total = weight = 0.0
        for _, raw, used in sorted(rows, key=lambda r: r[0]):  # in the order of shards
            used = np.frombuffer(used, np.float32)
            first = len(raw) == 2 * WAYS * len(used)
            values = np.frombuffer(raw, np.float16 if first else np.float32).reshape(-1, WAYS).astype(np.float64)
            total = total + (values * used[:, None] if first else values)
            weight = weight + used.astype(np.float64)
        out = [np.asarray(total, np.float32).tobytes()], [np.asarray(weight, np.float32).tobytes()]
        yield batch_of(_DENSE, [key[0].as_py()], [key[1].as_py() if len(key) > 1 else 0], *out)

    # a block meets the changes of the square root of all shards at a time, so no group grows with the corpus
    some = map_batches(dealt.select("__tm_shard", "__tm_key", "__tm_text"), learn, _DENSE_SQL)
    some = some.groupBy("block", F.pmod("part", F.lit(parts)).alias("group")).applyInArrow(combine, _DENSE_SQL)
    found = some.groupBy("block").applyInArrow(combine, _DENSE_SQL).select("block", "values", "used").toArrow()
    out = weights.copy()
    for b, raw, used in zip(*(found.column(i).to_pylist() for i in range(3)), strict=True):
        used = np.maximum(np.frombuffer(used, np.float32), 1e-9)
        out[b * _BLOCK : b * _BLOCK + len(used)] += np.frombuffer(raw, np.float32).reshape(-1, WAYS) / used[:, None]
    return out


@dataclass
class Model:
    """What is broadcast, and the table of all counts, which is not."""

    vocabulary: Vocabulary
    weights: np.ndarray
    tokens: int  # N
    types: int  # V
    ends: int
    tail_unit: np.ndarray  # by ending: log10 of the shares' denominator in its leaf
    tail_unknown: np.ndarray  # and of the unknown words' numerator
    counts: DataFrame | None = None

    def base_unit(self) -> float:
        return float(np.log10(self.tokens + ADD * (self.types + 1)))


def fit(
    docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", rounds: list[Column] | None = None,
    rate: float = 0.35, known: int = KNOWN,
) -> Model:
    """The model; ``trains`` is true for training rows, and ``rounds`` are conditions that divide them."""
    spark = docs.sparkSession
    ship_package(spark)
    space = Workspace(spark, "lm-score")
    text = F.col(text_col).cast("string").alias("__tm_text")
    counts = space.save(token_counts(docs.where(trains).select(text)), "counts")
    words = counts.where("hash <> -1")
    row = counts.agg(
        F.sum("count").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("hash") == -1, F.col("count"))).alias("e")
    ).first()
    tokens, types, ends = row["n"] or 0, row["v"], row["e"] or 0
    top = columns(words.orderBy(F.col("count").desc(), "hash").limit(known).select("hash", "count", "ending"))
    order = np.lexsort((top["hash"], -top["count"]))
    vocabulary = Vocabulary(top["hash"][order].view(tk.U), top["count"][order])
    own = order[: OWN - 1]
    own = own[top["count"][own] >= OWN_LEAST]

    by_ending = words.groupBy("ending").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v"))
    by_ending = columns(by_ending)
    mass, types_of = np.zeros(ITEMS), np.zeros(ENDINGS)
    mass[0] = ends
    mass[1 : len(own) + 1] = top["count"][own]
    mass[OWN + by_ending["ending"]] = by_ending["n"]
    types_of[by_ending["ending"]] = by_ending["v"]
    mass[OWN:] -= np.bincount(top["ending"][own], top["count"][own], ENDINGS)
    types_of -= np.bincount(top["ending"][own], minlength=ENDINGS)
    unit, unknown = np.log10(mass[OWN:] + ADD), np.log10(DISCOUNT * types_of + ADD)

    vocabulary.leaf = _tree(docs.where(trains).select(text), vocabulary)
    by_leaf = np.zeros(LEAVES)
    by_leaf[vocabulary.leaf] = mass
    weights = _priors(by_leaf)
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    shared = spark.sparkContext.broadcast(vocabulary)
    conditions = rounds or [F.lit(True)]
    share = int(tokens) // len(conditions)
    shards = max(1, min(SHARDS, share // FEW_TOKENS), -(-share // MOST_TOKENS))
    for condition in conditions:
        start = spark.sparkContext.broadcast(weights)
        texts = docs.where(trains & condition).select(key.alias("__tm_key"), text)
        weights = _round(texts, shards, lambda start=start: Trainer(start.value, shared.value, rate), weights)
        start.unpersist()
    shared.unpersist()
    return Model(vocabulary, weights, int(tokens), int(types), int(ends), unit, unknown, counts)


_PART = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base_log", pa.float64()), ("model_log", pa.float64()),
    ("rare", pa.list_(pa.struct([("hash", pa.int64()), ("unknown", pa.float32())]))),
])
_PART_SQL = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_log double, model_log double, "
    "rare array<struct<hash: bigint, unknown: float>>"
)


def _logs(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Logs of the known words' counts for the base and for shared leaves, and those of one occurrence last."""
    counts = np.append(model.vocabulary.counts, 1)
    return np.log10(counts + ADD), np.log10(counts - DISCOUNT)


def _scored(chunk: tk.Chunk, model: Model, logs: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """By row: tokens, known ones, sums of base and of model logs but for rare words' shares, and the rare words."""
    words = tk.words(chunk, tk.SPACE)
    found = sequences(words, model.vocabulary)
    n = len(found.item)
    log, inner = (x[found.known] for x in logs or _logs(model))  # a rare word's come later
    rare = np.zeros(n, bool)
    rare[found.own] = found.known[found.own] < 0
    end = found.item == 0
    log[rare] = inner[rare] = 0
    log[end] = np.log10(model.ends + ADD)
    tail = found.item >= OWN
    kind = np.where(tail, found.item - OWN, 0)
    own = np.where(tail, inner - model.tail_unit[kind], 0)
    leaf, depth = model.vocabulary.leaf[found.item].astype(np.int64), depth_of(found.item)
    for a in range(0, n, STEP_TOKENS):
        part = slice(a, a + STEP_TOKENS)
        own[part] += log_leaf(model.weights, found.context[:, part], leaf[part], depth[part]) / _LOG10
    first = found.rows[:-1]
    seen = ~rare & ~end
    total = lambda x: np.add.reduceat(x, first)
    known = total(seen.astype(np.int64)) + (model.ends > 0)
    at = np.flatnonzero(rare)
    bounds = np.searchsorted(at, found.rows)
    value = np.zeros(n, tk.U)
    value[found.own] = words.hash
    words_ = pa.StructArray.from_arrays(
        [pa.array(tk.as_long(value[at])), pa.array(model.tail_unknown[kind[at]].astype(np.float32))], names=["hash", "unknown"]
    )
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words_)
    return np.diff(found.rows), known, total(log), total(own), lists


def score(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text's tokens, known tokens, base score and model score (log10 probabilities)."""
    spark = docs.sparkSession
    space = Workspace(spark, "lm-score")
    counts, model.counts = model.counts, None
    shared = spark.sparkContext.broadcast(model)
    model.counts = counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 36  # rows are numbered by task; the table is written once
        logs = _logs(shared.value)
        for batch in batches:
            for chunk in tk.chunks(batch.column(2)):
                ids, held = (batch.column(i).slice(chunk.first, chunk.rows) for i in (0, 1))
                yield batch_of(_PART, np.arange(at, at + chunk.rows), ids, held, *_scored(chunk, shared.value, logs))
                at += chunk.rows

    narrow = docs.select(F.col(id_col).cast("long"), held_out.alias("held_out"), F.col(text_col).cast("string"))
    parts = space.save(map_batches(narrow, run, _PART_SQL), "parts")
    if not model.tokens:
        parts = parts.withColumn("more", F.size("rare") * float(np.log10(ADD))).withColumn("seen", F.lit(0).cast("long"))
    else:
        rare = parts.select("row", F.explode("rare").alias("word")).select("row", "word.hash", "word.unknown")
        rare = rare.join(counts.select("hash", "count").hint("merge"), "hash", "left")
        rare = rare.groupBy(F.col("row").alias("of")).agg(
            F.sum(F.log10(F.coalesce("count", F.lit(0)) + F.lit(ADD))).alias("more"),
            F.sum(F.coalesce(F.log10(F.col("count") - DISCOUNT), "unknown")).alias("shares"), F.count("count").alias("seen"),
        )
        parts = parts.drop("rare").join(rare.hint("merge"), F.col("row") == F.col("of"), "left")
    more = F.coalesce("more", F.lit(0.0))
    base = F.col("base_log") + more - F.col("n_tokens") * F.lit(model.base_unit())
    return parts.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("model_log") + F.coalesce("shares", F.lit(0.0)) if model.tokens else base).alias("score"),
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = fold(F.col("doc_id"), 10)
    return score(docs, fit(docs, part != 0, rounds=[part < 5, part >= 5]), part == 0)
