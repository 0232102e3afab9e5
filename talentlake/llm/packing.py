"""Documents packed into sequences of WINDOW tokens.

Each document's ids are cut at multiples of the window: those pieces fill sequences alone. The rests, shorter than a
window, are counted by length. Shallow combinations of lengths that fill a window are enumerated, and non-negative least
squares finds how often to repeat each so that the histogram of lengths is met; the repeats are rounded down, what
is left is packed greedily into exact fills, longest first, and what fits nowhere is laid on one line that is cut at each
window. The line's end is cut at powers of two, so no sequence needs padding.

The histogram has WINDOW - 1 rows at most and so has the plan a few thousand, whatever the size of the corpus: solving it
is the driver's only work. A rest finds its place by its rank among the rests of its length, so a length that a third of
all documents have is dealt like any other. Ranks are those within a partition plus counts of the partitions before.

Tokenizing is written once to the shared folder; all else reads that table, so that an executor that is lost costs its
own tasks only.

Defined results: a null or empty text is its end id alone; rows of equal or null id are packed each for itself; very
long texts are cut like others; an empty table gives none; columns that aren't asked for are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentlake.llm._util import blocks, lookup, text_buffers, tidied, written
from talentlake.llm.chunks import ByteTokens, cut, joinable, spread, strings

WINDOW = 1024
END_ID = 0
#: Distinct chunks after which a worker forgets those it knows, bytes of text encoded at once, chunks encoded in one text.
MEMO, BLOCK, JOINT = 600_000, 1 << 21, 4096
#: Copies of one length in a combination, triples and quadruples for each shortest length, and rounds of the solver. What
#: the combinations leave over is packed all the same.
COPIES, SPREAD, ROUNDS = 7, 8, 400
TOKENS = "part int, doc_id long, n long, full_before long, length int, rank long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


# -- tokens -----------------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts: those of their chunks, each of which is encoded once and found again by its text."""

    def __init__(self, path: str):
        self.coder = ByteTokens(path, special=True)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.starts, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of a block of texts, each ended by END_ID."""
        if len(self.known) > MEMO:
            self.clear()
        cuts, per = cut(raw, offsets)
        if not len(cuts) - 1:
            return np.full(len(per), END_ID, np.int32), np.ones(len(per), np.int64)
        coded = strings(raw, cuts).dictionary_encode()
        words = coded.dictionary.to_pylist()
        place = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = len(self.known) + np.arange(len(new))
            self._learn(coded.dictionary.take(pa.array(new)))
            self.known.update([(words[k], p) for k, p in zip(new.tolist(), place[new].tolist(), strict=True)])
        at = place[coded.indices.to_numpy()]
        counts = self.counts[at]
        ids = self.flat[spread(self.starts[at], counts)]
        n = np.diff(np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(per)))])
        return np.insert(ids, np.cumsum(n), END_ID), n + 1

    def _learn(self, chunks: pa.Array) -> None:
        raw, cuts = text_buffers(chunks)
        together, size = joinable(raw, cuts), np.diff(cuts)
        starts, counts = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        at = np.flatnonzero(together)
        for lo in range(0, len(at), JOINT):
            part = at[lo : lo + JOINT]
            joint = raw[spread(cuts[part], size[part])]
            ids = self.coder.ids(joint.tobytes().decode())
            ends = np.cumsum(self.coder.bytes.size[ids])
            stops = np.searchsorted(ends, np.cumsum(size[part]), "left") + 1
            counts[part] = np.diff(stops, prepend=0)
            starts[part] = self._add(ids) + stops - counts[part]
        text = raw.tobytes()
        for k in np.flatnonzero(~together).tolist():
            ids = self.coder.ids(text[cuts[k] : cuts[k + 1]].decode())
            starts[k], counts[k] = self._add(ids), len(ids)
        self.starts, self.counts = np.concatenate((self.starts, starts)), np.concatenate((self.counts, counts))

    def _add(self, ids: np.ndarray) -> int:
        """Append ids; where they begin."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.flat):
            self.flat = np.concatenate((self.flat[:at], np.empty(max(len(self.flat), len(ids)), np.int32)))
        self.flat[at : self.used] = ids
        return at


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder: tasks of one worker share what it knows."""
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))


def tokenized(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """A row for each document: its ids, their number n, full windows of its partition before it, the length of its rest
    (0: none) and the rest's rank among those of its length in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from talentlake.llm.packing import encoder  # by name: what a task brings along is built anew for each task

        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        full, seen = 0, np.zeros(window, np.int64)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for lo, hi in blocks(offsets, BLOCK):
                ids, n = coder.encode(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                before = full + np.cumsum(n // window) - n // window
                full = int(before[-1] + n[-1] // window)
                rest = n % window
                rank = seen[rest] + nth(rest)
                seen += np.bincount(rest, minlength=window)
                upto = 4 * np.concatenate(([0], np.cumsum(n)))
                cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(upto), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(before), pa.array(rest.astype(np.int32)), pa.array(rank), cells],
                    ["part", "doc_id", "n", "full_before", "length", "rank", "ids"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(run), TOKENS)


def nth(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, np.int64)
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(first, np.diff(np.append(first, len(values))))
    return out


# -- the plan ---------------------------------------------------------------------------------------------------------


def combinations(counts: np.ndarray, copies: int = COPIES, spread_: int = SPREAD) -> np.ndarray:
    """Combinations of lengths that occur and fill a window, a row each, behind zeros: all pairs, all of one length up to
    `copies` times with another, and for each shortest length some triples and quadruples, spread evenly."""
    window, width = len(counts), copies + 1
    v = np.arange(1, window)
    out = [np.stack((v, window - v), 1)[v <= window // 2]]
    for k in range(2, copies + 1):
        one = v[v * k < window]
        out.append(np.stack([*[one] * k, window - k * one], 1))
    for k in range(1, spread_ + 1):
        a = v[v <= window // 3]
        b = a + (((window - a) // 2 - a) * k) // (spread_ + 1)
        out.append(np.stack((a, b, window - a - b), 1))
        a = v[v <= window // 4]
        b = a + (((window - a) // 3 - a) * k) // (spread_ + 1)
        c = b + ((window - a - b) // 2 - b) * ((5 * k + 2) % (spread_ + 1)) // (spread_ + 1)
        out.append(np.stack((a, b, c, window - a - b - c), 1))
    every = np.concatenate([np.pad(np.sort(x, 1), ((0, 0), (width - x.shape[1], 0))) for x in out])
    every = np.unique(every, axis=0)
    times = (every[:, :, None] == every[:, None, :]).sum(2)
    return every[((every == 0) | (counts[every] >= times)).all(1)]


def repeats(rows: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients: how often each combination is to be used, so that the
    lengths that are used come nearest to their counts."""
    m, width, window = *rows.shape, len(counts)
    x = np.zeros(m)
    if not m:
        return x
    flat, used = rows.ravel(), (rows > 0).ravel()
    flat = flat[used]
    owner = np.repeat(np.arange(m), width)[used]

    def of_lengths(y: np.ndarray) -> np.ndarray:
        return np.bincount(flat, y[owner], window)

    def of_rows(r: np.ndarray) -> np.ndarray:
        return np.bincount(owner, r[flat], m)

    probe = np.ones(m)
    for _ in range(20):  # the largest eigenvalue
        probe = of_rows(of_lengths(probe))
        norm = float(np.linalg.norm(probe))
        probe /= norm
    goal = counts.astype(float)
    goal[0] = 0
    y, momentum = x, 1.0
    for _ in range(rounds):
        then = np.maximum(y - of_rows(of_lengths(y) - goal) / (1.01 * norm), 0)
        step = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        y, x, momentum = then + (momentum - 1) / step * (then - x), then, step
    return x


def rounded(rows: np.ndarray, x: np.ndarray, counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """([(combination, times)], counts left): amounts rounded down, as far as the lengths last, largest first."""
    left, out = counts.copy(), []
    for j in np.argsort(-x, kind="stable").tolist():
        times = int(x[j] + 1e-6)
        if not times:
            break
        own = tuple(int(v) for v in rows[j] if v)
        times = min([times, *(int(left[v]) // own.count(v) for v in own)])
        if times:
            out.append((own, times))
            for v in own:
                left[v] -= times
    return out, left


def greedy(left: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """The same for what is left: the longest length, with the longest others that fit, until one or two more fill the
    window exactly; such a combination is used as often as its lengths last. A length that ends in no exact fill stays."""
    left, out, window = left.copy(), [], len(left)
    for v in range(window - 1, 0, -1):
        while left[v]:
            own, gap, free = [v], window - v, left.copy()
            free[v] -= 1
            while gap:
                if free[gap]:
                    own.append(gap)
                    break
                first = np.arange(1, gap // 2 + 1)
                fits = first[(free[first] > 0) & (free[gap - first] > (2 * first == gap))]
                if len(fits):
                    own += [gap - int(fits[-1]), int(fits[-1])]
                    break
                shorter = np.flatnonzero(free[1:gap])
                if not len(shorter):
                    own = []
                    break
                w = int(shorter[-1]) + 1
                own.append(w)
                free[w] -= 1
                gap -= w
            if not own:
                break
            times = min(int(left[o]) // own.count(o) for o in own)
            out.append((tuple(own), times))
            for o in own:
                left[o] -= times
    return out, left


@dataclass
class Plan:
    """Places of rests by length and rank. Slots of a length: ranks below `upto` and not below the slot's before stand in
    sequence first + rank at `offset`; ranks from `lined` on lie on the line, from `line_at` on, one behind another."""

    window: int
    upto: list[np.ndarray] = field(default_factory=list)
    first: list[np.ndarray] = field(default_factory=list)
    offset: list[np.ndarray] = field(default_factory=list)
    lined: np.ndarray = None
    line_at: np.ndarray = None
    line_end: int = 0
    line_sequence: int = 0
    n_sequences: int = 0

    def places(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """[(sequence, offset, tokens)] of the pieces of a rest, in order."""
        if rank < self.lined[length]:
            k = int(np.searchsorted(self.upto[length], rank, "right"))
            return [(int(self.first[length][k]) + rank, int(self.offset[length][k]), length)]
        at = int(self.line_at[length]) + (rank - int(self.lined[length])) * length
        end, out = at + length, []
        whole = self.line_end // self.window * self.window
        while at < end:
            begin, sequence = at // self.window * self.window, self.line_sequence + at // self.window
            stop = begin + self.window
            if at >= whole:  # the last window's tokens, by powers of two
                left, begin, stop = self.line_end - whole, whole, whole
                while stop <= at:
                    begin, stop = stop, stop + (1 << (left - (stop - whole)).bit_length() - 1)
                    sequence += begin > whole
            n = min(end, stop) - at
            out.append((sequence, at - begin, n))
            at += n
        return out


def planned(counts: np.ndarray) -> Plan:
    """The plan for rests of given counts by length (index 0: none)."""
    counts = counts.astype(np.int64).copy()
    counts[0] = 0
    rows = combinations(counts)
    used, left = rounded(rows, repeats(rows, counts), counts)
    more, left = greedy(left)
    plan = Plan(len(counts))
    slots: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    filled, sequence = [0] * len(counts), 0
    for own, times in used + more:
        offset = 0
        for v in sorted(own, reverse=True):
            slots[v].append((filled[v] + times, sequence - filled[v], offset))
            filled[v] += times
            offset += v
        sequence += times
    for of in slots:
        upto, first, offset = np.array(of, np.int64).reshape(-1, 3).T
        plan.upto.append(upto)
        plan.first.append(first)
        plan.offset.append(offset)
    plan.lined = np.array(filled, np.int64)
    tokens = left * np.arange(len(counts))
    plan.line_at = np.cumsum(tokens[::-1])[::-1] - tokens  # longest first
    plan.line_end, plan.line_sequence = int(tokens.sum()), sequence
    rest = plan.line_end % plan.window
    plan.n_sequences = sequence + plan.line_end // plan.window + rest.bit_count()
    return plan


# -- pieces -----------------------------------------------------------------------------------------------------------


def packed(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """A row for each piece: doc_id, start in its document, length, doc_tokens, sequence_id, offset there, ids (little-endian)."""
    rows = written(tokenized(docs, tokenizer, text, doc_id, window), "packing-tokens")
    rests = rows.where("length > 0").groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(rests.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-ranks")
    counts = np.zeros(window, np.int64)
    for length, n in bases.groupBy("length").agg(F.sum("n")).collect():  # as many rows as there are lengths, at most
        counts[length] = n
    plan = planned(counts)
    fulls = rows.groupBy("part").agg(F.sum(F.floor(F.col("n") / window)).alias("n"))
    at = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = fulls.select("part", (F.coalesce(F.sum("n").over(at), F.lit(0)) + plan.n_sequences).alias("first"))
    based = lookup(lookup(rows, starts, ["part"]), bases.select("part", "length", "base"), ["part", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, first, before_, length, rank, base = (batch.column(k) for k in range(1, 8))
            out: list[tuple] = []
            for i, (m, f, b, v, r, s) in enumerate(zip(*(c.to_pylist() for c in (n, first, before_, length, rank, base)), strict=True)):
                out += [(i, k * window, window, m, f + b + k, 0) for k in range(m // window)]
                begin = m - v
                for sequence, offset, size in plan.places(v, s + r) if v else ():
                    out.append((i, begin, size, m, sequence, offset))
                    begin += size
            row, begin, size, m, sequence, offset = np.array(out, np.int64).reshape(-1, 6).T
            bounds = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset).astype(np.int64)
            words = np.frombuffer(ids.buffers()[2], np.uint8)
            flat = words[spread(bounds[row] + 4 * begin, 4 * size)]
            cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(4 * np.concatenate(([0], np.cumsum(size)))), pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *map(pa.array, (begin, size, m, sequence, offset)), cells], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return based.select("doc_id", "ids", "n", "first", "full_before", "length", "rank", "base").mapInArrow(tidied(run), PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences themselves; each has a window of tokens at most."""
    by = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    empty = F.lit(b"").cast("binary")
    return by.select("sequence_id", "n_tokens", F.aggregate("p", empty, lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
