"""Near-duplicate passages by compact windows.

A text is its sequence of 5-word shingles. For each of HASHES hash functions, the Cartesian tree over the shingles'
hashes gives compact windows (l, c, r): every passage that lies in [l, r] and holds c has its min-hash at c. Only windows
of LEAST shingles or more count; their centres are the minima of all runs of LEAST shingles, so the tree is built over
those centres alone. Two texts that share a passage of LEAST shingles share its min-hash under each function; at a
likeness of 0.75, under one function at least but for (1/4)**HASHES of the cases.

A link needs an equal min-hash and an equal side, the shingle SIDE places right or left of the centre: of a passage of
LEAST shingles, one side of every centre lies within. So windows meet twice, by min-hash and right side and by min-hash
and left side. Up to CLOSE windows of such a group are all linked with each other; in a larger group, whose windows share
two shingles SIDE places apart, each is linked with the one before it and the first, never with all. A batch links its
own large groups before the shuffle and sends on the first window of each alone, so a passage that a third of all texts
share sends few rows for the side that they share; links that are made travel under keys of their own.

Such a group of several documents is a crowd. Once the links are verified, a second round takes the crowds whose documents
are not yet one component: there each document outside the largest component meets all of other components, in blocks, and
those that may share a passage are verified like the others. So no two documents of a group stay apart that share one.

Linked centres of a pair at one shift are one interval of each text over the hash functions, with MARGIN shingles around
it; overlapping ones are one region, which is read again and verified: the stretch of each text that the other holds, of LEAST distinct shingles or more, with a
Jaccard likeness of 0.75 or more. So one phrase over and over is no passage. All regions are verified, each pair of
differing excerpts once: equal excerpts are known to be alike from their hashes. Excerpts are compared by 32-bit hashes.

Defined results: null, empty and short texts have no passage; repeated rows share all their passages; a text is not
compared with itself, nor with a row of its own id; an empty table gives an empty table; very long texts are cut whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentlake.llm._util import blocks, drop_path, lookup, mix64, text_buffers, tidied, word_hashes, written
from talentlake.llm.components import components
from talentlake.llm.near_dup import NEED, OF, WIDTH

#: Hash functions, and distinct shingles of the shortest passage (50 words).
HASHES, LEAST = 3, 46
#: Places from a centre to its sides; windows of one key up to which all are linked with each other.
SIDE, CLOSE = 22, 9
#: Documents of a block of a crowd that meet those of another block, and distinct shingles that two passages have in common.
APART, ENOUGH = 128, -(-2 * LEAST * NEED // (OF + NEED))
#: Shingles around the first and last linked centre of a pair that are read for verification.
MARGIN = 2 * LEAST
#: Held shingles for each other one in a stretch: it makes a likeness of 0.75 at least if both texts have it.
RATE = 6
BLOCK = 1 << 18
_MULT = np.random.Generator(np.random.PCG64(46)).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = 24  # low bits that hold a place in a block
_NAMES = ["key", "doc", "c", "odoc", "shift", "hi"]
#: A window that is open for links (key, doc, c; hi is 1 if it stands for a crowd of its batch), or linked centres c to hi
#: of a pair of documents, doc the later one.
_ROW = "key long, doc long, c int, odoc long, shift int, hi int"


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of WIDTH words of a block of texts, in order; a row's last four words begin none."""
    h, rows, _, _ = word_hashes(raw, offsets)
    n = len(h) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    acc = h[:n].copy()
    for k in range(1, WIDTH):
        acc = mix64(acc) + h[k : k + n]
    ok = rows[:n] == rows[WIDTH - 1 :]
    return mix64(acc[ok]), rows[:n][ok]


def centres(packed: np.ndarray, rows: np.ndarray, least: int) -> np.ndarray:
    """Places of the minima of all runs of `least` values within a row, ascending; values hold their place in the low bits."""
    n = len(packed)
    if n < least:
        return np.empty(0, np.int64)
    pad = -n % least
    full = np.concatenate((packed, np.full(pad, ~np.uint64(0)))).reshape(-1, least)
    ahead = np.minimum.accumulate(full, 1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    low = np.minimum(behind[: n - least + 1], ahead[least - 1 : n])
    low = low[rows[: n - least + 1] == rows[least - 1 :]]
    if not len(low):
        return np.empty(0, np.int64)
    change = np.ones(len(low), bool)
    change[1:] = low[1:] != low[:-1]
    return np.unique((low[change] & np.uint64((1 << _PLACE) - 1)).astype(np.int64))


def compact(packed: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the compact windows of `least` values or more: a centre's nearest smaller neighbours are centres."""
    c = centres(packed, rows, least)
    value, row, place = packed[c].tolist(), rows[c].tolist(), c.tolist()
    left, right, stack = [0] * len(c), [0] * len(c), []
    for i in range(len(place)):
        while stack and (row[stack[-1]] != row[i] or value[stack[-1]] > value[i]):
            j = stack.pop()
            right[j] = place[i] - 1 if row[j] == row[i] else last[row[j]]
        left[i] = place[stack[-1]] + 1 if stack else first[row[i]]
        stack.append(i)
    for j in stack:
        right[j] = last[row[j]]
    return np.array(left, np.int64), c, np.array(right, np.int64)


def _sided(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Rows (key of min-hash and side, document, centre) of the windows of each batch of (doc, text)."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        raw, offsets = text_buffers(batch.column(1))
        found = []
        for a, b in blocks(offsets, BLOCK):
            h, rows = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if len(h) < LEAST:
                continue
            first = np.searchsorted(rows, np.arange(b - a))
            last = np.searchsorted(rows, np.arange(b - a), "right") - 1
            for k in range(HASHES):
                values = mix64(h * _MULT[k])
                # a text of over 2**24 shingles is cut into stretches that overlap by LEAST
                for lo in range(0, len(h), (1 << _PLACE) - LEAST):
                    hi = min(len(h), lo + (1 << _PLACE))
                    v, rw = values[lo:hi], rows[lo:hi]
                    packed = (v & ~np.uint64((1 << _PLACE) - 1)) | np.arange(hi - lo, dtype=np.uint64)
                    f, e = np.maximum(first - lo, 0).tolist(), np.minimum(last - lo, hi - lo - 1).tolist()
                    l, c, r = compact(packed, rw, f, e, LEAST)
                    own, key = h[lo:hi], mix64(v[c] + np.uint64(k))
                    for which, side in ((0, c + SIDE), (1, c - SIDE)):
                        on = np.flatnonzero((side <= r) & (side >= l))
                        on = on[own[side[on]] != own[c[on]]]  # one phrase over and over is no passage
                        sided = mix64(mix64(key[on] + np.uint64(which)) + own[side[on]])
                        found.append((sided.view(np.int64), ids[a + rw[c[on]]], c[on] + lo - first[rw[c[on]]]))
        if found:
            yield [np.concatenate(x) for x in zip(*found, strict=True)]


def _every_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, doc, c in _sided(batches):
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc.astype(np.int64)), pa.array(c.astype(np.int32))], ["key", "doc", "c"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _sided(batches):
        rows, x, y, still = _linked(rows, keep=True)
        doc, odoc, shift, low, high = _merged(rows, x, y)
        # links that are made need no partner: any key will do, so that none is hot
        any_key = mix64(doc.astype(np.uint64) * np.uint64(3) + mix64(odoc.astype(np.uint64) + low.astype(np.uint64))).view(np.int64)
        n, m = len(still), len(doc)
        none = np.concatenate((np.ones(n, bool), np.zeros(m, bool)))
        pad, crowd = np.zeros(n, np.int64), _crowded(rows)[still].astype(np.int64)
        key, own, at = (np.concatenate(z) for z in ((rows[0][still], any_key), (rows[1][still], doc), (rows[2][still], low)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(own), pa.array(at.astype(np.int32)), pa.array(np.concatenate((pad, odoc)), mask=none),
             pa.array(np.concatenate((pad, shift)).astype(np.int32), mask=none), pa.array(np.concatenate((crowd, high)).astype(np.int32))], _NAMES
        )


def _linked(rows: list[np.ndarray], keep: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Rows (key, doc, c) in order; links (x, y) among rows of one key, later document first: all of a small group, and
    with keep none of it; in a large one each with the one before it and with the group's first, or, of the first one's
    document, with the first of another. With keep also the places of rows that stay open for links with others."""
    order = np.lexsort((rows[2], rows[1], rows[0]))
    rows = [x[order] for x in rows]
    key, doc, at = rows[0], rows[1], np.arange(len(order))
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new_key)
    size = np.diff(np.append(starts, len(key)))
    head = starts.repeat(size)
    same = doc == doc[head]
    n_same = np.add.reduceat(same.astype(np.int64), starts) if len(starts) else starts
    alone = (n_same == size).repeat(size)
    second = (starts + n_same).repeat(size)
    large = size.repeat(size) > CLOSE
    xs, ys = [at[large & ~same]], [head[large & ~same]]
    of_first = at[large & same & ~alone]
    xs.append(second[of_first])
    ys.append(of_first)
    for lag in range(1, CLOSE):
        i = at[lag:][(key[lag:] == key[:-lag]) & (large[lag:] if keep else ~large[lag:] | (lag == 1))]
        if keep and lag > 1:
            break
        xs.append(i)
        ys.append(i - lag)
    x, y = np.concatenate(xs), np.concatenate(ys)
    ok = doc[x] != doc[y]
    return rows, x[ok], y[ok], at[~large | (head == at) | alone] if keep else at[:0]


def _crowded(rows: list[np.ndarray]) -> np.ndarray:
    """Of rows sorted by key and document, those of a crowd: a group of over CLOSE windows of several documents."""
    key, doc = rows[0], rows[1]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    size = np.diff(np.append(starts, len(key)))
    return ((size > CLOSE) & (doc[starts] != doc[starts + size - 1])).repeat(size)


def _merged(rows: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """(doc, odoc, shift, first centre, last centre) of links, one row for each pair of documents and shift."""
    doc, odoc, c, shift = rows[1][x], rows[1][y], rows[2][x], rows[2][x] - rows[2][y]
    order = np.lexsort((c, shift, odoc, doc))
    doc, odoc, c, shift = doc[order], odoc[order], c[order], shift[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (odoc[1:] != odoc[:-1]) | (shift[1:] != shift[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    return [doc[first], odoc[first], shift[first], c[first], c[last]]


def _link_batch(doc: np.ndarray, odoc: np.ndarray, shift: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    ints = [pa.array(z.astype(np.int32)) for z in (shift, low, high)]
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(odoc.astype(np.int64)), *ints], ["doc", "odoc", "shift", "lo", "hi"])


def _runs(batches: Iterator[pa.RecordBatch], crowds: bool = False) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and document, the links that they bring along, and links among the open ones, over batch borders;
    with crowds also a row (key, null) for each key whose group is a crowd, in its batch or here."""
    carry = None
    for batch in batches:
        closed = batch.column(3).is_valid()
        made = batch.filter(closed)
        if made.num_rows:
            yield _link_batch(*(made.column(k).to_numpy() for k in (1, 3, 4, 2, 5)))
        batch = batch.filter(pc.invert(closed))
        if not batch.num_rows:
            continue
        rows = [batch.column(k).to_numpy() for k in range(3)]
        marked = rows[0][batch.column(5).fill_null(0).to_numpy() > 0]
        if carry is not None:
            rows = [np.concatenate(z) for z in zip(carry, rows, strict=True)]
        rows, x, y, _ = _linked(rows, keep=False)
        if len(x):
            yield _link_batch(*_merged(rows, x, y))
        if crowds and len(marked := np.unique(np.concatenate((marked, rows[0][_crowded(rows)])))):
            none = pa.nulls(len(marked), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(marked), none, *[x.cast(pa.int32()) for x in (none, none, none)]], ["doc", "odoc", "shift", "lo", "hi"])
        last = np.flatnonzero(rows[0] == rows[0][-1])
        others = last[rows[1][last] != rows[1][last[0]]]
        if len(last) > CLOSE and len(others):  # of a large group, its first, the first of another document, and its last
            last = np.unique([last[0], others[0], last[-1]])
        carry = [z[last] for z in rows]


def _runs_and_crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _runs(batches, crowds=True)


def _distinct(h: np.ndarray) -> int:
    return len(np.unique(h))


def _excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, l, r, n, distinct shingles, 32-bit shingle hashes) of the wanted spans [l, r] of whole texts."""
    for batch in batches:
        raw, offsets = text_buffers(batch.column(1))
        for a, b in blocks(offsets, BLOCK):
            h, rows = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            at, h = np.searchsorted(rows, np.arange(b - a + 1)), (h >> np.uint64(32)).astype(np.uint32)
            out: list[list] = [[] for _ in range(6)]
            for i in range(a, b):
                mine = h[at[i - a] : at[i - a + 1]]
                for s in batch.column(2)[i].as_py():
                    cut = mine[s["l"] : s["r"] + 1]
                    for k, value in enumerate((batch.column(0)[i].as_py(), s["l"], s["r"], len(cut), _distinct(cut), cut.tobytes())):
                        out[k].append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], ["doc", "l", "r", "n", "d", "h"])


def stretch(total: np.ndarray, held: np.ndarray, anchor: int) -> tuple[int, int]:
    """The longest stretch around a held anchor over which total, a running score, does not fall; without others at its ends."""
    low = np.minimum.accumulate(total[: anchor + 1])
    ends = np.arange(anchor + 1, len(total))
    starts = np.searchsorted(-low, -total[ends])
    size = np.where(starts <= anchor, ends - starts, 0)
    best = int(size.argmax())
    a, b = (int(starts[best]), int(ends[best])) if size[best] else (anchor, anchor + 1)
    on = np.flatnonzero(held[a:b])
    return a + int(on[0]), a + int(on[-1]) + 1


def runs_of(held: np.ndarray) -> np.ndarray:
    """(begin, end) of each run of held shingles."""
    return np.flatnonzero(np.diff(np.concatenate(([0], held.astype(np.int8), [0])))).reshape(-1, 2)


def stretches(held: np.ndarray, most: int | None = None) -> list[tuple[int, int]]:
    """Disjoint stretches with RATE held shingles for each other one, around the runs of held shingles, the longest first."""
    if held.all():
        return [(0, len(held))]
    total = np.concatenate(([0], np.cumsum(np.where(held, 1, -RATE))))
    runs = runs_of(held)
    out: list[tuple[int, int]] = []
    for i in np.argsort(runs[:, 0] - runs[:, 1], kind="stable").tolist():
        a, b = runs[i].tolist()
        if b - a < LEAST // 8 or len(out) == most:
            break
        if not any(s < b and a < e for s, e in out):
            out.append(stretch(total, held, a))
    return out


def _likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard likeness of two stretches; 0 if one has fewer than LEAST distinct shingles."""
    u, v = np.unique(x), np.unique(y)
    if min(len(u), len(v)) < LEAST:
        return 0.0
    common = len(np.intersect1d(u, v, assume_unique=True))
    return common / (len(u) + len(v) - common)


def _shared(p: np.ndarray, q: np.ndarray, enough: int) -> list[tuple]:
    """(a, b, oa, ob, likeness) of the passages that two runs of shingles share: wide stretches, and what bare runs add."""
    if len(p) == len(q) and (p == q).all():
        return [(0, len(p), 0, len(q), 1.0)] if _distinct(p) >= LEAST else []
    held = np.isin(p, q)
    n = int(held.sum())
    found: list[tuple] = []
    if n < enough:
        return found
    for a, b in stretches(held):
        if b - a >= LEAST:
            oa, ob = (stretches(np.isin(q, p[a:b]), 1) or [(0, 0)])[0]
            if (like := _likeness(p[a:b], q[oa:ob])) * OF >= NEED:
                found.append((a, b, oa, ob, like))
    for a, b in runs_of(held).tolist():
        if b - a >= LEAST and not any(s < b and a < e for s, e, *_ in found):
            back = runs_of(np.isin(q, p[a:b]))
            oa, ob = back[(back[:, 1] - back[:, 0]).argmax()].tolist()
            if (like := _likeness(p[a:b], q[oa:ob])) * OF >= NEED:
                found.append((a, b, oa, ob, like))
    return found


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enough = LEAST * NEED * 2 // (OF + NEED)
    for batch in batches:
        g, og = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = [[] for _ in range(7)]
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            p, q = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
            for found in _shared(p, q, enough):
                for k, value in enumerate((g[i], og[i], *found)):
                    out[k].append(value)
        yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.int64()) for v in out[:2]], *[pa.array(v, pa.int32()) for v in out[2:6]], pa.array(out[6], pa.float64())], ["g", "og", "a", "b", "oa", "ob", "like"])


def _spans(regions: DataFrame) -> DataFrame:
    """(doc, l, r) of both texts of regions."""
    both = F.array(F.struct("doc", "l", "r"), F.struct(F.col("odoc").alias("doc"), F.col("ol").alias("l"), F.col("orr").alias("r")))
    return regions.select(F.explode(both).alias("s")).select("s.*")


def _verify(docs: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc, odoc, a, b, oa, ob, like): the passages that pairs of regions hold, from one more reading of the texts."""
    spark = docs.sparkSession
    wanted = written(_spans(regions).groupBy("doc").agg(F.collect_set(F.struct("l", "r")).alias("spans")), "passage-spans")
    some = lookup(docs, wanted.select("doc"), ["doc"], "left_semi")
    met = lookup(some, wanted, ["doc"], "inner", hot=False).select("doc", "text", "spans")
    cut = met.mapInArrow(tidied(_excerpts), "doc long, l int, r int, n int, d int, h binary")
    read = written(cut.select("*", F.xxhash64("h").alias("g")), "passage-excerpts")
    here = read.select("doc", "l", "r", "n", "d", "g")
    there = read.select(F.col("doc").alias("odoc"), F.col("l").alias("ol"), F.col("r").alias("orr"), F.col("g").alias("og"))
    named = written(regions.join(here, ["doc", "l", "r"]).join(there, ["odoc", "ol", "orr"]), "passage-named")
    turned = [F.least("g", "og").alias("g"), F.greatest("g", "og").alias("og")]
    pairs = written(named.where("g != og").select(*turned).distinct(), "passage-pairs")
    asked = pairs.select(F.explode(F.array("g", "og")).alias("g")).distinct()
    data = written(read.groupBy("g").agg(F.first("h").alias("h")).join(asked, "g", "left_semi"), "passage-data")
    drop_path(spark, read.written_path)
    both = pairs.join(data.withColumnRenamed("h", "x"), "g").join(data.select(F.col("g").alias("og"), F.col("h").alias("y")), "og")
    good = both.select("g", "og", "x", "y").mapInArrow(tidied(_verified), "g long, og long, a int, b int, oa int, ob int, like double")
    good = written(good, "passage-verified")
    drop_path(spark, data.written_path)
    back = good.select(F.col("og").alias("g"), F.col("g").alias("og"), F.col("oa").alias("a"), F.col("ob").alias("b"), F.col("a").alias("oa"), F.col("b").alias("ob"), "like")
    n = F.col("n")
    equal = named.where((F.col("g") == F.col("og")) & (F.col("d") >= LEAST))
    equal = equal.select("doc", "odoc", "l", "ol", F.lit(0).alias("a"), n.alias("b"), F.lit(0).alias("oa"), n.alias("ob"), F.lit(1.0).alias("like"))
    found = named.join(good.union(back), ["g", "og"]).select("doc", "odoc", "l", "ol", "a", "b", "oa", "ob", "like").union(equal)
    places = [(F.col(x) + F.col(at)).alias(x) for x, at in (("a", "l"), ("b", "l"), ("oa", "ol"), ("ob", "ol"))]
    return found.select("doc", "odoc", *places, "like")


def _regions(links: DataFrame) -> DataFrame:
    """(doc, odoc, l, r, ol, orr) to verify, from linked centres (doc, odoc, shift, lo, hi) of pairs of documents."""
    # interval join over the hash functions: linked windows of a pair at one shift are one interval of each text, and
    # intervals that overlap in the later text are one region
    links = links.repartition("doc", "odoc").groupBy("doc", "odoc", "shift").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    side = lambda by: (F.greatest(F.col("lo") - by - MARGIN, F.lit(0)), F.col("hi") - by + MARGIN)
    (l, r), (ol, orr) = side(F.lit(0)), side(F.col("shift"))
    boxes = links.select("doc", "odoc", l.alias("l"), r.alias("r"), ol.alias("ol"), orr.alias("orr"))
    before = Window.partitionBy("doc", "odoc").orderBy("l", "r", "ol")
    reach = F.max("r").over(before.rowsBetween(Window.unboundedPreceding, -1))
    boxes = boxes.withColumn("apart", F.coalesce((F.col("l") > reach).cast("int"), F.lit(0)))
    boxes = boxes.withColumn("island", F.sum("apart").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    regions = boxes.groupBy("doc", "odoc", "island").agg(F.min("l").alias("l"), F.max("r").alias("r"), F.min("ol").alias("ol"), F.max("orr").alias("orr"))
    return written(regions.drop("island"), "passage-regions")


def _paired(good: DataFrame) -> DataFrame:
    """The pairs of verified passages, one row each."""
    # passages of a pair that overlap, from regions at several shifts, count as one
    ends = F.array_sort(F.collect_set(F.struct("a", "b")))
    start = F.struct(F.lit(-1).alias("until"), F.lit(0).alias("n"))
    more = lambda acc, p: F.struct(F.greatest(acc["until"], p["b"]).alias("until"), (acc["n"] + (p["a"] >= acc["until"]).cast("int")).alias("n"))
    disjoint = F.aggregate(ends, start, more, lambda acc: acc["n"].cast("long"))
    spread = lambda lo, hi: (F.max(hi) - F.min(lo) + (WIDTH - 1)).cast("long")
    return good.groupBy(F.col("doc").alias("doc_id"), F.col("odoc").alias("other_id")).agg(
        F.min("a").cast("long").alias("start_word"), spread("a", "b").alias("n_words"),
        F.min("oa").cast("long").alias("other_start_word"), spread("oa", "ob").alias("other_n_words"),
        disjoint.alias("n_passages"), F.max("like").alias("likeness"),
    )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, root, centres, 32-bit shingle hashes from before the first to behind the last of them) of documents in
    crowds; those of fewer than LEAST distinct shingles hold no passage."""
    for batch in batches:
        raw, offsets = text_buffers(batch.column(1))
        for a, b in blocks(offsets, BLOCK):
            h, rows = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            at, h = np.searchsorted(rows, np.arange(b - a + 1)), (h >> np.uint64(32)).astype(np.uint32)
            out: list[list] = [[] for _ in range(5)]
            for i in range(a, b):
                mine = h[at[i - a] : at[i - a + 1]]
                for w in batch.column(2)[i].as_py():
                    c = sorted(x for x in w["c"] if x < len(mine))
                    near = mine[max(c[0] - MARGIN, 0) : c[-1] + MARGIN + 1] if c else mine[:0]
                    if _distinct(near) >= LEAST:
                        for k, value in enumerate((w["key"], batch.column(0)[i].as_py(), w["root"], c, near.tobytes())):
                            out[k].append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], ["key", "doc", "root", "c", "s"])


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of one list has in common with each of another."""
    tables = []
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for sets in (left, right):
        all_, of = np.concatenate(sets), np.arange(len(sets)).repeat([len(x) for x in sets])
        at = np.searchsorted(both, all_)
        on = np.flatnonzero(both[np.minimum(at, len(both) - 1)] == all_) if len(both) else at[:0]
        table = np.zeros((len(sets), len(both)), np.float32)
        table[of[on], at[on]] = 1
        tables.append(table)
    return tables[0] @ tables[1].T


def _may_hold(run: np.ndarray, other: np.ndarray) -> bool:
    """Whether a run of shingles has a stretch of LEAST places, with RATE for each other one, that a sorted set holds."""
    at = np.minimum(np.searchsorted(other, run), len(other) - 1)
    total = np.concatenate(([0], np.cumsum(np.where(other[at] == run, 1, -RATE))))
    return bool((total[LEAST:] >= np.minimum.accumulate(total)[:-LEAST]).any())


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Linked centres of pairs of a crowd, of rows (key, row block, column block, side, doc, root, major, centres, shingles)
    sorted by the first four: each row of side 0 with those of side 1 of other components, if they have enough shingles in
    common for a passage, in stretches of both. Centres meet the first and the last of the other side, which has the region of all of them."""
    place, left, right = None, [], []

    def met() -> Iterator[pa.RecordBatch]:
        if not left or not right:
            return
        (doc, root), (odoc, oroot, major) = (np.array([r[:n] for r in rows], np.int64).T for rows, n in ((left, 2), (right, 3)))
        ok = (doc[:, None] != odoc) & (root[:, None] != oroot) & ((oroot == major) | (doc[:, None] > odoc))
        links = [[] for _ in range(5)]
        if ok.any():
            sets, osets = ([np.unique(r[4]) for r in rows] for rows in (left, right))
            ok &= _common(sets, osets) >= ENOUGH
        for i, j in np.argwhere(ok).tolist():
            if not (_may_hold(left[i][4], osets[j]) and _may_hold(right[j][4], sets[i])):
                continue
            one, two = (left[i], right[j]) if doc[i] > odoc[j] else (right[j], left[i])
            for to in (two[3][0], two[3][-1]):
                for k, value in enumerate(([one[0]] * len(one[3]), [two[0]] * len(one[3]), one[3] - to, one[3], one[3])):
                    links[k].append(value)
        if links[0]:
            yield _link_batch(*map(np.concatenate, links))

    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        for i, key in enumerate(keys):
            if key != place:
                yield from met()
                place, left, right = key, [], []
            row = [batch.column(k)[i].as_py() for k in (4, 5, 6)] + [np.array(batch.column(7)[i].as_py(), np.int64), np.frombuffer(batch.column(8)[i].as_py(), np.uint32)]
            (right if batch.column(3)[i].as_py() else left).append(row)
    yield from met()


def _apart(docs: DataFrame, crowds: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (doc, odoc, shift, lo, hi) between documents of a crowd that pairs don't connect: each outside the crowd's
    largest component with all of other components, in blocks of APART documents a side."""
    roots = components(pairs, "doc_id", "other_id").withColumnRenamed("node", "doc")
    every = docs.mapInArrow(tidied(_every_window), "key long, doc long, c int")
    found = lookup(every, crowds, ["key"], "left_semi").groupBy("key", "doc").agg(F.collect_set("c").alias("c"))
    mine = written(lookup(found, roots, ["doc"], hot=False).withColumn("root", F.coalesce("root", "doc")), "passage-crowded")

    def split(rows: DataFrame) -> DataFrame:
        """(key, major, n, out): of keys with several components, the largest one, all documents and those outside of it."""
        each = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        main = each.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n"))
        return main.where(F.col("m.n") < F.col("n")).select("key", F.col("m.root").alias("major"), "n", (F.col("n") - F.col("m.n")).alias("out"))

    some = lookup(mine, written(split(mine).select("key"), "passage-split"), ["key"], "left_semi")
    wanted = written(some.groupBy("doc").agg(F.collect_list(F.struct("key", "root", "c")).alias("w")), "passage-outside")
    some = lookup(docs, wanted.select("doc"), ["doc"], "left_semi")
    texts = lookup(some, wanted, ["doc"], "inner", hot=False).select("doc", "text", "w")
    held = written(texts.mapInArrow(tidied(_contexts), "key long, doc long, root long, c array<int>, s binary"), "passage-contexts")
    held = lookup(held, written(split(held), "passage-open"), ["key"], "inner")
    parts, spread = lambda n: F.ceil(F.col(n) / APART), F.xxhash64("doc", "key")
    block, blocks_ = lambda n: F.pmod(spread, parts(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), parts(n).cast("int") - 1))
    left = held.where("root != major").select("key", block("out").alias("rb"), blocks_("n").alias("cb"), F.lit(0).alias("side"), "doc", "root", "major", "c", "s")
    right = held.select("key", blocks_("out").alias("rb"), block("n").alias("cb"), F.lit(1).alias("side"), "doc", "root", "major", "c", "s")
    met = left.union(right).repartition("key", "rb", "cb").sortWithinPartitions("key", "rb", "cb", "side")
    return met.mapInArrow(tidied(_meetings), "doc long, odoc long, shift int, lo int, hi int").distinct()


def passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pairs of documents with near-duplicate passages: doc_id, other_id (smaller), and, from the first to the last such
    passage, start_word and n_words in each, the passages' number and their highest likeness."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null")
    open_ = docs.mapInArrow(tidied(_windows), _ROW).repartition("key").sortWithinPartitions("key", "doc", "c")
    links = written(open_.mapInArrow(tidied(_runs_and_crowds), "doc long, odoc long, shift int, lo int, hi int"), "passage-met")
    regions = _regions(links.where("odoc is not null"))
    crowds = written(links.where("odoc is null").select(F.col("doc").alias("key")).distinct(), "passage-crowds")
    drop_path(spark, links.written_path)
    pairs = written(_paired(_verify(docs, regions)), "passage-links")
    if crowds.isEmpty():
        return pairs
    return pairs.unionByName(_paired(_verify(docs, _regions(_apart(docs, crowds, pairs)))))


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document that has a passage in common with another: doc_id, group_id (the smallest doc_id reachable over
    such passages), n_links (documents it was linked with: all in small groups, in crowds the neighbours that stand
    for the rest), start_word and n_words from its first to its last such passage, and the highest likeness."""
    pairs = written(passages(docs, text, doc_id), "passage-links")
    groups = components(pairs, "doc_id", "other_id")
    two = pairs.select("doc_id", F.col("other_id").alias("other"), "start_word", "n_words", "likeness").union(
        pairs.select("other_id", "doc_id", "other_start_word", "other_n_words", "likeness")
    )
    until = F.max(F.col("start_word") + F.col("n_words")) - F.min("start_word")
    each = two.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_links"), F.min("start_word").alias("start_word"), until.alias("n_words"), F.max("likeness").alias("likeness"))
    return each.join(groups.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id")), "doc_id").select(
        "doc_id", "group_id", "n_links", "start_word", "n_words", "likeness"
    )
