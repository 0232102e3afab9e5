"""Near-duplicate documents by an LSH forest of MinHash signatures, confirmed on full shingle sets.

One pass over the texts gives each document the size, digest and signature of its set of 5-word shingles. Equal sets are
one class from then on, so exact copies are linked without a comparison. Each of TREES trees orders the classes by its
own DEPTH min-hashes; classes that share the first LEAST of them are a region. In a region, in the order of its deeper
hashes, each class meets the WINDOW classes before it, those of the longest common prefixes; a region of over WINDOW
classes is ordered in parts of some PART_ROWS. A sketch of one min-hash in each of BINS ranges of hashes estimates the
likeness of mates, all but exactly for sets of fewer shingles than bins; mates estimated SLACK standard deviations under
the threshold are out.

Links are confirmed on full sets, in two rounds. First every class's likeliest mate: this joins most of a group at a cost
of one confirmation a class. Then all mates that are still in different components; a link inside a component would
change nothing. Regions of up to WINDOW classes are whole in this round. In a larger one every class outside of its largest
component meets all classes of other components there, by sketch and then by set, in blocks; so no bound on neighbours
loses a link.

Defined results: documents without words (null, empty, blank) have an empty set and are linked with nothing; fewer than
five words are one shingle; repeated rows are copies; a null doc_id never names a component; an empty table gives an
empty table. Signatures and set digests are 64-bit hashes of the folded words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentlake.llm._util import blocks, drop_path, fresh, lookup, mix64, shingle_hashes, text_buffers, tidied, word_hashes, written
from talentlake.llm.components import components

#: Words per shingle; a link needs 100 * intersection >= 75 * union.
WIDTH, NEED, OF = 5, 75, 100
TREES, DEPTH, LEAST, WINDOW = 20, 6, 4, 64
HASHES = TREES * DEPTH
#: Bins of the sketch that estimates a likeness, and how many standard deviations under the threshold an estimate may lie.
BINS, SLACK = 512, 4.0
#: Rows of a part of a crowded region's order, and of a side of a block that compares its components.
PART_ROWS, BLOCK_ROWS = 1024, 512
#: Bytes of text handled at once.
BLOCK = 1 << 18
_MULT = np.random.Generator(np.random.PCG64(75)).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, offsets by text) of a block of texts."""
    n = len(offsets) - 1
    words, rows, _, _ = word_hashes(raw, offsets)
    h, r = shingle_hashes(words, rows, n, width)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[keep], np.concatenate(([0], np.cumsum(np.bincount(r[keep], minlength=n))))


def sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A byte for each of BINS equal ranges of hashes: 0 if a set has none there, else one made from its least."""
    out = np.zeros((len(at) - 1, BINS), np.uint8)
    row, bin_ = np.repeat(np.arange(len(at) - 1), np.diff(at)), (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = (bin_[1:] != bin_[:-1]) | (row[1:] != row[:-1])
    out[row[first], bin_[first]] = ((h[first] >> np.uint64(16)) % np.uint64(255)).astype(np.uint8) + 1
    return out


def estimates(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(likeness, least likeness that may belong to a link) of paired sketches. The fewer elements of a union share a
    bin, the more of them are compared, and the smaller is the deviation."""
    used = ((x | y) > 0).sum(1).clip(1)
    union = -BINS * np.log1p(-np.minimum(used, BINS - 0.5) / BINS)
    part = np.maximum(1 - used / union, 0.04)
    return ((x == y) & (x > 0)).sum(1) / used, NEED / OF - SLACK * np.sqrt(NEED * (OF - NEED) / OF**2 / used * part)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffers(batch.column(1))
        for a, b in blocks(offsets, BLOCK):
            h, at = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            sizes = np.diff(at)
            full = np.flatnonzero(sizes)
            sig = np.empty((len(full), HASHES), np.uint32)
            sid = np.zeros(b - a, np.uint64)
            if len(full):
                for k in range(HASHES):
                    sig[:, k] = np.minimum.reduceat(h * _MULT[k], at[full]) >> np.uint64(32)
                sums = np.add.reduceat(mix64(h), at[full])
                sid[full] = mix64(sums ^ mix64(np.bitwise_xor.reduceat(h, at[full]) + sizes[full].astype(np.uint64)))
            blob, small, j, bins = [None] * (b - a), [None] * (b - a), 0, sketches(h, at)
            for i in full.tolist():
                blob[i], small[i] = sig[j].astype(">u4").tobytes(), bins[i].tobytes()
                j += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(sizes.astype(np.int64)), pa.array(sid.view(np.int64), mask=sizes == 0), pa.array(blob, pa.binary()), pa.array(small, pa.binary()), batch.column(2).slice(a, b - a)],
                ["doc_id", "n_shingles", "sid", "sig", "small", "text_hash"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffers(batch.column(1))
        for a, b in blocks(offsets, BLOCK):
            h, at = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([h[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["sid", "members"])


def _columns(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """n whole-number columns of a batch, then its sketches."""
    sketch = batch.column(n)
    joined = b"".join(sketch.to_pylist())
    return [batch.column(k).to_numpy() for k in range(n)] + [np.frombuffer(joined, np.uint8).reshape(-1, BINS)]


def _pairs(x: list, y: list, like: list) -> pa.RecordBatch:
    flat = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind)
    return pa.RecordBatch.from_arrays([pa.array(flat(x, np.int64)), pa.array(flat(y, np.int64)), pa.array(flat(like, np.float64))], ["x", "y", "like"])


def _mates(every: bool):
    """Candidate links from rows (key, part, sid, root, sketch) sorted by key, part and deeper hashes: each row against
    the WINDOW rows before it that have its key and part, and another root; all that may be links, or the likeliest."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = _columns(batch, 4)
            old = len(tail[0]) if tail else 0
            now = [np.concatenate(x) for x in zip(tail, now, strict=True)] if tail else now
            key, part, sid, root, small = now
            best, mate, pairs = np.full(len(sid), -1.0), np.zeros(len(sid), np.int64), []
            for lag in range(1, min(WINDOW, len(sid) - 1) + 1):
                i = np.arange(max(lag, old), len(sid))
                i = i[(key[i] == key[i - lag]) & (part[i] == part[i - lag])]
                if not len(i):
                    break
                i = i[root[i] != root[i - lag]]
                like, least = estimates(small[i], small[i - lag])
                i, like = i[like >= least], like[like >= least]
                if every:
                    pairs.append((sid[i], sid[i - lag], like))
                else:
                    more = like > best[i]
                    best[i[more]], mate[i[more]] = like[more], sid[i[more] - lag]
            if not every:
                i = np.flatnonzero(best >= 0)
                pairs = [(sid[i], mate[i], best[i])]
            yield _pairs(*([z[k] for z in pairs] for k in range(3)))
            tail = [z[-WINDOW:].copy() for z in now]

    return found


def _near(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sorted sets are a link."""
    both = np.concatenate((p, q))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return OF * common >= NEED * (len(p) + len(q) - common)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows (key, row block, column block, side, sid, root, outside, tree, sketch, signature, members), sorted
    by the first four: each row of side 0, a class outside its region's largest component, against the rows of side 1.
    Pairs that their sketches leave are confirmed on the full sets, in the first tree that has both in one region."""
    place, left = None, []

    for batch in batches:
        if not batch.num_rows:
            continue
        *keys, side, sid, root, outside, tree, small = _columns(batch, 8)
        prefix = np.frombuffer(b"".join(batch.column(9).to_pylist()), np.uint32).reshape(-1, TREES, DEPTH)[:, :, :LEAST]
        members = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(10)]
        keys = np.stack(keys, 1)
        new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
        xs, ys = [], []
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(keys)], strict=True):
            if place != keys[lo].tolist():
                place, left = keys[lo].tolist(), []
            cut = lo + int(np.searchsorted(side[lo:hi], 1))
            left += [(int(sid[i]), int(root[i]), small[i].copy(), prefix[i].copy(), members[i].copy()) for i in range(lo, cut)]
            for s, r, sketch, mine, own in left if cut < hi else ():
                like, least = estimates(small[cut:hi], sketch[None, :])
                at = cut + np.flatnonzero((like >= least) & (root[cut:hi] != r) & ((outside[cut:hi] == 0) | (sid[cut:hi] > s)))
                first = (prefix[at] == mine).all(2).argmax(1)
                for i in at[first == tree[at]].tolist():
                    if _near(own, members[i]):
                        xs.append(s)
                        ys.append(int(sid[i]))
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for p, q in zip(batch.column(2), batch.column(3), strict=True):
            ok.append(_near(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, ok) of candidate links: ok if their full sets are near."""
    one = pairs.join(sets.select(F.col("sid").alias("a"), F.col("members").alias("p")), "a")
    two = one.join(sets.select(F.col("sid").alias("b"), F.col("members").alias("q")), "b")
    return written(two.select("a", "b", "p", "q").mapInArrow(tidied(_confirmed), "a long, b long, ok boolean"), "dup-links")


def _crowded_links(rooted: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links of regions of over WINDOW classes: every class outside the region's largest component against all
    classes of other components there, in blocks of BLOCK_ROWS. Rows are copied to as many blocks as the other side has;
    so a region that is one component but for few classes costs those few passes."""
    crowd = rooted.where(F.col("n") > WINDOW)
    each = crowd.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    main = each.groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("total"))
    main = main.where(F.col("m.c") < F.col("total")).select(
        "key", F.col("m.root").alias("major"), F.ceil(F.col("total") / BLOCK_ROWS).cast("int").alias("cols"),
        F.ceil((F.col("total") - F.col("m.c")) / BLOCK_ROWS).cast("int").alias("rows"),
    )
    mine = lookup(crowd.select("key", "sid", "root", "tree", "small", "sig"), written(main, "dup-open"), ["key"], "inner")
    mine = mine.withColumn("outside", (F.col("root") != F.col("major")).cast("int"))
    spread = F.xxhash64("sid", "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = written(mine.join(sets, "sid"), "dup-crowded")
    keep = ["sid", "root", "outside", "tree", "small", "sig", "members"]
    left = mine.where("outside = 1").select("key", F.pmod(spread, "rows").cast("int").alias("rb"), every("cols").alias("cb"), F.lit(0).alias("side"), *keep)
    right = mine.select("key", every("rows").alias("rb"), F.pmod(spread, "cols").cast("int").alias("cb"), F.lit(1).alias("side"), *keep)
    met = left.union(right).repartition("key", "rb", "cb").sortWithinPartitions("key", "rb", "cb", "side")
    return met.mapInArrow(tidied(_blocks), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and text_hash."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    signed = hashed.mapInArrow(tidied(_signed), "doc_id long, n_shingles long, sid long, sig binary, small binary, text_hash long")
    rows = written(signed, "dup-rows")
    same = rows.where("sid is not null").groupBy("sid").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("text_hash", "doc_id")).alias("at"), F.count(F.lit(1)).alias("copies"),
        F.first("sig").alias("sig"), F.first("small").alias("small"),
    )
    classes = written(same, "dup-classes")

    key = lambda t: F.xxhash64(t, F.substring("sig", t * (4 * DEPTH) + 1, F.lit(4 * LEAST)))
    tree = lambda t: F.struct(t.alias("tree"), key(t).alias("key"))
    trees = classes.select("sid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), tree)).alias("k")).select("sid", "k.tree", "k.key")
    regions = written(trees.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "dup-regions")
    hits = written(lookup(trees, regions, ["key"], "inner", hot=False), "dup-hits")
    deep = F.substring("sig", F.col("tree") * (4 * DEPTH) + (4 * LEAST + 1), F.lit(4 * (DEPTH - LEAST)))
    part = F.when(F.col("n") > WINDOW, F.pmod(F.xxhash64("sid", "key"), F.ceil(F.col("n") / PART_ROWS))).otherwise(F.lit(0)).cast("int")
    members = hits.join(classes.select("sid", "sig", "small"), "sid").select("sid", "key", "tree", "n", part.alias("part"), deep.alias("deep"), "small", F.when(F.col("n") > WINDOW, F.col("sig")).alias("sig"))
    members = written(members, "dup-members")

    nodes = written(classes.select("sid", "at").join(hits.select("sid").distinct(), "sid").select("sid", "at.*"), "dup-nodes")
    texts = lookup(hashed, nodes, ["text_hash", "doc_id"], "inner", hot=False).select("sid", "text")
    sets = texts.mapInArrow(tidied(_sets), "sid long, members binary")
    sets = written(sets.groupBy("sid").agg(F.first("members").alias("members")), "dup-sets")

    def mates(rooted: DataFrame, every: bool) -> DataFrame:
        met = rooted.select("key", "part", "sid", "root", "small", "deep").repartition("key", "part").sortWithinPartitions("key", "part", "deep", "sid")
        return met.select("key", "part", "sid", "root", "small").mapInArrow(tidied(_mates(every)), "x long, y long, like double")

    turned = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    likeliest = mates(members.withColumn("root", F.col("sid")), False).groupBy("x").agg(F.max(F.struct("like", "y")).alias("m"))
    pairs = written(likeliest.select("x", "m.y").select(*turned).distinct(), "dup-pairs")
    known = _confirm(pairs, sets)
    roots = components(known.where("ok"))

    named = lookup(members, roots.withColumnRenamed("node", "sid"), ["sid"], hot=False).withColumn("root", F.coalesce("root", "sid"))
    rooted = written(named, "dup-rooted")
    found = mates(rooted.where(F.col("n") <= WINDOW), True)
    rest = found.select(*turned).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
    links = known.union(_confirm(written(rest, "dup-pairs"), sets)).where("ok").select("a", "b")
    if not regions.where(F.col("n") > WINDOW).isEmpty():
        links = links.union(_crowded_links(rooted, sets))
    roots = components(links)
    for gone in (members, rooted, sets):
        drop_path(spark, gone.written_path)

    linked = classes.select("sid", "first_id", "copies").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    several = linked.where("root is not null or copies > 1").withColumn("root", F.coalesce("root", "sid"))
    least = several.groupBy("root").agg(F.min("first_id").alias("least"))
    names = written(several.join(least, "root").select("sid", "least"), "dup-names")
    out = lookup(rows.select("doc_id", "n_shingles", "sid", "text_hash"), names, ["sid"])
    component = F.coalesce("least", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")


def dedupe(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one document of each group, that of the least id; of rows that share this id, that of the least text
    hash, and of equal rows one. Documents without words or without an id stay."""
    found = written(near_duplicates(docs, text, doc_id), "dup-documents")
    mine = found.where("kept and n_shingles > 0 and doc_id is not null")
    many = mine.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.min("text_hash").alias("first")).where("n > 1")
    gone = found.where("not kept").select("doc_id", "text_hash")
    repeated = not many.isEmpty()
    if repeated:
        gone = gone.union(mine.join(many, "component_id").where("text_hash != first").select("doc_id", "text_hash"))
    h, key = fresh(docs, "text_hash", "dup_key")
    rows = docs.withColumn(h, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn(key, F.col(doc_id).cast("long"))
    out = lookup(rows, written(gone.distinct(), "dup-gone").select(F.col("doc_id").alias(key), F.col("text_hash").alias(h)), [key, h], "left_anti")
    if repeated:
        (own,) = fresh(out, "dup_once")
        once = F.when(F.col(key).isNotNull() & (F.trim(F.coalesce(F.col(text), F.lit(""))) != ""), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1)
        out = out.withColumn(own, once).dropDuplicates([key, h, own])
    return out.select(*docs.columns)
