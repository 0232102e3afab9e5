"""How two tokenizers cut the same texts: groups of tokens that end together, and how often two ids do.

Texts reach Python in Arrow batches and are cut into chunks where both tokenizers end a token (chunks.py). In each Arrow
partition a DuckDB connection holds the chunks met so far. The tokens of new ones stand in two interval tables on one
byte axis: ASOF joins find the first and last piece token under each byte-level token, a range join gives all overlaps,
those of equal ends are links, and window sums of link flags number the groups. A document is the sequence of its chunks,
so its counts and its groups follow by look-up; its linked id pairs and those of its batch go to Spark with their counts.

Spark merges the batches' pair counts, marks the most frequent partners of each piece id and joins the counts back to the
documents' pairs. The most frequent pairs are broadcast (up to a bound that is counted), rarer ones are joined by shuffle:
no pair of those has many rows.

Both passes read a written table, so that an executor that is lost costs its own tasks only.

Defined results: null and empty texts have no tokens, nor have texts that the tokens' bytes don't give back (a piece
tokenizer that normalises, the space sign inside a text): zeros and an empty hash. Rows of equal or null id stay apart;
repeated rows count as often as they stand; very long texts are one batch; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentlake.llm._util import blocks, text_buffers, tidied, written
from talentlake.llm.chunks import ByteTokens, PieceTokens, cut, joinable, spread, strings

#: Chunks after which a worker forgets those it knows.
MEMO = 500_000
#: Bytes of text cut at once, and bytes of new chunks whose tokens are aligned at once.
BLOCK, JOINT = 4 << 20, 1 << 20
#: Id pairs that are broadcast at most, the most frequent ones: two whole numbers each.
PAIRS_BROADCAST = 1_000_000
#: Memory of a connection.
LIMIT = "256MB"
SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"

#: Links of the tokens a and b (i: place, id, s, e: byte range), their groups, and the chunks c (k, s, e) that they lie in.
LINKS = """
CREATE OR REPLACE TEMP TABLE spans AS
SELECT a.i, a.id, a.e, f.i AS first_b, l.i AS last_b FROM a ASOF JOIN b f ON a.s >= f.s ASOF JOIN b l ON a.e > l.s;
CREATE OR REPLACE TEMP TABLE links AS
SELECT x.i AS ai, b.i AS bi, x.id AS a_id, b.id AS b_id, x.e FROM spans x JOIN b ON b.i BETWEEN x.first_b AND x.last_b WHERE b.e = x.e;
"""
GROUPED = """
WITH flagged AS (
  SELECT 0 AS side, a.*, CASE WHEN l.ai IS NULL THEN 0 ELSE 1 END AS linked FROM a LEFT JOIN links l ON l.ai = a.i
  UNION ALL SELECT 1, b.*, CASE WHEN l.bi IS NULL THEN 0 ELSE 1 END FROM b LEFT JOIN links l ON l.bi = b.i),
numbered AS (SELECT *, coalesce(sum(linked) OVER (PARTITION BY side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM flagged)
SELECT n.side, n.id, n.linked, c.k FROM numbered n ASOF JOIN c ON n.e > c.s ORDER BY n.g, n.side, n.i
"""
PAIRS = "SELECT c.k, (CAST(l.a_id AS BIGINT) << 32) | l.b_id AS pair FROM links l ASOF JOIN c ON l.e > c.s ORDER BY l.ai"


class Aligner:
    """What one process knows of chunks: their groups, counts and linked pairs, found again through a DuckDB table."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteTokens(byte_path, special=False), PieceTokens(piece_path)
        self.signs = pa.array([f"{i}{end}" for n, last in ((len(self.a.bytes.size), "|"), (len(self.b.bytes.size), ";")) for i in range(n) for end in (",", last)], pa.large_string())
        import duckdb

        self.db = duckdb.connect()
        self.db.execute(f"SET threads=1; SET memory_limit='{LIMIT}'; SET enable_progress_bar=false")
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.groups, self.counts, self.pairs, self.upto = [], np.empty((0, 4), np.int64), np.empty(0, np.int64), np.zeros(1, np.int64)
        self.db.execute("CREATE OR REPLACE TABLE known (chunk VARCHAR, place BIGINT)")

    def places(self, chunks: pa.Array) -> np.ndarray:
        """Places of distinct chunks in what is known; new ones are learnt."""
        if self.n > MEMO:
            self.clear()
        self.db.register("met", pa.table({"chunk": chunks, "k": pa.array(np.arange(len(chunks)))}))
        got = self.db.sql("SELECT place FROM met LEFT JOIN known USING (chunk) ORDER BY k").to_arrow_table().column(0).combine_chunks()
        place = got.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = chunks.take(pa.array(new))
            place[new] = self.n + np.arange(len(new))
            self.db.register("learnt", pa.table({"chunk": fresh, "place": pa.array(place[new])}))
            self.db.execute("INSERT INTO known SELECT chunk, place FROM learnt")
            self._learn(fresh)
        return place

    def _learn(self, chunks: pa.Array) -> None:
        """Align new chunks, in blocks, and append what they have in their order."""
        raw, offsets = text_buffers(chunks)
        for lo, hi in blocks(offsets, JOINT):
            part = raw[offsets[lo] : offsets[hi]]
            self._block(part, offsets[lo : hi + 1] - offsets[lo])
        self.n += len(chunks)

    def _tokens(self, raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(valid chunks, ids of byte-level tokens, of piece tokens) of chunks, those of invalid ones left out."""
        valid, together = np.ones(len(cuts) - 1, bool), joinable(raw, cuts)
        text, size = raw.tobytes(), np.diff(cuts)
        ids = []
        for coder in (self.a, self.b):
            flat, per = np.empty(0, np.int32), np.zeros(len(size), np.int64)
            if together.any():
                at = np.flatnonzero(together)
                joint = raw[spread(cuts[:-1][at], size[at])]
                flat = coder.ids(joint.tobytes().decode())
                if not np.array_equal(coder.bytes.of(flat), joint):
                    together = np.zeros(len(size), bool)
                    return self._alone(text, cuts)
                ends = np.cumsum(coder.bytes.size[flat])
                per[at] = np.diff(np.searchsorted(ends, np.cumsum(size[at]), "left") + 1, prepend=0)
            ids.append((flat, per))
        if together.all():
            return valid, ids[0][0], ids[1][0]
        rest = {int(k): self._one(text[cuts[k] : cuts[k + 1]]) for k in np.flatnonzero(~together)}
        out = []
        for side, (flat, per) in enumerate(ids):
            upto, parts, last = np.concatenate(([0], np.cumsum(per))), [], 0
            for k, found in rest.items():
                parts += [flat[upto[last] : upto[k]], found[side] if found else flat[:0]]
                last = k
            out.append(np.concatenate([*parts, flat[upto[last] :]]))
        valid[[k for k, found in rest.items() if not found]] = False
        return valid, *out

    def _alone(self, text: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [self._one(text[x:y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        none = np.empty(0, np.int32)
        return np.array([f is not None for f in found]), *(np.concatenate([none, *(f[side] for f in found if f)]) for side in (0, 1))

    def _one(self, chunk: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of one chunk; None if they don't give its bytes back."""
        out = tuple(coder.ids(chunk.decode()) for coder in (self.a, self.b))
        same = all(coder.bytes.of(ids).tobytes() == chunk for coder, ids in zip((self.a, self.b), out, strict=True))
        return out if same else None

    def _block(self, raw: np.ndarray, cuts: np.ndarray) -> None:
        valid, a, b = self._tokens(raw, cuts)
        size = np.diff(cuts)
        good = np.flatnonzero(valid)
        ends = np.cumsum(size[good])
        counts = np.zeros((len(size), 4), np.int64)
        counts[:, 3] = ~valid
        pairs, per = np.empty(0, np.int64), np.zeros(len(size), np.int64)
        if len(good):
            for name, ids, coder in (("a", a, self.a), ("b", b, self.b)):
                e = np.cumsum(coder.bytes.size[ids])
                self.db.register(name + "_", pa.table({"i": pa.array(np.arange(len(ids))), "id": pa.array(ids), "s": pa.array(e - coder.bytes.size[ids]), "e": pa.array(e)}))
                self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM {name}_")
            self.db.register("c_", pa.table({"k": pa.array(good), "s": pa.array(ends - size[good]), "e": pa.array(ends)}))
            self.db.execute("CREATE OR REPLACE TEMP TABLE c AS SELECT * FROM c_")
            self.db.execute(LINKS)
            side, ids, linked, k = (c.to_numpy() for c in self.db.sql(GROUPED).to_arrow_table().columns)
            counts[:, 0], counts[:, 1], counts[:, 2] = (np.bincount(k[on], minlength=len(size)) for on in (side == 0, side == 1, (side == 0) & (linked == 1)))
            signs, at = text_buffers(self.signs.take(pa.array(2 * (ids + side * self.a.bytes.size.size) + linked)))
            groups = strings(signs, at[np.concatenate(([0], np.cumsum(np.bincount(k, minlength=len(size)))))])
            k, pairs = (c.to_numpy() for c in self.db.sql(PAIRS).to_arrow_table().columns)
            per = np.bincount(k, minlength=len(size))
        else:
            groups = pa.array([""] * len(size), pa.large_string())
        self.groups.append(groups)
        self.counts = np.concatenate((self.counts, counts))
        self.pairs = np.concatenate((self.pairs, pairs))
        self.upto = np.concatenate((self.upto, self.upto[-1] + np.cumsum(per)))

    def documents(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(n_a, n_b, n_groups by text, hashes of groups, (texts, pairs, times)) of a block of texts, each with its space."""
        cuts, per = cut(raw, offsets)
        coded = strings(raw, cuts).dictionary_encode()
        place = self.places(coded.dictionary)[coded.indices.to_numpy()]
        if len(self.groups) > 1:
            self.groups = [pa.concat_arrays(self.groups)]
        upto = np.concatenate(([0], np.cumsum(per)))
        sums = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(self.counts[place], axis=0)))
        counts = sums[upto[1:]] - sums[upto[:-1]]
        bad = counts[:, 3] > 0
        counts[bad] = 0
        data, at = text_buffers(self.groups[0].take(pa.array(place)))
        data, at = data.tobytes(), at[upto]
        hashes = [hashlib.sha256(data[x : y - 1]).hexdigest() if n else "" for x, y, n in zip(at[:-1].tolist(), at[1:].tolist(), counts[:, 0].tolist(), strict=True)]
        n_pairs = self.upto[place + 1] - self.upto[place]
        pairs = self.pairs[spread(self.upto[place], n_pairs)]
        rows = np.repeat(np.repeat(np.arange(len(per)), per), n_pairs)
        ok = ~bad[rows]
        return counts[:, :3], hashes, counted(rows[ok], pairs[ok])


def counted(rows: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, times) of the distinct pairs of each row, in order."""
    order = np.lexsort((pairs, rows))
    rows, pairs = rows[order], pairs[order]
    first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (pairs[1:] != pairs[:-1]))) if len(rows) else np.empty(0, bool))
    return rows[first], pairs[first], np.diff(np.append(first, len(rows)))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """This process's aligner: its tokenizers are read once."""
    key = (byte_path, piece_path)
    return _ALIGNERS.get(key) or _ALIGNERS.setdefault(key, Aligner(byte_path, piece_path))


def documents(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each document with its counts, hash and linked pairs; rows without n_a have the pair counts of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from talentlake.llm.align import aligner  # by name: what a task brings along is built anew for each task

        found = aligner(byte_path, piece_path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for lo, hi in blocks(offsets, BLOCK):
                part, at = spaced(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                counts, hashes, (rows, pairs, times) = found.documents(part, at)
                n = hi - lo
                every, where = np.unique(pairs, return_inverse=True)
                total = np.bincount(where, times, len(every)).astype(np.int64)
                upto = np.append(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))), len(rows) + len(every)).astype(np.int32)
                last = pa.nulls(1, pa.int64())
                cells = [pa.concat_arrays([pa.array(counts[:, j]), last]) for j in (0, 1, 2, 2)]
                lists = [pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(v))) for v in ((pairs, every), (times.astype(np.int64), total))]
                ids = pa.concat_arrays([batch.column(0).slice(lo, n), last])
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n + 1)), ids, *cells, pa.array([*hashes, None], pa.string()), *lists], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                row += n + 1

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(run), SCHEMA)


def spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space before each that isn't empty."""
    filled = offsets[:-1] < offsets[1:]
    return np.insert(raw, offsets[:-1][filled], 0x20), offsets + np.concatenate(([0], np.cumsum(filled)))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, value): how often each id pair is linked in all documents, doubled, plus one for the most frequent of its piece id."""
    batches = rows.where("n_a is null").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = batches.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    counts = written(counts, "pair-counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    best = counts.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most"))
    marked = counts.withColumn("b_id", b_id).join(F.broadcast(best), "b_id")  # as many rows as the piece vocabulary has ids
    return written(marked.select("pair", (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("long")).alias("value")), "pair-values")


def aligned(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = written(documents(docs, byte_path, piece_path, text, doc_id), "aligned")
    values = pair_counts(rows)
    own = rows.where("n_a is not null")
    links = own.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))

    def summed(x: DataFrame) -> DataFrame:
        return x.groupBy("row").agg(F.sum(F.col("times") * (F.col("value") % 2)).alias("n_best"), F.sum(F.col("times") * F.shiftright("value", 1)).alias("count_sum"))

    least = frequent(values)
    sums = summed(links.join(F.broadcast(values.where(F.col("value") >= least)), "pair"))
    if least > 0:
        hot = F.broadcast(values.where(F.col("value") >= least).select("pair"))
        rare = links.join(hot, "pair", "left_anti").join(values.where(F.col("value") < least).hint("shuffle_hash"), "pair")
        sums = sums.unionByName(summed(rare)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = own.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


def frequent(values: DataFrame, most: int | None = None) -> int:
    """The least value for which at most `most` pairs have as much, among powers of two; 0 if all pairs are no more."""
    most = PAIRS_BROADCAST if most is None else most
    classes = values.groupBy(F.floor(F.log2("value")).cast("int").alias("c")).count().orderBy(F.desc("c")).collect()  # 63 rows at most
    total, least = 0, 1 << 62
    for c, n in classes:
        total += n
        if total > most:
            return least
        least = 1 << c
    return 0
