"""Token ids in Simple-8b files.

A word has a selector in its top four bits and, below, as many ids of equal width as the selector says. Ids too wide for
any packing are escapes: the word holds a place in the segment's table of escapes. A segment's ids are coded in blocks
of BLOCK_IDS; a table has each block's first word, so a block is decoded alone, all words of a selector at once.

Segments are rows of a Parquet table written by Spark's committer (part, seq, first id, counts, bytes), in the order
(part, seq): Spark writes them to any store, retries lost tasks and never shows half a file. Texts are ordered by one
range shuffle on the document id.

Defined results: a null text counts as empty and has the end id alone; null ids come first; rows of equal id follow by
text; an empty table gives an empty table that can be read; very long texts may make a segment of their own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentlake.llm._util import _FOLD, _SPACE, blocks, lookup, text_buffers, tidied, word_hashes

#: Fixed values of the format: ids per word and bits per id by selector; selector 15 is an escape.
PACKS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
MAGIC, HEADER = b"TLS8", struct.Struct("<4sIQQQQQ")
BLOCK_IDS = 1 << 16
#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 20
#: Distinct words after which a worker forgets those it met once; one block may add its own to them.
MEMO = 600_000
#: Bytes of text encoded at once.
BLOCK = 1 << 18
#: Stands between words that are encoded together; words that hold it are encoded alone.
SEPARATOR = "\u2661"
END_ID = 2
SCHEMA = "part int, seq int, n_docs long, n_ids long, payload binary"


#: Bits that the narrowest selector for an id below 2**16 has.
_NEED = np.array(sorted(b for _, b in PACKS), np.uint8)[np.searchsorted([(1 << b) - 1 for b in sorted(b for _, b in PACKS)], np.arange(1 << 16))]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of unsigned ids: each word takes the longest run that some selector holds."""
    v, n = np.asarray(ids, np.uint64), len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    wide = v >= np.uint64(1 << 60)
    top = _NEED[np.minimum(v, np.uint64(len(_NEED) - 1)).astype(np.int64)]
    big = np.flatnonzero(v >= np.uint64(len(_NEED)))
    if len(big):
        top[big] = np.where(v[big] >> np.uint64(60) > 0, 61, np.where(v[big] >> np.uint64(30) > 0, 60, np.where(v[big] >> np.uint64(20) > 0, 30, 20)))
    best = np.full(n, ESCAPE, np.uint8)
    best[~wide] = len(PACKS) - 1
    runs, known = top, 1  # runs[i]: widest of `known` ids from i
    for s in range(len(PACKS) - 2, -1, -1):
        count, bits = PACKS[s]
        while known < count:
            step = min(known, count - known)
            runs = np.maximum(runs[:-step], runs[step:]) if len(runs) > step else runs[:0]
            known += step
        fit = runs <= bits
        if not fit.any():
            break
        best[: len(runs)][fit] = s
    counts = np.array([c for c, _ in PACKS] + [0, 1], np.int64)
    after = (np.arange(n) + counts[best]).tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i = after[i]
    at = np.array(at, np.int64)
    sel = best[at]
    out = sel.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(PACKS):
        rows = np.flatnonzero(sel == s)
        for k in range(count if len(rows) else 0):
            out[rows] |= v[at[rows] + k] << np.uint64(k * bits)
    rows = np.flatnonzero(sel == ESCAPE)
    out[rows] |= np.arange(len(rows), dtype=np.uint64)
    return out, v[at[rows]]


def unpack(packed: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of words."""
    sel = (packed >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in PACKS] + [0, 1], np.int64)[sel]
    at = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    for s, (count, bits) in enumerate(PACKS):
        rows = np.flatnonzero(sel == s)
        for k in range(count if len(rows) else 0):
            out[at[rows] + k] = (packed[rows] >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)
    rows = np.flatnonzero(sel == ESCAPE)
    out[at[rows]] = escapes[(packed[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def to_bytes(doc_ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment: header, document ids and which are null, packed lengths, block table, packed ids, escapes."""
    blocks = [pack(ids[i : i + BLOCK_IDS]) for i in range(0, len(ids), BLOCK_IDS)]
    table = np.array([[len(w), len(e)] for w, e in blocks], np.uint64).reshape(-1, 2).cumsum(0).astype("<u8")
    sizes, _ = pack(lengths)
    head = HEADER.pack(MAGIC, 1, len(doc_ids), len(ids), len(blocks), len(sizes), BLOCK_IDS)
    parts = [doc_ids.astype("<i8"), valid.astype(np.uint8), sizes.astype("<u8"), table, *[w.astype("<u8") for w, _ in blocks], *[e.astype("<u8") for _, e in blocks]]
    return head + b"".join(p.tobytes() for p in parts)


class Segment:
    """A segment's bytes, opened: ids of any range decode only the blocks that it touches."""

    def __init__(self, data: bytes):
        magic, version, docs, self.n_ids, n_blocks, n_sizes, self.block = HEADER.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token segment")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        self.doc_ids, self.valid = take("<i8", docs), take("u1", docs).astype(bool)
        self.lengths = unpack(take("<u8", n_sizes), np.empty(0, np.uint64)).astype(np.int64)
        self.table = np.concatenate((np.zeros((1, 2), np.int64), take("<u8", 2 * n_blocks).reshape(-1, 2).astype(np.int64)))
        self.words, self.escapes = take("<u8", int(self.table[-1, 0])), take("<u8", int(self.table[-1, 1]))

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else stop
        a, b = start // self.block, -(-stop // self.block)
        got = [unpack(self.words[self.table[k, 0] : self.table[k + 1, 0]], self.escapes[self.table[k, 1] : self.table[k + 1, 1]]) for k in range(a, b)]
        return np.concatenate([np.empty(0, np.uint64), *got])[start - a * self.block : stop - a * self.block]


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind, *width: int):
        self.data, self.n = np.empty((1 << 14, *width), kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            more = np.empty((max(2 * len(self.data), self.n + len(values)), *self.data.shape[1:]), self.data.dtype)
            more[: self.n] = self.data[: self.n]
            self.data = more
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class _Places:
    """A hash table from 64-bit word hashes to places, probed for many words at once. It doubles before it is half full."""

    def __init__(self, slots: int = 1 << 16):
        self.n = 0
        self._empty(slots)

    def _empty(self, slots: int) -> None:
        self.mask = np.uint64(slots - 1)
        self.keys, self.places = np.zeros(slots, np.uint64), np.empty(slots, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of words; -1 for unknown ones."""
        out, slot, open_ = np.full(len(h), -1, np.int32), (h & self.mask).astype(np.int64), np.arange(len(h))
        while len(open_):
            at = slot[open_]
            key = self.keys[at]
            hit = key == h[open_]
            out[open_[hit]] = self.places[at[hit]]
            go = ~hit & (key != 0)
            open_ = open_[go]
            slot[open_] = (at[go] + 1) & int(self.mask)
        return out

    def add(self, h: np.ndarray) -> None:
        """Give distinct unknown words the next places."""
        need = 2 * (self.n + len(h))
        if need > len(self.keys):
            used = np.flatnonzero(self.keys)
            keys, places = self.keys[used], self.places[used]
            self._empty(1 << int(need).bit_length())
            self._put(keys, places)
        self._put(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _put(self, h: np.ndarray, place: np.ndarray) -> None:
        slot, open_ = (h & self.mask).astype(np.int64), np.arange(len(h))
        while len(open_):
            at = slot[open_]
            free = self.keys[at] == 0
            self.keys[at[free]] = h[open_[free]]
            won = self.keys[at] == h[open_]  # of several for one free slot, the last
            self.places[at[won]] = place[open_[won]]
            open_ = open_[~won]
            slot[open_] = (at[~won] + 1) & int(self.mask)


def ends_of_words(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What tells words of equal hash apart: length, first and last eight folded bytes (all bytes, up to sixteen)."""
    folded = np.concatenate((_FOLD[raw], np.zeros(8, np.uint8)))
    eight = np.ndarray(len(folded) - 7, "<u8", folded, 0, (1,))
    size = end - begin
    short = np.minimum(size, 8).astype(np.uint64)
    first = eight[begin] & (~np.uint64(0) >> (np.uint64(64) - short * np.uint64(8)))
    last = np.where(size > 8, eight[np.maximum(end - 8, 0)], np.uint64(0))
    return np.stack((size.astype(np.uint64), first, last), 1)


def pieces(raw: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of pieces, text of each piece): texts of over `most` bytes are cut behind white space, at the last one
    within `most` bytes or, where a word is longer, at the next one."""
    cuts, owner = [0], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while b - a > most:
            gaps = np.flatnonzero(_SPACE[raw[a : a + most]])
            upto, step = a + most, most
            while not len(gaps) and upto < b:
                gaps = np.flatnonzero(_SPACE[raw[upto : upto + step]]) + (upto - a)
                upto, step = upto + step, 2 * step
                gaps = gaps[:1]
            if not len(gaps):
                break
            a += int(gaps[-1]) + 1
            cuts.append(a)
            owner.append(i)
        cuts.append(b)
        owner.append(i)
    return np.array(cuts, np.int64), np.array(owner, np.int64)


class Encoder:
    """Ids of whole texts. The tokenizer drops white space and never joins across it, so a text's ids are those of its
    words, one after another, and a stop or comma behind a letter is always apart. A word's ids are computed once and
    found again by a 64-bit hash of its folded bytes, its length and its first and last eight bytes. The tokenizer
    lower-cases, but for its special tokens: texts that may hold one are encoded as they are."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.mark = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.known, self.flat, self.starts, self.counts = _Places(), _Grown(np.int32), _Grown(np.int64), _Grown(np.int32)
        self.ends, self.hashes, self.again = _Grown(np.uint64, 3), _Grown(np.uint64), _Grown(bool)

    def _forget(self) -> None:
        """Let go of the words that were not met again since they were learnt; of all, if most were."""
        kept = np.flatnonzero(self.again.data[: self.again.n])
        if 2 * len(kept) > MEMO:
            return self.clear()
        starts, counts = self.starts.data[kept], self.counts.data[kept]
        upto = np.cumsum(counts, dtype=np.int64) - counts
        flat = self.flat.data[np.repeat(starts - upto, counts) + np.arange(int(counts.sum()))]
        hashes, ends = self.hashes.data[kept], self.ends.data[kept]
        self.clear()
        for grown, values in ((self.flat, flat), (self.starts, upto), (self.counts, counts), (self.ends, ends), (self.hashes, hashes), (self.again, np.zeros(len(kept), bool))):
            grown.add(values)
        self.known.add(hashes)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encode new words: many in one text, parted by SEPARATOR, which is one id that no other word has."""
        for lo in range(0, len(new), 1024):
            part = new[lo : lo + 1024]
            alone = [i for i, w in enumerate(part) if len(self.mark) != 1 or SEPARATOR in w]
            own = dict(zip(alone, self._ids([part[i] for i in alone]), strict=True))
            joint = f" {SEPARATOR} ".join([*("" if i in own else w for i, w in enumerate(part)), ""])
            ids = np.array(self.tokenizer.encode(joint, add_special_tokens=False).ids, np.int32) if len(self.mark) == 1 else np.empty(0, np.int32)
            ends = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else np.empty(0, np.int64)
            counts = np.diff(ends, prepend=-1) - 1 if len(self.mark) == 1 else np.zeros(len(part), np.int64)
            starts = self.flat.n + np.cumsum(counts) - counts
            self.flat.add(np.delete(ids, ends))
            for i, x in own.items():
                starts[i], counts[i] = self.flat.n, len(x)
                self.flat.add(np.array(x, np.int32))
            self.starts.add(starts)
            self.counts.add(counts)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text), each text ended by END_ID. Long texts are encoded piece by piece."""
        cuts, owner = pieces(raw, offsets, BLOCK)
        ids, counts = [], []
        for a, b in blocks(cuts, BLOCK):
            one, n = self._block(raw[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])
            ids.append(one)
            counts.append(n)
        flat = np.concatenate([np.empty(0, np.int32), *ids])
        n = np.bincount(owner, np.concatenate([np.empty(0, np.int64), *counts]), len(offsets) - 1).astype(np.int64)
        return np.insert(flat, np.cumsum(n), END_ID), n + 1

    def _block(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of a block of texts, without end ids."""
        if self.known.n > MEMO:
            self._forget()
        whole, size = set(), len(offsets) - 1
        data = raw.tobytes()
        if b"<|" in data:
            whole = {i for i in range(size) if b"<|" in data[offsets[i] : offsets[i + 1]]}
        h, rows, begin, end = word_hashes(raw, offsets, marks=True)
        if not len(h):
            return np.empty(0, np.int32), np.zeros(size, np.int64)
        tell = ends_of_words(raw, begin, end)
        h[h == 0] = 1
        at = self.known.find(h)
        lacking = np.flatnonzero(at < 0)
        self.again.data[at[at >= 0]] = True
        if len(lacking):
            fresh_, first = np.unique(h[lacking], return_index=True)
            where = lacking[first]
            self._learn([data[a:b].lower().decode("utf-8", "replace") for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)])
            self.ends.add(tell[where])
            self.hashes.add(fresh_)
            self.again.add(np.zeros(len(fresh_), bool))
            self.known.add(fresh_)
            at[lacking] = self.known.find(h[lacking])
        other = (self.ends.data[at] != tell).any(1)
        if other.any():  # words of one hash that differ
            whole |= set(rows[other].tolist())
        counts = self.counts.data[at]
        upto = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        ids = self.flat.data[np.repeat(self.starts.data[at] - upto[:-1], counts) + np.arange(upto[-1])]
        ends = upto[np.searchsorted(rows, np.arange(1, size + 1))]
        if not whole:
            return ids, np.diff(ends, prepend=0)
        parts = []
        for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            parts.append(np.array(self._ids([data[offsets[i] : offsets[i + 1]].decode()])[0], np.int32) if i in whole else ids[a:b])
        return np.concatenate(parts).astype(np.int32), np.array([len(p) for p in parts], np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """This process's encoder: tasks of one worker share what it remembers."""
    return _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, Encoder(tokenizer))


def encode(docs: DataFrame, path: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write the ids of all texts, in ascending order of doc_id, as segments under path."""
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from talentlake.llm.token_files import encoder  # by name, as what a task brings along is built anew for each task

        coder = encoder(tokenizer)
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def segment() -> pa.RecordBatch:
            keys, valid, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            data = to_bytes(keys, valid, lengths, ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(keys)]), pa.array([len(ids)]), pa.array([data], pa.binary())], ["part", "seq", "n_docs", "n_ids", "payload"])

        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for lo, hi in blocks(offsets, 8 * BLOCK):
                ids, lengths = coder.encode(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                keys = batch.column(0).slice(lo, hi - lo)
                held.append((keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_valid().to_numpy(zero_copy_only=False), lengths, ids))
                if sum(len(x[3]) for x in held) >= SEGMENT_IDS:
                    yield segment()
                    seq += 1
        if held:
            yield segment()

    rows.repartitionByRange("i").sortWithinPartitions("i", "t").mapInArrow(tidied(coded), SCHEMA).write.option("compression", "none").parquet(path)


def decode(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers)."""
    files = spark.read.schema(SCHEMA).parquet(path)
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("inside", inside).join(before.select("part", "base"), "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("base"))
    based = lookup(files, starts, ["part", "seq"], "inner").select("base", "payload")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seg = Segment(data.as_py())
                raw = seg.ids().astype("<u4").tobytes()
                upto = np.concatenate(([0], np.cumsum(seg.lengths)))
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(seg.doc_ids, mask=~seg.valid), pa.array(upto[:-1] + base), pa.array(seg.lengths), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.mapInArrow(tidied(opened), "doc_id long, start long, n_tokens long, ids_crc32 long")
