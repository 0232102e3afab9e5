"""Language identification by prediction by partial matching.

Per language a byte context tree of orders 0 to 3 is counted on a bounded, labelled sample. Escape method C gives each
byte a probability in its longest context; code lengths are fixed-point numbers (1/1024 bit) summed exactly, so results
do not depend on batches or partitions. The statistics are frozen before any text is scored.

Defined results: a null text or one without a letter is `und` with score 0; an empty table gives an empty table; ties go
to the language that sorts first; repeated rows are scored alike; very long texts are scored whole, in blocks; columns
of the input named like an output get the output's value.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.llm._util import fresh, text_buffers, tidied

UND = "und"
#: Longest context, in bytes.
ORDER = 3
#: Fixed-point unit of code lengths.
UNIT = 1 << 10
#: Labelled documents per language that are counted, in expectation: the bound of the training sample.
SAMPLE_DOCS = 2500
#: Bits of a byte without a model, and bits that a text may have on top: codes longer than that are of no learned language.
RAW_BITS, SPARE_BITS = 8, 64
#: States whose costs are computed at once.
ROWS = 2048
#: Bytes of text handled at once.
BLOCK = 1 << 17


@dataclass(frozen=True)
class Model:
    """Frozen counts: 4-byte grams (three context bytes, then the byte; 256 is the text's beginning) by language."""

    langs: tuple[str, ...]
    grams: tuple[np.ndarray, ...]
    counts: tuple[np.ndarray, ...]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def held_out(doc_id: Column) -> Column:
    """True for documents that training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The gram of each byte as a base-257 number; positions before a text count as 256."""
    out = raw.astype(np.int64)
    for k in range(1, ORDER + 1):
        out += _before(raw, offsets, k).astype(np.int64) * 257**k
    return out


def _before(codes: np.ndarray, offsets: np.ndarray, k: int, boundary: int = 256) -> np.ndarray:
    """The code k places back in the same text."""
    prior = np.full(len(codes), boundary, np.int32)
    prior[k:] = codes[:-k] if len(codes) > k else prior[k:]
    starts = offsets[:-1]
    for j in range(k):
        at = starts + j
        prior[at[at < offsets[1:]]] = boundary
    return prior


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.asarray(batch.column(1).to_pylist(), dtype=object)
        raw, offsets = text_buffers(batch.column(0))
        for lang in sorted(set(langs)):
            rows = np.flatnonzero(langs == lang)
            parts = [raw[offsets[r] : offsets[r + 1]] for r in rows]
            own = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            gram, n = np.unique(_grams(np.concatenate(parts), own), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Count the context trees on labelled texts (lang and text not null; the caller leaves out what is held out).

    Languages with more than sample_docs labelled documents are sampled by a hash of id and text; what reaches the
    driver is one row per distinct gram of that bounded sample."""
    rows = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), F.col(doc_id).alias("i")).where("t is not null and l is not null")
    have = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not have:
        return Model((), (), ())
    share = None
    for name, n in have.items():
        keep = F.lit(min(1.0, sample_docs / n))
        share = F.when(F.col("l") == name, keep) if share is None else share.when(F.col("l") == name, keep)
    drawn = rows.where(F.shiftrightunsigned(F.xxhash64("i", "t"), 11) * F.lit(2.0**-53) < share)
    counted = drawn.select(F.lower("t").alias("t"), "l").mapInArrow(tidied(_count), "lang string, gram long, n long")
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "gram"])
    langs = tuple(sorted(table["lang"].unique()))
    own = [table[table["lang"] == name] for name in langs]
    return Model(langs, tuple(t["gram"].to_numpy(np.int64) for t in own), tuple(t["n"].to_numpy(np.int64) for t in own))


class Coder:
    """Code-length tables of a model: for each context state and byte, a fixed-point cost per language."""

    def __init__(self, model: Model):
        seen = np.unique(np.concatenate([g % 257 for g in model.grams]))
        a = self.size = len(seen) + 2  # 0: before the text, 1: a byte that the sample lacks
        code = np.ones(257, np.int64)
        code[seen] = np.arange(2, a)
        code[256] = 0
        self.code = code[:256].astype(np.int32)
        keys, sums = [], []
        for g, n in zip(model.grams, model.counts, strict=True):
            context = self._context(g)
            key, at = np.unique(context, return_inverse=True)
            keys.append(key)
            sums.append(np.bincount(at, n))
        seen, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(sums))
        kept = seen[total > 1]  # a context that was seen once says no more than its shorter one
        self.state = np.tile(np.arange(a * a, dtype=np.int32), a)
        self.state[kept] = a * a + np.arange(len(kept), dtype=np.int32)
        self.cost = np.empty(((a * a + len(kept)) * a, len(model.langs)), np.uint16)
        for i, (g, n) in enumerate(zip(model.grams, model.counts, strict=True)):
            context, s = self._context(g), code[g % 257]
            p = self._mixed(np.bincount(s, n, a)[None, :], np.full((1, a), 1 / 256))
            p = self._mixed(np.bincount(context % a * a + s, n, a * a).reshape(a, a), p)
            self._table(i, 0, context % (a * a), s, n, a * a, p)
            at = np.searchsorted(kept, context)
            ok = (at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == context) if len(kept) else np.zeros(len(context), bool)
            self._table(i, a * a, at[ok], s[ok], n[ok], len(kept), None, kept % (a * a))

    def _context(self, grams: np.ndarray) -> np.ndarray:
        """The codes of three bytes before, as a number."""
        out = np.zeros(len(grams), np.int64)
        for k in range(ORDER, 0, -1):
            code = grams // 257**k % 257
            out = out * self.size + np.where(code == 256, 0, self.code[np.minimum(code, 255)])
        return out

    def _table(self, lang: int, first: int, at: np.ndarray, s: np.ndarray, n: np.ndarray, rows: int, below: np.ndarray | None, shorter: np.ndarray | None = None) -> None:
        """Fill a language's costs of states from `first` on, some rows at a time; the shorter context's shares are rows of
        below by a state's last code, or what costs of order 2 say."""
        a, order = self.size, np.argsort(at, kind="stable")
        at, s, n = at[order], s[order], n[order]
        for lo in range(0, rows, ROWS):
            hi = min(rows, lo + ROWS)
            x, y = np.searchsorted(at, (lo, hi))
            count = np.bincount((at[x:y] - lo) * a + s[x:y], n[x:y], (hi - lo) * a).reshape(hi - lo, a)
            if below is not None:
                share = below[np.arange(lo, hi) % a]
            else:
                two = self.cost[(shorter[lo:hi, None] * a + np.arange(a)).ravel(), lang].reshape(hi - lo, a)
                share = np.exp2(-two / UNIT)
            bits = -np.log2(self._mixed(count, share)) * UNIT
            self.cost[(first + lo) * a : (first + hi) * a, lang] = np.minimum(np.rint(bits), 65535).ravel()

    @staticmethod
    def _mixed(n: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Method C: a seen byte has n / (N + D); an unseen one the escape D / (N + D) times its shorter context's share."""
        total, kinds = n.sum(-1, keepdims=True), (n > 0).sum(-1, keepdims=True)
        below = np.maximum(total + kinds, 1)
        return np.where(total == 0, shorter, np.where(n > 0, n / below, kinds / below * shorter))

    def lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text under each language in 1/1024 bit, each byte's rounded to one."""
        a, out = self.size, np.zeros((len(offsets) - 1, self.cost.shape[1]), np.int64)
        for lo in range(0, len(raw), BLOCK):
            hi, back = min(lo + BLOCK, len(raw)), max(0, lo - ORDER)
            codes, at = self.code[raw[back:hi]], np.clip(offsets - back, 0, hi - back)
            ctx = codes * 0
            for k in range(ORDER, 0, -1):
                ctx = ctx * a + self._prior(codes, offsets - back, k)
            row = self.cost[(self.state[ctx] * np.int64(a) + codes)[lo - back :]]
            at = np.clip(at - (lo - back), 0, hi - lo)
            full = np.flatnonzero(at[:-1] < at[1:])
            out[full] += np.add.reduceat(row, at[full], axis=0, dtype=np.int64)
        return out

    @staticmethod
    def _prior(codes: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
        prior = np.zeros(len(codes), np.int32)
        prior[k:] = codes[:-k] if k < len(codes) else prior[k:]
        for j in range(k):
            at = offsets[:-1] + j
            prior[at[(at < offsets[1:]) & (at >= 0) & (at < len(codes))]] = 0
        return prior


_CODERS: dict[str, Coder] = {}


def coder_of(model: Model) -> Coder | None:
    """This process's tables of a model: tasks of one worker share them. Those of another model are let go."""
    if model.langs and model.key not in _CODERS:
        _CODERS.clear()
        _CODERS[model.key] = Coder(model)
    return _CODERS.get(model.key)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs, or its columns in keep, with lang_pred, score (posterior of lang_pred under equal priors, from code lengths)
    and bits_per_byte. Columns that are not kept don't come back from Python, which for texts is half of what moves."""
    spark = docs.sparkSession
    outs = ["lang_pred", "score", "bits_per_byte"]
    base = docs.select(*[c for c in docs.columns if c.lower() not in outs and (keep is None or c in keep)])
    folded, letters = fresh(base, "folded", "letters")
    fed = docs.select(*base.columns, F.lower(F.col(text)).alias(folded), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(letters))
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from talentlake.llm.langid import coder_of  # by name, as what a task brings along is built anew for each task

        frozen = shared.value
        coder = coder_of(frozen)
        for batch in batches:
            n = batch.num_columns - 2
            live = np.asarray(batch.column(n + 1).to_pylist(), dtype=bool)
            if coder is None:
                live[:] = False
            pred, score, rate = np.full(len(live), UND, object), np.zeros(len(live)), np.zeros(len(live))
            if live.any():
                raw, offsets = text_buffers(batch.column(n))
                bits = coder.lengths(raw, offsets) / UNIT
                best = bits.argmin(1)
                low = bits[np.arange(len(best)), best]
                sure = 1 / np.exp2(-np.minimum(bits - low[:, None], 1000)).sum(1)
                pred = np.where(live, np.asarray(frozen.langs, object)[best], UND)
                score = np.where(live, sure, 0.0)
                rate = np.where(live, low / np.maximum(np.diff(offsets), 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(pred, pa.string()), pa.array(score), pa.array(rate)], [*batch.schema.names[:n], *outs])

    schema = base.schema
    for name, kind in zip(outs, ("string", "double", "double"), strict=True):
        schema = type(schema)([*schema.fields]).add(name, kind)
    return fed.mapInArrow(tidied(scored), schema)


def foreign(judged: DataFrame, text: str = "text") -> Column:
    """True for texts of no learned language, from identify's columns: they have no letter, or their shortest code is longer
    than the plain bytes and SPARE_BITS."""
    size = F.octet_length(F.lower(F.coalesce(F.col(text), F.lit(""))))
    return (F.col("lang_pred") == UND) | (F.col("bits_per_byte") * size > RAW_BITS * size + SPARE_BITS)
