"""Aligned tokenizers, fill-in-middle forms and packed sequences against plain Python, with nulls, ties and odd columns."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from talentlake.llm import align, chunks, fill_middle, packing, queries
from talentlake.llm._util import configured, text_buffers

ODD = [
    None, "", " ", "\n", "a", "  two  spaces \n\n here\n", "The same text. Twice\n\nThree", "The same text. Twice\n\nThree", "x" * 9000, "é" * 50 + " ñandú ЖЖ 日本語 　x",
    "no break  here\n there", "sign ▁ of space", "<|endoftext|> <s> </s> <0x41> it's\r\nI'll\tgo", "    x\u0085y", "one\ntwo\n three\n\n four \n five", "12 345,678.90 -- ''\x00\x1c b﻿", "\n\n\n", "end ",
]


@pytest.fixture(scope="module")
def rows():
    return [(i, t, "en", None) for i, t in enumerate(ODD)] + [(None, "no id", None, "a"), (3, "same id", "de", "a"), (3, "same id", "de", "a")]


# -- alignment --------------------------------------------------------------------------------------------------------


def by_hand(texts):
    """Per text: groups and linked pairs, or None, from whole texts."""
    a, b = chunks.ByteTokens(queries.vocabulary("byte_bpe_50k.json"), special=False), chunks.PieceTokens(queries.vocabulary("piece_bpe_32k.model"))

    def pieces(coder, ids):
        return [coder.bytes.flat[coder.bytes.start[i] : coder.bytes.start[i] + coder.bytes.size[i]].tobytes() for i in ids]

    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        whole = " " + t
        ids = (a.tokenizer.encode(whole, add_special_tokens=False).ids, b.model.encode(t))
        found = [pieces(c, i) for c, i in zip((a, b), ids, strict=True)]
        if any(b"".join(p) != whole.encode() for p in found):
            out.append(None)
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in found]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, last = [], 0
        for e in common:
            groups.append("|".join(",".join(str(i) for i, x in zip(ids[s], ends[s], strict=True) if last < x <= e) for s in (0, 1)))
            last = e
        pairs = [(ids[0][ends[0].index(e)], ids[1][ends[1].index(e)]) for e in common]
        out.append((len(ids[0]), len(ids[1]), groups, pairs))
    return out


def expected(ids, texts):
    found = by_hand(texts)
    counts = Counter(p for f in found if f for p in f[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, f in zip(ids, found, strict=True):
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, pairs = f
            out.append((i, a, b, len(groups), len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_odd_texts(spark, frame, empty, rows, monkeypatch):
    configured(spark)
    paths = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")
    want = expected([r[0] for r in rows], [r[1] for r in rows])
    got = align.aligned(frame(rows), *paths)
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=repr) == want
    monkeypatch.setattr(align, "PAIRS_BROADCAST", 4)  # nearly all pairs are joined by shuffle
    assert sorted(map(tuple, align.aligned(frame(rows).repartition(3), *paths).select(COLUMNS).collect()), key=repr) == want
    assert align.aligned(empty, *paths).count() == 0


def test_alignment_query(spark, small, sf_dir):
    want = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    got = queries.op11_token_alignment(spark, sf_dir).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == expected(*zip(*want, strict=True))


def test_chunks_forget_and_stay_right():
    texts = [t for t in ODD if t] * 2
    import pyarrow as pa

    found = align.Aligner(queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model"))
    memo, align.MEMO = align.MEMO, 3
    try:
        parts = [found.documents(*align.spaced(*text_buffers(pa.array([t])))) for t in texts]
    finally:
        align.MEMO = memo
    for p, f in zip(parts, by_hand(texts), strict=True):
        assert p[0][0].tolist() == ([f[0], f[1], len(f[2])] if f else [0, 0, 0])
        assert p[1][0] == (hashlib.sha256(";".join(f[2]).encode()).hexdigest() if f else "")


# -- fill in the middle -----------------------------------------------------------------------------------------------


def middle_by_hand(doc_id, text):
    t = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sizes = (None, None) if form == "plain" else (len(p), len(m))
    return (doc_id, len(u), form, *sizes, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_fill_middle(frame, empty, rows):
    more = [(100 + i, t, None, None) for i, t in enumerate(["has <P> inside", "a<b<c<S d<M", "<" * 30 + "S" + ">" * 30, "<S <P <M" * 9, "y" * 200_000 + " z"] * 8)]
    every = rows + more + [(200 + i, "words, and more words.\n" * 3, None, None) for i in range(60)]
    got = sorted(map(tuple, fill_middle.digest(frame(every)).collect()), key=repr)
    assert got == sorted((middle_by_hand(r[0], r[1]) for r in every), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.digest(empty).count() == 0
    clash = frame(every).withColumn("fim_units", F.lit(1)).withColumn("n", F.lit(2))
    out = fill_middle.transformed(clash)
    assert out.columns == [*clash.columns, "fim"]
    assert out.where(~fill_middle.restored(F.col("fim.output"), F.col("fim.form")).eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0


def test_fill_middle_has_no_shuffle_and_no_python(spark, sf_dir):
    plan = queries.op12_fill_middle(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow", plan)


def test_fill_middle_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(queries.OP12_SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, queries.op12_fill_middle(spark, sf_dir).select(names).collect())) == sorted(want.fetchall())


# -- packing ----------------------------------------------------------------------------------------------------------


def check_pieces(pieces, texts):
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) hold every id once and need no padding."""
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for i, t in texts:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    by_doc, by_sequence = {}, {}
    for i, start, length, crc, n, sequence, offset in pieces:
        assert length > 0 and 0 <= crc < 1 << 32
        by_doc.setdefault(i, []).append((start, length, crc, n))
        by_sequence.setdefault(sequence, []).append((offset, length))
    for of in by_sequence.values():
        at = 0
        for offset, length in sorted(of):
            assert offset == at
            at += length
        assert at == 1024 or at < 1024 and at.bit_count() == 1  # no padding at all
    assert Counter(i for i, _ in texts) == Counter({i: sum(s == 0 for s, *_ in of) for i, of in by_doc.items()})
    assert sum(length for of in by_doc.values() for _, length, *_ in of) == sum(n * k for (_, n, _), k in want.items())
    return by_doc, want


def test_packing_of_odd_texts(spark, frame, empty, rows):
    configured(spark)
    path = queries.vocabulary("byte_bpe_50k.json")
    long = " ".join(f"w{k}" for k in range(40_000))
    every = rows + [(50, long, None, None), (51, "a" * 5000 + "\n" + "b <|endoftext|> c<|endoftext|>\n\n<|endoftext|> d", None, None)] + [(100 + k, "same words again and again " * 30, "x", "x") for k in range(300)]
    pieces = packing.packed(frame(every).repartition(3), path)
    kept = pieces.collect()
    by_doc, want = check_pieces([(r["doc_id"], r["start"], r["length"], zlib.crc32(bytes(r["ids"])), r["doc_tokens"], r["sequence_id"], r["offset"]) for r in kept], [(r[0], r[1]) for r in every])
    ids = {}
    for r in sorted(kept, key=lambda r: r["start"]):
        ids.setdefault(r["doc_id"], []).append(bytes(r["ids"]))
    single = [r[0] for r in every if [x[0] for x in every].count(r[0]) == 1]
    assert all((i, len(b"".join(ids[i])) // 4, zlib.crc32(b"".join(ids[i]))) in want for i in single)
    whole = packing.sequences(pieces).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(r["n_tokens"] for r in whole) == sum(len(r["ids"]) for r in kept)
    assert packing.packed(empty, path).count() == 0


def test_packing_query(spark, small, sf_dir):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = list(map(tuple, queries.op13_packing(spark, sf_dir).select(columns).collect()))
    by_doc, want = check_pieces(pieces, [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()])
    for i, of in by_doc.items():
        at, crc = 0, 0
        for start, length, _, n in sorted(of):
            assert start == at
            at += length
        assert at == n
        if len(of) == 1:
            assert (i, n, of[0][2]) in want


@pytest.mark.parametrize("kind", ["even", "short", "few", "hot", "one", "none"])
def test_plan_places_every_rest(kind):
    """Every rest of a histogram has its place, places don't overlap, and only the line cuts rests."""
    rng = np.random.default_rng(7)
    v = np.arange(1024)
    counts = {"even": rng.poisson(20, 1024), "short": rng.poisson(200 * np.exp(-v / 250)), "few": rng.poisson(0.2, 1024), "hot": np.where(v == 700, 9000, rng.poisson(9, 1024)), "one": (v == 3) * 5, "none": 0 * v}[kind]
    plan = packing.planned(counts)
    counts[0] = 0
    used, cut_ = {}, 0
    for length in v[1:]:
        for rank in range(counts[length]):
            got = plan.places(int(length), rank)
            assert sum(n for *_, n in got) == length
            cut_ += len(got) > 1
            for sequence, offset, n in got:
                used.setdefault(sequence, []).append((offset, n))
    assert sorted(used) == list(range(plan.n_sequences))
    for of in used.values():
        at = 0
        for offset, n in sorted(of):
            assert offset == at
            at += n
        assert at == 1024 or at.bit_count() == 1
    if kind in ("even", "short"):
        assert cut_ < 0.05 * counts.sum()


def test_least_squares_meets_the_histogram():
    """Where a histogram is a sum of combinations, the solver finds amounts of no error."""
    rng = np.random.default_rng(3)
    every = packing.combinations(np.full(1024, 100))
    counts = np.zeros(1024, np.int64)
    for j in rng.integers(0, len(every), 200):
        np.add.at(counts, every[j], 50)
    counts[0] = 0
    rows = packing.combinations(counts)
    x = packing.repeats(rows, counts, 3000)
    left = counts - np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), 1024)
    assert (x >= 0).all() and np.abs(left[1:]).sum() < 0.01 * counts.sum()
