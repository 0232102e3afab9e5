"""Language ID, secrets, main text, token files and fingerprints against plain Python, with nulls, ties and odd columns."""

import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talentlake.llm import html_text, langid, merkle, queries, secrets, token_files
from talentlake.llm._util import configured, new_path, shingle_hashes, text_buffers, word_hashes

ODD = [None, "", " \t\n", "123 456 !!", "a", "The same text. Twice\n\nThree", "The same text. Twice\n\nThree", "x" * 9000, "é" * 50 + " ñandú ЖЖ 日本語"]


# -- language ---------------------------------------------------------------------------------------------------------


def test_langid_held_out_accuracy(spark, small):
    configured(spark)
    out = queries.op1_language_id(spark, "/root/testdata/sf0.001").join(small.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    assert list(out.held_out) == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]


def test_langid_odd_texts(spark, small, frame, empty):
    configured(spark)
    model = langid.train(small)
    got = {r["doc_id"]: r for r in langid.identify(frame([(i, t, "en", None) for i, t in enumerate(ODD)]), model).collect()}
    assert [got[i]["lang_pred"] for i in range(4)] == ["und"] * 4 and [got[i]["score"] for i in range(4)] == [0.0] * 4
    assert got[4]["lang_pred"] in model.langs and got[5]["lang_pred"] == got[6]["lang_pred"] and got[5]["score"] == got[6]["score"]
    assert langid.identify(empty, model).count() == 0
    none = langid.train(empty)
    assert [r["lang_pred"] for r in langid.identify(frame([(1, "abc", None, None)]), none).collect()] == ["und"]


def test_langid_code_lengths_are_ppm():
    """Lengths equal a direct evaluation of escape method C, byte by byte, and do not depend on block size."""
    texts = ["abracadabra", "abba babba", "cadabra"]
    grams, counts = np.unique(np.concatenate([langid._grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in texts]), return_counts=True)
    coder = langid.Coder(langid.Model(("x",), (grams,), (counts.astype(np.int64),)))
    seen = {}
    for t in texts:
        for i, c in enumerate(t):
            for k in range(4):
                seen.setdefault((" " * 3 + t)[i + 3 - k : i + 3].replace(" ", "^") if k > i else t[i - k : i], {}).setdefault(c, 0)
    ctx = {}
    for t in texts:
        padded = "^^^" + t
        for i, c in enumerate(t):
            for k in range(4):
                ctx.setdefault((k, padded[i + 3 - k : i + 3]), {}).setdefault(c, 0)
                ctx[k, padded[i + 3 - k : i + 3]][c] += 1

    def p(padded, i, c, k):
        if k < 0:
            return 1 / 256
        have = ctx.get((k, padded[i + 3 - k : i + 3]))
        if not have or (k == 3 and sum(have.values()) < 2):
            return p(padded, i, c, k - 1)
        n, d = sum(have.values()), len(have)
        return have[c] / (n + d) if c in have else d / (n + d) * p(padded, i, c, k - 1)

    for t in ("abracad", "zab", "bab"):
        raw, at = np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])
        want = sum(-np.log2(p("^^^" + t, i, c, 3)) for i, c in enumerate(t))
        assert coder.lengths(raw, at)[0, 0] / langid.UNIT == pytest.approx(want, abs=0.02)
    many = "".join(texts * 40).encode()
    whole = coder.lengths(np.frombuffer(many, np.uint8), np.array([0, 100, 100, len(many)]))
    old, langid.BLOCK = langid.BLOCK, 7
    try:
        assert (coder.lengths(np.frombuffer(many, np.uint8), np.array([0, 100, 100, len(many)])) == whole).all() and whole[1, 0] == 0
    finally:
        langid.BLOCK = old


# -- secrets ----------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secrets(spark, frame, empty):
    key, live, shared = "AKIA" + "Z9" * 8, "Zx81Qw77Lp04Mn3kTt5r", "Rr20Tt51Uu88Ii67Kk1z"
    cases = [None, "", "token: \"secret\": \"abcdefgh12\"", "é PASSWORD='hunter2hunter2' api_key = short", f"{key} AKIAAKIA AKIA1", "a" * 31 + " " + "0f" * 16 + " " + "0f" * 17, f"see {live} here", f"x {shared}", f"y {shared}", "secret=" + "f" * 40, "secret=" + "f" * 40]
    docs = frame([(i, t, "en", "s1" if i != 8 else None) for i, t in enumerate(cases)])
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(docs)).collect()}
    for i, t in enumerate(cases):
        assert got[i]["base_sha256"] == hashlib.sha256(base_spans(t).encode()).hexdigest(), t
        assert [got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]] == [base_spans(t).count(f"{k}:") for k in secrets.KINDS]
    assert got[6]["spans"] == "live:4:24" and got[7]["spans"] == "" and got[8]["spans"] == ""
    assert got[9]["n_live"] == 2
    assert secrets.digest(secrets.scan(empty)).count() == 0


# -- main text --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return html_text.train()


def test_main_text_of_pages(spark, sf_dir, model):
    configured(spark)

    def want(h):
        body = h[h.index("<article>") + 9 : h.index("</article>")].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body))
        return "\n\n".join(b for b in blocks if b)

    got = queries.op7_main_text(spark, sf_dir).toPandas()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas().set_index("page_id").html
    same = [want(pages[p]) == t for p, t in zip(got.page_id, got.text, strict=True)]
    assert sum(same) >= 0.95 * len(same) and list(got.n_chars) == [len(t) for t in got.text]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><nav><a href=a>Home</a><a href=b>News</a></nav><main><h2>Title here</h2><p>One  &amp; two,\n three.<p>Four five six.</main><footer>&copy; 2020 x</footer>", "Title here\n\nOne & two, three.\n\nFour five six."),
        ("<article><p>Some words in a text, long enough.</p><section class='comments'><p>Nice text, thanks a lot!</p></section></article>", "Some words in a text, long enough."),
        ("<div class='cookie-notice'><p>We use cookies.</p><button>Yes</button></div><article><p>Plain words, and more of them.</p></article><script>var x = '<p>no</p>'</script>", "Plain words, and more of them."),
        ("", ""),
        ("<article><p>Left open, with many words <b>and bold", "Left open, with many words and bold"),
    ],
)
def test_main_text_cases(page, text, model):
    assert html_text.main_text(page, model) == text


def test_main_text_odd_rows(spark, model):
    configured(spark)
    rows = spark.createDataFrame([(1, None, "a"), (2, "<!-- open", "b"), (3, "<p>" * 3000 + "deep words here", "c")], "page_id int, html string, main_text string")
    got = {r["page_id"]: r["main_text"] for r in html_text.extract(rows, model).collect()}
    assert got[1] == "" and got[2] == "" and set(got) == {1, 2, 3}


@pytest.mark.parametrize("page", ["<a " * 200_000, "<div>" * 30_000 + "x", "<a \"" * 150_001, "<div>" * 20_000 + "</b>" * 50_000, "<p><table>" + "<div>" * 30_000, "<!" * 200_000])
def test_hostile_pages_are_read_in_one_pass(page, model):
    began = time.perf_counter()
    html_text.main_text(page, model)
    assert time.perf_counter() - began < 4


@pytest.mark.parametrize("before, after", [("<object>", "</object>"), ("<noscript>", "</noscript>"), ("<svg>", ""), ("<select>", ""), ("<p title=\"x>", "")])
def test_article_within_or_behind_odd_markup(before, after, model):
    article = "<article>" + "".join(f"<p>Some words, here and there, number {i} of a long story. And more of it.</p>" for i in range(6)) + "</article>"
    plain = html_text.main_text(f"<html><body>{article}</body></html>", model)
    assert len(plain) > 300
    assert html_text.main_text(f"<html><body><nav><a href=/x>x</a></nav>{before}{article}{after}<footer>Copyright</footer></body></html>", model) == plain


def test_marginals_equal_enumeration():
    parent, top = [-1, 0, 0, 2, 2], [True, False, False, False, False]
    unary, pair = [0.3, -1.0, 0.7, 2.0, -0.2], (((0.9, 0.1), (0.2, 0.8)), ((0.5, 0.5), (0.4, 0.6)))
    weight, on = 0.0, [0.0] * 5
    for bits in range(32):
        y = [bits >> i & 1 for i in range(5)]
        w = np.exp(sum(u for u, b in zip(unary, y, strict=True) if b))
        for e in range(1, 5):
            w *= pair[top[parent[e]]][y[parent[e]]][y[e]]
        weight += w
        on = [o + w * b for o, b in zip(on, y, strict=True)]
    assert html_text.marginals(parent, unary, pair, top) == pytest.approx([o / weight for o in on])


def test_model_on_unseen_layouts(model):
    right = total = 0
    for source in html_text.labelled_pages(60, seed=1234):
        page = html_text.Page(source)
        y = page.labels()
        page.attrs = [re.sub(r'\s*data-label="[01]"', "", a) for a in page.attrs]
        unary = [model.bias + sum(model.weights.get(f, 0.0) for f in x) for x in page.features()]
        right += sum((p > 0.5) == bool(b) for p, b in zip(html_text.marginals(page.parent, unary, model.pair, page.top()), y, strict=True))
        total += len(y)
    assert right / total > 0.95


# -- tokens -----------------------------------------------------------------------------------------------------------


def test_packing_round_trip():
    rng = random.Random(5)
    for _ in range(60):
        v = np.array([rng.getrandbits(rng.randint(1, rng.choice([3, 17, 33, 64]))) for _ in range(rng.randint(0, 900))], np.uint64)
        assert (token_files.unpack(*token_files.pack(v)) == v).all()


def test_tokens_equal_the_library(spark, small, frame, empty):
    configured(spark)
    special = ["<|endoftext|> x <|STARTOFTEXT|>", "it's foo). ♡ x♡y, a. .b", "İ É é a\x1cb\x85c"]
    rows = [(9 - i, t, "en", "s") for i, t in enumerate(ODD + special)] + [(None, "null id", "en", "s")]
    coder = token_files.encoder(queries.vocabulary()).tokenizer
    for docs in (frame(rows), small.where("doc_id < 40")):
        path = new_path(spark, "t")
        token_files.encode(docs, path, queries.vocabulary())
        got = sorted(token_files.decode(spark, path).collect(), key=lambda r: r["start"])
        want, start = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")), 0
        assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want]
        for g, w in zip(got, want, strict=True):
            ids = [*coder.encode(w["text"] or "", add_special_tokens=False).ids, 2]
            assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    path = new_path(spark, "t")
    token_files.encode(empty, path, queries.vocabulary())
    assert token_files.decode(spark, path).count() == 0


def test_long_texts_and_tables_that_grow():
    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    from talentlake.llm._util import text_buffers

    coder, library = token_files.Encoder(queries.vocabulary()), Tokenizer.from_file(queries.vocabulary())
    texts = ["", " ".join(f"{i}q" for i in range(150_000)), "x" * 300_000 + " y", "<|endoftext|> Hello <|END", None, "\"Hi,\" it's. a.b, " * 20_000]
    ids, n = coder.encode(*text_buffers(pa.array(texts)))
    for text, own in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert own.tolist() == [*library.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from talentlake.llm._util import text_buffers

    plain = token_files.word_hashes
    monkeypatch.setattr(token_files, "word_hashes", lambda *a, **k: (np.full_like((x := plain(*a, **k))[0], 7), *x[1:]))
    coder = token_files.Encoder(queries.vocabulary())
    ids, n = coder.encode(*text_buffers(pa.array(["one two", "three four one"])))
    monkeypatch.undo()
    want, m = token_files.Encoder(queries.vocabulary()).encode(*text_buffers(pa.array(["one two", "three four one"])))
    assert ids.tolist() == want.tolist() and n.tolist() == m.tolist()


def test_segment_ranges():
    ids = np.arange(200_000) % 50_000
    seg = token_files.Segment(token_files.to_bytes(np.array([5]), np.array([True]), np.array([200_000]), ids))
    assert (seg.ids(65_530, 140_000) == ids[65_530:140_000]).all() and seg.lengths.tolist() == [200_000]


# -- fingerprints -----------------------------------------------------------------------------------------------------


def check_prints(docs, got):
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (-r[0], -r[1], r[2]))
    by = {(r["doc_id"], r["edited_sha256"]): r for r in got}
    for k, (known, i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][2]
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        r = by[i if known else None, hashlib.sha256(new.encode()).hexdigest()]
        assert r["n_chars"] == len(t) and (r["fingerprint"] == r["edited_fingerprint"]) == (t == new) and 0 <= r["near_edited"] <= 1
        if t == nxt:
            assert r["near_next"] == 1.0


def test_fingerprints(spark, frame, small, empty, monkeypatch):
    odd = frame([(i, t, "en", "s") for i, t in enumerate(ODD)] + [(None, "no id", "en", "s"), (3, "again 3. And more", "en", "s")])
    check_prints(odd, merkle.edited(odd).collect())
    monkeypatch.setattr(merkle, "RANGE_DOCS", 7)
    check_prints(small, merkle.edited(small).collect())
    check_prints(odd, merkle.edited(odd).collect())
    one = frame([(1, "only one. Here", "en", "s")])
    check_prints(one, merkle.edited(one).collect())
    assert merkle.edited(empty).count() == 0


def test_fingerprints_find_edits(spark):
    a, b = "One two three.\nFour five six.\n\nSeven eight nine.", "One two three.\nFour five six.\n\nSeven eight ten."
    row = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("x"), merkle.fingerprint(F.col("b")).alias("y"))
    row = row.select(merkle.differing(F.col("x"), F.col("y")).alias("d"), merkle.differing(F.col("x"), F.col("x")).alias("e"), merkle.likeness(F.col("x"), F.col("y")).alias("n")).first()
    assert row["d"] == [1] and row["e"] == [] and row["n"] == 0.5


# -- shared hashing ---------------------------------------------------------------------------------------------------


def test_word_and_shingle_hashes():
    texts = ["A b  c\td e f", "", "a B c d e", "x", "a b c d e f g", None, "É é"]
    raw, at = text_buffers(pa.array(texts))
    h, rows, start, end = word_hashes(raw, at)
    low = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    words = [(i, low(w)) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert rows.tolist() == [i for i, _ in words] and [low(bytes(raw[a:b]).decode()) for a, b in zip(start, end, strict=True)] == [w for _, w in words]
    assert len({(int(x), w) for x, (_, w) in zip(h, words, strict=True)}) == len({w for _, w in words}) == len(set(h.tolist()))
    s, r = shingle_hashes(h, rows, len(texts))
    assert r.tolist() == [0, 0, 2, 3, 4, 4, 4, 6] and s[0] == s[2] == s[4] and s[1] == s[5]
