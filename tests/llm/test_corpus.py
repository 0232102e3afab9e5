"""Mixing, near duplicates, decontamination, line and passage dedup and the pipeline against brute force."""

import random
import re
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from talentlake.llm import components, decontaminate, lines, mixing, near_dup, passages
from talentlake.llm._util import configured


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(t))


def prose(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 6))) for _ in range(n))


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = prose(r, 1)
    return " ".join(w)


# -- mixing -----------------------------------------------------------------------------------------------------------


def water_fill(sizes, weights, factor=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, free = float(sum(sizes.values())), {}, set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > factor * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = factor * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix(spark, frame, empty):
    r = random.Random(3)
    rows = [(i, prose(r, r.randint(0, 60)), "en", r.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(1500)]
    rows += [(2000, None, "en", "a"), (2001, "", "en", "e"), (2002, "one word", "en", "f"), (5, "again here", "en", "a")]
    docs = frame(rows)
    got = mixing.mixed_sizes(docs).toPandas()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    want = water_fill(sizes, mixing.WEIGHTS)
    got["source"] = got.source.where(got.source.notna(), None)
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and got.target.sum() > 0
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s, g in got.groupby("source", dropna=False):
        s = None if s != s else s
        assert g.target.iloc[0] == pytest.approx(want[s]) and g.source_size.iloc[0] == sizes[s]
        if sizes[s] > 1000:
            assert abs(g.taken.sum() - want[s]) <= 60
    again = mixing.mixed_sizes(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, again[key].values.tolist()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == got[got["size"] > 0].copies.sum()
    assert mixing.mixed_sizes(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mix_thresholds_are_nested(spark, frame):
    r = random.Random(4)
    docs = frame([(i, prose(r, 10), "en", "a") for i in range(300)])
    few, many = (mixing.mixed_sizes(docs, share=s).where("copies > 0").select("doc_id").toPandas().doc_id for s in (0.2, 0.6))
    assert set(few) < set(many)


# -- components and near duplicates -----------------------------------------------------------------------------------


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components_in_rounds(spark):
    configured(spark)
    r = random.Random(5)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)]
    df = spark.createDataFrame(pairs, "a long, b long")
    one = {x["node"]: x["root"] for x in components.components(df).collect()}
    rounds = {x["node"]: x["root"] for x in components.components(df, in_task=10).collect()}
    real = [p for p in pairs if p[0] != p[1]]
    assert one == rounds == groups({x for p in real for x in p}, real)


def test_components(spark):
    links = [(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (5, 6)] + [(i, i + 1) for i in range(20, 60)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups({x for p in links for x in p}, links)
    assert got == {n: r for n, r in want.items() if n != 4}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(t):
    w = words(t)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))


def brute_near(rows):
    sets = [shingle_set(r[1]) for r in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = groups(range(len(rows)), links)
    least = defaultdict(list)
    for i in root:
        least[root[i]].append(rows[i][0])
    return sets, {i: min((x for x in least[root[i]] if x is not None), default=None) for i in root}


def corpus():
    r = random.Random(8)
    rows, base = [], [prose(r, r.choice([3, 8, 40, 120, 300])) for _ in range(40)]
    for i in range(260):
        t = r.choice(base)
        k = r.random()
        t = t if k < 0.2 else edited(r, t, r.randint(1, max(1, len(t.split()) // 25))) if k < 0.8 else prose(r, 60)
        rows.append((i, t.upper() if r.random() < 0.1 else t, "en", "s"))
    hot = prose(r, 150)
    rows += [(1000 + i, edited(r, hot, 2), "en", "s") for i in range(150)] + [(2000 + i, hot, "en", "s") for i in range(50)]
    return rows + [(3000, None, "en", "s"), (3001, " \n", "en", "s"), (3002, "", "en", "s"), (3003, "a b", "en", "s"), (3004, "A  b", "en", "s"), (7, rows[7][1], "en", "s"), (None, hot, "en", "s")]


def test_near_duplicates(spark, frame, empty):
    configured(spark)
    rows = corpus()
    sets, root = brute_near(rows)
    got = near_dup.near_duplicates(frame(rows)).toPandas()
    want = sorted((str(r[0]), len(sets[i]), str(root[i] if root[i] is not None else None)) for i, r in enumerate(rows))
    show = lambda x: "None" if x != x else str(int(x))
    assert sorted((show(a), n, show(c)) for a, n, c in zip(got.doc_id, got.n_shingles, got.component_id, strict=True)) == want
    assert near_dup.near_duplicates(empty).count() == 0


def test_dedupe_keeps_one_of_each_group(spark, frame, empty):
    configured(spark)
    rows = corpus()
    sets, root = brute_near(rows)
    docs = frame(rows)
    got = near_dup.dedupe(docs)
    assert got.columns == docs.columns
    kept = got.select("doc_id", "text").collect()
    with_words = [r for r in kept if words(r["text"]) and r["doc_id"] is not None]
    by_id = {r[0]: root[i] for i, r in enumerate(rows)}
    assert sorted(by_id[r["doc_id"]] for r in with_words) == sorted({root[i] for i, r in enumerate(rows) if sets[i] and root[i] is not None})
    assert {3000, 3001, 3002} <= {r["doc_id"] for r in kept}
    assert near_dup.dedupe(empty).count() == 0


def test_near_duplicates_among_boilerplate(spark, frame):
    """Hundreds of texts with the same long boilerplate, likeness about 0.7, and a few pairs of them that are links."""
    configured(spark)
    r = random.Random(28)
    boilerplate, rows = prose(r, 500), []
    for i in range(0, 700, 2):
        own = prose(r, 100)
        mate = own.split()[:28] + prose(r, 72).split() if i % 14 == 0 else prose(r, 100).split()
        rows += [(i, f"{boilerplate} {own}", "en", "s"), (i + 1, f"{boilerplate} {' '.join(mate)}", "en", "s")]
    sets = [shingle_set(t) for _, t, _, _ in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert links == [(i, i + 1) for i in range(0, 700, 14)]
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(frame(rows)).collect()}
    assert got == groups(range(len(rows)), links)


# -- decontamination --------------------------------------------------------------------------------------------------


def test_leaks(spark, frame, empty):
    r = random.Random(5)
    items = [(0, "If Anna buys 12 apples for 30 euros and sells 12 apples to Peter for 45 euros how much does she earn"), (1, prose(r, 30)), (2, "four little words here"), (3, None), (4, ""), (5, prose(r, 40))]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    again = "If Maria buys 7 apples for 20 euros and sells 7 apples to Jonas for 99 euros how much does she earn"
    mixed = "If Maria buys 7 apples for 20 euros and sells 8 apples to Jonas for 99 euros how much does she earn"
    cases = [prose(r, 80), f"{prose(r, 20)}. {items[0][1]}. {prose(r, 9)}", f"{prose(r, 20)}. {again}", mixed, f"{prose(r, 5)} {items[1][1].upper()} {prose(r, 5)}", None, "", f"x {items[2][1]} y", " ".join(items[5][1].split()[:12]), " ".join(items[5][1].split()[5:22])]
    got = {(x["doc_id"], x["item_id"]): x["same_values"] for x in decontaminate.leaks(frame([(i, t, "en", "s") for i, t in enumerate(cases)]), benchmark).collect()}
    assert got == {(1, 0): True, (2, 0): False, (4, 1): True, (7, 2): True, (9, 5): True}
    docs = frame([(i, t, "en", "s") for i, t in enumerate(cases)] + [(1, cases[1], "en", "s")])
    assert sorted(x["doc_id"] for x in decontaminate.clean(docs, benchmark).collect()) == [0, 3, 5, 6, 8]
    assert decontaminate.leaks(empty, benchmark).count() == 0 and decontaminate.leaks(docs, benchmark.where("false")).count() == 0


def test_leaks_of_few_literal_words(spark, frame):
    configured(spark)
    cities = "Paris 1900, London 1908, Stockholm 1912, Antwerp 1920, Amsterdam 1928, Berlin 1936, Helsinki 1952, Melbourne 1956"
    texts = ["What is 17 times 23?", "Solve 3 4 5 6 7 8 9 10 for x.", cities]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    r = random.Random(2)
    rows = [(i, f"{prose(r, 9)}. {t} {prose(r, 9)}", "en", "s") for i, t in enumerate(texts)]
    rows += [(10, "What is 18 times 24?", "en", "s"), (11, "Paris 1900, Rome 1960", "en", "s"), (12, None, "en", "s"), (13, prose(r, 5000), "en", "s")]
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(frame(rows), items).collect()}
    assert got == {(0, 0), (1, 1), (2, 2)}


def test_leaks_compare_the_slots_of_matched_windows(spark, frame):
    r = random.Random(29)
    coincide = "the box holds 3 red and 5 blue marbles that were put there by the children of the village school"
    first, rest = f"a train with 12 full wagons leaves the old station and {prose(r, 12)}", f"{prose(r, 6)} over 12 bridges {prose(r, 8)}"
    benchmark = spark.createDataFrame([(0, coincide), (1, f"{first} {rest}")], "item_id long, text string")
    own = f"{prose(r, 6)} over 40 {prose(r, 9)}"
    cases = [coincide.replace("3", "4").replace("5", "4"), f"{first} {own}", coincide.replace("3", "4").replace("5", "6"), prose(r, 40)]
    got = {(x["doc_id"], x["item_id"]): x["same_values"] for x in decontaminate.leaks(frame([(i, t, "en", "s") for i, t in enumerate(cases)]), benchmark).collect()}
    assert got == {(0, 0): False, (1, 1): True, (2, 0): False}


# -- lines ------------------------------------------------------------------------------------------------------------


def test_lines(spark, frame, empty):
    r = random.Random(6)
    base = [prose(r, r.choice([1, 3, 8, 20, 60])) for _ in range(25)] + ["the of and", "the of and in", "of the"]
    rows = [(i, "\n".join(r.choice([b, b.upper(), edited(r, b, 1), "", " ", prose(r, 12)]) for b in r.choices(base, k=r.randint(0, 9))), "en", "s") for i in range(120)]
    hot = prose(r, 30)
    rows += [(500 + i, edited(r, hot, 1) + "\n" + hot, "en", "s") for i in range(60)] + [(900, None, "en", "s"), (901, "", "en", "s")]
    seen, want = [], {}
    for i, t, _, _ in rows:
        for k, line in enumerate((t or "").split("\n"), 1):
            s = frozenset(x for x in line.lower().split(" ") if x)
            if s:
                want[i, k] = any(100 * len(s & o) >= 75 * len(s | o) for o in seen)
                seen.append(s)
    got = lines.near_lines(frame(rows))
    assert {(x["doc_id"], x["line_no"]): x["removed"] for x in got.collect()} == want
    left = {x["doc_id"]: x["text"] for x in lines.kept_text(frame(rows), got).collect()}
    for i, t, _, _ in rows:
        assert left[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n"), 1) if not want.get((i, k), False)))
    assert lines.near_lines(empty).count() == 0


# -- passages ---------------------------------------------------------------------------------------------------------


def test_lines_of_many_sizes_against_brute_force(spark, frame):
    """Links of every size of line, repeated rows, a null id, clashing names and a long line."""
    configured(spark)
    r = random.Random(41)
    base = [prose(r, n) for n in (1, 2, 3, 4, 7, 20, 70, 150, 400)]
    texts = [edited(r, b, k) for b in base for k in (0, 0, 1, 2, 5, len(b.split()) // 5)] + [prose(r, 20000)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s"), (None, texts[0], "en", "s")]
    got = lines.near_lines(frame(rows)).collect()
    sets = {i: set(words(t)) for i, t in enumerate(texts)}
    like = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    kinds = {frozenset(s) for s in sets.values()}
    assert len(got) == len(rows)
    for g in got:
        own = sets[g["doc_id"] if g["doc_id"] is not None else 0]
        assert g["n_links"] == sum(k != own and like(k, own) for k in kinds)
    named = frame(rows).withColumnRenamed("source", "gone_lines")
    assert lines.kept_text(named, lines.near_lines(named)).columns == named.columns


def test_lines_are_verified_on_their_own_words(spark, frame, monkeypatch):
    """Whatever pairs meet: blocks of a crowd lose none, and rows that share an id and differ in text keep their own words."""
    r = random.Random(12)
    hot = prose(r, 50)
    rows = [(i, edited(r, hot, i % 6), "en", "s") for i in range(30)]
    other = prose(r, 30)
    rows += [(7, other, "en", "s"), (40, other + " end", "en", "s"), (9, rows[9][1], "en", "s")]
    sets = {frozenset(words(t)) for _, t, _, _ in rows}
    want = {s: sum(s != o and 100 * len(s & o) >= 75 * len(s | o) for o in sets) for s in sets}
    digests = lambda tokens, name: tokens.select(tokens.digest.alias(name)).distinct()
    monkeypatch.setattr(lines, "_candidates", lambda tokens: digests(tokens, "a").crossJoin(digests(tokens, "b")).where("a < b"))
    monkeypatch.setattr(lines, "CELL_PAIRS", 50, raising=False)
    got = lines.near_lines(frame(rows)).collect()
    assert sorted((x["doc_id"], x["n_links"]) for x in got) == sorted((i, want[frozenset(words(t))]) for i, t, _, _ in rows)


def test_links_within_crowds_are_counted_not_listed(spark, frame, monkeypatch):
    """Crowds of near copies, two of them alike, with differences that several lines share, copies and lines of no crowd: links
    and places against brute force, though few of the pairs are listed."""
    r = random.Random(77)
    hot = prose(r, 60)
    near = " ".join(x if i % 6 else x + "q" for i, x in enumerate(hot.split()))  # another crowd, linked with the first in part
    tail = " ".join(f"extra{i}" for i in range(9))
    rows = [(i, edited(r, hot, i % 7), "en", "s") for i in range(90)] + [(100 + i, edited(r, near, i % 7), "en", "s") for i in range(50)]
    rows += [(200 + i, edited(r, hot, 3) + " " + tail, "en", "s") for i in range(12)] + [(300 + i, edited(r, prose(r, 30), 2), "en", "s") for i in range(20)]
    rows += [(400, rows[5][1], "en", "s"), (None, rows[6][1], "en", "s"), (401, hot + "\n" + near, "en", "s")]
    r.shuffle(rows)
    sets = sorted(((-1 if i is None else i), k, frozenset(words(line))) for i, t, _, _ in rows for k, line in enumerate(t.split("\n"), 1))
    like = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    kinds = {s for _, _, s in sets}
    want = [(i, k, sum(o != s and like(o, s) for o in kinds), any(like(o, s) for _, _, o in sets[:at])) for at, (i, k, s) in enumerate(sets)]
    listed, joined = [], lines._joined_links
    verified = lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, *more: listed.append(pairs.count()) or verified(pairs, *more))
    monkeypatch.setattr(lines, "_joined_links", lambda members: listed.append(joined(members).count()) or joined(members))
    got = lines.near_lines(frame(rows)).collect()
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["line_no"], x["n_links"], x["removed"]) for x in got) == want
    in_first = [s for i, _, s in sets if 0 <= i < 90]
    assert sum(listed) < sum(a != b and like(a, b) for a in in_first for b in in_first) // 2


def test_compact_windows_cover_every_passage():
    import numpy as np

    rng = np.random.default_rng(2)
    for least in (3, 7):
        rows = np.repeat(np.arange(4), [20, 2, 7, 31])
        packed = (rng.integers(0, 1 << 30, len(rows)).astype(np.uint64) << np.uint64(24)) | np.arange(len(rows), dtype=np.uint64)
        first, last = [0, 20, 22, 29], [19, 21, 28, 59]
        left, centre, right = passages.compact(packed, rows, first, last, least)
        windows = {c: (a, b) for a, c, b in zip(left.tolist(), centre.tolist(), right.tolist(), strict=True)}
        for a in range(len(rows)):
            for b in range(a + least - 1, len(rows)):
                if rows[a] == rows[b]:
                    c = a + int(packed[a : b + 1].argmin())
                    assert windows[c][0] <= a and b <= windows[c][1]
        assert all(b - a + 1 >= least for a, b in windows.values())


def test_passages(spark, frame, empty):
    configured(spark)
    r = random.Random(7)
    shared = [prose(r, 60), prose(r, 80), prose(r, 51), prose(r, 45)]
    rows = [(i, prose(r, r.randint(10, 200)), "en", "s") for i in range(60)]
    rows += [(100 + i, f"{prose(r, 30)} {shared[i % 3]} {prose(r, 40)}", "en", "s") for i in range(30)]
    rows += [(200 + i, f"{prose(r, 30)} {shared[3]} {prose(r, 30)}", "en", "s") for i in range(5)]
    near = prose(r, 100)
    rows += [(300, near, "en", "s"), (301, f"{prose(r, 20)} {edited(r, near, 1)}", "en", "s"), (302, shared[0].upper(), "en", "s")]
    rows += [(400, None, "en", "s"), (401, "", "en", "s"), (402, "few words", "en", "s"), (0, rows[0][1], "en", "s"), (None, rows[100 - 40][1], "en", "s")]
    got = passages.passages(frame(rows)).collect()
    flagged = {x for g in got for x in (g["doc_id"], g["other_id"])}
    assert flagged == {*range(100, 130), 300, 301, 302}
    for g in got:
        assert g["other_id"] < g["doc_id"] and g["likeness"] >= 0.75 and g["n_words"] >= 50
    texts = {i: words(t) for i, t, _, _ in rows}
    one = next(g for g in got if g["doc_id"] == 302)
    part = texts[one["other_id"]][one["other_start_word"] : one["other_start_word"] + one["other_n_words"]]
    assert part == words(shared[0])
    assert passages.passages(empty).count() == 0


def joined(groups_of, rows):
    """Whether each group of documents is connected by rows of (doc_id, other_id)."""
    root = groups({x for p in rows for x in p} | {x for g in groups_of for x in g}, rows)
    return [len({root[x] for x in g}) == 1 for g in groups_of]


def test_windows_of_a_large_group_meet_by_either_side():
    import numpy as np
    import pyarrow as pa

    def window(doc, right, left):  # (key of min-hash and side, doc, c) by either side
        return [(1000 + right, doc, 30), (2000 + left, doc, 30)]

    # two batches: 1 and 2 agree on the left, 2 and 30 on the right; each side has a large group
    one = [*window(1, 1, 7), *window(2, 2, 7), *[w for d in range(3, 15) for w in window(d, 1, 7)]]
    two = [*window(30, 2, 8), *[w for d in range(31, 45) for w in window(d, 3, 8)]]
    links, rows = [], []
    for batch in (one, two):
        cols, x, y, still = passages._linked([np.array(z) for z in zip(*batch, strict=True)], keep=True)
        links += zip(cols[1][x].tolist(), cols[1][y].tolist(), strict=True)
        rows += [{"key": int(cols[0][i]), "doc": int(cols[1][i]), "c": int(cols[2][i]), "odoc": None, "shift": None, "hi": None} for i in still]
    rows.sort(key=lambda r: (r["key"], r["doc"], r["c"]))
    kinds = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("c", pa.int32()), ("odoc", pa.int64()), ("shift", pa.int32()), ("hi", pa.int32())])
    for n in (1, 3, 1000):  # whatever the cuts between batches
        cuts = [pa.RecordBatch.from_pylist(rows[i : i + n], kinds) for i in range(0, len(rows), n)]
        met = links + [(r["doc"], r["odoc"]) for b in passages._runs(iter(cuts)) for r in b.to_pylist()]
        assert all(a > b for a, b in met) and joined([[*range(1, 15), *range(30, 45)]], met) == [True]


def test_edited_passages_against_brute_force(spark, frame):
    """Passages of 80 words in differing contexts with one or two edits; brute force says which are links."""
    configured(spark)
    r, rows, near = random.Random(37), [], set()
    for k in range(150):
        base = prose(r, 80).split()
        other = list(base)
        for _ in range(r.choice([1, 1, 2])):
            at, how = r.randrange(10, 70), r.choice(["put", "insert", "drop"])
            other[at : at + (how != "insert")] = [] if how == "drop" else [prose(r, 1) + "z"]
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, other)]
        rows += [(2 * k + j, f"{prose(r, 30)} {' '.join(w)} {prose(r, 25)}", "en", "s") for j, w in enumerate((base, other))]
        if 100 * len(sets[0] & sets[1]) >= 75 * len(sets[0] | sets[1]):
            near.add((2 * k + 1, 2 * k))
    rows += [(1000, " ".join(["again"] * 300), "en", "s"), (1001, "now " + " ".join(["again"] * 200), "en", "s")]  # one phrase over and over
    rows += [(1002, None, "en", "s"), (1003, rows[0][1], "en", "s")]
    got = {(g["doc_id"], g["other_id"]) for g in passages.passages(frame(rows)).collect()}
    assert got <= near | {(1003, 0), (1003, 1)}
    assert len(near) > 100 and len(near & got) >= 0.95 * len(near)
    found = {g["doc_id"]: g for g in passages.repeated(frame(rows)).collect()}
    assert set(found) == {x for p in got for x in p}
    assert all(g["group_id"] <= g["doc_id"] and g["n_links"] >= 1 for g in found.values()) and found[1003]["group_id"] == 0


def test_passages_of_boilerplate_in_differing_contexts(spark, frame):
    configured(spark)
    r = random.Random(17)
    one, two, pairs, docs = [], [], [], 0
    for _ in range(120):
        core, x, y, a, b, c = (prose(r, n) for n in (27, 40, 40, 40, 23, 40))
        places = [(one, x, b), *[(one, x, a)] * 13, (two, y, b), *[(two, y, c)] * 13]
        for k, (rows, left, right) in enumerate(places):
            rows.append((docs + k, f"{prose(r, 20)} {left} {core} {right} {prose(r, 20)}", "en", "s"))
        pairs.append([docs, docs + 14])  # of differing batches, they alone share the core and what follows it
        docs += len(places)
    got = {(g["doc_id"], g["other_id"]) for g in passages.passages(frame(one).coalesce(1).union(frame(two).coalesce(1))).collect()}
    assert joined(pairs, got) == [True] * 120


def test_passages_of_a_crowd_that_stand_between_others(spark, frame):
    """Passages of 50 words with 40 in common, taken in turn: neither the first of their crowd nor the one before is alike."""
    configured(spark)
    r, rows, kinds = random.Random(47), [], {}
    for k in range(20):
        core, ends = prose(r, 40), [prose(r, 10) for _ in range(3)]
        for i in range(12):
            rows.append((100 * k + i, f"{prose(r, 20)} {core} {ends[i % 3]} {prose(r, 20)}", "en", "s"))
            kinds.setdefault((k, i % 3), []).append(100 * k + i)
    want = {d: min(kind) for kind in kinds.values() for d in kind}
    for n in (1, 8):
        found = {g["doc_id"]: g for g in passages.repeated(frame(rows).repartition(n, "doc_id")).collect()}
        assert {d: g["group_id"] for d, g in found.items()} == want
        assert all(g["n_words"] == 50 for g in found.values())


def test_passages_between_copies_that_share_one_more(spark, frame):
    configured(spark)
    r = random.Random(27)
    a, b, shared, other = (prose(r, n) for n in (150, 150, 60, 90))
    a, b = f"{a} {shared} {prose(r, 30)}", f"{prose(r, 20)} {shared} {b}"
    rows = [(1, a, "en", "s"), (2, a, "en", "s"), (3, b, "en", "s"), (4, b.upper(), "en", "s")]
    # 11 and 12 share less than each shares with another document around the same place
    left, right = prose(r, 120), prose(r, 120)
    rows += [(11, f"{left} {other} {prose(r, 9)}", "en", "s"), (12, f"{prose(r, 9)} {other} {right}", "en", "s"), (13, f"{left} {other}", "en", "s"), (14, f"{other} {right}", "en", "s")]
    got = {(g["doc_id"], g["other_id"]): g for g in passages.passages(frame(rows)).collect()}
    assert set(got) == {(y, x) for k in (1, 11) for x, y in combinations(range(k, k + 4), 2)}
    assert {g["n_passages"] for g in got.values()} == {1} and got[3, 1]["n_words"] == got[4, 2]["other_n_words"] == 60
    assert got[2, 1]["likeness"] == 1 and got[2, 1]["n_words"] == 240


# -- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert len(names) == 5
    odd = [(10**6, "123 !!"), (10**6 + 1, "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 5)]
    more = spark.createDataFrame(odd, "doc_id long, text string").join(docs.limit(1).drop("doc_id", "text")).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.written(docs.unionByName(more.select(*docs.columns)), "t")
    counts = [kept.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, kept, sf_dir), "t")
        assert kept.columns == columns, name
        counts.append(kept.count())
        if name == "language_id":
            assert counts[-1] == counts[-2] - 2
        if name == "near_dedup":
            sets = [shingle_set(x["text"]) for x in kept.collect()]
            assert not any(100 * len(a & b) >= 75 * len(a | b) for a, b in combinations(sets, 2) if a and b)
        if name == "decontamination":
            items = [x["text"] for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert not any(i in x["text"] for x in kept.collect() for i in items)
    out = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert out.count() == counts[-1]


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
