"""Forms for hot groups equal the plain ones: sweeps, slices and histogram passes."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from talentlake.operators import evaluation, layout, retrieve
from talentlake.session import ship
from talentlake.streaming import state


def beside(blocks):
    """Whether a left and a right block of a page overlap, by all pairs."""
    left = [b for b in blocks if b[0] < 252 and b[1] < 408]
    right = [b for b in blocks if b[0] > 252]
    return len(blocks) >= 6 and len(left) >= 2 and len(right) >= 2 and any(min(a[3], b[3]) - max(a[2], b[2]) > 12 for a in left for b in right)


def test_sweep_equals_all_pairs(spark):
    rng = random.Random(2)
    pages = {}
    for p in range(300):
        size = rng.choice([10, 30, 200, 2000])
        pages[p] = [(x := float(rng.choice([10, 20, 252, 260, 400])), x + rng.choice([50.0, 100.0, 390.0]), y := float(rng.randrange(size)), y + rng.choice([-5.0, 0.0, 5.0, 12.0, 12.5, 13.0, 40.0])) for _ in range(rng.randrange(1, 14))]
    rows = [(p, 600.0, *b, "t") for p, bs in pages.items() for b in bs] + [(999, 600.0, 1.0, 2.0, 3.0, 90.0, "  "), (998, None, None, None, None, None, None)]
    got = {r[0]: r[1] for r in layout.multi_column_join(spark.createDataFrame(rows, "page_id int, width double, x0 double, x1 double, y0 double, y1 double, text string")).collect()}
    assert got == {p: beside(bs) for p, bs in pages.items()} | {999: False, 998: False}
    assert 30 < sum(got.values()) < 270


def test_sweep_of_a_long_page_makes_no_pairs(spark):
    """10,000 blocks that alternate down a page: 25 million pairs, of which none overlaps by enough; then one does."""
    x, y = F.when(F.col("id") % 2 == 0, 10.0).otherwise(300.0), F.col("id") * 20.0
    rows = spark.range(10_000).select(F.lit(1).alias("page_id"), F.lit(600.0).alias("width"), x.alias("x0"), (x + 50).alias("x1"), y.alias("y0"), (y + 19).alias("y1"), F.lit("t").alias("text"))
    assert not layout.multi_column_join(rows).first()["multi_column"]
    taller = rows.withColumn("y1", F.when(F.col("y0") == 4000.0, F.col("y1") + 15).otherwise(F.col("y1")))
    assert layout.multi_column_join(taller).first()["multi_column"]
    plan = layout.multi_column_join(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("slices", [1, 3, 8])
def test_slices_equal_one_window(spark, slices):
    rng = random.Random(slices)
    rows = [(rng.choice(["hot"] * 9 + ["x", "y"]), rng.choice([None, *[rng.randrange(-500, 3000) for _ in range(30)]]), i) for i in range(3000)] + [(None, 5, -1), (None, None, -2)]
    events = spark.createDataFrame(rows, "who string, epoch long, slice_ int")
    got = {r["slice_"]: r["n_trailing"] for r in state.trailing_count(events, "who", "epoch", 60, slices).collect()}
    plain = events.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("who").orderBy("epoch").rangeBetween(-60, 0)))
    assert got == {r["slice_"]: r["n"] for r in plain.collect()}


def test_hot_key_is_spread(spark):
    events = spark.range(20_000).select(F.when(F.col("id") < 19_000, "hot").otherwise("x").alias("who"), F.col("id").alias("epoch"))
    out = state.trailing_count(events, "who", "epoch", 10, 8)
    assert out.count() == 20_000 and out.where("epoch % 19000 >= 10 and n_trailing != 11").count() == 0
    keys = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(who" in keys and "slice_" in keys.split("hashpartitioning(who")[1][:40]


@pytest.mark.parametrize("kind", ["even", "ties", "tails", "far"])
def test_percentiles_by_passes(spark, kind):
    ship(spark)
    rng = np.random.default_rng(4)
    n = 4000
    values = {"even": rng.random(n), "ties": rng.integers(0, 5, n).astype(float), "tails": rng.standard_cauchy(n) * 1e6, "far": np.concatenate((rng.random(n - 2), [1e308, -1e308]))}[kind]
    rows = [("hot", float(v)) for v in values] + [("few", float(v)) for v in values[:7]] + [(None, 1.0), (None, 3.0), ("none", None), ("inf", float("inf")), ("inf", 1.0)] + [("same", 2.5)] * 300
    frame = spark.createDataFrame(rows, "g string, x double").repartition(5)
    ask = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r["g"]: r["q"] for r in evaluation.exact_percentiles(frame, "x", ask, "g", at_once=100).collect()}
    assert got["hot"] == pytest.approx(np.quantile(values, ask).tolist(), rel=1e-12) and got["few"] == pytest.approx(np.quantile(values[:7], ask).tolist())
    assert got[None] == pytest.approx([1.0, 1.5, 2.0, 2.9, 3.0]) and got["same"] == [2.5] * 5 and got["none"] is None and got["inf"][0] == 1.0
    whole = evaluation.exact_percentiles(frame.where("g = 'hot'"), "x", ask, at_once=100).first()["q"]
    assert whole == pytest.approx(got["hot"], rel=1e-12)


@pytest.mark.parametrize(("common", "k"), [(0, 3), (2, 1), (4, 3), (8, 5)])
def test_best_items_with_common_tokens(spark, common, k):
    """Masks, rare tokens and ties of ids against a ranking of all pairs."""
    rng = random.Random(k)
    words = ["alpha", "beta", "gamma", "delta", *[f"rare{n}" for n in range(60)]]
    text = lambda: " ".join([w for w in words[:4] if rng.random() < 0.7] + rng.sample(words[4:], rng.randrange(0, 4)))
    items, queries = {n: text() for n in range(400)}, {n: text() for n in range(60)} | {90: "nothing here", 91: "", 92: "alpha"}
    frame = lambda rows, key: spark.createDataFrame(list(rows.items()) + [(-1, None)], f"{key} int, text string").repartition(3)
    got = {}
    for r in retrieve.top_k(frame(queries, "query_id"), frame(items, "item_id"), k, common=common).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"], r["overlap"]))
    for key, q in queries.items():
        shared = sorted((-len({*q.split()} & {*t.split()}), n) for n, t in items.items())
        want = [(rank, n, -s) for rank, (s, n) in enumerate([x for x in shared if x[0] < 0][:k], 1)]
        assert sorted(got.get(key, [])) == want, key
    assert -1 not in got


def test_tokens_of_all_items_are_not_joined(spark):
    """Every item has the same two tokens: the join gets none of them."""
    items = spark.range(5000).select(F.col("id").alias("item_id"), F.concat(F.lit("shared words "), F.lit("own"), F.col("id")).alias("text"))
    queries = spark.createDataFrame([(1, "shared words"), (2, "shared own77"), (3, "own77 own78 shared words")], "query_id int, text string")
    got = {(r["query_id"], r["rank"]): (r["item_id"], r["overlap"]) for r in retrieve.top_k(queries, items, 2).collect()}
    assert got == {(1, 1): (0, 2), (1, 2): (1, 2), (2, 1): (77, 2), (2, 2): (0, 1), (3, 1): (77, 3), (3, 2): (78, 3)}
    tokens = retrieve.common_tokens(items.select("item_id", F.split("text", " ").alias("tokens")))
    assert tokens == ["shared", "words"]


def test_top_k_ways_agree(spark):
    """A small side of queries or of items in every task, and the join, all give what brute force gives."""
    rng = random.Random(3)
    words = [f"w{i:02d}x" for i in range(30)]
    queries = {n: " ".join(rng.choices(words, k=rng.randrange(0, 6))) for n in range(12)} | {90: None}
    items = {n * 7 % 101: " ".join(rng.choices(words, k=rng.randrange(0, 9))) for n in range(60)} | {900: None}
    sets = lambda rows: {k: set((v or "").split()) for k, v in rows.items()}
    q, i, want = sets(queries), sets(items), set()
    for a in q:
        ranked = sorted((-len(q[a] & i[b]), b) for b in i if q[a] & i[b])[:3]
        want |= {(a, b, -n, at + 1) for at, (n, b) in enumerate(ranked)}
    frame = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} long, text string").repartition(5)
    few_pairs = {}
    for most in (0, 20, 1000):
        found = retrieve.top_k(frame(queries, "query_id"), frame(items, "item_id"), most_few=most)
        assert {tuple(r) for r in found.select("query_id", "item_id", "overlap", "rank").collect()} == want
        few_pairs[most] = "MapInArrow" in found._jdf.queryExecution().toString()
    assert few_pairs == {0: False, 20: True, 1000: True}


def test_blocks_of_retrieval(monkeypatch):
    """Rows are counted alike however a batch is cut."""
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7, 8, 9]), pa.array([["a", "b"], None, [], ["b", "x"], ["c", "a"]])], ["id", "tokens"])
    for cells in (1, 6, 10**6):
        monkeypatch.setattr(retrieve, "CELLS", cells)
        found = list(retrieve._blocks(iter([batch.slice(1), batch.slice(0, 1)]), [["a", "b"], ["b", "c"], []]))
        assert [x for ids, _ in found for x in ids.to_pylist()] == [6, 7, 8, 9, 5]
        assert np.concatenate([n for _, n in found]).tolist() == [[0, 0, 0], [0, 0, 0], [1, 1, 0], [1, 1, 0], [2, 1, 0]]
