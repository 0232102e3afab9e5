"""Top-k retrieval by shared tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from talentlake.functions.text import rag_tokens

#: Tokens at most that are summed by masks instead of being joined, and the share of items from which on a token is one.
COMMON, COMMON_SHARE = 8, 0.02
#: Parts that a ranking is cut into before its best rows meet.
SALTS = 64


def _first(rows: DataFrame, k: int, by: list[str], order: list[Column], salt: str) -> DataFrame:
    """The first k rows of each group with `rank`, in two steps, so that a large group is spread over many tasks."""
    part = F.pmod(F.xxhash64(salt), F.lit(SALTS))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by, part).orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


#: Rows of a side, and cells of its table of rows and tokens, up to which each task compares its rows of the other side
#: with all of them; cells of a block of rows there.
FEW, FEW_CELLS, CELLS = 1000, 4_000_000, 4_000_000


def _few(rows: DataFrame, key: str, most: int) -> list | None:
    """(id, tokens) of a small side in the order of its ids; null if it is large, or an id is missing or repeated. The other
    way serves then."""
    if rows.select(key).limit(most + 1).count() > most:
        return None
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.size("tokens"))).first()
    if n * (size or 0) > FEW_CELLS:
        return None
    got = [(r[0], r[1] or []) for r in rows.select(key, "tokens").orderBy(key).collect()]  # `most` rows
    return got if got and None not in {i for i, _ in got} and len({i for i, _ in got}) == len(got) else None


def _blocks(batches: Iterator[pa.RecordBatch], tokens: list[list[str]]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, overlaps with each of the small side's token sets) of blocks of rows (id, tokens)."""
    names = pa.array(sorted({w for t in tokens for w in t}), pa.string())
    place = {w: n for n, w in enumerate(names.to_pylist())}
    table = np.zeros((len(place), len(tokens)), np.float32)
    for n, own in enumerate(tokens):
        table[[place[w] for w in own], n] = 1
    step = max(1, CELLS // max(1, len(place), len(tokens)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            own = pc.index_in(pc.list_flatten(part.column(1)), names)
            row = pc.list_parent_indices(part.column(1)).to_numpy()
            known = own.is_valid().to_numpy(zero_copy_only=False)
            has = np.zeros((part.num_rows, len(place)), np.float32)
            has[row[known], own.drop_null().to_numpy()] = 1
            yield part.column(0), (has @ table).astype(np.int64)


def _by_few_queries(q: list, i: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, overlap): of each task's items those that can be among a query's first k, k a query at most."""
    tokens = [t for _, t in q]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        overlap, item = np.zeros((0, len(tokens)), np.int64), np.zeros((0, len(tokens)), np.int64)
        for ids, n in _blocks(batches, tokens):
            ids = ids.cast(pa.int64()).to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, n = ids[order], n[order]
            # more in common first, then the smaller id, which is the earlier row
            keys = n * len(ids) + np.arange(len(ids))[::-1, None]
            top = np.argpartition(keys, max(0, len(ids) - k), 0)[-k:]
            overlap, item = np.concatenate((overlap, np.take_along_axis(n, top, 0))), np.concatenate((item, ids[top]))
            first = np.lexsort((item, -overlap), 0)[:k]
            overlap, item = np.take_along_axis(overlap, first, 0), np.take_along_axis(item, first, 0)
        _, query = np.nonzero(overlap)
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(item[overlap > 0]), pa.array(overlap[overlap > 0])], ["few", "item_id", "overlap"])

    found = i.select(F.col("item_id").cast("long"), "tokens").mapInArrow(best, "few int, item_id long, overlap long")
    return found.withColumn("item_id", F.col("item_id").cast(i.schema["item_id"].dataType))


def _by_few_items(q: DataFrame, i: list, k: int, empty: bool) -> DataFrame:
    """(query_id, item_id, overlap) of each query's first k items."""
    tokens = [t for _, t in i]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n in _blocks(batches, tokens):
            top = np.argsort(-n, 1, kind="stable")[:, :k]
            overlap = np.take_along_axis(n, top, 1)
            row, at = np.nonzero((overlap > 0) | empty)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(top[row, at].astype(np.int32)), pa.array(overlap[row, at])], ["query_id", "few", "overlap"])

    kind = q.schema["query_id"].dataType.simpleString()
    return q.select("query_id", "tokens").mapInArrow(best, f"query_id {kind}, few int, overlap long")


def _named(found: DataFrame, few: list, side: DataFrame, key: str) -> DataFrame:
    """found with the ids of the small side for their numbers."""
    ids = found.sparkSession.createDataFrame([(n, i) for n, (i, _) in enumerate(few)], StructType([StructField("few", IntegerType()), side.schema[key]]))
    return found.join(F.broadcast(ids), "few").select("query_id", "item_id", "overlap")


def common_tokens(items: DataFrame, most: int = COMMON, share: float = COMMON_SHARE) -> list[str]:
    """The most frequent tokens of items (item_id, tokens), `most` at most, of those that a share of all items has."""
    n = items.count()
    counts = items.select(F.explode("tokens").alias("token")).groupBy("token").count()
    return [r["token"] for r in counts.where(F.col("count") > share * n).orderBy(F.desc("count"), "token").limit(most).collect()]


def top_k(queries: DataFrame, items: DataFrame, k: int = 3, empty: bool = False, common: int = COMMON, share: float = COMMON_SHARE, most_few: int = FEW) -> DataFrame:
    """(query_id, item_id, overlap, rank): each query's k items by falling overlap of tokens, then by item_id.

    queries: query_id, text; items: item_id, text. The tokens that most items have are bits of a mask: two texts share as
    many of them as their masks have bits in common. The other tokens meet in an equi-join and are summed. Of items that
    share common tokens alone with a query, only the first k of each mask can be among its best: such with more tokens in
    common, or with smaller ids, stand before the others. So all pairs of a token that all items share are never made, and
    the result is exact. With empty, for small sets of items, the first items fill up what shares none.

    Where one side is small, it goes to every task instead, which counts what its rows of the other side share with all of
    it and keeps the first k a query: no pair is shuffled that can't be in the result. Items
    without an id count as one, the last of equals."""
    q = queries.select("query_id", rag_tokens(F.col("text")).alias("tokens"))
    i = items.select("item_id", rag_tokens(F.col("text")).alias("tokens"))
    last = [F.desc("overlap"), F.asc_nulls_last("item_id")]
    few = _few(i, "item_id", most_few)
    if few is not None:
        # all of a query is in one task from here on; a repeated query counts once
        pairs = _named(_by_few_items(q, few, k, empty), few, i, "item_id").repartition("query_id").groupBy("query_id", "item_id").agg(F.max("overlap").alias("overlap"))
        ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*last)))
        return ranked.where(F.col("rank") <= k).select("query_id", "item_id", "overlap", "rank")
    whole = i.schema["item_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    few = _few(q, "query_id", most_few) if whole and not empty else None
    if few is not None:
        pairs = _named(_by_few_queries(few, i.where("item_id is not null"), k), few, q, "query_id").groupBy("query_id", "item_id").agg(F.max("overlap").alias("overlap"))
        nameless = i.where("item_id is null").select("item_id", F.explode("tokens").alias("token"))
        asked = q.select("query_id", F.explode("tokens").alias("token"))
        pairs = pairs.unionByName(asked.join(nameless, "token").groupBy("query_id", "item_id").agg(F.count(F.lit(1)).alias("overlap")))
        return _first(pairs, k, ["query_id"], last, "item_id").select("query_id", "item_id", "overlap", "rank")
    hot = common_tokens(i, common, share)

    def split(rows: DataFrame, key: str, mask: str) -> DataFrame:
        bits = [F.when(F.array_contains("tokens", t), 1 << n).otherwise(0) for n, t in enumerate(hot)]
        rest = F.array_except("tokens", F.array(*[F.lit(t) for t in hot])) if hot else F.col("tokens")
        return rows.select(key, sum(bits, F.lit(0)).alias(mask), rest.alias("tokens"))

    q, i = split(q, "query_id", "q_mask"), split(i, "item_id", "i_mask")
    rare = q.select("query_id", "q_mask", F.explode("tokens").alias("token")).join(i.select("item_id", "i_mask", F.explode("tokens").alias("token")), "token")
    met = rare.groupBy("query_id", "item_id", "q_mask", "i_mask").agg(F.count(F.lit(1)).alias("n"))
    found = met.select("query_id", "item_id", (F.col("n") + F.bit_count(F.col("q_mask").bitwiseAND(F.col("i_mask")))).alias("overlap"))
    if hot:
        ids = _first(i.where("i_mask > 0 and item_id is not null").select("item_id", "i_mask"), k, ["i_mask"], [F.col("item_id")], "item_id").drop("rank")
        each = ids.withColumn("q_mask", F.explode(F.sequence(F.lit(1), F.lit((1 << len(hot)) - 1))))  # 2 ** common masks, k items each
        shared = each.withColumn("overlap", F.bit_count(F.col("q_mask").bitwiseAND(F.col("i_mask"))).cast("long")).where("overlap > 0")
        best = _first(shared.select("q_mask", "item_id", "overlap"), k, ["q_mask"], [F.desc("overlap"), F.col("item_id")], "item_id").drop("rank")
        alike = q.select("query_id", "q_mask").join(F.broadcast(best), "q_mask").select("query_id", "item_id", "overlap")
        found = found.unionByName(alike).groupBy("query_id", "item_id").agg(F.max("overlap").alias("overlap"))
    if empty:
        few = items.orderBy("item_id").limit(k).select("item_id")  # k rows
        rest = queries.select("query_id").distinct().withColumn("i", F.explode(F.lit([r["item_id"] for r in few.collect()]))).select("query_id", F.col("i").alias("item_id"))
        found = found.unionByName(rest.join(found, ["query_id", "item_id"], "left_anti").withColumn("overlap", F.lit(0).cast("long")))
    return _first(found, k, ["query_id"], last, "item_id").select("query_id", "item_id", "overlap", "rank")
