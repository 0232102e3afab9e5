"""Near-duplicate lines by an exact set-similarity join, in DataFrame functions alone.

A line is the set of its lower-cased words. Words are ordered by rarity: by the size class of the count that their hash
bucket has in the corpus (BUCKETS counts, a table of fixed size), then by hash. Lines of equal sets are one class, named by
its first line. Of two classes with a Jaccard likeness of NEED/OF, the one of more words has a word of its probing prefix
(the first n - ceil(n * NEED/OF) + 1) in the indexing prefix of the other (its first n - ceil(n * 2 * NEED/(OF + NEED)) + 1).
Pairs that share one pass the length filter, the positional filter (enough words are left behind the shared one) and a
filter on 128 bits of their words; what is left is verified on the lines' words, which travel once for many pairs, so all
links between classes are found. A line is removed if an earlier line equals or resembles it, removed or not.

Links within a crowd of near copies are counted, not listed. A crowd has a centre, the words that most of its lines have, and
a line differs from it by few words. Two lines that differ from the centre by no common word differ from each other by both
numbers together, so that one number a line, its slack, tells whether they are linked, and a line's links are those of a
histogram of slacks. Only pairs that would be linked by words that both differ in are joined, on these words. Which lines make
a crowd is a matter of cost alone: pairs across crowds, and with lines of none, go by the prefix words.

Words that a bucket counts once are in one line alone and are not joined. Words are told apart by 64-bit hashes, in the join
by 32-bit numbers, which only lets more pairs meet, and as they are when a pair is verified; equal sets are told by a 64-bit
hash of their words' hashes.

Defined results: null and blank texts and lines have no row; repeated rows with one id are lines of one document, whose
equal numbers are equal places; a null id comes first; an empty table gives an empty table; lines of any length are whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.llm._util import BROADCAST_ROWS, fresh, lookup, written

NEED, OF = 75, 100
#: Buckets of words whose counts order them, and buckets that a row of the collected table has.
BUCKETS, PER_ROW = 1 << 18, 1 << 10
#: Pairs that are verified beside each other, from one copy of their lines.
CELL_PAIRS = 4096
#: Lines that make a crowd, and the rarest shared words of a line by which it finds one.
CROWD, RAREST = 16, 4
#: Places of a set's words, from the rarest, that are in no other line.
ALONE = -31 << 26


def line_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, line_no, mark, words) of lines that have a word; lines are numbered from 1, blank ones included. A line's mark
    is its hash, which tells it from lines of other rows with its id."""
    each = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.posexplode(F.split(F.lower(F.col(text)), "\n", -1)).alias("i", "line"))
    rows = each.select("doc_id", (F.col("i") + 1).alias("line_no"), F.xxhash64("line").alias("mark"), F.array_remove(F.split("line", " ", -1), "").alias("words"))
    return rows.where(F.size("words") > 0)


def _classes_of_counts(lines: DataFrame) -> list[int]:
    """By bucket of word hashes, 0 for a count of up to one, else one more than 2.25 times the count's binary logarithm, 63 at most."""
    found = lines.select(F.explode("words").alias("w")).groupBy(F.xxhash64("w").bitwiseAND(BUCKETS - 1).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sized = found.select("b", F.least(F.lit(63), F.when(F.col("n") > 1, 1 + F.floor(2.25 * F.log2("n"))).otherwise(0)).cast("int").alias("c"))
    pairs = F.transform(F.collect_list(F.struct("b", "c")), lambda x: F.concat_ws(":", x["b"], x["c"]))
    out = [0] * BUCKETS
    for row in sized.groupBy((F.col("b") / PER_ROW).cast("int")).agg(F.array_join(pairs, ",").alias("s")).collect():  # BUCKETS / PER_ROW rows
        for pair in row["s"].split(","):
            b, c = pair.split(":")
            out[int(b)] = int(c)
    return out


def _ranked(words: Column, classes: list[int]) -> Column:
    """A line's set: its distinct words as 64-bit numbers, sorted, whose order is that of rarity: the bucket's class, less 32,
    then 58 bits of the hash."""
    known = F.split(F.lit(",".join(str(c - 32) for c in classes)), ",").cast("array<tinyint>")
    rank = lambda h: F.shiftleft(F.coalesce(F.get(known, h.bitwiseAND(BUCKETS - 1).cast("int")).cast("long"), F.lit(0).cast("long")), 58).bitwiseOR(F.shiftrightunsigned(h, 6))
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: rank(F.xxhash64(w)))))


def _prefix(ranked: Column, length: Column) -> Column:
    """The first of a set's numbers, as their upper 32 bits. Words of one number only meet more pairs, as a prefix is cut from
    all numbers, repeated ones included."""
    return F.transform(F.slice(ranked, F.lit(1), length), lambda x: F.shiftright(x, 32).cast("int"))


def _bits(ranked: Column, half: int) -> Column:
    """One half of 128 bits of a set: whether the words whose number has `half` in its place 6 are odd in number, by 64 places.
    Two sets differ in as many words at least as in bits."""
    own = lambda x: F.shiftrightunsigned(x if half else F.bitwise_not(x), 6).bitwiseAND(1)
    return F.aggregate(ranked, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", own(x), x.bitwiseAND(63).cast("int"))))


def _whole(over: Column, under: int) -> Column:
    """The quotient of whole numbers, rounded up, without decimals."""
    return F.call_function("div", over + (under - 1), F.lit(under))


def _near_enough() -> Column:
    """Whether sets a and b may be linked, by their sizes and bits."""
    n, m = F.col("a.n"), F.col("b.n")
    differ = lambda half: F.bit_count(F.col(f"a.{half}").bitwiseXOR(F.col(f"b.{half}")))
    long_enough = F.least(n, m) * OF >= F.greatest(n, m) * NEED
    return long_enough & (differ("low") + differ("high") <= n + m - 2 * _whole((n + m) * NEED, OF + NEED))


def _may_link() -> Column:
    """Whether rows a and b of prefix words, of one token, may be of linked classes; all is asked of both sides at once, so
    that a table joined with itself remains one exchange."""
    n, m, i, j = F.col("a.n"), F.col("b.n"), F.col("a.at"), F.col("b.at")
    overlap = _whole((n + m) * NEED, OF + NEED)  # words that a link needs in common
    shorter, place = F.least(n, m), F.when(n <= m, i).otherwise(j)
    indexed = place < shorter - _whole(shorter * (2 * NEED), OF + NEED) + 1  # the indexing prefix of the shorter one
    positional = F.least(n - i, m - j) >= overlap
    return indexed & positional & _near_enough()


def _candidates(tokens: DataFrame) -> DataFrame:
    """(a, b) of classes that may be linked, from their prefix words (token, digest, n, at, low, high); at counts from 0."""
    order = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.digest") < F.col("b.digest")))
    met = tokens.alias("a").join(tokens.alias("b"), (F.col("a.token") == F.col("b.token")) & order & _may_link())
    return met.select(F.col("a.digest").alias("a"), F.col("b.digest").alias("b")).distinct()


def _crowded(rows: DataFrame) -> DataFrame:
    """(digest, crowd) of classes that are probably one of CROWD near copies at least. Of the classes that hold one of a
    class's rarest shared words, the one of the least digest is looked at; a class follows the least one that may be alike."""
    shared = F.slice(F.filter("prefix", lambda t: t >= ALONE), 1, RAREST)
    held = rows.select("digest", "n", "low", "high", F.explode(shared).alias("token"))
    first = held.groupBy("token").agg(F.min("digest").alias("digest"), F.max("digest").alias("last"), F.count(F.lit(1)).alias("held"))
    first = written(first.where((F.col("held") >= CROWD // 2) & (F.col("digest") < F.col("last"))).select("token", "digest"), "line-first")
    heads = lookup(rows.select("digest", "n", "low", "high"), written(first.select("digest").distinct(), "line-heads"), ["digest"], "left_semi").distinct()
    known = written(first.join(heads, "digest").select("token", F.struct("digest", "n", "low", "high").alias("b")), "line-known")
    follow = lookup(held, known, ["token"], "inner").select("digest", F.struct("n", "low", "high").alias("a"), "b").where(_near_enough())
    led = follow.groupBy("digest").agg(F.min("b.digest").alias("crowd"))
    led = written(led, "line-led")
    many = written(led.groupBy("crowd").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CROWD).select("crowd"), "line-crowds")
    return lookup(led, many, ["crowd"], "left_semi")


def _tokens(sets: DataFrame) -> DataFrame:
    """The prefix words of sets (.., prefix) that are in other lines as well, as (.., at, token)."""
    return sets.select(*[c for c in sets.columns if c != "prefix"], F.posexplode("prefix").alias("at", "token")).where(F.col("token") >= ALONE)


def _sized(named: list[str], h: Column) -> list[Column]:
    """Columns n, prefix, low and high of a set's numbers, behind others."""
    n = F.size(h)
    return [*named, n.alias("n"), _prefix(h, n - _whole(n * NEED, OF).cast("int") + 1).alias("prefix"), _bits(h, 0).alias("low"), _bits(h, 64).alias("high")]


def _merged(centres: DataFrame, ranked: Callable) -> tuple[DataFrame, DataFrame]:
    """(crowd, centre) from (crowd, centre, size) without crowds whose centre is near that of a larger one, and the centres'
    prefix words. Centres meet as lines do."""
    sets = centres.select(F.col("crowd").alias("digest"), ranked(F.col("centre")).alias("h"))
    tokens = written(_tokens(sets.select(*_sized(["digest"], F.col("h")))), "line-centre-words")
    one = lambda x: centres.select(F.col("crowd").alias(x), F.struct("size", "crowd", "centre").alias(f"{x}_"))
    met = tokens.alias("a").join(tokens.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.digest") < F.col("b.digest")) & _may_link())
    pairs = met.select(F.col("a.digest").alias("a"), F.col("b.digest").alias("b")).distinct().join(one("a"), "a").join(one("b"), "b")
    x, y = F.col("a_.centre"), F.col("b_.centre")
    apart = F.size(x) + F.size(y) - 2 * F.size(F.array_intersect(x, y))
    close = pairs.where(apart * (OF + NEED) * 2 <= (F.size(x) + F.size(y)) * (OF - NEED))
    less = written(close.select(F.array_min(F.array("a_", "b_"))["crowd"].alias("crowd")).distinct(), "line-less")
    left = written(lookup(centres.select("crowd", "centre"), less, ["crowd"], "left_anti"), "line-centres")
    return left, written(lookup(tokens, less.select(F.col("crowd").alias("digest")), ["digest"], "left_anti"), "line-head-words")


def _centres(crowded: DataFrame, classes: DataFrame, docs: DataFrame, ranked: Callable) -> tuple[DataFrame, DataFrame]:
    """(crowd, centre) of crowds, and the centres' prefix words; the centre is the words that over half of its lines have."""
    held = written(_words(crowded.join(classes, "digest"), docs, ["crowd"]).select("crowd", "words"), "line-crowded")
    size = written(held.groupBy("crowd").agg(F.count(F.lit(1)).alias("size")), "line-sizes")
    count = held.select("crowd", F.explode("words").alias("w")).groupBy("crowd", "w").agg(F.count(F.lit(1)).alias("n"))
    usual = lookup(count, size, ["crowd"], "inner").where(F.col("n") * 2 > F.col("size"))
    return _merged(written(usual.groupBy("crowd").agg(F.collect_list("w").alias("centre")).join(size, "crowd"), "line-usual"), ranked)


def _members(rows: DataFrame, centres: DataFrame, heads: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Classes that are near a crowd's centre (digest, crowd, place, n, slack, differ). They meet the centres as lines meet."""
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_ROWS else heads
    met = _tokens(rows.select("digest", "n", "low", "high", "prefix")).alias("a").join(heads.alias("b"), (F.col("a.token") == F.col("b.token")) & _may_link())
    bits = F.bit_count(F.col("a.low").bitwiseXOR(F.col("b.low"))) + F.bit_count(F.col("a.high").bitwiseXOR(F.col("b.high")))
    near = met.select("a.digest", F.struct(bits.alias("bits"), F.col("b.digest").alias("crowd")).alias("c")).groupBy("digest").agg(F.min("c").alias("c")).select("digest", "c.crowd")
    held = _words(near.join(classes, "digest"), docs, ["crowd", "doc_id"]).dropDuplicates(["digest"])
    both = lookup(held, centres, ["crowd"], "inner")
    apart = both.select("digest", "crowd", F.struct("doc_id", "line_no").alias("place"), F.size("words").alias("n"), F.array_union(F.array_except("words", "centre"), F.array_except("centre", "words")).alias("differ"))
    slack = F.col("n").cast("long") * (OF - NEED) - F.size("differ") * (OF + NEED)
    # others are no copies of the centre; their links are found by their prefix words
    return written(apart.withColumn("slack", slack).where(F.col("slack") + F.col("n") * (OF - NEED) >= 0), "line-members")


def _counted_links(members: DataFrame) -> DataFrame:
    """(digest, n_links, late) of links within crowds that need no common word of difference: slacks that are 0 together at
    least. A crowd's histogram has a row for each slack, not for each class."""
    bins = members.groupBy("crowd", "slack").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    table = written(bins.groupBy("crowd").agg(F.collect_list(F.struct("slack", "n", "first")).alias("bins")), "line-slacks")
    near = F.filter("bins", lambda x: x["slack"] + F.col("slack") >= 0)
    seen = lookup(members.select("digest", "crowd", "place", "slack"), table, ["crowd"], "inner").withColumn("near", near)
    own = F.when(F.col("slack") >= 0, 1).otherwise(0)
    n = F.aggregate("near", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]) - own
    return seen.select("digest", n.alias("n_links"), F.exists("near", lambda x: x["first"] < F.col("place")).alias("late")).where("n_links > 0")


def _joined_links(members: DataFrame) -> DataFrame:
    """(a, b) of links within crowds that common words of difference make: each brings both sets closer by two words."""
    words = members.select("crowd", "digest", "slack", F.size("differ").alias("d"), F.explode("differ").alias("w"))
    gain = 2 * (OF + NEED)
    slack = F.col("a.slack") + F.col("b.slack")
    wanted = (slack < 0) & (slack + F.least("a.d", "b.d") * gain >= 0) & (F.col("a.digest") < F.col("b.digest"))
    met = words.alias("a").join(words.alias("b"), (F.col("a.crowd") == F.col("b.crowd")) & (F.col("a.w") == F.col("b.w")) & wanted)
    common = met.groupBy(F.col("a.digest").alias("a"), F.col("b.digest").alias("b")).agg(F.first(slack).alias("slack"), F.count(F.lit(1)).alias("common"))
    return common.where(F.col("slack") + F.col("common") * gain >= 0).select("a", "b")


def _across(tokens: DataFrame, others: DataFrame, members: DataFrame, centres: DataFrame) -> DataFrame:
    """(a, b) of classes that may be linked, of which one or both are members of crowds, but not of the same: from the prefix
    words of members (with crowd) and of others. Crowds whose centres are too far apart for any of their members don't meet."""
    pair = (F.col("a.digest").alias("a"), F.col("b.digest").alias("b"))
    mixed = others.alias("a").join(tokens.alias("b"), (F.col("a.token") == F.col("b.token")) & _may_link()).select(*pair)
    far = F.max(F.col("n") * (OF - NEED) + F.size("differ") * (OF + NEED)).alias("reach")
    reach = members.groupBy("crowd").agg(far).join(centres, "crowd")
    held = tokens.select("token", "crowd").distinct()
    meet = held.alias("a").join(held.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.crowd") < F.col("b.crowd"))).select(F.col("a.crowd").alias("ca"), F.col("b.crowd").alias("cb")).distinct()
    sides = meet.join(reach.select(F.col("crowd").alias("ca"), F.col("reach").alias("ra"), F.col("centre").alias("x")), "ca").join(reach.select(F.col("crowd").alias("cb"), F.col("reach").alias("rb"), F.col("centre").alias("y")), "cb")
    apart = F.size("x") + F.size("y") - 2 * F.size(F.array_intersect("x", "y"))
    close = written(sides.where(F.col("ra") + F.col("rb") >= apart * (OF + NEED)).select("ca", "cb"), "line-close")
    one = close.join(tokens.withColumnRenamed("crowd", "ca"), "ca").alias("a")
    two = one.join(tokens.alias("b"), (F.col("a.cb") == F.col("b.crowd")) & (F.col("a.token") == F.col("b.token")) & _may_link()).select(*pair)
    return mixed.union(two).distinct()


def _placed(pairs: DataFrame) -> DataFrame:
    """pairs with a cell: pairs of one neighbourhood share it, so that a line's words travel once a cell and not once a pair.

    A class's home is the least digest among it and those that it is paired with, a pair's the lesser of its classes'. A home
    of over CELL_PAIRS pairs is cut into blocks by both classes."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("digest"), "b"), F.struct(F.col("b").alias("digest"), F.col("a").alias("b")))).alias("e"))
    homes = written(ends.groupBy("e.digest").agg(F.least("e.digest", F.min("e.b")).alias("home")), "line-homes")
    one = pairs.join(homes.select(F.col("digest").alias("a"), F.col("home").alias("ha")), "a").join(homes.select(F.col("digest").alias("b"), F.col("home").alias("hb")), "b")
    at_home = written(one.select("a", "b", F.least("ha", "hb").alias("home")), "line-homed")
    large = at_home.groupBy("home").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_PAIRS).select("home", F.ceil(F.sqrt(F.col("n") / CELL_PAIRS)).alias("side"))
    side = F.coalesce("side", F.lit(1).cast("long"))
    return lookup(at_home, written(large, "line-large"), ["home"]).select("a", "b", F.xxhash64("home", F.pmod("a", side), F.pmod("b", side)).alias("cell"))


def _words(sides: DataFrame, docs: DataFrame, keep: list[str]) -> DataFrame:
    """(digest, line_no, words) and columns to keep of classes (digest, doc_id, line_no, mark), from the documents' texts."""
    carried = [c for c in keep if c != "doc_id"]
    wanted = sides.groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "digest", "mark", *carried)).alias("wanted"))
    texts = lookup(docs, written(wanted, "line-wanted"), ["doc_id"], "inner", hot=False)
    parts = texts.select("doc_id", F.split(F.lower("text"), "\n", -1).alias("l"), F.explode("wanted").alias("w"))
    # rows that share an id may have other texts at the same place, or the same words again
    own = parts.select("doc_id", "w.*", F.get("l", F.col("w.line_no") - 1).alias("line")).where(F.xxhash64("line") == F.col("mark"))
    return own.select("digest", "line_no", *keep, F.array_distinct(F.array_remove(F.split("line", " ", -1), "")).alias("words"))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (a, b) of class digests that are alike, from the lines' words."""
    placed = written(_placed(pairs), "line-placed")
    cells = placed.select("cell", F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.collect_set("cell").alias("cells"))
    own = _words(cells.join(classes, "digest"), docs, ["cells"]).select(F.explode("cells").alias("cell"), F.struct("digest", F.sort_array("words").alias("words")).alias("side"))
    at = own.groupBy("cell").agg(F.map_from_entries(F.collect_set("side")).alias("held"))
    both = placed.join(at, "cell").select("a", "b", F.element_at("held", F.col("a")).alias("x"), F.element_at("held", F.col("b")).alias("y"))
    alike = F.size(F.array_intersect("x", "y")) * (OF + NEED) >= (F.size("x") + F.size("y")) * NEED
    return both.where(alike).select("a", "b")


def near_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per line: doc_id, line_no, class_doc_id and class_line_no (the first line of equal words), n_links (other
    classes that resemble its class), removed."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    lines = line_rows(docs)
    counts = _classes_of_counts(lines)
    ranked = lambda words: _ranked(words, counts)
    hashed = lines.select("doc_id", "line_no", "mark", ranked(F.col("words")).alias("h"))
    rows = written(hashed.select(*_sized(["doc_id", "line_no", "mark", F.xxhash64("h").alias("digest")], F.col("h"))), "line-rows")
    classes = written(rows.groupBy("digest").agg(F.min(F.struct("doc_id", "line_no", "mark")).alias("f")).select("digest", "f.*"), "line-classes")
    centres, heads = _centres(_crowded(rows), classes, docs, ranked)
    members = _members(rows, centres, heads, classes, docs)

    crowds = written(members.select("digest", "crowd"), "line-crowd")
    taken = crowds.count()
    sets = lambda r: r.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("n", "prefix", "low", "high")])
    bare = rows.select("digest", "n", "prefix", "low", "high")
    alone = _tokens(sets(lookup(bare, crowds.select("digest"), ["digest"], "left_anti", rows=taken) if taken else bare))
    pairs = _candidates(alone)
    if taken:
        in_crowds = written(sets(lookup(bare, crowds.select("digest"), ["digest"], "left_semi", rows=taken)).join(crowds, "digest"), "line-in-crowds")
        tokens = _tokens(in_crowds)
        near = alone.join(tokens.select("token").distinct(), "token", "left_semi")
        pairs = pairs.union(_across(tokens, near, members, centres))
    links = _verified(written(pairs, "line-pairs"), classes, docs).union(_joined_links(members))

    places = classes.select("digest", F.struct("doc_id", "line_no").alias("place"))
    sided = written(links, "line-links").join(places.select(F.col("digest").alias("a"), F.col("place").alias("pa")), "a").join(places.select(F.col("digest").alias("b"), F.col("place").alias("pb")), "b")
    ends = F.explode(F.array(F.struct(F.col("a").alias("digest"), (F.col("pb") < F.col("pa")).alias("late")), F.struct(F.col("b").alias("digest"), (F.col("pa") < F.col("pb")).alias("late"))))
    each = sided.select(ends.alias("e")).select("e.digest", F.lit(1).cast("long").alias("n_links"), "e.late").union(_counted_links(members))
    counted = each.groupBy("digest").agg(F.sum("n_links").alias("n_links"), F.max("late").alias("late"))

    named = classes.select("digest", F.col("doc_id").alias("class_doc_id"), F.col("line_no").alias("class_line_no")).join(counted, "digest", "left")
    out = rows.select("doc_id", "line_no", "digest").join(written(named, "line-named").hint("merge"), "digest")
    own = F.col("doc_id").eqNullSafe(F.col("class_doc_id")) & (F.col("line_no") == F.col("class_line_no"))
    links_ = F.coalesce("n_links", F.lit(0)).cast("long")
    return out.select("doc_id", "line_no", "class_doc_id", "class_line_no", links_.alias("n_links"), (~own | F.coalesce("late", F.lit(False))).alias("removed"))


def kept_text(docs: DataFrame, lines: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with text as the lines that stay, from near_lines' result."""
    (mark,) = fresh(docs, "gone_lines")
    gone = lines.where("removed").groupBy(F.col("doc_id").alias(doc_id)).agg(F.collect_set("line_no").alias(mark))
    joined = lookup(docs, gone, [doc_id])
    stay = F.transform(F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct((i + 1).alias("i"), x.alias("x"))), lambda s: ~F.array_contains(mark, s["i"])), lambda s: s["x"])
    return joined.withColumn(text, F.when(F.col(mark).isNull(), F.col(text)).otherwise(F.array_join(stay, "\n"))).select(*docs.columns)
