"""Text functions against small specifications in plain Python."""

import random
import re
import unicodedata

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talentlake.functions import skills as sk
from talentlake.functions import text as tx
from talentlake.operators import redact
from talentlake.plans import registry

LINES = ["", "a\r\nb\n\n c \x0bd\x1ce\x85f g\r", " \xa0 \n x", "• one -\n - \n\ttwo  words", "đ ß ﬁ Ｆｕｌｌ é é", None]


def run(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o"))
    return [r["o"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def test_source_lines(spark):
    want = [None if v is None else [x.strip() for x in v.splitlines() if x.strip()] for v in LINES]
    assert run(spark, LINES, tx.source_lines) == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \t\r\n\x0b\x0c\x1c\x1d\x85  ", max_size=12), min_size=1, max_size=30))
def test_source_lines_random(spark, texts):
    assert run(spark, texts, tx.source_lines) == [[x.strip() for x in v.splitlines() if x.strip()] for v in texts]


def test_prompt_and_normalized(spark):
    assert run(spark, ["a\n\n b "], tx.indexed_prompt) == ["[L0001] a\n[L0002] b"]
    assert run(spark, ["a\n\n b ", " \n"], tx.normalized_source) == ["a\nb", None]


def test_display_lines(spark):
    want = [[re.sub(r"\s+", " ", x).strip(" •▪●-\t") for x in v.splitlines() if x.strip()] for v in LINES[:-1]]
    assert run(spark, LINES[:-1], tx.display_lines) == want


def test_folding(spark):
    texts = ["Đặng Thị Straße", "ﬁne Ｆｕｌｌ", "ÀÉÎõü Ångström", "Tối ưu", "é", ""]
    want = ["".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c)) for x in texts]
    assert run(spark, texts, tx.exact_fold) == want
    assert run(spark, texts, tx.fold) == want
    assert run(spark, ["  A  b"], tx.exact_value) == ["a b"]


def test_small_functions(spark):
    assert run(spark, ["abc", "dự án", "12"], tx.detected_language) == ["en", "vi", None]
    assert run(spark, ["", "a b/c.pdf"], tx.file_stem) == ["cv", "a_b_c.pdf"]
    assert run(spark, ["call +84 912 345 678", "x@y", "plain", "0123"], tx.is_contact_line) == [True, True, False, False]
    assert run(spark, ["0.12345"], lambda c: tx.percent(c.cast("double"))) == ["12.35%"]
    assert run(spark, ["26.25", "26.35"], lambda c: tx.round1(c.cast("double"))) == [26.2, pytest.approx(26.4)]


def test_skills(spark):
    folded = lambda c: tx.fold(c)
    texts = ["I know node.js and javascript", "Java script, ASP.NET MVC", "scheduled by git", "gitlab only", "C# and C++"]
    got = run(spark, texts, lambda c: sk.skills_in(folded(c)))
    assert got[0] == ["JavaScript", "Node.js"] and "Java" in got[1] and ".NET" in got[1] and got[2] == ["Git"] and got[3] == [] and got[4] == ["C#", "C++"]
    assert run(spark, ["scheduled", "Tăng và led"], lambda c: sk.phrases_in(folded(c), sk.ACTION_VERBS)) == [["led"], ["led", "tăng"]]
    assert run(spark, ["9%", "12+", "3x", "5", "a12b", "1.5 %"], sk.is_quantified) == [True, True, True, False, False, True]
    assert run(spark, ["Team  Work", "Java", "Giao tiếp"], sk.looks_soft) == [True, False, True]


def test_redaction(spark):
    assert run(spark, ["mail a.b@c.org.", "x@y.zz,"], redact.mask_emails) == ["mail a.b@c.org.", "[MASKED],"]
    phones = ["call 12345678", "call 123456789", "+1 (234) 567-8901 x", "1234567890123456", "123456789012345"]
    assert run(spark, phones, redact.mask_phones) == ["call 12345678", "call [MASKED]", "[MASKED] x", "1234567890123456", "[MASKED]"]
    urls = ["see https://github.com/www.foo.com now", "www.a.b and http://c.d/e"]
    assert run(spark, urls, redact.mask_urls) == [urls[0], "[MASKED] and [MASKED]"]
    names = ["\nJane Mary Doe\nx", "Curriculum Vitae\r\nJane Doe\r\n", "\n".join(["#"] * 12 + ["Jane Doe"]), "jane doe", "Jean-Luc Picard"]
    assert run(spark, names, lambda c: redact.redact(c, first_page=True)) == ["\n[MASKED]\nx", "Curriculum Vitae\r\n[MASKED]\r\n", names[2], "jane doe", "[MASKED]"]
    pages = spark.createDataFrame([("d", 2, "b@c.dd"), ("d", 1, "Jane Doe\nx")], "doc_id string, page_no int, text string")
    row = redact.redacted_pages(pages, prefix=True).first()
    assert row["text"] == "[SOURCE p1]\n[MASKED]\nx\n\n[SOURCE p2]\n[MASKED]" and row["within_limit"]


def test_value_of_compatibility_characters(spark):
    texts = ["Ｐｙｔｈｏｎ　３", "Kỹ năng ĐẠI HỌC", "Straße ﬁn", "m² №5 ™", "ſpark", "C++ / .NET  x", "é Ünï", "ＡＢＣ１２３", "", None]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select(tx.value(F.col("x")).alias("v"), tx.exact_value(F.col("x")).alias("e")).collect()
    assert [r["v"] for r in rows] == [r["e"] for r in rows]


def _named(folded, alias):
    return re.search(f"(?<![a-z0-9]){alias}(?![a-z0-9])", folded) if re.fullmatch("[a-z0-9 ]+", alias) else alias in folded


def test_dictionary_forms_equal_search(spark):
    """One pass over the words finds what a search for each alias finds, in the column form and in the join form."""
    rng = random.Random(3)
    aliases = [a for names in sk.SKILLS.values() for a in names]
    parts = [w for a in aliases for w in a.split(" ")] + aliases + ["x", "k8", "|", "ß", "7"]
    texts = [None, "", "  ", "spring  boot", "spring\nboot", "xspring boot", "(spring boot)", "spring boots", "node js js", "a.netb", "sql server", "é sql", "ésql"]
    texts += ["".join(rng.choice(parts) + rng.choice([" ", " ", " ", "  ", ", ", "\n", "", "-", "."]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, f string").withColumn("alias", F.lit("clash")).repartition(4)
    want = {i: [n for n, names in sk.SKILLS.items() if any(_named(x or "", tx.fold_text(a)) for a in names)] for i, x in enumerate(texts)}
    assert {r["i"]: r["s"] for r in rows.select("i", sk.skills_in(F.col("f")).alias("s")).collect()} == want
    assert {r["i"]: r["skills"] for r in sk.skills_by_join(rows, "i", "f").collect()} == {i: s for i, s in want.items() if s}


def test_dictionary_of_any_size(spark):
    """Aliases given as a table: many, long, null, empty and repeated ones; the plan does not grow with them."""
    given = [(i, f"S{i}", f"word{i} of use") for i in range(5000)] + [(9000, "Long", "A b c d e"), (9000, "Long", "a b c d e"), (9001, "Odd", "é+"), (9002, "No", None), (9003, "No", "")]
    table = spark.createDataFrame(given, "ord int, canonical string, alias string").withColumn("note", F.lit(1))
    texts = spark.createDataFrame([(1, "word7 of use, word4999 of use"), (2, "a b c d e+"), (3, "word7 of user"), (4, None), (1, "z e+")], "i int, f string")
    got = {r["i"]: r["skills"] for r in sk.skills_by_join(texts, "i", "f", table).collect()}
    assert got == {1: ["S7", "S4999", "Odd"], 2: ["Long", "Odd"]}
    assert sk.skills_by_join(texts, "i", "f", table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sk.skills_by_join(texts, "i", "f", spark.range(1001).select(F.col("id").cast("int").alias("ord"), F.lit("x").alias("canonical"), F.concat(F.lit("+"), "id").alias("alias")))


def test_dictionary_join_reads_texts_once(spark, sf_dir, monkeypatch):
    """Texts are read and folded once; crowded words, and dictionaries that are shuffled, find the same."""
    plan = registry.queries()["skill_join"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
    given = [(i, f"S{i}", f"a{i} management") for i in range(30)] + [(40, "M", "management"), (41, "T", "of b c"), (42, "P", "c++")]
    table = spark.createDataFrame(given, "ord int, canonical string, alias string")
    texts = spark.createDataFrame([(1, "a3 management, a29  management"), (2, "xof b c of b cx"), (3, "x of b c++"), (4, "(of b c)"), (5, None)], "i int, f string")
    want = {1: ["S3", "M"], 3: ["P"], 4: ["T"]}
    for most in (sk.BROADCAST_ALIASES, 2):
        monkeypatch.setattr(sk, "BROADCAST_ALIASES", most)
        got = {r["i"]: r["skills"] for r in sk.skills_by_join(texts, "i", "f", table).collect()}
        assert got == want | {3: ["T", "P"]}


def test_mask_email_equals_its_sql(spark, tmp_path):
    """Addresses one character apart, at both ends, before line ends, and beside signs that only one engine's \\w has."""
    texts = ["a@b.com c@d.com", "a@b.com\nc@d.com;e@f.org", "a@b.com, c@d.com", "x a@b.com\n", "a@b@c.com", "a@b.com@c@d.com", "a@b.com²", "²a@b.com", "Ⓐa@b.com", "é@b.com\u200d", "e\u0301a@b.comx\u0301", "a@b.com.", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: r[1] for r in registry.queries()["mask_email"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(db.execute(registry.oracle_sql()["mask_email"]).fetchall())
    assert run(spark, texts[:2], redact.mask_emails) == ["[MASKED] [MASKED]", "[MASKED]\n[MASKED];[MASKED]"]


def test_normalized_source_equals_its_sql(spark, tmp_path):
    """Texts without any line hash as the empty text, null stays null; the function still gives null for both."""
    texts = ["", " ", "\n", "\r\n \t\x0b\x85\u2028", "\xa0\u3000", None, "\u200b", "a", " a\r\n\r\n b ", "\n\x1ca\x1c\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: r[1] for r in registry.queries()["normalized_source"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(db.execute(registry.oracle_sql()["normalized_source"]).fetchall())
    assert got[5] is None and got[0] == "d41d8cd98f00b204e9800998ecf8427e"
    assert run(spark, texts[:6], tx.normalized_source) == [None] * 6


def test_text_classes_equal_unicode(spark):
    """White space, line ends, words and marks of numbers, over all signs of the basic plane and odd lines."""
    signs = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    spaces = run(spark, signs, lambda c: c.rlike(f"^[{tx.SPACE}]$") & ~c.rlike(f"^[^{tx.SPACE}]$"), "boolean")
    assert [s for s, is_space in zip(signs, spaces, strict=True) if is_space] == [s for s in signs if s.isspace()] == sorted(tx.SPACES)
    ends = run(spark, signs, lambda c: F.concat(F.lit("a"), c, F.lit("b")).rlike(f"^a(?:{tx.LINE_END})b"), "boolean")
    assert [s for s, is_end in zip(signs, ends, strict=True) if is_end] == [s for s in signs if len(f"a{s}b".splitlines()) == 2]
    lines = ["", " ", "a", "a b c d", " a  b\xa0c　d ", "a b c ", " a b c d e", "a\r\n\r\rb\n\n"]
    assert run(spark, lines, lambda c: tx.has_words(c, 4), "boolean") == [len(x.split()) >= 4 for x in lines]
    assert run(spark, lines, tx.n_words, "int") == [len(x.split()) for x in lines]
    plain = lambda c: F.when(c.rlike(r"\p{L}"), F.when(c.rlike(f"[{tx.VIETNAMESE}]"), "vi").otherwise("en"))
    assert run(spark, signs, tx.detected_language) == run(spark, signs, plain)
    quantified = ["1x", "a1x", "12", "a12", "12a", "3 %", "1,5%", "7", "٣%", "10+ ", "x", "é12"]
    old = r"(?U)\d+[.,]?\d*\s*%|\b\d{2,}[+]?\b|\b\d+[xX]\b"
    assert run(spark, quantified, sk.is_quantified, "boolean") == run(spark, quantified, lambda c: c.rlike(old), "boolean")
    tel = ["call 0912345678", "10912345678", "+84 91 234 56 78", "84912345678x", "8491", "a@b", "GMAIL", "LinkedIn.com/x", "none", "00912345678"]
    old = r"(?U)(?<!\d)(?:\+?84|0)[\d\s().-]{7,18}(?!\d)"
    marks = lambda x: any(m in x.lower() for m in tx.CONTACT_MARKS)
    assert run(spark, tel, tx.is_contact_line, "boolean") == [a or marks(x) for a, x in zip(run(spark, tel, lambda c: c.rlike(old), "boolean"), tel, strict=True)]
