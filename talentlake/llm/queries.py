"""The thin queries of this subpackage: whole tables in, the contracts' columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.llm import align, decontaminate, fill_middle, html_text, langid, lines, merkle, mixing, near_dup, packing, passages, secrets, token_files
from talentlake.llm._util import configured, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configured(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file; the package that holds them is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.near_lines(_table(spark, sf_dir, "documents"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(_table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html_text.extract(pages.select("page_id", "url", F.col("html")), html_text.train())
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.encode(_table(spark, sf_dir, "documents"), path, vocabulary())
    return token_files.decode(spark, path)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(_table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.packed(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def queries() -> dict:
    first = (op1_language_id, op2_mix_sources, op3_secret_scan, op4_decontamination, op5_line_dedup, op6_repeated_passages, op7_main_text)
    rest = (op8_near_duplicates, op9_token_files, op10_fingerprints, op11_token_alignment, op12_fill_middle, op13_packing)
    return {f.__name__: f for f in first + rest}


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = """
WITH l AS (SELECT doc_id, generate_subscripts(t, 1) AS line_no, unnest(t) AS line FROM (SELECT doc_id, string_split(lower(text), chr(10)) AS t FROM documents)),
s AS (SELECT doc_id, line_no, list_sort(list_distinct(list_filter(string_split(line, ' '), lambda x: x <> ''))) AS s FROM l),
f AS (SELECT doc_id, line_no, s, row_number() OVER (PARTITION BY s ORDER BY doc_id, line_no) AS rn, first_value(doc_id) OVER (PARTITION BY s ORDER BY doc_id, line_no) AS cd, first_value(line_no) OVER (PARTITION BY s ORDER BY doc_id, line_no) AS cl FROM s WHERE len(s) > 0),
c AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) AS k, doc_id, line_no, s FROM f WHERE rn = 1),
w AS (SELECT k, len(s) AS n, unnest(s) AS x FROM c),
p AS (SELECT a.k AS ak, b.k, a.n AS an, b.n AS bn, count(*) AS m FROM w a JOIN w b ON a.x = b.x AND a.k < b.k AND a.n * 100 >= b.n * 75 AND b.n * 100 >= a.n * 75 GROUP BY a.k, b.k, a.n, b.n),
r AS (SELECT ak, k FROM p WHERE 100 * m >= 75 * (an + bn - m)),
e AS (SELECT k, true AS late FROM r UNION ALL SELECT ak, false FROM r),
g AS (SELECT c.doc_id, c.line_no, count(*) AS n_links, bool_or(e.late) AS late FROM c JOIN e ON e.k = c.k GROUP BY ALL)
SELECT f.doc_id, CAST(f.line_no AS INT) AS line_no, f.cd AS class_doc_id, CAST(f.cl AS INT) AS class_line_no, coalesce(g.n_links, 0) AS n_links, f.rn > 1 OR coalesce(g.late, false) AS removed
FROM f LEFT JOIN g ON g.doc_id = f.cd AND g.line_no = f.cl"""

OP8_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (an + bn - c)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.root AS component_id, s.doc_id = m.root AS kept
FROM s JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m ON m.doc_id = s.doc_id"""


OP12_SQL = """
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS x FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || x[i:i + 7] AS BIGINT)) AS h FROM u),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are held against brute force in tests/llm."""
    return {"op5_line_dedup": OP5_SQL, "op8_near_duplicates": OP8_SQL, "op12_fill_middle": OP12_SQL}
