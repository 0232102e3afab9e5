"""Evaluation, layout, integrity, sources, state and streams."""

import hashlib
import json
import random
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from talentlake.operators import evaluation, integrity, layout
from talentlake.schemas import CV
from talentlake.session import ship
from talentlake.sources import files
from talentlake.streaming import state, timers


def cv(**changes):
    base = {"personal_info": {"name": "[MASKED]", "email": "[MASKED]", "phone": "[MASKED]", "github_url": ""}, "summary": "", "skills": {"hard_skills": [], "soft_skills": []}, "experience": [], "projects": [], "education": [], "certifications": [], "activities": [], "awards": []}
    return json.dumps({**base, **changes})


def test_field_metrics(spark):
    gold = [("a", cv(summary="X  y", awards=["p", "P", "q"])), ("b", cv(awards=["r"])), ("c", cv())]
    pred = [("a", cv(summary="x y", awards=["p", "z"])), ("c", cv(awards=["s"]))]
    load = lambda rows: spark.createDataFrame(rows, "id string, v string").select("id", F.from_json("v", CV).alias("cv"))
    both = evaluation.compared(evaluation.items(load(gold), "id", "cv"), evaluation.items(load(pred), "id", "cv"), ["id", "field", "item"])
    got = {r["field"]: r for r in evaluation.scored(evaluation.counts(both, "field")).collect()}
    assert (got["awards"]["tp"], got["awards"]["fp"], got["awards"]["fn"]) == (1, 2, 2) and got["summary"]["f1"] == 1.0
    total = evaluation.micro_macro(evaluation.scored(evaluation.counts(both, "field"))).first()
    assert (total["tp"], total["fp"], total["fn"]) == (2, 2, 2) and abs(total["macro_f1"] - (1 + 1 / 3) / 2) < 1e-12
    wrong = {(r["id"], r["field"]): (r["extra"], r["missing"]) for r in evaluation.mismatches(both, "id").collect()}
    assert wrong == {("a", "awards"): (["z"], ["q"]), ("b", "awards"): ([], ["r"]), ("c", "awards"): (["s"], [])}


def test_scores_of_nothing(spark):
    row = evaluation.scored(spark.createDataFrame([(0, 0, 0), (0, 2, 0)], "tp long, fp long, fn long")).collect()
    assert [(r["precision"], r["recall"], r["f1"]) for r in row] == [(None, None, None), (0.0, 0.0, 0.0)]


def test_spans(spark):
    rows = spark.createDataFrame([("k", [1, 2], [1, 2], True), ("k", None, None, True), ("k", None, None, False), ("j", [1, 1], [1, 2], True)], "kind string, gold array<int>, pred array<int>, found boolean")
    got = {r["kind"]: r for r in evaluation.span_accuracy(rows).collect()}
    assert (got["k"]["all_slots"], got["k"]["all_exact"], got["k"]["non_null_exact"]) == (3, 2, 1) and got["j"]["non_null_gold_accuracy"] == 0.0 and got[None]["all_slots"] == 4


def test_percentiles(spark):
    for values in ([3.0], [1.0, 2.0], [1.0, 2.0, 4.0, 8.0]):
        r = evaluation.efficiency(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
        at = (len(values) - 1) * 0.95
        low = int(at)
        want = values[low] * (1 - at + low) + values[min(low + 1, len(values) - 1)] * (at - low)
        assert abs(r["p95"] - want) < 1e-9


def block(x0, x1, y0, y1, text="t"):
    return (float(x0), float(x1), float(y0), float(y1), text)


def test_columns(spark):
    left, right = [block(0, 100, 0, 50)] * 3, [block(300, 400, 20, 70)] * 3
    low, at_edge = [block(300, 400, 38, 70)] * 3, [block(252, 400, 0, 50)] * 3
    cases = [left + right, left + low, left[:2] + right, left + right[:1] + left[:2], left + at_edge, left + [block(300, 400, 20, 70, " ")] * 3]
    rows = spark.createDataFrame([(i, 600.0, [dict(zip(("x0", "x1", "y0", "y1", "text"), b, strict=True)) for b in c]) for i, c in enumerate(cases)], "page_id int, width double, blocks array<struct<x0:double,x1:double,y0:double,y1:double,text:string>>")
    want = [True, False, False, False, False, False]
    got = {r["page_id"]: r["m"] for r in rows.select("page_id", layout.multi_column(F.col("blocks"), F.col("width")).alias("m")).collect()}
    assert [got[i] for i in range(6)] == want
    flat = rows.select("page_id", "width", F.explode("blocks").alias("b")).select("page_id", "width", "b.*")
    assert {r["page_id"]: r["multi_column"] for r in layout.multi_column_join(flat).collect()} == got


def test_routes_and_profiles(spark):
    rows = spark.createDataFrame([(0.02, "x" * 79), (0.02, "x" * 80), (0.01, " a "), (0.01, "  ")], "d double, n string")
    assert [r[0] for r in rows.select(layout.route(F.col("d"), F.col("n"), "vi")).collect()] == ["ocr_vi", "native_text", "native_text", "skip_near_blank"]
    blocks = "array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>"
    pages = spark.createDataFrame([("a", 1, "x" * 100, "o", 600.0, None), ("a", 2, "short", "read", 600.0, None), ("b", 1, " ", "", 600.0, None)], f"doc_id string, page_no int, native_text string, ocr_text string, width double, blocks {blocks}")
    p = {r["doc_id"]: r for r in layout.profiles(pages).collect()}
    assert p["a"]["text"] == "x" * 100 + "\n\nshort" and p["a"]["profile"]["native_text_pages"] == 1 and p["a"]["profile"]["needs_ocr"]
    i = {r["doc_id"]: r for r in layout.ingested(pages, "vi").collect()}
    assert i["a"]["routes"] == ["pdf_text", "paddleocr_latin_vi"] and i["a"]["ocr_quality_warning"] and i["b"]["error"] is not None
    lines = spark.createDataFrame([(["a@b", "c"], ["x", "d", "e"])], "p array<string>, v array<string>").select(layout.chosen_lines(F.col("p"), F.col("v")).alias("l")).first()["l"]
    assert lines == ["a@b", "d"]


def test_checks(spark):
    rows = spark.createDataFrame([(True, "a.pdf", "x" * 80, "vi"), (False, "", "x", "de"), (True, "a.doc", "x" * 30001, None)], "c boolean, f string, j string, l string")
    got = [r[0] for r in rows.select(integrity.form_errors(F.col("c"), F.col("f"), F.col("j"), F.col("l"))).collect()]
    assert got == [[], ["consent", "file", "jd_short", "language"], ["file_type", "jd_long", "language"]]
    paths = spark.createDataFrame([("a/b",), ("/a",), ("a/../b",), ("a..b",)], "p string")
    assert [r[0] for r in paths.select(integrity.is_safe_path(F.col("p"))).collect()] == [True, False, False, True]
    bad = integrity.provenance(spark.createDataFrame([("a", "validation"), ("a", "test")], "sample_id string, split string"), {"split": "validation"}, 75)
    assert {r["rule"]: r["n"] for r in bad.collect()} == {"differs:split": 1, "repeated_key": 1, "count": 73}


def test_archives(spark, tmp_path):
    ship(spark)
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("run/a.json", "{}")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("run/../b", "x")
        z.writestr("other/c", "x")
    (tmp_path / "no.zip").write_bytes(b"text")
    members = files.zip_members(spark, f"file://{tmp_path}/*.zip")
    got = {(r["archive"].rsplit("/", 1)[1], r["problem"]) for r in files.archive_problems(members, ["a.json"]).collect()}
    assert got == {("bad.zip", "unsafe"), ("bad.zip", "roots"), ("bad.zip", "missing:a.json"), ("no.zip", "broken"), ("no.zip", "missing:a.json")}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert sorted(r["a"] for r in files.json_lines(spark, f"file://{tmp_path}/a.jsonl", "a int").collect()) == [1, 2]
    (tmp_path / "t.csv").write_bytes(b'\xef\xbb\xbfskill,n\n"a, b",2\n')
    assert [tuple(r) for r in files.reference_csv(spark, f"file://{tmp_path}/t.csv").select("skill", "n").collect()] == [("a, b", "2")]
    (tmp_path / "jobs").mkdir()
    (tmp_path / "jobs" / "1.json").write_text('{"token": "x"}')
    (tmp_path / "jobs" / "2.json").write_text("{")
    assert [r["token"] for r in files.job_documents(spark, f"file://{tmp_path}/jobs", "token string").collect()] == ["x"]
    rows = spark.createDataFrame([(1, ["a"])], "i int, l array<string>")
    files.write_csv(rows, f"file://{tmp_path}/out.csv")
    assert spark.read.csv(f"file://{tmp_path}/out.csv", header=True).first()["l"].replace("\\", "") == '["a"]'
    files.append_json(rows, f"file://{tmp_path}/log")
    files.append_json(rows, f"file://{tmp_path}/log")
    assert spark.read.json(f"file://{tmp_path}/log").count() == 2
    assert files.report(spark.range(1)).first()["value"].endswith("| id | 0 |")
    made = spark.createDataFrame([("JVBERi0x",), ("eHg=",), ("?",)], "b string")
    assert [r["problem"] for r in files.decoded_pdfs(made, "b").collect()] == [None, "no PDF", "invalid"]
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 two pages")
    (tmp_path / "y.pdf").write_bytes(b"nothing")
    pages, rejected = files.pdf_files(spark, f"file://{tmp_path}/*.pdf", lambda data: [{"page_no": 1, "native_text": data[:8].decode(), "ocr_text": "", "width": 600.0, "dark_ratio": 0.5, "blocks": []}])
    assert pages.first()["native_text"] == "%PDF-1.4" and rejected.first()["problem"] == "no PDF"


REQUESTS = [(u, e, i) for i, (u, e) in enumerate([("a", 0), ("a", 0), ("a", 10), ("b", 5), ("a", 100), ("a", 101), ("b", 106), ("a", 111), ("a", 205)])]


def plain_limiter(rows, most, window):
    logs, out = {}, {}
    for u, e, i in sorted(rows, key=lambda r: (r[1], r[2])):
        kept = [x for x in logs.get(u, []) if x >= e - window]
        out[i] = len(kept) < most
        logs[u] = kept + [e] * out[i]
    return out


def test_limiter(spark):
    ship(spark)
    rows = spark.createDataFrame(REQUESTS, "who string, epoch bigint, n int")
    for most in (1, 2, 5):
        got = {r["n"]: r["allowed"] for r in state.limited(rows, "who", "epoch", "n", most, 100).collect()}
        assert got == plain_limiter(REQUESTS, most, 100)


def streamed(spark, tmp_path, batches, schema, build):
    source, out = tmp_path / "in", []
    source.mkdir()
    for i, rows in enumerate(batches):
        pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).to_json(source / f"{i}.json", orient="records", lines=True)
    timers.timed(spark)
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{source}"))
    run = stream.writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination(120)
    return out


def test_limiter_stream(spark, tmp_path):
    ship(spark)
    got = streamed(spark, tmp_path, [REQUESTS[:4], REQUESTS[4:]], "who string, epoch bigint, n int", lambda s: timers.limited_stream(s, "who", "epoch", "n", 2, 100))
    assert {r["n"]: r["allowed"] for r in got} == plain_limiter(REQUESTS, 2, 100)


JOBS = [("t", "CREATED", 1), ("t", "IN_QUEUE", 2), ("t", "COMPLETED", 3), ("t", "COMPLETED", 4), ("u", "FAILED", 5), ("u", "COMPLETED", 6), ("v", "IN_QUEUE", 7)]


def test_jobs_batch_and_stream(spark, tmp_path):
    ship(spark)
    schema = "token string, status string, seq bigint"
    batch = {r["token"]: r["status"] for r in state.job_states(spark.createDataFrame(JOBS, schema)).collect()}
    assert batch == {"t": "COMPLETED", "u": "FAILED", "v": "IN_QUEUE"}
    got = streamed(spark, tmp_path, [JOBS[:3], JOBS[3:]], schema, lambda s: timers.job_states_stream(s.withColumn("at", F.timestamp_seconds("seq")), "token", "status", "at", "seq"))
    changes = [(r["token"], r["status"]) for r in got]
    assert changes.count(("t", "COMPLETED")) == 1 and ("u", "COMPLETED") not in changes and {t: s for t, s in changes} == batch


def test_finalized_once(spark, tmp_path):
    build = lambda s: state.finalized_once(s.withColumn("at", F.timestamp_seconds("seq")), "token", "at")
    got = streamed(spark, tmp_path, [JOBS[:3], JOBS[3:]], "token string, status string, seq bigint", build)
    assert sorted(r["token"] for r in got) == ["t", "u"] and {r["seq"] for r in got if r["token"] == "t"} == {3}


def test_rejected_documents(spark):
    read = spark.createDataFrame([("a", "x", None, 1), ("b", "y", None, 2), ("c", "z", "page count", 13)], "doc_id string, text string, error string, page_count int")
    documents = spark.createDataFrame([("a", None), ("b", True), ("c", False), ("d", None)], "doc_id string, encrypted boolean")
    got = {r["doc_id"]: (r["text"], r["error"], r["page_count"]) for r in layout.with_rejected(read, documents).collect()}
    assert got == {"a": ("x", None, 1), "b": (None, "encrypted", 2), "c": ("z", "page count", 13), "d": (None, "no pages", None)}


def test_stores(spark, tmp_path):
    jobs = spark.createDataFrame([("a", "COMPLETED", "2024-01-01 00:00:00"), ("b", "IN_QUEUE", "2024-01-01 21:00:01"), ("c", "IN_QUEUE", "2024-01-01 20:59:59"), ("d", "FAILED", None)], "token string, status string, u string").withColumn("updated_at", F.to_timestamp("u"))
    gone = state.expired(jobs, F.lit("2024-01-02 00:00:00").cast("timestamp")).collect()
    assert [r["token"] for r in gone] == ["c"]
    store = spark.createDataFrame([("s1", "h1"), ("s2", "h1")], "submission_id string, source_sha256 string").withColumn("withdrawal_hash", F.sha2("submission_id", 256))
    assert [r[0] for r in state.withdrawn(store, spark.createDataFrame([(" s1 ",)], "code string")).select("submission_id").collect()] == ["s2"]
    assert tuple(state.public_stats(store).first()) == (2, 1)
    delays = spark.range(7).select(state.poll_delay(F.col("id"))).collect()
    assert [r[0] for r in delays] == [0.8, 2.5, 2.5, 2.5, 2.5, 5.0, 5.0]


def test_files_are_hashed_in_pieces(spark, tmp_path):
    """Hashes of files of all sizes, and a file of 3 GB (a sparse one) by workers of under 500 MB."""
    ship(spark)
    sizes = {"empty": 0, "one": 1, "even": files.CHUNK, "more": files.CHUNK + 1, "a b%20ü": 3 * files.CHUNK - 1}
    for name, n in sizes.items():
        (tmp_path / f"{name}.bin").write_bytes(random.Random(n).randbytes(n))
    got = {r["name"]: (r["size"], r["sha256"]) for r in files.file_hashes(spark, f"file://{tmp_path}/*.bin").collect()}
    assert got == {f"{k}.bin": (n, hashlib.sha256(random.Random(n).randbytes(n)).hexdigest()) for k, n in sizes.items() if n}  # Spark lists no empty file

    with open(tmp_path / "large.dat", "wb") as f:
        f.truncate(3 << 30)
    zeros = hashlib.sha256()
    for _ in range(3 << 4):
        zeros.update(bytes(64 << 20))

    def measured(batches):
        import resource

        for b in files._hashed(batches):
            yield b.assign(peak=resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)

    row = files._listed(spark, f"file://{tmp_path}/large.dat").mapInPandas(measured, "path string, size bigint, sha256 string, peak bigint").first()
    assert (row["size"], row["sha256"]) == (3 << 30, zeros.hexdigest()) and row["peak"] < 500 << 10
    (tmp_path / "large.dat").unlink()


def test_archive_members_in_pieces(spark, tmp_path):
    """Large members keep size and hash, a broken one hides none after it, and all is as written."""
    ship(spark)
    data = {"run/small": b"{}", "run/none": b"", "run/even": bytes(1000), "run/over": bytes(1001), "run/large": random.Random(1).randbytes(3 * files.CHUNK + 7)}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in data.items():
            z.writestr(name, content)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("run/first", "abcdefgh")
        z.writestr("run/second", "ijkl")
    spoilt = (tmp_path / "b.zip").read_bytes().replace(b"abcdefgh", b"abcdXfgh")
    (tmp_path / "b.zip").write_bytes(spoilt)
    (tmp_path / "c.zip").write_bytes(b"x")
    rows = files.zip_members(spark, f"file://{tmp_path}/*.zip", most_bytes=1000).collect()
    of = lambda name: {r["name"]: r for r in rows if r["archive"].endswith(name)}
    a, b, c = of("a.zip"), of("b.zip"), of("c.zip")
    assert {k: (r["size"], r["sha256"], r["broken"]) for k, r in a.items()} == {k: (len(v), hashlib.sha256(v).hexdigest(), False) for k, v in data.items()}
    assert {k: r["content"] for k, r in a.items()} == {k: v if len(v) <= 1000 else None for k, v in data.items()}
    assert b["run/first"]["broken"] and b["run/first"]["content"] is None and bytes(b["run/second"]["content"]) == b"ijkl"
    assert list(c) == [None] and c[None]["broken"]


def test_compared_unites_repeats_and_sorts_nothing(spark):
    rows = lambda *v: spark.createDataFrame(list(v), "k long, field string, item string")
    gold = rows((1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (None, "a", "z"), (2, None, "q"))
    predicted = rows((1, "a", "x"), (1, "a", "x"), (1, "b", "y"), (None, "a", "z"))
    found = evaluation.compared(gold, predicted, ["k", "field", "item"])
    want = [(1, "a", "x", True, True), (1, "a", "y", True, False), (None, "a", "z", True, False), (2, None, "q", True, False), (1, "b", "y", False, True), (None, "a", "z", False, True)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
