"""JSON, pointers, policy, scores and matching."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from talentlake.operators import evaluation, jsonc, matching, pointer, policy, scoring
from talentlake.schemas import CV
from talentlake.session import ship

SOURCE = "SUMMARY\nBuilds data tools\nSKILLS\nPython, SQL\nEXPERIENCE\nAcme\nReduced cost by 20%\nEDUCATION\nBSc"
RECORD = {
    "personal_info": {"name": "[MASKED]", "email": "[MASKED]", "phone": "[MASKED]", "github_url": ""},
    "summary_span": [2, 2],
    "skills": {"hard_skills": ["Python", "SQL"], "soft_skills": ["Communication"]},
    "experience": [{"company": "Acme", "job_title": "Dev", "duration": "2020", "description_span": [7, 7]}],
    "projects": [],
    "education": [{"degree": "BSc", "university": "X", "gpa": 3, "year_graduated": None}],
    "certifications": [],
    "activities": [],
    "awards": [],
}


def changed(path, value):
    out = copy.deepcopy(RECORD)
    at = out
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return out


def parse(spark, raws, source=SOURCE):
    ship(spark)
    rows = pointer.with_pointer(jsonc.with_parse(spark.createDataFrame(list(enumerate(raws)), "i int, raw string"), F.col("raw")), F.lit(source), out="p")
    return [r["p"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def test_strict_json(spark):
    ship(spark)
    texts = ['{"a":1}', '{"a":{"b":1,"b":2}}', "[NaN]", '{"a":1} x', "null", "", "[-Infinity]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string").select("i", jsonc.strict_json("v").alias("o"))
    got = {r["i"]: r["o"] for r in rows.collect()}
    assert [got[i]["ok"] for i in range(7)] == [True, False, False, False, True, False, False]
    assert got[1]["error"] == "duplicate_json_key=b" and got[2]["error"] == "non_standard_json_constant=NaN" and got[4]["value"] == "null"


TEXTS = [
    None, '{"a":1}', '{"a":1} x', '{"a":1}{', '{"a":1,"a":2}', '{"a":NaN}', "NaN", "Infinity", "1", "1.0", "1e3", "12345678901234567890", "null", '"x"', "[1,2.0,true,null]", "", "  ", '"a\tb"', "01", "{a:1}", "[1,]",
    "/*c*/1", '  {"a":1}\n', '{"x":{"a":1,"a":1}}', "tru", "\ufeff1", '"\\u00e9\\n"', "-", "-1", "+1", ".5", "5.", "1,2", "1]", '1}', '1,"e":0}', '"}', "]", "{", '{"v":1}', '{"a":[{"b":{}}]}', "x" * 50, "[" * 40 + "]" * 40,
]


def test_built_in_parser_is_as_strict_as_python(spark):
    """The variant is null for what Python refuses, and the two phases tell the same errors as two parses in Python."""
    ship(spark)
    wrapped = [f"<think>q</think>{x}" for x in TEXTS if x] + [f"```json\n{x}\n```" for x in TEXTS if x]
    rows = spark.createDataFrame(list(enumerate([*TEXTS, *wrapped])), "i int, raw string")
    fine = {r["raw"]: r["ok"] for r in rows.select("raw", jsonc.variant(F.col("raw")).isNotNull().alias("ok")).collect()}
    assert {x: jsonc.attempt(x)[1] for x in TEXTS if x is not None} == {x: fine[x] for x in TEXTS if x is not None} and not fine[None]
    for r in jsonc.with_parse(rows.select("*", jsonc.unwrapped(F.col("raw")).alias("u")), F.col("raw")).collect():
        p = r["parse"]
        if r["raw"] is None:
            assert p["strict_json"] is None and p["value"] is None
            continue
        first, second = r["raw"].strip(), r["u"]["candidate"]
        (_, ok1, error1), (_, ok2, error2) = jsonc.attempt(first), jsonc.attempt(second)
        assert (p["strict_json"], p["recoverable_json"], p["strict_error"], p["recovery_error"]) == (ok1, ok1 or ok2, error1, None if ok1 else error2), r["raw"]
        assert p["value"] == (first if ok1 else second if ok2 else None) and p["recovery_steps"] == ([] if ok1 else r["u"]["steps"])


def scrambled(value, rng):
    """A record with some of its parts replaced, dropped or added."""
    odd = [None, 1, -3, 2.0, 2.5, True, "x", "[MASKED]", "", [], {}, [1, 2], [3, 1], [0, 99], [1], ["a", 1], {"k": None}, 10**20, "it's"]
    if rng.random() < 0.08:
        return copy.deepcopy(rng.choice(odd))
    if isinstance(value, dict):
        out = {k: scrambled(v, rng) for k, v in value.items() if rng.random() > 0.02}
        return out | ({rng.choice(["x", "it's", 'q"', "b\\s", 'both\'"']): 1} if rng.random() < 0.06 else {})
    if isinstance(value, list):
        return [scrambled(v, rng) for v in value] + ([copy.deepcopy(value[0])] if value and rng.random() < 0.2 else [])
    return value


def test_built_in_validator_equals_the_walk(spark):
    rng = random.Random(5)
    full = {**RECORD, "projects": [{"name": "n", "role": "", "technologies": ["a"], "details_span": [1, 3]}], "awards": ["w"]}
    records = [full, RECORD, [1], "x", 3, {}, True] + [scrambled(full, rng) for _ in range(400)]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, raw string").repartition(3)
    got = {r["i"]: [tuple(x) for x in r["p"]] for r in rows.select("i", jsonc.variant(F.col("raw")).alias("v")).select("i", pointer.variant_problems("v", "9").alias("p")).collect()}
    for i, record in enumerate(records):
        assert got[i] == pointer.problems(record, 9), record
    assert sum(bool(v) for v in got.values()) > 200


def test_paths_have_kinds(spark):
    row = spark.createDataFrame([(json.dumps(RECORD),)], "raw string").select(jsonc.variant(F.col("raw")).alias("v")).select(pointer.typed_paths("v").alias("p")).first()
    kinds = {x["path"]: x["kind"] for x in row["p"]}
    assert kinds["$.summary_span"] == "list" and kinds["$.skills.hard_skills"] == "list" and kinds["$.education[0].gpa"] == "int" and kinds["$.education[0].year_graduated"] == "NoneType"
    assert kinds["$.personal_info.name"] == "str" and "$.projects[0].name" not in kinds


def test_messages_quote_apostrophes(spark):
    texts = ["plain", "it's", 'say "x"', 'both \' and "', "back\\slash"]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", policy.shown_text(F.col("x")).alias("s")).collect()
    assert {r["x"]: r["s"] for r in got} == {x: repr(x) for x in texts}


def test_wrappers(spark):
    raws = [" <think>a</think>\n<think>b</think> x", "<think>open x", "</tool_call></tool_call> x", "```JSON\n x \n```", "```json x``` tail", "<think>a</think></tool_call>```x```"]
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, v string").select("i", jsonc.unwrapped(F.col("v")).alias("o"))
    got = {r["i"]: (r["o"]["candidate"], r["o"]["steps"]) for r in rows.collect()}
    t, c, m = jsonc.STEPS
    assert got == {0: ("x", [t]), 1: ("<think>open x", []), 2: ("x", [c]), 3: ("x", [m]), 4: ("```json x``` tail", []), 5: ("x", [t, c, m])}


def test_parse_success_and_failures(spark):
    raw = json.dumps(RECORD)
    got = parse(spark, [raw, f"```json\n{raw}\n```", "null", "{", json.dumps(changed(["summary_span"], [3, 2])), json.dumps(changed(["personal_info", "name"], "Jane")), json.dumps(changed(["skills", "soft_skills"], ["python"]))])
    assert [p["status"] for p in got] == ["success", "success", "failed", "failed", "needs_review", "needs_review", "needs_review"]
    cv = json.loads(got[0]["cv_json"])
    assert cv["summary"] == "Builds data tools" and cv["experience"][0]["description"] == "Reduced cost by 20%" and cv["education"][0]["gpa"] == 3.0
    assert got[0]["evidence"]["experience[0].description"]["span"] == [7, 7] and got[1]["recovery_steps"] == ["markdown_fence"]
    assert got[2]["strict_json"] and got[2]["issues"][0]["message"] == "unknown JSON error"
    assert got[4]["pointer_schema_valid"] and not got[4]["span_contract_valid"] and got[4]["retry_targets"] == ["summary_span"]
    assert [i["code"] for i in got[5]["issues"]] == ["pii_not_masked"] and got[5]["retry_targets"] == []
    assert got[6]["issues"][0]["message"] == "hard_soft_overlap=['python']; disallowed_soft_skills=['python']"


@pytest.mark.parametrize(
    ("path", "value", "codes"),
    [
        (["summary_span"], [0, -1], ["span_start_before_first_line", "span_reversed"]),
        (["summary_span"], [1, 99], ["span_end_after_last_line"]),
        (["summary_span"], [1], ["span_type"]),
        (["summary_span"], [1.0, 2], ["span_type"]),
        (["summary_span"], [True, 2], ["span_type"]),
        (["summary_span"], "1-2", ["span_type"]),
        (["summary_span"], None, []),
        (["skills"], {"hard_skills": []}, ["missing_keys"]),
        (["skills", "hard_skills"], [1], ["string_type"]),
        (["experience"], {}, ["array_type"]),
        (["experience"], [3], ["object_type"]),
        (["experience"], [{"company": "a"}], ["missing_keys", "string_type", "string_type"]),
        (["education", 0, "gpa"], True, ["number_or_null_type"]),
        (["education", 0, "year_graduated"], 2020.0, ["integer_or_null_type"]),
        (["extra"], 1, ["extra_keys"]),
    ],
)
def test_validator(path, value, codes):
    assert [i[0] for i in pointer.problems(changed(path, value), 9)] == codes


def test_validator_on_other_values():
    assert [i[0] for i in pointer.problems([1], 9)] == ["object_type"]
    assert [i[:2] for i in pointer.problems({}, 9)][:2] == [("missing_keys", "$"), ("object_type", "personal_info")]


def test_record_parse(spark):
    ship(spark)
    cv, _ = pointer.rebuilt(RECORD, pointer.lines_of(SOURCE))
    raws = [json.dumps(cv), json.dumps({**cv, "x": 1}), "nope"]
    rows = jsonc.with_parse(spark.createDataFrame(list(enumerate(raws)), "i int, raw string"), F.col("raw")).select("i", pointer.parsed_record(F.col("parse")).alias("p"))
    got = {r["i"]: r["p"] for r in rows.collect()}
    assert got[0]["schema_valid"] and got[0]["skill_policy_valid"] and not got[1]["schema_valid"] and got[2]["schema_error"] == "json_not_recoverable"


def test_native_spans(spark):
    spans = [None, [1, 2], [0, -1], [3, 2], [1, 99], [1]]
    rows = spark.createDataFrame(list(enumerate(spans)), "i int, s array<int>")
    out = rows.select("i", pointer.span_issues(F.col("s"), F.lit(3)).alias("c"), pointer.span_text(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.when(F.col("i") < 2, F.col("s"))).alias("t"))
    got = {r["i"]: (r["c"], r["t"]) for r in out.collect()}
    assert got[1] == ([], "a\nb") and got[0] == ([], "") and got[2][0] == ["span_start_before_first_line", "span_reversed"] and got[5][0] == ["span_type"]


def test_native_reconstruction(spark):
    row = spark.createDataFrame([(json.dumps(RECORD), SOURCE)], "p string, s string").select(pointer.typed_pointer(F.col("p")).alias("p"), "s")
    got = row.select(pointer.reconstruct(F.col("p"), F.col("s")).alias("r")).first()["r"]
    want, evidence = pointer.rebuilt(RECORD, pointer.lines_of(SOURCE))
    assert got["cv"]["summary"] == want["summary"] and {k: v["text"] for k, v in got["evidence"].items()} == {k: v["text"] for k, v in evidence.items()}


DECISIONS = [
    ((True, "success", [], ["SQL"], ["Communication"]), ("parser_v1_strict", 0)),
    ((False, "success", [], [], []), ("rejected", 0)),
    ((True, "needs_review", ["disallowed_soft_skills=['x']"], ["SQL"], ["x"]), ("real_cv_soft_skills_expanded", 1)),
    ((True, "needs_review", ["hard_soft_overlap=['teamwork']; disallowed_soft_skills=['teamwork']"], ["Teamwork"], ["teamwork"]), ("real_cv_skills_normalized", 2)),
    ((True, "needs_review", ["hard_soft_overlap=['sql']"], ["SQL"], ["sql"]), ("rejected", 0)),
    ((True, "needs_review", ["communication_is_hard"], ["communication"], []), ("rejected", 0)),
    ((True, "needs_review", ["disallowed_soft_skills=['a;b']"], [], ["a;b"]), ("rejected", 0)),
]


def test_decisions(spark):
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(DECISIONS)], "i int, ok boolean, status string, m array<string>, hard array<string>, soft array<string>")
    issues = F.transform("m", lambda m: F.struct(F.lit("skill_policy").alias("code"), m.alias("message")))
    out = rows.select("i", "hard", "soft", policy.decide(F.col("ok"), F.col("status"), issues, F.col("hard"), F.col("soft")).alias("d"))
    got = {r["i"]: r for r in out.select("*", policy.normalized_hard(F.col("hard"), F.col("soft"), F.col("d.mode")).alias("h")).collect()}
    assert [(got[i]["d"]["mode"], len(got[i]["d"]["warnings"])) for i in range(len(DECISIONS))] == [w for _, w in DECISIONS]
    assert got[3]["h"] == [] and got[3]["d"]["normalizations"] == ["removed_from_hard_skills:teamwork"]


def python_scores(profile, quantified, actions, passives, bullets, has, coverage):
    q, a = min(1.0, quantified / max(3, bullets * 0.2)), min(1.0, actions / max(3, bullets * 0.15))
    ats = 20.0 - 6 * profile["needs_ocr"] - 3 * (profile["character_count"] < 500) - 2 * profile["likely_multi_column"] - max(0, min(2, profile["page_count"] - 3)) - (3 - sum(has)) * 1.5
    return (round(max(0, min(20, ats)), 1), round(max(0, min(30, 5 + 17 * q + 8 * a)), 1), round(35 * coverage, 1), round(max(0, min(15, 5 + 10 * a - 1.5 * passives)), 1))


def test_evaluation(spark):
    cv = "SUMMARY\nSkills: Python, Docker\nExperience at Acme: reduced cost by 20% in 3x less time\nresponsible for many other things there\nEducation"
    rows = spark.createDataFrame([(cv, "Python, SQL, Docker and Redis", (1, 1, 900, 3, False, True))], "cv_text string, jd_text string, profile struct<page_count:int,native_text_pages:int,character_count:int,block_count:int,likely_multi_column:boolean,needs_ocr:boolean>")
    r = scoring.evaluate(rows).first()["result"]
    profile = {"page_count": 1, "character_count": 900, "likely_multi_column": False, "needs_ocr": True}
    want = python_scores(profile, 1, len(r["action_verbs_found"]), 1, 2, (True, True, True), 0.5)
    assert tuple(r["scores"]) == want and r["total_score"] == round(sum(want), 1)
    assert r["matched_skills"] == ["Docker", "Python"] and r["missing_skills"] == ["Redis", "SQL"] and r["passive_phrases_found"] == ["responsible for"]
    assert len(r["improvements"]) <= 5 and r["improvements"][0].startswith("JD còn") and "cần OCR" in r["score_notes"]["ats"]


def test_overlap_and_coverage(spark):
    arrays = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    row = spark.range(1).select(
        scoring.lexical_overlap(arrays("a", "b"), arrays("b", "c")).alias("few"), scoring.lexical_overlap(arrays("a"), arrays()).alias("none"),
        scoring.coverage(arrays("x"), arrays("x", "y", "z", "w"), F.lit(0.9)).alias("quarter"), scoring.coverage(arrays(), arrays(), F.lit(0.3)).alias("words"),
    ).first()
    assert tuple(row) == (1 / 8, 0.0, 0.25, 0.3)


ANSWER = {"impact_score": 21.0, "impact_notes": "", "semantic_score": 28.0, "semantic_notes": "", "tone_score": 9.0, "tone_notes": "", "must_have_coverage": 0.66667, "matched_skills": ["SQL"], "missing_skills": [], "unverified_skills": [], "action_verbs_found": [], "passive_phrases_found": [], "quantified_lines": 1, "strengths": ["s"] * 7, "improvements": []}


def test_model_strategy(spark):
    cv, _ = pointer.rebuilt(RECORD, pointer.lines_of(SOURCE))
    rows = spark.createDataFrame([(json.dumps(cv), "SQL and Python", (1, 1, 900, 3, False, False))], "cv string, jd_text string, profile struct<page_count:int,native_text_pages:int,character_count:int,block_count:int,likely_multi_column:boolean,needs_ocr:boolean>")
    rows = scoring.evaluate(rows.withColumn("cv", F.from_json("cv", CV)), cv="cv").withColumn("ats", F.col("result.scores.ats"))
    asked = matching.prompts(rows, "zero_shot_m1")
    assert "personal_info" not in asked.first()["prompt"] and "[MASKED]" not in asked.first()["prompt"]
    answer = json.dumps(ANSWER)
    r = matching.merged(matching.asked(asked, lambda prompt: answer), "zero_shot_m1").first()["result"]
    assert r["total_score"] == round(r["scores"]["ats"] + 58, 1) and r["must_have_coverage"] == 0.6667 and len(r["strengths"]) == 5
    with pytest.raises(ValueError):
        matching.prompts(rows, "deterministic_b1")
    few = matching.prompts(rows, "few_shot_m2").first()["prompt"]
    assert matching.EXAMPLES in few and f"fixed ATS score at {r['scores']['ats']}/20" in few and few.count("SQL and Python") == 1
    bad = {**ANSWER, "impact_score": 31, "x": 1}
    del bad["tone_notes"]
    got = spark.createDataFrame([(json.dumps(bad),), (answer,), ("no",)], "raw string").select(matching.output_problems(F.col("raw")).alias("p")).collect()
    assert [r["p"] for r in got] == [["missing:tone_notes", "extra:x", "range:impact_score"], [], ["json"]]


def test_wrongly_typed_answers_are_refused(spark):
    """Each wrong type is named, and merged() gives no result for such an answer."""
    wrong = [
        ("impact_score", "abc"), ("impact_score", "21"), ("impact_score", True), ("impact_score", float("1e300")), ("impact_notes", 3), ("tone_score", None), ("matched_skills", "SQL"), ("matched_skills", [1]),
        ("matched_skills", ["a", None]), ("matched_skills", [None]), ("matched_skills", {}), ("quantified_lines", 1.5), ("quantified_lines", -1), ("must_have_coverage", 1.01), ("strengths", None),
    ]
    fine = [("quantified_lines", 2.0), ("impact_score", 30), ("impact_score", 0), ("matched_skills", []), ("matched_skills", ["a", "b"])]
    cases = wrong + fine
    rows = spark.createDataFrame([(i, json.dumps({**ANSWER, k: v})) for i, (k, v) in enumerate(cases)], "i int, raw string")
    got = {r["i"]: r["p"] for r in rows.select("i", matching.output_problems(F.col("raw")).alias("p")).collect()}
    beyond = {3, 12, 13}
    assert [got[i] for i in range(len(cases))] == [[f"{'range' if i in beyond else 'type'}:{k}"] for i, (k, _) in enumerate(wrong)] + [[]] * len(fine)
    others = ["[]", "null", "3", "", None, '{"impact_score":1,"impact_score":2}', json.dumps(ANSWER) + " x"]
    told = spark.createDataFrame([(x,) for x in others], "raw string").select(matching.output_problems(F.col("raw")).alias("p")).collect()
    assert [r["p"] for r in told] == [["json"]] * len(others)
    cv, _ = pointer.rebuilt(RECORD, pointer.lines_of(SOURCE))
    base = spark.createDataFrame([(json.dumps(cv), "SQL and Python", (1, 1, 900, 3, False, False))], "cv string, jd_text string, profile struct<page_count:int,native_text_pages:int,character_count:int,block_count:int,likely_multi_column:boolean,needs_ocr:boolean>")
    base = scoring.evaluate(base.withColumn("cv", F.from_json("cv", CV)), cv="cv").select("result").crossJoin(rows.withColumnRenamed("raw", "raw_output"))  # one row
    out = {r["i"]: (r["result"], r["problems"]) for r in matching.merged(base, "zero_shot_m1").collect()}
    assert all((out[i][0] is None) == bool(got[i]) and out[i][1] == got[i] for i in got)


def test_long_prompts_never_reach_the_model(spark):
    ship(spark)
    rows = spark.createDataFrame([(1, "a b c"), (2, "a b c d"), (3, "")], "i int, prompt string")

    def model(prompt):
        assert len(prompt.split()) < 4
        return prompt.upper()

    got = {r["i"]: (r["raw_output"], r["model_error"]) for r in matching.asked(rows, model, lambda p: len(p.split()), 3).collect()}
    assert got == {1: ("A B C", None), 2: (None, "Prompt has 4 tokens; maximum is 3"), 3: ("", None)}
    assert [r["model_error"] for r in matching.asked(rows.where("i = 1"), lambda p: p).collect()] == [None]


def test_request_body(spark):
    body = json.loads(spark.createDataFrame([('say "x"\n',)], "p string").select(matching.request(F.col("p"), "m").alias("b")).first()["b"])
    assert body["messages"] == [{"role": "system", "content": matching.SYSTEM}, {"role": "user", "content": 'say "x"\n'}] and body["temperature"] == 0 and body["model"] == "m"
    assert body["response_format"]["json_schema"]["strict"] and body["response_format"]["json_schema"]["schema"] == json.loads(matching.output_schema())


def test_model_contract(spark):
    schema = json.loads(matching.output_schema())
    assert set(schema["required"]) == set(schema["properties"]) == set(ANSWER) and not schema["additionalProperties"]
    assert schema["properties"]["impact_score"] == {"type": "number", "minimum": 0, "maximum": 30}
    assert schema["properties"]["quantified_lines"] == {"type": "integer", "minimum": 0}
    rows = spark.createDataFrame([(5120,), (5121,), (None,)], "n int").select(matching.length_error(F.col("n")).alias("e")).collect()
    assert [r["e"] for r in rows] == [None, "Prompt has 5121 tokens; maximum is 5120", None]


def test_retrieval(spark):
    cv, _ = pointer.rebuilt(RECORD, pointer.lines_of(SOURCE))
    rows = spark.createDataFrame([(1, json.dumps(cv), "prefer specific action verbs"), (2, json.dumps(cv), "zzz")], "id int, cv string, jd string").withColumn("cv", F.from_json("cv", CV))
    got = {r["id"]: [s["id"] for s in r["sources"]] for r in matching.retrieved(rows, "id", "cv", "jd").collect()}
    assert got[1][0] == "project_rubric_tone_v1" and len(got[2]) == 3


def test_evaluation_keeps_columns_of_clashing_names(spark):
    p = F.struct(F.lit(1).alias("page_count"), F.lit(1).alias("native_text_pages"), F.lit(900).alias("character_count"), F.lit(9).alias("block_count"), F.lit(False).alias("likely_multi_column"), F.lit(False).alias("needs_ocr"))
    rows = spark.createDataFrame([("Python developer\nSkills: SQL", "We need Python and SQL", "a", "b", "c")], "cv_text string, jd_text string, scores string, matched string, total string").withColumn("profile", p)
    plain = scoring.evaluate(rows.drop("scores", "matched", "total")).first()["result"]
    out = scoring.evaluate(rows.withColumn("result", F.lit(1))).first()
    assert (out["scores"], out["matched"], out["total"]) == ("a", "b", "c") and out["result"] == plain
    items = scoring.description_skills(rows)
    assert scoring.evaluate(items, jd_skills="jd_skills").first()["result"] == plain


def places(value, path=""):
    """All places of a nested value, as evaluation.leaves has them."""
    if isinstance(value, dict):
        return {k: v for name, x in value.items() for k, v in places(x, f"{path}.{name}".lstrip(".")).items()}
    if isinstance(value, list):
        return {f"{path}[]": str(len(value))} | {k: v for i, x in enumerate(value) for k, v in places(x, f"{path}[{i}]").items()}
    return {path: value}


def test_differences_of_records(spark):
    """Deep, typed and null-safe: against a plain walk over pairs of changed records."""
    ship(spark)
    full = {**RECORD, "projects": [{"name": "n", "role": "", "technologies": ["a", "b"], "details_span": None}], "awards": ["w"]}
    changes = [([], None), (["summary_span"], None), (["summary_span"], [2, 3]), (["awards"], []), (["awards"], ["w", "v"]), (["projects"], []), (["projects", 0, "technologies"], ["a"]), (["education", 0, "gpa"], None), (["skills", "hard_skills"], ["SQL", "Python"]), (["projects", 0, "details_span"], [1, 2])]
    def apply(path, value):
        out = copy.deepcopy(full)
        at = out
        for k in path[:-1]:
            at = at[k]
        if path:
            at[path[-1]] = value
        return out

    records = [apply(p, v) for p, v in changes]
    rows = spark.createDataFrame([(i, json.dumps(full), json.dumps(r)) for i, r in enumerate(records)], "i int, gold string, raw string").select("i", "raw", pointer.typed_pointer(F.col("gold")).alias("gold"), F.lit(SOURCE).alias("text"))
    rows = rows.withColumn("cv", pointer.reconstruct(F.col("gold"), F.col("text"))["cv"].cast(CV))
    parsed = pointer.with_pointer(jsonc.with_parse(rows, F.col("raw")), F.col("text"))
    got = {r["i"]: r for r in evaluation.sample_errors(parsed, "i", "gold", "cv").collect()}
    want = places(full)
    show = lambda v: v if v is None or isinstance(v, str) else str(float(v)) if isinstance(v, float) else str(v)
    for i, record in enumerate(records):
        have = places(record)
        paths = sorted(k for k in {**want, **have} if (k in want, want.get(k)) != (k in have, have.get(k)))
        assert [d["path"] for d in got[i]["pointer_differences"]] == paths and got[i]["pointer_exact"] == (not paths), i
        assert all(d["expected"] == (show(want[d["path"]]) if d["path"] in want else evaluation.MISSING) or "gpa" in d["path"] for d in got[i]["pointer_differences"])
    assert got[0]["cvschema_exact"] and got[0]["status"] == "success" and not got[0]["span_errors"]
    assert [tuple(x) for x in got[2]["span_errors"]] == [("summary_span", "[2,2]", "[2,3]")] and [tuple(x) for x in got[1]["span_errors"]] == [("summary_span", "[2,2]", None)]
    assert [tuple(x) for x in got[5]["span_errors"]] == [("projects[0].details_span", None, evaluation.MISSING)]
    assert [d["path"] for d in got[2]["cv_differences"]] == ["summary"] and not got[8]["cvschema_exact"]
    lost = pointer.with_pointer(jsonc.with_parse(rows.where("i = 0").withColumn("raw", F.lit("no")), F.col("raw")), F.col("text"))
    none = evaluation.sample_errors(lost, "i", "gold", "cv").first()
    assert none["status"] == "failed" and not none["pointer_exact"] and not none["cvschema_exact"] and len(none["pointer_differences"]) == len(want) and len(none["span_errors"]) == 3


def test_sound_records_have_no_problems(spark):
    """What one cast finds sound has no problem; each odd value sends a record to the full look."""
    import json

    from pyspark.sql import functions as F

    from talentlake.operators import jsonc, pointer

    masked = {k: pointer.MASK for k in ("name", "email", "phone")} | {"github_url": ""}
    good = {
        "personal_info": masked, "summary_span": [1, 1], "skills": {"hard_skills": ["SQL"], "soft_skills": []},
        "experience": [{"company": "aé\"\\/\n", "job_title": "b", "duration": "c", "description_span": None}],
        "projects": [{"name": "", "role": "", "technologies": ["x"], "details_span": [2, 3]}],
        "education": [{"degree": "", "university": "", "gpa": 4.0, "year_graduated": 2020}, {"degree": "", "university": "", "gpa": None, "year_graduated": None}],
        "certifications": [], "activities": [], "awards": ["x"],
    }
    bad = []
    for path in (("summary_span",), ("skills",), ("skills", "hard_skills"), ("experience", 0), ("experience", 0, "company"), ("experience", 0, "description_span"), ("education", 0, "gpa"), ("education", 0, "year_graduated"), ("awards", 0), ("personal_info", "name")):
        for odd in (None, "x", 5, 2.0, True, [], {}, [2.0, 3.0], [1, None], [0, 1], [3, 2], [1, 9], [1, 2, 3], [1, 2], "DELETE"):
            one = json.loads(json.dumps(good))
            at = one
            for k in path[:-1]:
                at = at[k]
            at[path[-1]] = odd
            if odd == "DELETE":
                del at[path[-1]]
            bad.append(one)
    bad += [good | {"more": 1}, [], "x", None]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate([good, *bad])], "i int, raw string").withColumn("v", jsonc.variant(F.col("raw")))
    got = dict(rows.select("i", pointer.sound("v", "4")).collect())
    assert got[0] and not any(got[i] and pointer.problems(x, 4) for i, x in enumerate([good, *bad]))
    assert sum(got.values()) > 5
