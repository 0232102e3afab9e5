"""Matching strategies: the deterministic one and those that ask a language model, which is passed in as a function."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.functions.text import round1
from talentlake.operators.jsonc import once, variant
from talentlake.operators.retrieve import top_k
from talentlake.operators.scoring import verdict
from talentlake.schemas import MATCH_OUTPUT

# Fixed value: the names of the strategies in results.
STRATEGIES = {
    "deterministic_b1": "B1 · Deterministic baseline",
    "zero_shot_m1": "M1 · Zero-shot (Groq Qwen 3.8 27B)",
    "few_shot_m2": "M2 · Few-shot (Groq Qwen 3.8 27B)",
    "rag_m3": "M3 · RAG thử nghiệm (Groq Qwen 3.8 27B)",
}
PAYLOAD = ("summary", "skills", "experience", "projects", "education", "certifications", "activities", "awards")
#: Ranges of a model's numbers (fixed values).
RANGES = {"impact_score": (0, 30), "semantic_score": (0, 35), "tone_score": (0, 15), "must_have_coverage": (0, 1), "quantified_lines": (0, None)}
# Fixed value: the guidance that retrieval ranks, (id, status, text).
KNOWLEDGE = (
    ("project_rubric_skill_evidence_v1", "internal_project_rubric", "Only count a JD skill as matched when the CV explicitly states the skill or an approved alias. A skill listed without experience or project evidence may be reported as unverified. Never invent experience."),
    ("project_rubric_impact_v1", "internal_project_rubric", "Impact evidence combines a concrete action, its context and an observable result. Quantified results are stronger, but absence of a number alone does not prove that an achievement is false."),
    ("project_rubric_tone_v1", "internal_project_rubric", "Prefer specific action verbs and direct descriptions of contribution. Flag passive phrases such as responsible for, participated in, helped with or worked on when a more precise action is available."),
    ("project_rubric_ats_v1", "internal_project_rubric", "ATS layout evidence must come from the PDF analysis. An LLM receiving structured CV text must not infer fonts, columns, icons or reading order. The ATS score supplied by the deterministic PDF analyzer is fixed."),
)

# Fixed value: the examples that the few-shot strategy shows.
EXAMPLES = """\
Example A: CV explicitly states Python and FastAPI in a project; JD requires Python, FastAPI and Docker.
Expected: matched_skills=["Python","FastAPI"], missing_skills=["Docker"], must_have_coverage=0.6667.
Do not claim Docker experience or recommend adding it unless the candidate truly has it.

Example B: CV lists AWS in Skills but no experience/project mentions AWS; JD requires AWS.
Expected: AWS can be matched lexically and must also appear in unverified_skills. The improvement should ask for truthful evidence or removal."""
# Fixed value: the prompt; its places are for strategy, context, layout score, record and description.
PROMPT = """\
You are an evidence-grounded CV-to-JD matching engine.
Strategy: {}
{}

The PDF analyzer already fixed ATS score at {}/20. Do not rescore layout.
Score only Impact (0-30), Semantic match (0-35), and Tone (0-15).
Use only facts explicitly present in CVSchema and JD. Never invent skills, years, metrics or achievements.
Keep improvements truthful: recommend adding a missing skill only if the candidate actually has it; otherwise recommend learning it.

=== CVSchema 2.0 without personal contact fields ===
{}

=== JOB DESCRIPTION ===
{}

Return data matching the required JSON schema. matched_skills and missing_skills must be grounded in the JD.
"""
#: Most tokens of a prompt that a model is given (fixed value).
MOST_TOKENS = 5120
#: JSON Schema of the types in an answer.
KINDS = {"double": {"type": "number"}, "int": {"type": "integer"}, "string": {"type": "string"}, "array<string>": {"type": "array", "items": {"type": "string"}}}


def payload(cv: Column) -> Column:
    """A record without its personal fields, as JSON."""
    return F.to_json(F.struct(*[cv[k].alias(k) for k in PAYLOAD]), {"ignoreNullFields": "false"})


def knowledge(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(KNOWLEDGE)], "position int, id string, source_status string, text string")


def retrieved(queries: DataFrame, key: str, cv: str, jd: str, k: int = 3) -> DataFrame:
    """(key, sources): the k pieces of guidance nearest to each description and record's skills, best first."""
    c = F.col(cv)["skills"]
    text = F.concat_ws(" ", F.col(jd), F.array_join(F.concat(c["hard_skills"], c["soft_skills"]), " "))
    found = top_k(queries.select(F.col(key).alias("query_id"), text.alias("text")), knowledge(queries.sparkSession).select(F.col("position").alias("item_id"), "text"), k, empty=True)
    ranked = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("r"))
    pieces = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("id", "source_status", "text"), row, strict=True)]) for row in KNOWLEDGE])  # texts are not shuffled
    of = lambda x: once(F.element_at(pieces, x["item_id"] + 1), lambda p: F.struct(x["rank"].alias("rank"), p["id"].alias("id"), p["source_status"].alias("source_status"), p["text"].alias("text")))
    return ranked.select(F.col("query_id").alias(key), F.transform("r", of).alias("sources"))


def prompts(rows: DataFrame, strategy: str, cv: str = "cv", jd: str = "jd_text", ats: str = "ats", sources: str = "sources", examples: str = EXAMPLES) -> DataFrame:
    """rows with the prompt of a strategy; rag_m3 reads the retrieved sources."""
    if strategy not in STRATEGIES or strategy == "deterministic_b1":
        raise ValueError(f"no such model strategy: {strategy}")
    context = {
        "zero_shot_m1": F.lit("No examples or retrieved knowledge are provided. Evaluate zero-shot."),
        "few_shot_m2": F.lit("Use these formatting and evidence examples:\n" + examples),
        "rag_m3": F.concat(F.lit("Use the retrieved internal project rubric below. Do not present it as an external academic quotation:\n"), F.to_json(F.col(sources))) if sources in rows.columns else F.lit(""),
    }[strategy]
    values = [F.lit(strategy), context, F.col(ats).cast("string"), payload(F.col(cv)), F.col(jd)]
    pieces = [F.lit(piece) for piece in PROMPT.split("{}")]
    body = F.concat(pieces[0], *[part for value, piece in zip(values, pieces[1:], strict=True) for part in (value, piece)])
    return rows.withColumn("prompt", body)


def asked(rows: DataFrame, model: Callable[[str], str], tokens: Callable[[str], int] | None = None, most: int = MOST_TOKENS) -> DataFrame:
    """rows with raw_output, what the model, a function from prompt to text, answers, and model_error. It runs batch by
    batch on executors. With tokens, a function that counts a prompt's, one of over `most` is refused before the model is
    called: it has no output but an error. A prompt is never cut."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = [tokens(p) if tokens else 0 for p in b["prompt"]]
            outputs = [model(p) if n <= most else None for p, n in zip(b["prompt"], sizes, strict=True)]
            errors = [None if n <= most else f"Prompt has {n} tokens; maximum is {most}" for n in sizes]
            yield b.assign(raw_output=pd.Series(outputs, b.index, dtype=object), model_error=pd.Series(errors, b.index, dtype=object))

    return rows.mapInPandas(ask, type(rows.schema)([*rows.schema.fields]).add("raw_output", "string").add("model_error", "string"))


def _typed(kind: str, value: Column) -> Column:
    """Whether a variant has the kind of a field."""
    schema = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    if kind == "string":
        return schema == "STRING"
    if kind == "double":
        return (schema == "BIGINT") | (schema == "DOUBLE") | schema.startswith("DECIMAL")
    if kind == "int":
        return (schema == "BIGINT") | schema.rlike(r"^DECIMAL\(\d+,0\)$")
    return F.coalesce(F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"), F.lit(False))


def output_problems(raw: Column) -> Column:
    """What is wrong with a model's answer: no strict JSON object, missing or unknown keys, values of another type, and
    numbers out of range. Numbers in quotes and truth values are no numbers; a whole number may be written with a zero
    fraction."""
    kinds = dict(f.split(" ", 1) for f in MATCH_OUTPUT.split(", "))
    known = F.array(*[F.lit(n) for n in kinds])
    named = lambda start, found: F.transform(F.array_sort(found), lambda k: F.concat(F.lit(start), k))

    def judged(fields: Column) -> Column:
        keys = F.map_keys(fields)
        checks = []
        for name, kind in kinds.items():
            value = F.try_element_at(fields, F.lit(name))
            lo, hi = RANGES.get(name, (None, None))
            number = F.try_variant_get(value, "$", "double")
            beyond = F.lit(False) if lo is None else (number < lo) | (number > hi if hi is not None else F.lit(False))
            wrong = F.when(~_typed(kind, value), F.lit(f"type:{name}")).when(beyond, F.lit(f"range:{name}"))
            checks.append(F.when(value.isNotNull(), wrong))
        return F.concat(named("missing:", F.array_except(known, keys)), named("extra:", F.array_except(keys, known)), F.array_compact(F.array(*checks)))

    found = once(F.try_variant_get(variant(raw), "$", "map<string,variant>"), lambda f: F.when(f.isNotNull(), judged(f)))
    return F.coalesce(found, F.array(F.lit("json")))


def merged(rows: DataFrame, strategy: str, raw: str = "raw_output", result: str = "result") -> DataFrame:
    """rows with result made from a model's valid answer and the fixed layout score of the deterministic result, and
    `problems` of the answer (of a clashing name, `problems_`). An answer with problems is refused: its result is null."""
    told = "problems"
    while told in rows.columns:
        told += "_"
    packed = rows.select(F.struct(*[F.col(c) for c in rows.columns]).alias("row"), F.from_json(F.col(raw), MATCH_OUTPUT).alias("o"), output_problems(F.col(raw)).alias("p"))
    o, r = F.col("o"), F.col("row")[result]
    out = packed.withColumn("t", round1(r["scores"]["ats"] + o["impact_score"] + o["semantic_score"] + o["tone_score"]))
    keep = lambda name: o[name].alias(name)
    scores = F.struct(r["scores"]["ats"].alias("ats"), *[round1(o[f"{k}_score"]).alias(k) for k in ("impact", "semantic", "tone")])
    notes = F.struct(r["score_notes"]["ats"].alias("ats"), *[o[f"{k}_notes"].alias(k) for k in ("impact", "semantic", "tone")])
    new = F.struct(
        F.col("t").alias("total_score"), verdict(F.col("t")).alias("verdict"), scores.alias("scores"), notes.alias("score_notes"), r["cv_skills"].alias("cv_skills"), r["jd_skills"].alias("jd_skills"),
        keep("matched_skills"), keep("missing_skills"), keep("unverified_skills"), F.bround(o["must_have_coverage"], 4).alias("must_have_coverage"), keep("action_verbs_found"), keep("passive_phrases_found"),
        keep("quantified_lines"), F.slice(o["strengths"], 1, 5).alias("strengths"), F.slice(o["improvements"], 1, 5).alias("improvements"), r["extraction"].alias("extraction"),
        F.lit(STRATEGIES[strategy]).alias("method"), F.lit(strategy).alias("strategy"),
    )
    made = out.select("row", "p", F.when(F.size("p") == 0, new).alias("made"))
    return made.select(*[F.col("made").alias(c) if c == result else F.col("row")[c].alias(c) for c in rows.columns], F.col("p").alias(told))


def length_error(tokens: Column, most: int = MOST_TOKENS) -> Column:
    """Why a prompt of so many tokens is not given to a model; null if it is. A null count is of an empty prompt."""
    return F.when(tokens > most, F.format_string("Prompt has %d tokens; maximum is %d", tokens, F.lit(most)))


def output_schema() -> str:
    """The JSON Schema of an answer, for a model's structured output."""
    fields = dict(f.split(" ", 1) for f in MATCH_OUTPUT.split(", "))
    properties = {}
    for name, kind in fields.items():
        low, high = RANGES.get(name, (None, None))
        properties[name] = {**KINDS[kind], **({"minimum": low} if low is not None else {}), **({"maximum": high} if high is not None else {})}
    return json.dumps({"type": "object", "additionalProperties": False, "properties": properties, "required": list(fields)})


#: Fixed values of a request: the system message, the schema's name and the most tokens of an answer.
SYSTEM, SCHEMA_NAME, ANSWER_TOKENS = "Return only evidence-grounded structured matching data.", "cv_jd_matching", 1600


def request(prompt: Column, model: str) -> Column:
    """The body of a request to a chat model, as JSON: both messages, no sampling, and the strict schema of the answer."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    head = F.to_json(F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(SYSTEM)), message("user", F.coalesce(prompt, F.lit("")))).alias("messages")))
    schema = {"type": "json_schema", "json_schema": {"name": SCHEMA_NAME, "strict": True, "schema": json.loads(output_schema())}}
    rest = json.dumps({"temperature": 0, "reasoning_effort": "none", "max_tokens": ANSWER_TOKENS, "response_format": schema}, separators=(",", ":"))
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit("," + rest[1:]))
