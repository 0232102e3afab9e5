"""Pointer records: validation, spans, reconstruction from source lines, and the parse of a whole response.

One description of the record (SHAPE) is walked twice: problems() over a Python value, and variant_problems(), which builds
the expression that finds the same problems in a variant. Whole responses are parsed by the latter, without Python.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.functions.text import source_lines
from talentlake.operators.jsonc import attempt, free_names, once, variant
from talentlake.operators.policy import policy_message, skill_policy
from talentlake.schemas import CV, EVIDENCE, ISSUES, POINTER

PARSER_VERSION = "talentlake-pointer-1"
MASK = "[MASKED]"
MISSING = "__MISSING__"
#: The record by field: a kind, or the fields of an object, or of each object of a list.
SHAPE = {
    "personal_info": {"name": "masked", "email": "masked", "phone": "masked", "github_url": "text"},
    "summary_span": "span",
    "skills": {"hard_skills": "texts", "soft_skills": "texts"},
    "experience": [{"company": "text", "job_title": "text", "duration": "text", "description_span": "span"}],
    "projects": [{"name": "text", "role": "text", "technologies": "texts", "details_span": "span"}],
    "education": [{"degree": "text", "university": "text", "gpa": "number", "year_graduated": "integer"}],
    "certifications": "texts",
    "activities": "texts",
    "awards": "texts",
}
#: Span fields and the text fields that they become.
TEXT_OF = {"summary_span": "summary", "description_span": "description", "details_span": "details"}


def _as_text(shape):
    if isinstance(shape, list):
        return [_as_text(shape[0])]
    return {TEXT_OF.get(k, k): "text" if v == "span" else _as_text(v) if isinstance(v, dict | list) else v for k, v in shape.items()}


#: The reconstructed record.
CV_SHAPE = _as_text(SHAPE)


class _Walk:
    """Collects the problems of a value against a shape."""

    def __init__(self, line_count: int):
        self.line_count, self.issues = line_count, []

    def say(self, code: str, field: str, message: str, category: str = "schema", retryable: bool = True) -> None:
        self.issues.append((code, field, message, category, retryable))

    def expect(self, ok: bool, code: str, field: str, what: str, value) -> bool:
        if not ok:
            self.say(code, field, f"expected {what}, got {type(value).__name__}")
        return ok

    def keys(self, value, shape: dict, field: str) -> bool:
        if not self.expect(isinstance(value, dict), "object_type", field, "object", value):
            return False
        for code, words, names in (("missing_keys", "missing keys", shape.keys() - value.keys()), ("extra_keys", "extra keys", value.keys() - shape.keys())):
            if names:
                self.say(code, field, f"{words}: {sorted(names)}")
        return value.keys() == shape.keys()

    def each(self, value: dict, shape: dict, at: str) -> None:
        for name, kind in shape.items():
            self.visit(value.get(name), kind, at + name)

    def visit(self, value, kind, field: str) -> None:
        if isinstance(kind, dict):  # fields are looked at only if all are there
            if self.keys(value, kind, field):
                self.each(value, {k: "text" if v == "masked" else v for k, v in kind.items()}, f"{field}.")
                for name, v in kind.items():
                    if v == "masked" and isinstance(value[name], str) and value[name] != MASK:
                        self.say("pii_not_masked", f"{field}.{name}", f"must be {MASK}", "policy", False)
        elif isinstance(kind, list):
            if self.expect(isinstance(value, list), "array_type", field, "array", value):
                for i, item in enumerate(value):
                    self.keys(item, kind[0], f"{field}[{i}]")
                    if isinstance(item, dict):
                        self.each(item, kind[0], f"{field}[{i}].")
        elif kind == "texts":
            if self.expect(isinstance(value, list), "array_type", field, "array", value):
                for i, item in enumerate(value):
                    self.visit(item, "text", f"{field}[{i}]")
        elif kind == "text":
            self.expect(isinstance(value, str), "string_type", field, "string", value)
        elif kind == "number":
            self.expect(value is None or type(value) in (int, float), "number_or_null_type", field, "number or null", value)
        elif kind == "integer":
            self.expect(value is None or type(value) is int, "integer_or_null_type", field, "integer or null", value)
        elif value is not None:
            self.span(value, field)

    def span(self, value, field: str) -> None:
        if not (isinstance(value, list) and len(value) == 2 and all(type(x) is int for x in value)):
            self.say("span_type", field, "expected null or exactly two integer line numbers")
            return
        start, end = value
        for bad, code, message in (
            (start < 1, "span_start_before_first_line", f"start={start}, minimum=1"),
            (end < start, "span_reversed", f"start={start}, end={end}"),
            (end > self.line_count, "span_end_after_last_line", f"end={end}, line_count={self.line_count}"),
        ):
            if bad:
                self.say(code, field, message, "span")


def problems(value, line_count: int, shape: dict = SHAPE) -> list[tuple]:
    """All problems of a value as (code, field, message, category, retryable), in document order."""
    walk = _Walk(line_count)
    walk.keys(value, shape, "$")
    if isinstance(value, dict):
        walk.each(value, shape, "")
    return walk.issues


def lines_of(text: str) -> list[str]:
    return [s for s in map(str.strip, text.splitlines()) if s]


def rebuilt(pointer: dict, lines: list[str]) -> tuple[dict, dict]:
    """(record, evidence) of a valid pointer: spans become the lines that they cite."""
    evidence: dict[str, dict] = {}

    def walk(value, path: str):
        if isinstance(value, list):
            return [walk(x, f"{path}[{i}]") for i, x in enumerate(value)]
        if not isinstance(value, dict):
            return value
        out = {}
        for k, v in value.items():
            if k in TEXT_OF:
                text = "" if v is None else "\n".join(lines[v[0] - 1 : v[1]])
                evidence[f"{path}.{TEXT_OF[k]}".lstrip(".")] = {"span": v, "text": text}
                out[TEXT_OF[k]] = text
            else:
                out[k] = walk(v, f"{path}.{k}".lstrip("."))
        return out

    return walk(pointer, ""), evidence


def canonical(cv: dict) -> dict:
    """A valid record in the shape's order, grades as floating numbers."""

    def order(value, shape):
        if isinstance(shape, dict):
            return {k: order(value[k], s) for k, s in shape.items()}
        if isinstance(shape, list):
            return [order(x, shape[0]) for x in value]
        return float(value) if shape == "number" and value is not None else value

    return order(cv, CV_SHAPE)


# -- the same in built-in functions, over variants ----------------------------------------------------------------------
# The expression is built as SQL text: it has some thousand parts, each of which would be a call to the JVM otherwise.

_NONE = f"CAST(array() AS {ISSUES})"
_QUOTED = r"""CASE WHEN contains({0}, "'") AND NOT contains({0}, '"') THEN concat('"', replace({0}, '\\', '\\\\'), '"') ELSE concat("'", replace(replace({0}, '\\', '\\\\'), "'", "\\'"), "'") END"""


class _Names:
    """Fresh names of lambda variables."""

    def __init__(self):
        self.n = 0

    def __call__(self, start: str) -> str:
        self.n += 1
        return f"{start}{self.n}"


def _text(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


def _sql_once(names: _Names, value: str, build: Callable[[str], str]) -> str:
    """build over a name for a value that is computed once."""
    x = names("x")
    return f"transform(array({value}), {x} -> {build(x)})[0]"


def _sql_issue(code: str, field: str, message: str, category: str = "schema", retryable: bool = True) -> str:
    return f"named_struct('code', '{code}', 'field', {field}, 'message', {message}, 'category', '{category}', 'retryable', {str(retryable).lower()})"


def _sql_if(bad: str, issue: str) -> str:
    return f"CASE WHEN {bad} THEN array({issue}) ELSE {_NONE} END"


def _sql_kind(names: _Names, value: str) -> str:
    """The kind of a variant, named as messages name it. A number with a fraction, also of zero, is a float."""
    return _sql_once(names, f"coalesce(schema_of_variant({value}), 'VOID')", lambda k: (
        f"CASE WHEN {k} = 'STRING' THEN 'str' WHEN {k} = 'VOID' THEN 'NoneType' WHEN {k} = 'BIGINT' OR {k} RLIKE '^DECIMAL[(](19|[23][0-9]),0[)]$' THEN 'int' "
        f"WHEN {k} = 'BOOLEAN' THEN 'bool' WHEN startswith({k}, 'ARRAY') THEN 'list' WHEN startswith({k}, 'OBJECT') THEN 'dict' ELSE 'float' END"
    ))


def kind_of(value: str) -> Column:
    """The kind of a variant, given as SQL: NoneType, str, bool, int, float, list or dict."""
    return F.expr(_sql_kind(_Names(), value))


class _Sql:
    """SQL of the problems of a variant against a shape, in the order of _Walk."""

    def __init__(self, line_count: str):
        self.names, self.line_count = _Names(), line_count

    def expect(self, value: str, kinds: tuple[str, ...], code: str, field: str, what: str) -> str:
        allowed = ", ".join(map(_text, kinds))
        return _sql_once(self.names, _sql_kind(self.names, value), lambda k: _sql_if(f"{k} NOT IN ({allowed})", _sql_issue(code, field, f"concat('expected {what}, got ', {k})")))

    def keys(self, value: str, fields: str, shape: dict, field: str) -> str:
        known = "array(" + ", ".join(map(_text, sorted(shape))) + ")"
        shown = lambda found: f"concat('[', array_join(transform(array_sort({found}), y -> {_QUOTED.format('y')}), ', '), ']')"
        parts = []
        for code, words, found in (("missing_keys", "missing keys: ", f"array_except({known}, map_keys({fields}))"), ("extra_keys", "extra keys: ", f"array_except(map_keys({fields}), {known})")):
            parts.append(_sql_once(self.names, found, lambda x, code=code, words=words: _sql_if(f"size({x}) > 0", _sql_issue(code, field, f"concat('{words}', {shown(x)})"))))
        return f"CASE WHEN {fields} IS NULL THEN {self.expect(value, ('dict',), 'object_type', field, 'object')} ELSE concat({', '.join(parts)}) END"

    def each(self, fields: str, shape: dict, at: str | None) -> str:
        path = lambda name: _text(name) if at is None else f"concat({at}, {_text('.' + name)})"
        found = [_sql_once(self.names, f"try_element_at({fields}, {_text(name)})", lambda v, name=name, kind=kind: self.visit(v, kind, path(name))) for name, kind in shape.items()]
        return f"concat({', '.join(found)})"

    def listed(self, value: str, field: str, item: Callable[[str, str], str]) -> str:
        x, i = self.names("x"), self.names("i")
        wrong = self.expect(value, ("list",), "array_type", field, "array")
        inside = lambda items: f"CASE WHEN {items} IS NULL THEN {wrong} ELSE flatten(transform({items}, ({x}, {i}) -> {item(x, i)})) END"
        return _sql_once(self.names, f"try_variant_get({value}, '$', 'array<variant>')", inside)

    def visit(self, value: str, kind, field: str) -> str:
        numbered = lambda i: f"concat({field}, '[', CAST({i} AS STRING), ']')"
        if isinstance(kind, dict):  # fields are looked at only if all are there
            return self.fields_of(value, lambda f: self.closed(value, f, kind, field))
        if isinstance(kind, list):
            item = lambda x, i: self.fields_of(x, lambda f: f"concat({self.keys(x, f, kind[0], numbered(i))}, CASE WHEN {f} IS NULL THEN {_NONE} ELSE {self.each(f, kind[0], numbered(i))} END)")
            return self.listed(value, field, item)
        if kind == "texts":
            return self.listed(value, field, lambda x, i: self.visit(x, "text", numbered(i)))
        if kind == "text":
            return self.expect(value, ("str",), "string_type", field, "string")
        if kind == "number":
            return self.expect(value, ("NoneType", "int", "float"), "number_or_null_type", field, "number or null")
        if kind == "integer":
            return self.expect(value, ("NoneType", "int"), "integer_or_null_type", field, "integer or null")
        return self.span(value, field)

    def fields_of(self, value: str, build: Callable[[str], str]) -> str:
        return _sql_once(self.names, f"try_variant_get({value}, '$', 'map<string,variant>')", build)

    def closed(self, value: str, fields: str, kind: dict, field: str) -> str:
        found = [self.each(fields, {k: "text" if v == "masked" else v for k, v in kind.items()}, field)]
        for name in (n for n, v in kind.items() if v == "masked"):
            own = f"try_element_at({fields}, {_text(name)})"
            issue = _sql_issue("pii_not_masked", f"concat({field}, {_text('.' + name)})", _text(f"must be {MASK}"), "policy", False)
            found.append(_sql_if(f"schema_of_variant({own}) = 'STRING' AND try_variant_get({own}, '$', 'string') <> '{MASK}'", issue))
        return _sql_once(self.names, self.keys(value, fields, kind, field), lambda k: f"CASE WHEN size({k}) > 0 THEN {k} ELSE concat({', '.join(found)}) END")

    def span(self, value: str, field: str) -> str:
        x, count = self.names("x"), f"CAST({self.line_count} AS STRING)"

        def inside(items: str) -> str:
            paired = f"coalesce(size({items}) = 2 AND forall({items}, {x} -> {_sql_kind(self.names, x)} = 'int'), false)"
            ends = ", ".join(f"'{c}', try_variant_get(get({items}, {k}), '$', 'decimal(38,0)')" for c, k in (("a", 0), ("b", 1)))
            wrong = _sql_issue("span_type", field, "'expected null or exactly two integer line numbers'")
            return f"CASE WHEN coalesce(schema_of_variant({value}), 'VOID') = 'VOID' THEN {_NONE} WHEN {paired} THEN {_sql_once(self.names, f'named_struct({ends})', broken)} ELSE array({wrong}) END"

        def broken(s: str) -> str:
            a, b = f"CAST({s}.a AS STRING)", f"CAST({s}.b AS STRING)"
            rules = (
                (f"{s}.a < 1", "span_start_before_first_line", f"concat('start=', {a}, ', minimum=1')"), (f"{s}.b < {s}.a", "span_reversed", f"concat('start=', {a}, ', end=', {b})"),
                (f"{s}.b > {self.line_count}", "span_end_after_last_line", f"concat('end=', {b}, ', line_count=', {count})"),
            )
            return f"concat({', '.join(_sql_if(bad, _sql_issue(code, field, message, 'span')) for bad, code, message in rules)})"

        return _sql_once(self.names, f"try_variant_get({value}, '$', 'array<variant>')", inside)


def variant_problems(value: str, line_count: str, shape: dict = SHAPE) -> Column:
    """All problems of a variant, as problems() has them and in its order, without Python. Both are given as SQL."""
    sql = _Sql(line_count)
    found = sql.fields_of(value, lambda f: f"concat({sql.keys(value, f, shape, _text('$'))}, CASE WHEN {f} IS NULL THEN {_NONE} ELSE {sql.each(f, shape, None)} END)")
    return F.expr(found)


def _sql_type(kind) -> str:
    """A shape's type with fields by name, as variants have them; numbers and spans, whose kinds count, stay variants."""
    if isinstance(kind, dict):
        return f"struct<{','.join(f'{k}:{_sql_type(kind[k])}' for k in sorted(kind))}>"
    if isinstance(kind, list):
        return f"array<{_sql_type(kind[0])}>"
    return {"texts": "array<string>", "text": "string", "masked": "string"}.get(kind, "variant")


def _sql_sound(names: _Names, x: str, kind, line_count: str) -> str:
    """SQL of whether a value of _sql_type has no problem."""
    if isinstance(kind, dict):
        return " AND ".join([f"{x} IS NOT NULL", *[f"({_sql_sound(names, f'{x}.{k}', v, line_count)})" for k, v in kind.items()]])
    if isinstance(kind, list) or kind == "texts":
        y = names("y")
        return f"{x} IS NOT NULL AND forall({x}, {y} -> coalesce({_sql_sound(names, y, 'text' if kind == 'texts' else kind[0], line_count)}, false))"
    if kind in ("text", "masked"):
        return f"{x} = '{MASK}'" if kind == "masked" else f"{x} IS NOT NULL"
    if kind == "span":
        s = names("s")
        ends = f"exists(array(try_variant_get({x}, '$', 'array<int>')), {s} -> size({s}) = 2 AND {s}[0] >= 1 AND {s}[1] >= {s}[0] AND {s}[1] <= {line_count})"
        return f"is_variant_null({x}) OR (schema_of_variant({x}) = 'ARRAY<BIGINT>' AND {ends})"
    return f"is_variant_null({x}) OR schema_of_variant({x}) IN ('BIGINT'{', ' + repr('DOUBLE') if kind == 'number' else ''}){' OR startswith(schema_of_variant(' + x + '), ' + repr('DECIMAL') + ')' if kind == 'number' else ''}"


def sound(value: str, line_count: str, shape: dict = SHAPE) -> Column:
    """Whether a variant is for certain a record without problems, by one cast: the typed record's JSON is then the variant's
    own, so all fields are there, no others, and of their kinds. Where it says no, variant_problems has to look."""
    kind, names = _sql_type(shape), _Names()
    text = lambda x: f"to_json({x}, map('ignoreNullFields', 'false'))"
    test = lambda r: f"coalesce({_sql_sound(names, r, shape, line_count)}, false) AND {text(r)} = to_json({value})"
    return F.coalesce(F.expr(_sql_once(names, f"try_variant_get({value}, '$', '{kind}')", test)), F.lit(False))


def typed_paths(value: str, shape: dict = SHAPE) -> Column:
    """(path, kind) of the fields that a shape names, as they are in a variant (given as SQL); list items by their number."""
    names = _Names()
    cell = lambda path, x: f"named_struct('path', {path}, 'kind', {_sql_kind(names, x)})"
    got = lambda x, path, kind="variant": f"try_variant_get({x}, '{path}', '{kind}')"
    paths = []
    for name, kind in shape.items():
        at = f"$.{name}"
        own = [at, *[f"{at}.{k}" for k in kind]] if isinstance(kind, dict) else [at]
        paths.append(f"array({', '.join(cell(_text(p), got(value, p)) for p in own)})")
        if isinstance(kind, list):
            cells = ", ".join(cell(f"concat('{at}[', CAST(i AS STRING), '].{k}')", got("x", f"$.{k}")) for k in kind[0])
            paths.append(f"coalesce(flatten(transform({got(value, at, 'array<variant>')}, (x, i) -> array({cells}))), CAST(array() AS array<struct<path:string,kind:string>>))")
    return F.expr(f"concat({', '.join(paths)})")


def _issue(code: str, field: Column, message: Column, category: str, retryable: bool = True) -> Column:
    return F.struct(F.lit(code).alias("code"), field.alias("field"), message.alias("message"), F.lit(category).alias("category"), F.lit(retryable).alias("retryable"))


RESULT = (
    "struct<parser_version:string,status:string,strict_json:boolean,recoverable_json:boolean,recovery_steps:array<string>,parsed_json:string,"
    f"pointer_schema_valid:boolean,span_contract_valid:boolean,cv_json:string,cvschema_valid:boolean,skill_policy_valid:boolean,evidence:{EVIDENCE},"
    f"retry_targets:array<string>,issues:{ISSUES},strict_error:string,recovery_error:string>"
)


def with_pointer(rows: DataFrame, source: Column, parse: str = "parse", out: str = "pointer_parse") -> DataFrame:
    """rows with a struct `out`: the parse of a response, from jsonc.with_parse's struct and the source text; null where the
    source has no line. All of it is built-in functions over the response's variant, in steps that are columns of their own."""
    names = free_names(rows, "p_lines", "p_variant", "p_kind", "p_found", "p_valid", "p_made", "p_policy")
    lines, value, kind, found, valid, made, policy = map(F.col, names)
    j, cv = F.col(parse), made["cv"]
    lost = kind == "NoneType"
    has = lambda *kinds: F.exists(found, lambda i: i["category"].isin(*kinds))
    why = F.coalesce(j["recovery_error"], j["strict_error"], F.lit("unknown JSON error"))
    staged = rows.withColumn(names[0], source_lines(source)).withColumn(names[1], variant(j["value"])).withColumn(names[2], kind_of(names[1]))
    issues = F.when(lost, F.array(_issue("json_not_recoverable", F.lit("$"), why, "json")))
    issues = issues.when(sound(names[1], f"size({names[0]})"), F.array().cast(ISSUES)).otherwise(variant_problems(names[1], f"size({names[0]})"))
    staged = staged.withColumn(names[3], issues)
    staged = staged.withColumn(names[4], F.struct((~lost & ~has("schema", "policy")).alias("shaped"), (~lost & ~has("schema", "policy", "span")).alias("spanned")))
    record = F.when(valid["spanned"], F.try_variant_get(value, "$", POINTER))
    staged = staged.withColumn(names[5], once(record, lambda r: F.when(r.isNotNull(), _rebuilt(r, lines))))
    staged = staged.withColumn(names[6], skill_policy(cv["skills"]["hard_skills"], cv["skills"]["soft_skills"])["message"])
    spanned = valid["spanned"]
    unskilled = F.array(_issue("skill_policy", F.lit("skills"), policy, "policy", False))
    every = F.when(policy.isNull(), found).otherwise(F.concat(found, unskilled))
    status = F.when(lost, "failed").when(spanned & policy.isNull() & (F.size(found) == 0), "success").otherwise("needs_review")
    cells = {
        "parser_version": F.lit(PARSER_VERSION), "status": status, "strict_json": j["strict_json"], "recoverable_json": j["recoverable_json"],
        "recovery_steps": j["recovery_steps"], "parsed_json": F.when(kind == "dict", j["value"]), "pointer_schema_valid": valid["shaped"],
        "span_contract_valid": spanned, "cv_json": F.when(spanned, F.to_json(cv, {"ignoreNullFields": "false"})), "cvschema_valid": spanned,
        "skill_policy_valid": spanned & policy.isNull(), "evidence": made["evidence"],
        "retry_targets": F.array_distinct(F.transform(F.filter(found, lambda i: i["retryable"]), lambda i: i["field"])), "issues": every,
        "strict_error": j["strict_error"], "recovery_error": j["recovery_error"],
    }
    result = F.struct(*[c.alias(n) for n, c in cells.items()]).cast(RESULT)
    return staged.withColumn(out, F.when(F.size(lines) > 0, result)).drop(*names)


def skill_key(value: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", value).casefold().split())


def parsed_record(json_parse: Column) -> Column:
    """The check of a direct record (no pointers) from jsonc.with_parse's struct: its shape, then its skills; cv_json is its canonical form."""
    kind = "struct<schema_valid:boolean,schema_error:string,skill_policy_valid:boolean,skill_policy_error:string,cv_json:string>"
    return F.udf(_parse_record, kind, useArrow=True)(json_parse["value"])


def _parse_record(value):
    record = json.loads(value) if value is not None else None
    if record is None:
        return (False, "json_not_recoverable", False, "schema_invalid", None)
    found = problems(record, 1, CV_SHAPE)
    if found:
        return (False, "; ".join(f"{i[1]}:{i[0]}" for i in found), False, "schema_invalid", None)
    message = policy_message([skill_key(s) for s in record["skills"]["hard_skills"]], [skill_key(s) for s in record["skills"]["soft_skills"]])
    return (True, None, message is None, message, json.dumps(canonical(record), ensure_ascii=False))


def issues_of(value: Column, line_count: Column) -> Column:
    """Problems of a pointer record given as JSON."""
    return F.udf(_issues_of, ISSUES, useArrow=True)(value, line_count)


def _issues_of(value, line_count):
    parsed, ok, _ = attempt(value or "")
    return problems(parsed, line_count) if ok else [("json_not_recoverable", "$", "unknown JSON error", "json", True)]


def span_issues(span: Column, line_count: Column) -> Column:
    """Codes of all rules that a typed span (null: no span) breaks."""
    bad = F.size(span) != 2
    start, end = F.get(span, F.lit(0)), F.get(span, F.lit(1))
    codes = F.array(
        F.when(bad | start.isNull() | end.isNull(), F.lit("span_type")),
        F.when(~bad & (start < 1), F.lit("span_start_before_first_line")),
        F.when(~bad & (end < start), F.lit("span_reversed")),
        F.when(~bad & (end > line_count), F.lit("span_end_after_last_line")),
    )
    return F.when(span.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(codes))


def span_text(lines: Column, span: Column) -> Column:
    """The lines that a valid span cites, or the empty text for none."""
    start, end = F.get(span, F.lit(0)), F.get(span, F.lit(1))
    return F.when(span.isNull(), F.lit("")).otherwise(F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n"))


def reconstruct(pointer: Column, source: Column) -> Column:
    """struct(cv, evidence) of a typed, valid pointer, in built-in functions."""
    return once(source_lines(source), lambda lines: _rebuilt(pointer, lines))


def _rebuilt(pointer: Column, lines: Column) -> Column:
    cite = lambda s: span_text(lines, s)
    cv = F.struct(
        pointer["personal_info"].alias("personal_info"), cite(pointer["summary_span"]).alias("summary"), pointer["skills"].alias("skills"),
        F.transform(pointer["experience"], lambda e: F.struct(e["company"], e["job_title"], e["duration"], cite(e["description_span"]).alias("description"))).alias("experience"),
        F.transform(pointer["projects"], lambda p: F.struct(p["name"], p["role"], p["technologies"], cite(p["details_span"]).alias("details"))).alias("projects"),
        *[pointer[k].alias(k) for k in ("education", "certifications", "activities", "awards")],
    )
    entry = lambda key, s: F.struct(key.alias("key"), F.struct(s.alias("span"), cite(s).alias("text")).alias("value"))
    path = lambda name, i, what: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"].{what}"))
    evidence = F.map_from_entries(F.concat(
        F.array(entry(F.lit("summary"), pointer["summary_span"])),
        F.transform(pointer["experience"], lambda e, i: entry(path("experience", i, "description"), e["description_span"])),
        F.transform(pointer["projects"], lambda p, i: entry(path("projects", i, "details"), p["details_span"])),
    ))
    return F.struct(cv.alias("cv"), evidence.alias("evidence"))


def span_slots(pointer: Column) -> Column:
    """All places for spans as (path, kind, span)."""
    slot = lambda path, kind, s: F.struct(path.alias("path"), F.lit(kind).alias("kind"), s.alias("span"))
    path = lambda name, i, what: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"].{what}"))
    return F.concat(
        F.array(slot(F.lit("summary_span"), "summary_span", pointer["summary_span"])),
        F.transform(pointer["experience"], lambda e, i: slot(path("experience", i, "description_span"), "experience.description_span", e["description_span"])),
        F.transform(pointer["projects"], lambda p, i: slot(path("projects", i, "details_span"), "projects.details_span", p["details_span"])),
    )


def typed_cv(cv_json: Column) -> Column:
    return F.from_json(cv_json, CV)


def typed_pointer(pointer_json: Column) -> Column:
    return F.from_json(pointer_json, POINTER)
