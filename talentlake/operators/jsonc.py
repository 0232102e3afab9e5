"""Strict JSON: wrappers of model responses, and parsing that rejects what is not interoperable.

Numbers keep their kinds as far as the built-in type has them: whole numbers of over 38 digits count as floating."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.functions.text import SPACE, strip

STEPS = ("leading_think", "leading_tool_call_close", "markdown_fence")
RESULT = "struct<strict_json:boolean,recoverable_json:boolean,recovery_steps:array<string>,value:string,strict_error:string,recovery_error:string>"


def once(value: Column, build: Callable[[Column], Column]) -> Column:
    """build over a value that is computed once, however often build names it."""
    return F.transform(F.array(value), build)[0]


def unwrapped(raw: Column) -> Column:
    """A response without its known wrappers, struct (candidate, steps): whole leading think blocks, then closing tool-call
    tags, then a code fence around all of it. Each step is named if it changed the text."""
    fence = f"^(?is)[{SPACE}]*```(?:json)?[{SPACE}]*\\n?(.*?)\\n?```[{SPACE}]*$"

    def thought(start: Column) -> Column:
        return once(F.regexp_replace(start, f"^(?s)(?:<think>.*?</think>[{SPACE}]*)+", ""), lambda think: called(start, think))

    def called(start: Column, think: Column) -> Column:
        return once(F.regexp_replace(think, f"^(?:[{SPACE}]*</tool_call>[{SPACE}]*)+", ""), lambda calls: once(calls.rlike(fence), lambda fenced: named(start, think, calls, fenced)))

    def named(start: Column, think: Column, calls: Column, fenced: Column) -> Column:
        body = F.when(fenced, strip(F.regexp_extract(calls, fence, 1))).otherwise(calls)
        steps = F.array_compact(F.array(F.when(think != start, F.lit(STEPS[0])), F.when(calls != think, F.lit(STEPS[1])), F.when(fenced, F.lit(STEPS[2]))))
        return F.struct(body.alias("candidate"), steps.alias("steps"))

    return once(strip(raw), thought)


class _Contract(ValueError):
    pass


def _constant(name: str):
    raise _Contract(f"non_standard_json_constant={name}")


def _distinct(pairs):
    out = dict(pairs)
    if len(out) < len(pairs):
        seen = set()
        raise _Contract("duplicate_json_key=" + next(k for k, _ in pairs if k in seen or seen.add(k)))
    return out


def strict_loads(text: str):
    """A JSON value; ValueError for repeated keys, NaN, infinities and text behind the value."""
    return json.loads(text, parse_constant=_constant, object_pairs_hook=_distinct)


def attempt(text: str) -> tuple[object, bool, str | None]:
    """(value, parsed, error) of a text."""
    try:
        return strict_loads(text), True, None
    except (ValueError, RecursionError) as e:
        return None, False, str(e)


#: What is said of a text that can't begin a value.
NO_VALUE = "Expecting value: line 1 column 1 (char 0)"


#: The name of a field that no text can know.
_END = f"end_{uuid.uuid4().hex}"


def variant(text: Column) -> Column:
    """A text's JSON value; null if it isn't strict JSON: repeated keys, constants beyond the standard, text behind the value.

    The built-in parser stops behind the first value. So the text stands as the first field of an object whose last field
    has a name drawn at random: that field is there only if the text ended where it should."""
    whole = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(f',"{_END}":0}}')))
    return F.when(F.try_variant_get(whole, f"$.{_END}", "int").isNotNull(), F.try_variant_get(whole, "$.v", "variant"))


def _errors(first, second):
    """(parsed, error) of the texts that the JVM refused."""
    out = []
    for text in (first, second):
        _, ok, error = (None, None, None) if text is None else attempt(text)
        out += [ok, error]
    return tuple(out)


def _refused(first: Column, second: Column) -> Column:
    """struct(ok1, error1, ok2, error2): one Python pass over texts that begin like JSON but are refused; null for others."""
    return F.udf(_errors, "struct<ok1:boolean,error1:string,ok2:boolean,error2:string>", useArrow=True)(first, second)


def _begins(text: Column) -> Column:
    """Whether a text may begin a value, as far as its first sign tells."""
    return text.rlike(r'^[ \t\n\r]*[\[{"\-0-9tfnNI\x{feff}]')


def strict_json(text: Column) -> Column:
    """struct(ok, value, error): whether a text is strict JSON, the value as canonical JSON, and the error."""
    return F.udf(_strict, "struct<ok:boolean,value:string,error:string>", useArrow=True)(text)


def _strict(text):
    if text is None:
        return None
    value, ok, error = attempt(text)
    return (ok, json.dumps(value, ensure_ascii=False) if ok else None, error)


def free_names(rows: DataFrame, *names: str) -> list[str]:
    """Names like these that rows have no column for."""
    taken = {c.lower() for c in rows.columns}
    return [n + "_" * (1 + max(map(len, taken))) if n in taken else n for n in names]


def with_parse(rows: DataFrame, raw: Column, out: str = "parse") -> DataFrame:
    """rows with a struct `out` of a response in two phases, the stripped text as it is, then without its wrappers:
    (strict_json, recoverable_json, recovery_steps, value, strict_error, recovery_error). Both errors are kept; value is the
    strict JSON text.

    Built-in functions judge all texts; only such as begin like JSON and are refused go to Python, for their errors. The
    steps are columns of their own, so that each is computed once and plans stay small."""
    names = free_names(rows, "parse_first", "parse_clean", "parse_fine", "parse_ask", "parse_found")
    first, clean, fine, ask, found = map(F.col, names)
    second = clean["candidate"]
    staged = rows.withColumn(names[0], strip(raw)).withColumn(names[1], unwrapped(first))
    staged = staged.withColumn(names[2], F.struct(variant(first).isNotNull().alias("one"), (variant(F.when(second != first, second)).isNotNull()).alias("two")))
    lost = ~fine["one"] & ~fine["two"]
    asks = F.struct(F.when(~fine["one"] & _begins(first), first).alias("one"), F.when(lost & _begins(second) & (second != first), second).alias("two"))
    staged = staged.withColumn(names[3], asks).withColumn(names[4], _refused(ask["one"], ask["two"]))
    known = first.isNotNull()
    ok1 = fine["one"] | F.coalesce(found["ok1"], F.lit(False))
    ok2 = fine["two"] | F.coalesce(found["ok2"], F.lit(False)) | ok1
    error1 = F.when(~ok1, F.coalesce(found["error1"], F.lit(NO_VALUE)))
    error2 = F.when(~ok2, F.when(second == first, error1).otherwise(F.coalesce(found["error2"], F.lit(NO_VALUE))))
    result = F.struct(
        F.when(known, ok1).alias("strict_json"), F.when(known, ok2).alias("recoverable_json"),
        F.when(ok1, F.array().cast("array<string>")).otherwise(clean["steps"]).alias("recovery_steps"), F.when(ok1, first).when(ok2, second).alias("value"),
        F.when(known, error1).alias("strict_error"), F.when(known, error2).alias("recovery_error"),
    )
    return staged.withColumn(out, result).drop(*names)


def key_problems(keys: Column, expected) -> Column:
    """(missing, extra) of an object's keys, each sorted."""
    known = F.array(*[F.lit(k) for k in sorted(expected)])
    return F.struct(F.array_except(known, keys).alias("missing"), F.array_sort(F.array_except(keys, known)).alias("extra"))
