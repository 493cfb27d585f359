"""Tolerant JSON: parsing by tiers, repair, label responses, balanced objects and preference payloads."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from planlake.functions.nested import let
from planlake.functions.text import without_fences

# The labels of questions, in reporting order.
LABELS = ("API_USAGE", "CONCEPTUAL", "DISCREPANCY", "ERRORS", "REVIEW", "API_CHANGE", "LEARNING")


def outermost(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def outermost_list(text: Column) -> Column:
    """From the first opening to the last closing bracket; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))


def _if_parsed(text: Column, opening: str) -> Column:
    """text if it is JSON that opens so, else null."""
    return let(text, lambda t: F.when(F.ltrim(t).startswith(opening) & F.try_parse_json(t).isNotNull(), t))


def object_text(text: Column) -> Column:
    """The JSON object in a response: as it stands, without fences, or between its outermost braces; null if none parses.

    Each way is tried only if those before it fail, and bound once, so that a text is parsed once by each.
    """
    inner = lambda plain: let(outermost(plain), lambda o: F.coalesce(_if_parsed(o, "{"), _if_parsed(repaired(o), "{"), _if_parsed(repaired(with_quotes_mended(o)), "{")))
    return let(text, lambda t: F.coalesce(_if_parsed(t, "{"), let(without_fences(t), lambda plain: F.coalesce(_if_parsed(plain, "{"), inner(plain)))))


def object_variant(text: Column) -> Column:
    """object_text, parsed: a VARIANT that each way of finding the object parses once."""
    read = lambda x: let(x, lambda t: F.when(F.ltrim(t).startswith("{"), F.try_parse_json(t)))
    inner = lambda plain: let(outermost(plain), lambda o: F.coalesce(read(o), read(repaired(o)), read(repaired(with_quotes_mended(o)))))
    return let(text, lambda t: F.coalesce(read(t), let(without_fences(t), lambda plain: F.coalesce(read(plain), inner(plain)))))


def object_or_list_text(text: Column) -> Column:
    """The JSON object in a response, or else its list: a plan may come as a bare list of steps."""
    inner = lambda plain: let(outermost_list(plain), lambda o: F.coalesce(_if_parsed(o, "["), _if_parsed(repaired(o), "[")))
    return let(text, lambda t: let(without_fences(t), lambda plain: F.coalesce(_if_parsed(plain, "["), object_text(t), inner(plain))))


_STRING = r'"(?:[^"\\]++|\\.)*+"'


def outside_strings(text: Column, fix) -> Column:
    """text with fix applied to what stands between its quoted strings, which stay as they are."""

    def joined(t: Column) -> Column:
        between = F.transform(F.call_function("split", t, F.lit(_STRING), F.lit(-1)), fix)
        strings = F.regexp_extract_all(t, F.lit(_STRING), F.lit(0))
        return F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("b"), strings.alias("s")), lambda x: F.array(x["b"], F.coalesce(x["s"], F.lit(""))))), "")

    return let(text, joined)


def repaired(text: Column) -> Column:
    """Common faults mended, outside of strings: comments, trailing commas, bare keys; and stray backslashes within them."""

    def fix(x: Column) -> Column:
        out = F.regexp_replace(x, r"(?m)//.*$", "")
        out = F.regexp_replace(out, r"(?s)/\*.*?\*/", "")
        out = F.regexp_replace(out, r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)(\s*:)", '$1"$2"$3')
        return out

    keyed = outside_strings(F.regexp_replace(text, r'\\(?!["\\/bfnrtu])', r"\\\\"), fix)
    # a comma may stand before a comment that is gone now, so trailing commas go last
    return outside_strings(keyed, lambda x: F.regexp_replace(x, r",(\s*[}\]])", "$1"))


def normal_labels(labels: Column, allowed: tuple[str, ...] = LABELS) -> Column:
    """Upper case with underscores, known ones only, first occurrences in order."""
    from planlake.functions.text import strip

    known = F.array(*[F.lit(x) for x in allowed])
    clean = F.transform(labels, lambda x: F.replace(F.upper(strip(x)), F.lit(" "), F.lit("_")))
    return F.array_distinct(F.filter(clean, lambda x: F.array_contains(known, x)))


def label_response(text: Column, allowed: tuple[str, ...] = LABELS) -> Column:
    """struct<labels, reasoning, parse_warning> of a response: its JSON object, or else the label names that it mentions, with a warning."""

    def answered(body: Column) -> Column:
        return let(F.from_json(body, "labels string, reasoning string"), said)

    def said(found: Column) -> Column:
        # a list arrives as its JSON text, a single label as itself
        labels = let(found["labels"], lambda x: F.coalesce(F.from_json(x, "array<string>"), F.when(x.isNotNull(), F.array(x))))
        reasoning = F.coalesce(found["reasoning"], F.lit(""))
        return let(labels, lambda x: F.when(x.isNotNull(), F.struct(normal_labels(x, allowed).alias("labels"), reasoning.alias("reasoning"), F.lit(False).alias("parse_warning"))))

    named = let(F.upper(text), lambda t: F.filter(F.array(*[F.lit(x) for x in allowed]), lambda x: F.contains(t, x)))
    mentioned = F.struct(named.alias("labels"), F.lit("").alias("reasoning"), F.lit(True).alias("parse_warning"))
    return F.coalesce(let(object_text(text), answered), mentioned)


def last_object(text: Column | str) -> Column:
    """The last balanced top-level {...} of a text, heeding strings and escapes; null if there is none.

    A fold over the marks that matter, quotes, braces and backslashes, and what stands between them, which keeps depth and state.
    """
    text = F.col(text) if isinstance(text, str) else text
    nothing = F.lit(0)
    start = F.struct(F.lit(1).alias("at"), nothing.alias("depth"), nothing.alias("opened"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), nothing.alias("first"), nothing.alias("end"))

    def step(s: Column, mark: Column) -> Column:
        opens, closes = ~s["quoted"] & (mark == "{"), ~s["quoted"] & (mark == "}") & (s["depth"] > 0)
        whole = closes & (s["depth"] == 1)
        at = s["at"] + F.length(mark)
        turned = F.when(s["quoted"], s["escaped"] | (mark != '"')).otherwise((mark == '"') & (s["depth"] > 0))
        return F.struct(
            at.alias("at"),
            (s["depth"] + opens.cast("int") - closes.cast("int")).alias("depth"),
            F.when(opens & (s["depth"] == 0), s["at"]).otherwise(s["opened"]).alias("opened"),
            turned.alias("quoted"),
            (s["quoted"] & ~s["escaped"] & (mark == "\\")).alias("escaped"),
            F.when(whole, s["opened"]).otherwise(s["first"]).alias("first"),
            F.when(whole, at).otherwise(s["end"]).alias("end"),
        )

    marks = F.regexp_extract_all(text, F.lit(r'["{}\\]|[^"{}\\]+'), F.lit(0))
    cut = lambda t: let(F.aggregate(marks, start, step), lambda s: F.when(s["end"] > 0, F.substring(t, s["first"], s["end"] - s["first"])))
    return let(text, cut)


#: A quote that may end a string: the text ends after it, or a colon or a closing bracket follows, or a comma and, past comments, what may come next in a list or an object.
_ENDS_STRING = r'"(?=\s*(?:[:}\]]|$|,\s*(?:(?://[^\n]*\n|/\*(?s:.*?)\*/)\s*)*(?:["{}\[\]\d-]|[A-Za-z_]\w*\s*:|(?:true|false|null)\b)))'


def with_quotes_mended(text: Column) -> Column:
    """text with the quotes inside its strings escaped: within a string, a quote that no mark of JSON follows cannot be its end.

    A fold over quotes, escapes and what stands between them, which knows whether it is within a string.
    """
    start = F.struct(F.lit(False).alias("within"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, part: Column) -> Column:
        quote = part.startswith('"')
        stray = quote & s["within"] & (part == '"')
        shown = F.when(stray, F.lit('\\"')).when(quote, F.lit('"')).otherwise(part)
        return F.struct(F.when(quote & ~stray, ~s["within"]).otherwise(s["within"]).alias("within"), F.array_append(s["parts"], shown).alias("parts"))

    marked = F.regexp_replace(text, _ENDS_STRING, '"\u0001')
    parts = F.regexp_extract_all(marked, F.lit(r'(?s)"\x01?|\\.|\\|[^"\\]+'), F.lit(0))
    return F.array_join(F.aggregate(parts, start, step)["parts"], "")


def _said(value) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        inner = next((value[k] for k in ("content", "text", "value", "messages") if k in value), None)
        return _said(inner) if inner is not None else json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        spoken = [x for x in value if isinstance(x, dict) and x.get("role") == "assistant"]
        return "\n".join(_said(x) for x in spoken or value)
    return "" if value is None else str(value)


def _payload(text: str | None) -> str:
    for parse in (json.loads, ast.literal_eval):
        try:
            return _said(parse(text or ""))
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
    return text or ""


@F.pandas_udf(StringType())
def payload_text(texts: pd.Series) -> pd.Series:
    """A preference payload's text: JSON, else a literal list, else as it stands; what assistants say goes first."""
    return texts.map(_payload)


def python_json(indent: int | None = None):
    """A function of JSON text: the same with the spacing of Python's writer, non-ASCII kept, indented if asked for."""

    @F.pandas_udf(StringType())
    def write(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=False, indent=indent))

    return write
