"""Types of parsed JSON: a VARIANT is walked along a declared shape, and what is missing or of another type is told by its path.

``from_json`` makes a value of a wrong type null, so that it cannot be told from one that is not there. Here a text is parsed once, and each value is looked up
in what was parsed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from planlake.functions.nested import let

#: A shape is a kind, or a kind with what it holds: (ARRAY, shape of its elements), (OBJECT, {field: shape}). A field whose name ends in ? may be missing or null. Several kinds are joined by |.
Shape = str | tuple

KINDS = ("OBJECT", "ARRAY", "STRING", "NUMBER", "BOOLEAN", "NULL")


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, NUMBER, BOOLEAN or NULL of a VARIANT; null where there is no value."""

    def named(told: Column) -> Column:
        head = F.regexp_extract(told, "^[A-Z]+", 0)
        return F.when(head.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN"), head).when(head == "VOID", "NULL").when(told.isNotNull(), "NUMBER")

    return let(F.schema_of_variant(value), named)


def field(value: Column, name: str) -> Column:
    """A field of an object as VARIANT; null where it is missing."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def has_list(value: Column, name: str) -> Column:
    """Whether an object has a list under name."""
    return F.coalesce(kind_of(field(value, name)) == "ARRAY", F.lit(False))


def _strings(*xs: Column) -> Column:
    return F.array(*xs).cast("array<string>")


def faults(value: Column, shape: Shape, path: Column | str = "$") -> Column:
    """array<string> of the faults of a VARIANT: "path: missing" and "path: KIND for KIND", in the order of the shape; what hangs below a fault is not looked at."""
    at = F.lit(path) if isinstance(path, str) else path
    kinds, inner = (shape, None) if isinstance(shape, str) else shape

    def told(found: Column) -> Column:
        missing = F.when(found.isNull(), _strings(F.concat(at, F.lit(": missing"))))
        wrong = F.when(~found.isin(*kinds.split("|")), _strings(F.concat(at, F.lit(": "), found, F.lit(f" for {kinds}"))))
        below = _strings()
        if isinstance(inner, Mapping):
            below = F.when(found == "OBJECT", F.concat(*[_field_faults(value, k, s, at) for k, s in inner.items()])).otherwise(below)
        elif inner is not None:
            items = F.try_variant_get(value, "$", "array<variant>")
            each = F.transform(items, lambda x, i: faults(x, inner, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
            below = F.when(found == "ARRAY", F.flatten(each)).otherwise(below)
        return F.coalesce(missing, wrong, below)

    return let(kind_of(value), told)


def _field_faults(value: Column, name: str, shape: Shape, at: Column) -> Column:
    optional, plain = name.endswith("?"), name.rstrip("?")
    path = F.concat(at, F.lit(f".{plain}"))

    def told(x: Column) -> Column:
        return F.when(F.coalesce(kind_of(x), F.lit("NULL")) == "NULL", _strings()).otherwise(faults(x, shape, path)) if optional else faults(x, shape, path)

    return let(field(value, plain), told)


_TEXTS = ("ARRAY", "STRING")
AGENT: Shape = ("OBJECT", {"agent_role": "STRING", "goal": "STRING", "backstory?": "STRING", "description?": "STRING", "tools": _TEXTS})
STEP: Shape = (
    "OBJECT",
    {"id": "STRING", "agent": "STRING", "objective": "STRING", "instruction": "STRING", "tool?": "STRING", "requires_human_input?": "BOOLEAN", "expected_output": "STRING", "depends_on?": _TEXTS},
)
SUBTASK: Shape = ("OBJECT", {"id": "STRING", "name": "STRING", "subtask_objective?": "STRING", "steps": ("ARRAY", STEP)})
#: The shape of a plan's output.
PLAN: Shape = ("OBJECT", {"agents": ("ARRAY", AGENT), "subtasks": ("ARRAY", SUBTASK), "execution_order": ("ARRAY", "STRING|OBJECT")})
