"""JSON out of free text, as Column expressions: fences, trailing commas, and the first balanced object or array.

The scanner is a pushdown automaton over lexemes: runs of characters that mean nothing, quotes, escapes and brackets. Its stack
holds one kind of bracket only, so a depth stands for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[ \t\n\r]*"
_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
_SCALAR = rf"(?s)^{_BLANK}(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|{_STRING}){_BLANK}$"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def unfenced(value: Column) -> Column:
    """What the first fenced block holds, or else the text; without white space at the ends."""
    fence = r"(?s)```(?:json|JSON)?\s*(.*?)```"
    inside = F.when(value.rlike(fence), F.regexp_extract(value, fence, 1)).otherwise(value)
    return F.regexp_replace(inside, r"^\s+|\s+$", "")


def without_trailing_commas(value: Column) -> Column:
    return F.regexp_replace(value, r",\s*([}\]])", "$1")


def balanced(value: Column, left: str = "{", right: str = "}") -> Column:
    """The text from the first left bracket to the right one that closes it; null without either. Brackets in strings don't count."""
    start_at = F.instr(value, left)
    lexemes = lambda at: F.regexp_extract_all(F.substring(value, at, F.length(value)), F.lit(rf'(?s)\\.?|["\{left}\{right}]|[^\\"\{left}\{right}]+'), 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("size"), F.lit(False).alias("closed"))

    def step(s: Column, x: Column) -> Column:
        # Outside of strings a backslash means nothing, so what follows it is a sign of its own.
        sign = F.when(F.startswith(x, F.lit("\\")) & ~s["quoted"], F.substring(x, 2, 1)).otherwise(x)
        depth = s["depth"] + F.when(s["quoted"], 0).when(sign == left, 1).when(sign == right, -1).otherwise(0)
        quoted = F.when(sign == '"', ~s["quoted"]).otherwise(s["quoted"])
        end = F.struct(depth.alias("depth"), quoted.alias("quoted"), (s["size"] + F.length(x)).alias("size"), ((depth == 0) & ~quoted).alias("closed"))
        return F.when(s["closed"], s).otherwise(end)

    def cut(at: Column) -> Column:
        return F.when(at > 0, _with(F.aggregate(lexemes(at), start, step), lambda found: F.when(found["closed"], F.substring(value, at, found["size"]))))

    return _with(start_at, cut)


def parsed(value: Column) -> Column:
    """The text as a VARIANT if all of it is one JSON value, else null; NaN and repeated keys are no JSON here."""
    return _with(F.regexp_replace(value, rf"^{_BLANK}|{_BLANK}$", ""), _parsed)


def _parsed(bare: Column) -> Column:
    whole = F.when(F.startswith(bare, F.lit("{")), balanced(bare) == bare).when(F.startswith(bare, F.lit("[")), balanced(bare, "[", "]") == bare).otherwise(bare.rlike(_SCALAR))
    return F.when(F.coalesce(whole, F.lit(False)), F.try_parse_json(bare))


def extracted(value: Column) -> Column:
    """The JSON value in a text: all of it, else its first balanced object, else its first balanced array, each with trailing commas if need be. Null for none."""
    either = lambda part: F.coalesce(parsed(part), parsed(without_trailing_commas(part)))
    return _with(unfenced(value), lambda c: F.coalesce(either(c), _with(balanced(c), either), _with(balanced(c, "[", "]"), either)))


def kind(value: Column) -> Column:
    """object, array, string, number, boolean, null, or null for no value; of a VARIANT."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), None).when(F.startswith(name, F.lit("OBJECT")), "object").when(F.startswith(name, F.lit("ARRAY")), "array").when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number")
    )


def extracted_object(value: Column) -> Column:
    """The JSON value in a text if it is an object, else null."""
    return _with(extracted(value), lambda found: F.when(kind(found) == "object", found))
