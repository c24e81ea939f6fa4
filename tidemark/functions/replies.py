"""JSON in what a model has written, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = r"(?s)```(?:json|JSON)?\s*(.*?)```"


def _sound(text: Column) -> Column:
    """The text without blanks around if it is a JSON object or array and nothing else, else null. The parser lets anything follow, so the text is parsed as the only entry of an array."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]"))), "$", "array<variant>")
    return F.when(bare.rlike(r"(?s)^[\[{]") & (F.size(alone) == 1), bare)


def reply_json(text: Column) -> Column:
    """The JSON object or array of a reply: what stands in the first fence, else the whole reply, else from the first brace or bracket to the last that closes it; null if none of these is sound."""
    fenced = _sound(F.regexp_extract(text, _FENCE, 1))
    braces, brackets = F.regexp_extract(text, r"(?s)\{.*\}", 0), F.regexp_extract(text, r"(?s)\[.*\]", 0)
    at = lambda sign: F.when(F.instr(text, sign) > 0, F.instr(text, sign)).otherwise(2**31 - 1)
    spans = F.when(at("{") < at("["), F.coalesce(_sound(braces), _sound(brackets))).otherwise(F.coalesce(_sound(brackets), _sound(braces)))
    return F.coalesce(fenced, _sound(text), spans)


def string_array(text: Column) -> Column:
    """The strings of a JSON array, others left out; empty for null, for what is no array and for what is no JSON."""
    parts = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    return F.coalesce(F.transform(F.filter(parts, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string")), F.array().cast("array<string>"))
