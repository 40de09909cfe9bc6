"""Check JSON answers against a declared schema, as one expression.

A schema is a ``StructType``; the metadata of a field says what its values may
be (``enum``), and whether null is one of them.  ``violations`` walks it once, on
the driver, and returns an expression that lists every departure of a text from
it as ``(path, value, rule)``; nothing is parsed in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, StringType, StructField, StructType

from colloquy import vocab

FOUND = "array<struct<path:string,value:string,rule:string>>"

# Rules, in the order in which they are tried on a value.
NOT_JSON, MISSING, NULL, WRONG_TYPE, NOT_LISTED, NOT_DECLARED = "not_json", "missing", "null", "wrong_type", "not_listed", "not_declared"


def text(name: str, enum=None, nullable: bool = False) -> StructField:
    return StructField(name, StringType(), nullable, {"enum": list(enum)} if enum else {})


def texts(name: str, enum=None) -> StructField:
    return StructField(name, ArrayType(StringType(), False), False, {"enum": list(enum)} if enum else {})


def truth(name: str) -> StructField:
    return StructField(name, BooleanType(), False)


def items(name: str, *fields: StructField) -> StructField:
    return StructField(name, ArrayType(StructType(list(fields)), False), False)


def part(name: str, *fields: StructField) -> StructField:
    return StructField(name, StructType(list(fields)), False)


QUESTIONS = [f"q{n}" for n in range(1, vocab.N_QUESTIONS + 1)]

SEGMENTS = StructType([items("positions", texts("question_ids", QUESTIONS), text("source_passage"), text("position_gist"), truth("is_background_only"))])
ANALYSIS = StructType([
    texts("question_ids", QUESTIONS), text("position", vocab.STANCES), text("primary_issue"), text("secondary_issue", nullable=True),
    text("stakeholder_concern"), text("requested_fda_action"), text("confidence", vocab.CONFIDENCE), texts("gap_tags", vocab.GAPS),
    items("gap_explanations", text("gap", vocab.GAPS), text("explanation")), text("public_summary"),
])
RESPONSE_TYPES = StructType([items("positions", text("segment_id"), text("response_type", vocab.RESPONSE_TYPES))])
SYNTHESIS = StructType([
    text("saying"), text("dominant_response_type", vocab.RESPONSE_TYPES),
    part("disagreement", truth("exists"), texts("about", vocab.DISAGREEMENT_TOPICS), text("text"),
         items("sides", text("summary"), texts("position_ids"))),
    part("stakeholder_divide", truth("claimed"), texts("groups"), text("text")), texts("evidence_position_ids"),
])
COMMENTER = StructType([
    text("display_name"), text("organization"), text("stakeholder_type"), text("source_identity_text"), text("confidence", vocab.CONFIDENCE)])


def _one(path: Column, value: Column, rule: str) -> Column:
    return F.array(F.struct(path.alias("path"), value.alias("value"), F.lit(rule).alias("rule"))).cast(FOUND)


def _none() -> Column:
    return F.array().cast(FOUND)


def _kind(raw: Column) -> Column:
    """What a JSON text holds, by how it begins."""
    first = F.substring(raw, 1, 1)
    return F.when(first == "{", F.lit("object")).when(first == "[", F.lit("array")).when(first == '"', F.lit("text")).when(
        raw.isin("true", "false"), F.lit("truth")).when(raw == "null", F.lit("null")).otherwise(F.lit("number"))


def _check(kind: DataType, text: Column, path: Column, nullable: bool, enum: list | None) -> Column:
    """Departures of one value, given as JSON text.  Each value is bound once: it
    is read in many places below."""
    return vocab.once(F.struct(text.alias("raw"), path.alias("path")), lambda own: _departures(kind, own["raw"], own["path"], nullable, enum))


def _departures(kind: DataType, raw: Column, path: Column, nullable: bool, enum: list | None) -> Column:
    holds = _kind(raw)
    if isinstance(kind, StructType):
        expected, inside = "object", _object(kind, raw, path)
    elif isinstance(kind, ArrayType):
        of, numbered = kind.elementType, F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "struct<v:array<variant>>")["v"]
        each = F.transform(numbered, lambda v, i: _check(
            of, F.to_json(v), F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), False, enum))
        expected, inside = "array", F.coalesce(F.flatten(each), _none())
    elif isinstance(kind, BooleanType):
        expected, inside = "truth", _none()
    else:
        bare = F.variant_get(F.try_parse_json(raw), "$", "string")
        expected = "text"
        inside = F.when(~F.coalesce(bare.isin(list(enum)), F.lit(False)), _one(path, bare, NOT_LISTED)).otherwise(_none()) if enum else _none()
    empty = _none() if nullable else _one(path, F.lit(None).cast("string"), NULL)
    return F.when(holds == "null", empty).when(holds != expected, _one(path, raw, WRONG_TYPE)).otherwise(inside)


def _object(kind: StructType, raw: Column, path: Column) -> Column:
    """Departures of the fields of an object, and fields that it should not have."""
    names = kind.fieldNames()

    def departures(held):
        found = []
        for field in kind.fields:
            here = F.concat(path, F.lit(f".{field.name}"))
            own = F.to_json(F.try_element_at(held, F.lit(field.name)))
            present = F.coalesce(F.map_contains_key(held, field.name), F.lit(False))
            found.append(F.when(~present, _one(here, F.lit(None).cast("string"), MISSING)).otherwise(
                _check(field.dataType, F.coalesce(own, F.lit("null")), here, field.nullable, field.metadata.get("enum"))))
        extra = F.array_sort(F.filter(F.map_keys(held), lambda k: ~k.isin(names)))
        found.append(F.transform(extra, lambda k: F.struct(
            F.concat(path, F.lit("."), k).alias("path"), F.to_json(F.try_element_at(held, k)).alias("value"), F.lit(NOT_DECLARED).alias("rule"))).cast(FOUND))
        return F.flatten(F.array(*found))

    return vocab.once(F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "struct<v:map<string,variant>>")["v"], departures)


def unfenced(answer: Column) -> Column:
    """An answer without the code fence it may stand in."""
    from colloquy.functions.text import strip

    return F.regexp_replace(strip(F.coalesce(answer, F.lit(""))), r"^```(?:json)?\s*|\s*```$", "")


def violations(answer: Column, schema: StructType) -> Column:
    """Every ``(path, value, rule)`` in which a JSON answer departs from a schema;
    an empty list for one that keeps to it.  A path begins with ``$``."""
    bare = unfenced(answer)
    parsed = F.try_parse_json(bare)
    raw = F.to_json(parsed)
    return F.when(parsed.isNull(), _one(F.lit("$"), F.substring(bare, 1, 80), NOT_JSON)).otherwise(_check(schema, raw, F.lit("$"), False, None))
