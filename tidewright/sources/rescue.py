"""JSON lines to typed columns, with everything that does not fit kept in a rescue column."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, DataType, MapType, StringType, StructType, VariantType

from tidewright.functions.fixed import CORRUPT_FIELD, RESCUED_COLUMN

_ENTRY = "array<struct<key:string,value:variant>>"

#: stands before the text of a number while a line is worked on; a line's own private-use character is escaped
ESCAPE = "\ue0f1"
MARK, ESCAPED = ESCAPE + "n", ESCAPE + "e"
#: the next number of a line outside its strings: what comes before it, then the number, which is no object key
_NUMBER = (
    r'\G((?:[^"0-9-]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+)'
    r"(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+)(?![0-9.eE+-]|\s*+:)"
)


def _parsed(line: Column) -> Column:
    """A line as a variant in which every number is a string: the mark, then the number as it is written.

    A variant would keep the number and not its text, so that 1.10, 1e3 or forty digits came back as something else.
    """
    escaped = F.when(line.contains(ESCAPE), F.replace(line, F.lit(ESCAPE), F.lit(ESCAPED))).otherwise(line)
    return F.try_parse_json(F.regexp_replace(escaped, _NUMBER, f'$1"{MARK}$2"'))


def _unmarked(json: Column) -> Column:
    """JSON text with its marked numbers as they were written."""
    written = F.replace(F.regexp_replace(json, f'"{MARK}([^"]*+)"', "$1"), F.lit(ESCAPED), F.lit(ESCAPE))
    return F.when(json.contains(ESCAPE), written).otherwise(json)


def _as_written(text: Column) -> Column:
    """A scalar's text without the mark; the JSON text of an object or array with none inside."""
    scalar = F.when(text.startswith(MARK), F.substring(text, 3, 2**31 - 1)).otherwise(_unmarked(text))
    return F.when(text.contains(ESCAPE), scalar).otherwise(text)


def _plain(variant: Column) -> Column:
    """A variant with numbers for marked strings."""
    return F.try_parse_json(_unmarked(F.to_json(variant)))


def _members(variant: Column) -> Column:
    """The fields of a JSON object by name; NULL for anything else."""
    return F.try_variant_get(variant, "$", "map<string,variant>")


def _given(raw: Column) -> Column:
    return raw.isNotNull() & ~F.is_variant_null(raw)


def _by_text(dtype: DataType) -> bool:
    return not isinstance(dtype, (VariantType, StructType, ArrayType, MapType))


def _typed(raw: Column, dtype: DataType) -> Column:
    """A variant as a value of the wanted type; NULL when it is none."""
    if isinstance(dtype, VariantType):
        return _plain(raw)
    if isinstance(dtype, StructType):
        obj = _members(raw)
        fields = [_typed(F.try_element_at(obj, F.lit(f.name)), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(obj.isNotNull(), F.struct(*fields))
    if isinstance(dtype, ArrayType) and isinstance(dtype.elementType, AtomicType):
        texts = F.try_variant_get(raw, "$", "array<string>")
        values = F.transform(texts, lambda t: _scalar(t, dtype.elementType))
        both = F.arrays_zip(texts.alias("t"), values.alias("v"))
        lost = F.exists(both, lambda e: e["t"].isNotNull() & e["v"].isNull())
        return F.when(~lost, values)
    if isinstance(dtype, (ArrayType, MapType)):
        return F.try_variant_get(_plain(raw), "$", dtype.simpleString())
    return _scalar(F.try_variant_get(raw, "$", "string"), dtype)


def _scalar(text: Column, dtype: DataType) -> Column:
    """Through text, because a variant cast would quietly turn 1.5 into the integer 1."""
    if isinstance(dtype, StringType):
        return _as_written(text)
    return F.replace(text, F.lit(MARK), F.lit("")).try_cast(dtype)  # text that holds the mark elsewhere has no type


def _misfit(raw: Column, value: Column, dtype: DataType) -> Column:
    """Whether part of a given value is lost in its typed form."""
    lost = _given(raw) & value.isNull()
    if not isinstance(dtype, StructType):
        return lost
    obj = _members(raw)
    inner = [(F.try_element_at(obj, F.lit(f.name)), value.getField(f.name), f.dataType) for f in dtype.fields]
    return lost | F.coalesce(_unclean(obj, dtype, inner), F.lit(False))


def _unclean(obj: Column, schema: StructType, fields: list[tuple[Column, Column, DataType]]) -> Column:
    """Whether an object has fields the schema lacks, or values that do not fit theirs."""
    known = functools.reduce(operator.add, [F.map_contains_key(obj, f.name).cast("int") for f in schema.fields])
    return functools.reduce(operator.or_, [_misfit(*f) for f in fields], F.size(obj) > known)


def _entry(path: str, value: Column) -> Column:
    return F.array(F.struct(F.lit(path).alias("key"), value.alias("value")))


def _entries(obj: Column, schema: StructType, prefix: str, fields: list[tuple[Column, Column, DataType]]) -> Column:
    """What an object loses: ``(dotted path, value)`` for unknown fields and for values of the wrong type."""
    parts: list[Column] = []
    for field, (raw, value, dtype) in zip(schema.fields, fields):
        path = prefix + field.name
        lost = F.when(_given(raw) & value.isNull(), _entry(path, raw))
        if isinstance(dtype, StructType):
            inner_obj = _members(raw)
            inner = [
                (F.try_element_at(inner_obj, F.lit(f.name)), value.getField(f.name), f.dataType) for f in dtype.fields
            ]
            lost = lost.when(inner_obj.isNotNull(), _entries(inner_obj, dtype, path + ".", inner))
        parts.append(lost)
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    unknown = F.filter(F.map_entries(obj), lambda e: ~F.array_contains(known, e.getField("key")))
    parts.append(
        F.transform(
            unknown,
            lambda e: F.struct(
                F.concat(F.lit(prefix), e.getField("key")).alias("key"), e.getField("value").alias("value")
            ),
        )
    )
    return F.concat(*[F.coalesce(p, F.array().cast(_ENTRY)) for p in parts])


def parse_with_rescue(
    lines: DataFrame, schema: StructType, *, value_column: str = "value", rescued_column: str = RESCUED_COLUMN
) -> DataFrame:
    """Typed columns per JSON line plus ``_rescued``: a JSON object of what did not fit, NULL when all did.

    Rescued are unknown fields, values of the wrong type (by dotted path, also inside structs) and lines that
    are no JSON object or repeat a key (whole, under ``_corrupt_record``). Numbers come back as they are written, in
    ``_rescued`` as in string columns: 1.10 is no 1.1. Other columns of ``lines`` are
    kept; blank lines are skipped, as a JSON reader does. Works on batch and streaming frames alike.

    Each line is parsed once and each field taken out once, in steps of their own; the list of what was lost
    is put together only for lines that lose something.
    """
    kept = [c for c in lines.columns if c != value_column]
    clash = sorted(set(kept) & {*schema.names, rescued_column})
    if clash:
        raise ValueError(f"columns occur twice: {clash}")
    if not schema.fields:
        raise ValueError("the schema has no columns")
    raw = [F.col(f"_raw{i}") for i in range(len(schema.fields))]
    typed = [F.col(f"_typed{i}") for i in range(len(schema.fields))]
    others = [F.col(f"`{c}`") for c in kept]
    obj = F.col("_obj")

    parsed = lines.filter(F.col(value_column).rlike(r"\S")).withColumn("_obj", _members(_parsed(F.col(value_column))))
    taken = parsed.select(
        "*", *[F.try_element_at(obj, F.lit(f.name)).alias(f"_raw{i}") for i, f in enumerate(schema.fields)]
    )
    scalars = [i for i, f in enumerate(schema.fields) if _by_text(f.dataType)]
    texts = taken.select("*", *[F.try_variant_get(raw[i], "$", "string").alias(f"_text{i}") for i in scalars])
    values = [
        (_scalar(F.col(f"_text{i}"), f.dataType) if i in scalars else _typed(raw[i], f.dataType)).alias(f"_typed{i}")
        for i, f in enumerate(schema.fields)
    ]
    fitted = texts.select("*", *values)
    fields = [(raw[i], typed[i], f.dataType) for i, f in enumerate(schema.fields)]
    whole = F.to_json(F.create_map(F.lit(CORRUPT_FIELD), F.col(value_column)))
    parts = _unmarked(F.to_json(F.map_from_entries(_entries(obj, schema, "", fields))))
    rescued = F.when(obj.isNull(), whole).when(_unclean(obj, schema, fields), parts)
    return fitted.select(
        *[typed[i].alias(f.name) for i, f in enumerate(schema.fields)], rescued.alias(rescued_column), *others
    )
