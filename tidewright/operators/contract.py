"""Record contracts: a JSON-Schema subset turned into column expressions.

The contract is walked once, on the driver, when the plan is built; every record is then checked by Spark
expressions over its parsed JSON (a variant), with no Python in the tasks. ``check_contract`` takes the values a
contract names out of the record level by level, as columns of their own; only what lies in arrays is bound inside
higher-order functions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.fixed import VALUE_TYPE_NAMES

Contract = Mapping[str, Any]


# a whole number that fits a long is a BIGINT; one that does not is a decimal of this shape, as is no 1.0
_BEYOND_LONG = r"^DECIMAL\((19|[23]\d),0\)$"


def _no_errors() -> Column:
    return F.array().cast("array<string>")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time, however often ``use`` mentions it.

    A column expression repeated in the branches of a check is evaluated in each; nested, that multiplies with
    every level of the contract. A one-element ``transform`` binds it to a variable instead.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def _member(value: Column, name: str) -> Column:
    """A field of an object as a variant; SQL NULL if there is none or the value is no object."""
    for quote in ("'", '"'):
        if name and quote not in name and "?" not in name:
            return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")
    # a name that no path can spell
    return F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(name))


def _elements(value: Column) -> Column:
    """The elements of an array; SQL NULL for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def _kind(value: Column, schema: Contract) -> Column:
    """The JSON type of a variant. What the contract expects is tried first: an object or array is told by a cast that
    looks no further into it, and any other value by its shape, which is spelled out in full for objects and arrays."""
    as_object = F.try_variant_get(value, "$", "struct<>").isNotNull()
    as_array = _elements(value).isNotNull()
    if schema.get("properties") or schema.get("required"):
        return F.when(as_object, "object").when(as_array, "array").otherwise(_leaf_kind(value))
    if "items" in schema:
        return F.when(as_array, "array").when(as_object, "object").otherwise(_leaf_kind(value))
    return _leaf_kind(value)


def _leaf_kind(value: Column) -> Column:
    """The JSON type of a variant by its shape; whole and fractional numbers told apart."""
    return _once(
        F.schema_of_variant(value),
        lambda shape: F.when(shape == "STRING", "string")
        .when((shape == "BIGINT") | shape.rlike(_BEYOND_LONG), "integer")
        .when(shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT"), "fraction")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "VOID", "null")
        .when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .otherwise("string"),
    )


def _text(value: Column, kind: Column) -> Column:
    """The value as an error message shows it."""
    raw = F.to_json(value)
    return (
        F.when(kind == "string", F.concat(F.lit("'"), F.try_variant_get(value, "$", "string"), F.lit("'")))
        .when(kind == "boolean", F.initcap(raw))
        .when(kind == "null", F.lit("None"))
        .otherwise(raw)
    )


def _shown(literal: Any) -> str:
    return repr(literal)


def _kind_of_literal(literal: Any) -> str:
    if isinstance(literal, bool):
        return "boolean"
    if isinstance(literal, int):
        return "integer"
    if isinstance(literal, float):
        return "fraction"
    if isinstance(literal, str):
        return "string"
    if literal is None:
        return "null"
    return "object" if isinstance(literal, Mapping) else "array"


def _equals(value: Column, kind: Column, literal: Any) -> Column:
    """JSON equality with a literal of the contract; 1 equals 1.0, and true equals neither."""
    wanted = _kind_of_literal(literal)
    if wanted == "null":
        return kind == "null"
    if wanted in ("integer", "fraction"):
        number = F.try_variant_get(value, "$", "double")
        return kind.isin("integer", "fraction") & F.coalesce(number == F.lit(float(literal)), F.lit(False))
    if wanted in ("string", "boolean"):
        typed = F.try_variant_get(value, "$", wanted)
        return (kind == wanted) & F.coalesce(typed == F.lit(literal), F.lit(False))
    return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(literal))))


def _has_type(kind: Column, types: list[str]) -> Column:
    wanted = []
    for t in types:
        wanted.extend(["integer", "fraction"] if t == "number" else [t])
    return kind.isin(*dict.fromkeys(wanted))


def _resolve(schema: Contract, root: Contract, seen: tuple[str, ...]) -> tuple[Contract, tuple[str, ...]]:
    while "$ref" in schema:
        ref = schema["$ref"]
        if not ref.startswith("#/"):
            raise ValueError(f"only local references are supported: {ref!r}")
        if ref in seen:
            raise ValueError(f"contract refers to itself: {ref!r}")
        seen = (*seen, ref)
        schema = root
        for part in ref[2:].split("/"):
            schema = schema[part]
    return schema, seen


Found = Callable[[str, Contract], Column]


def _node_errors(
    value: Column, kind: Column, schema: Contract, root: Contract, path: Column, seen: tuple[str, ...], found: Found
) -> Column:
    """Errors of one node and what lies below; ``found(name, schema)`` has those of a property."""
    own: list[Column] = []
    if "const" in schema:
        text = F.concat(path, F.lit(f": expected {_shown(schema['const'])}, got "), _text(value, kind))
        own.append(F.when(~_equals(value, kind, schema["const"]), text))
    if "enum" in schema:
        allowed = F.lit(False)
        for option in schema["enum"]:
            allowed = allowed | _equals(value, kind, option)
        text = F.concat(path, F.lit(": "), _text(value, kind), F.lit(f" not one of {_shown(list(schema['enum']))}"))
        own.append(F.when(~allowed, text))
    here = F.array_compact(F.array(*own)) if own else None

    below: list[Column] = []
    absent = [
        F.when(_member(value, name).isNull(), F.concat(path, F.lit(f": missing required key {_shown(name)}")))
        for name in schema.get("required") or ()
    ]
    if absent:
        below.append(F.when(kind == "object", F.array_compact(F.array(*absent))))
    for name, sub in (schema.get("properties") or {}).items():
        below.append(found(name, sub))
    if "items" in schema:

        def item_errors(item: Column, i: Column) -> Column:
            return _errors(item, schema["items"], root, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), seen)

        below.append(F.flatten(F.transform(_elements(value), item_errors)))
    parts = [here] if here is not None else []
    parts += [F.coalesce(part, _no_errors()) for part in below]
    everything = F.concat(*parts) if parts else _no_errors()

    types = schema.get("type")
    if not types:
        return everything
    types = [types] if isinstance(types, str) else list(types)
    found_name = F.element_at(F.create_map(*[F.lit(x) for pair in VALUE_TYPE_NAMES.items() for x in pair]), kind)
    mismatch = F.array(F.concat(path, F.lit(f": expected {'/'.join(types)}, got "), found_name))
    # a wrong type ends the check here; what lies below would only repeat it
    return F.when(_has_type(kind, types), everything).otherwise(mismatch if here is None else F.concat(here, mismatch))


def _errors(value: Column, schema: Contract, root: Contract, path: Column, seen: tuple[str, ...]) -> Column:
    """Errors of one node in a single expression; ``value`` is a variant, JSON null included, and never SQL NULL."""
    schema, seen = _resolve(schema, root, seen)

    def found(name: str, sub: Contract) -> Column:
        deeper = lambda child: F.when(
            child.isNotNull(), _errors(child, sub, root, F.concat(path, F.lit(f".{name}")), seen)
        )
        return _once(_member(value, name), deeper)

    return _once(_kind(value, schema), lambda kind: _node_errors(value, kind, schema, root, path, seen, found))


def _not_json(path: str) -> Column:
    return F.array(F.lit(f"{path}: not valid JSON"))


def contract_errors(doc: Column | str, contract: Contract, *, path: str = "$") -> Column:
    """``array<string>`` of ``path: message`` for one JSON text; empty when the record keeps the contract.

    Checks const, enum, type, required, properties, items and local ``$ref``. Text that is no JSON (or NULL)
    gives the single error ``$: not valid JSON``. As an expression it can stand anywhere; on a frame,
    ``check_contract`` gives the same in steps that Spark compiles.
    """
    parsed = F.try_parse_json(F.col(doc) if isinstance(doc, str) else doc)
    errors = lambda value: _errors(value, contract, contract, F.lit(path), ())
    return _once(parsed, lambda value: F.when(value.isNull(), _not_json(path)).otherwise(errors(value)))


def check_contract(
    df: DataFrame, doc: Column | str, contract: Contract, *, errors_column: str = "errors", path: str = "$"
) -> DataFrame:
    """The frame with an ``array<string>`` of contract errors per record, as ``contract_errors`` lists them.

    Each value that the contract names by properties alone becomes a column, taken from the level above it, and its
    kind another; a level is one projection. So every value is taken out once, however many checks mention it.
    """
    before = df.columns
    names = {"": "_contract_0"}
    df = df.withColumn(names[""], F.try_parse_json(F.col(doc) if isinstance(doc, str) else doc))
    kinds: dict[str, str] = {}
    level = [("", *_resolve(contract, contract, ()))]
    known = {"": level[0][1:]}
    while level:
        df = df.withColumns({names[at] + "_kind": _kind(F.col(names[at]), sub) for at, sub, _ in level})
        kinds |= {at: names[at] + "_kind" for at, _, _ in level}
        below, values = [], {}
        for at, schema, seen in level:
            for name, sub in (schema.get("properties") or {}).items():
                deeper = f"{at}.{len(at)}.{name}"
                names[deeper] = f"_contract_{len(names)}"
                known[deeper] = _resolve(sub, contract, seen)
                values[names[deeper]] = _member(F.col(names[at]), name)
                below.append((deeper, *known[deeper]))
        if values:
            df = df.withColumns(values)
        level = below

    def errors(at: str, where: str) -> Column:
        schema, seen = known[at]

        def found(name: str, _sub: Contract) -> Column:
            return errors(f"{at}.{len(at)}.{name}", f"{where}.{name}")

        value = F.col(names[at])
        here = _node_errors(value, F.col(kinds[at]), schema, contract, F.lit(where), seen, found)
        return F.when(value.isNotNull(), here)

    root = F.col(names[""])
    checked = df.withColumn(errors_column, F.when(root.isNull(), _not_json(path)).otherwise(errors("", path)))
    return checked.select(*[F.col(f"`{c}`") for c in before if c != errors_column], errors_column)
