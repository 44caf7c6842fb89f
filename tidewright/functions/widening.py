"""Which casts keep every value: what a writer may do to fit a batch into a table's types."""

from __future__ import annotations

from pyspark.sql import types as T

#: whole number types with the decimal digits they may need
_WHOLE = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
#: whole numbers that a floating type holds exactly
_EXACT_IN = {T.FloatType: (T.ByteType, T.ShortType), T.DoubleType: (T.ByteType, T.ShortType, T.IntegerType, T.FloatType)}


def keeps_values(source: T.DataType, target: T.DataType) -> bool:
    """Whether every value of ``source`` is the same value as a ``target``; nullability aside."""
    if source == target or isinstance(source, T.NullType):
        return True
    if isinstance(source, T.StructType) and isinstance(target, T.StructType):
        return len(source) == len(target) and all(
            a.name == b.name and keeps_values(a.dataType, b.dataType) for a, b in zip(source, target)
        )
    if isinstance(source, T.ArrayType) and isinstance(target, T.ArrayType):
        return keeps_values(source.elementType, target.elementType)
    if isinstance(source, T.MapType) and isinstance(target, T.MapType):
        return keeps_values(source.keyType, target.keyType) and keeps_values(source.valueType, target.valueType)
    digits = _WHOLE.get(type(source))
    if type(target) in _WHOLE:
        return digits is not None and digits <= _WHOLE[type(target)]
    if type(target) in _EXACT_IN:
        return isinstance(source, _EXACT_IN[type(target)])
    if isinstance(target, T.DecimalType):
        if isinstance(source, T.DecimalType):
            return source.scale <= target.scale and source.precision - source.scale <= target.precision - target.scale
        return digits is not None and digits <= target.precision - target.scale
    if isinstance(target, (T.TimestampType, T.TimestampNTZType)):
        return isinstance(source, T.DateType)
    if isinstance(target, T.StringType):
        return isinstance(source, (T.StringType, T.BooleanType, T.DateType, T.DecimalType, *_WHOLE))
    return False


def require_fit(source: T.StructType, target: T.StructType, what: str) -> None:
    """Raises where a column of ``source`` would lose values in the column of ``target`` with its name."""
    wanted = {f.name: f.dataType for f in target}
    lossy = [
        f"{f.name}: {f.dataType.simpleString()} into {wanted[f.name].simpleString()}"
        for f in source
        if f.name in wanted and not keeps_values(f.dataType, wanted[f.name])
    ]
    if lossy:
        raise ValueError(f"types that do not fit {what}, cast them first: {', '.join(lossy)}")
