"""The five parameter types and the canonical form by which inputs are equal.

Equality ignores key order and compares numbers by value (2 is 2.0), strings
and booleans by class; timestamps count as POSIX seconds. The canonical form
is an array of (key, cls, text) sorted by key, and its SHA-256 the address of
a result.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import math
from numbers import Integral, Real

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "datetime": T.TimestampType()}
EXACT = float(1 << 53)


def type_name(kind: T.DataType) -> str:
    """The parameter type of a Spark type; TypeError for any other."""
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "str"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    raise TypeError(f"{kind.simpleString()} is not a parameter type")


def value_type(value) -> str:
    """The parameter type of a Python value; TypeError for any other. bool comes first: it is an int to Python."""
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, str):
        return "str"
    if isinstance(value, datetime.datetime):
        return "datetime"
    if type(value).__name__ in ("bool_", "bool") or isinstance(value, complex):
        raise TypeError(f"{type(value).__name__} is not a parameter type")
    if isinstance(value, Integral):
        return "int"
    if isinstance(value, Real) and not hasattr(value, "numerator"):
        return "float"
    if type(value).__module__ == "numpy" and isinstance(value, Real):
        return "float"
    raise TypeError(f"{type(value).__name__} is not a parameter type")


def stored_value(value):
    """The value as it enters a key: plain Python, timestamps as seconds (naive ones are UTC)."""
    kind = value_type(value)
    if kind == "datetime":
        return (value if value.tzinfo else value.replace(tzinfo=datetime.timezone.utc)).timestamp()
    return {"bool": bool, "int": int, "float": float, "str": str}[kind](value)


def schema_of(values: dict) -> dict[str, str]:
    return {k: value_type(v) for k, v in values.items()}


def _text(value) -> tuple[str, str]:
    value = stored_value(value)
    if isinstance(value, bool):
        return "b", "true" if value else "false"
    if isinstance(value, str):
        return "s", value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a key holds finite numbers only")
        if value.is_integer() and abs(value) < EXACT:
            return "n", str(int(value))
        return "n", repr(value)
    return "n", str(value)


def canonical(values: dict) -> list[tuple[str, str, str]]:
    return [(k, *_text(values[k])) for k in sorted(values)]


def address(values: dict) -> str:
    """SHA-256 of the canonical form, as ``address_column`` computes it where doubles print alike."""
    entries = [{"key": k, "cls": c, "text": t} for k, c, t in canonical(values)]
    return hashlib.sha256(json.dumps(entries, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def epoch_seconds(column: Column | str, kind: T.DataType | None = None) -> Column:
    """POSIX seconds as a double, to the microsecond."""
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000.0)


def stored_column(column: Column, kind: T.DataType) -> Column:
    """A column in the type in which it enters a key."""
    name = type_name(kind)
    if name == "datetime":
        return epoch_seconds(column)
    return column.cast({"bool": "boolean", "int": "bigint", "float": "double", "str": "string"}[name])


def number_text(column: Column) -> Column:
    """Text of a number, the same for equal integers and doubles."""
    x = column.cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < EXACT)
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def entry(key: str, column: Column, kind: T.DataType) -> Column:
    """(key, cls, text) of one parameter column."""
    name = type_name(kind)
    value = stored_column(column, kind)
    if name == "bool":
        cls, text = "b", value.cast("string")
    elif name == "str":
        cls, text = "s", value
    elif name == "int":
        cls, text = "n", value.cast("string")
    else:
        finite = ~(F.isnan(value) | value.isin(float("inf"), float("-inf")))
        cls, text = "n", F.when(finite, number_text(value)).otherwise(F.raise_error(F.lit(f"{key}: a key holds finite numbers only")))
        text = F.when(value.isNotNull(), text)
    return F.struct(F.lit(key).alias("key"), F.lit(cls).alias("cls"), text.alias("text"))


def canonical_column(df: DataFrame, keys: dict[str, str]) -> Column:
    """The canonical form of the columns keys names (parameter name: column)."""
    return F.array(*[entry(k, F.col(keys[k]), df.schema[keys[k]].dataType) for k in sorted(keys)])


def address_column(form: Column) -> Column:
    """SHA-256 of a canonical form."""
    return F.sha2(F.to_json(form), 256)


def matching(column: Column, kind: T.DataType) -> Column:
    """A column under which equal parameters are equal: numbers as doubles with one zero, else as stored."""
    name = type_name(kind)
    value = stored_column(column, kind)
    return value.cast("double") + F.lit(0.0) if name in ("int", "float", "datetime") else value
