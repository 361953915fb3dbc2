"""Text to number and text to time, with two ways of treating dirty values.

``strict``  a value that is not wholly a finite number (or a time) becomes NULL.
``compat``  a text gives its leading number, and 0 if it has none, as loosely typed stores do.

Each function takes an SQL expression and returns one, so a profile of many columns reaches Spark
as one piece of text. None of them can fail a job: ANSI mode is on by default and a plain cast
would throw on junk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

STRICT, COMPAT = "strict", "compat"
_MODES = (STRICT, COMPAT)

_REAL_PREFIX = r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"
_INT_PREFIX = r"^\s*([+-]?[0-9]+)"
_MINUS = r"^\s*-[0-9.]"
_INF = "double('infinity')"


def check_mode(mode: str) -> str:
    if mode not in _MODES:
        raise ValueError(f"mode must be one of {_MODES}, not {mode!r}")
    return mode


def quote(name: str) -> str:
    """A column name as an SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def _is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _head(c: str, pattern: str, to: str) -> str:
    number = f"try_cast(regexp_extract({c}, {literal(pattern)}, 1) AS {to})"
    return f"CASE WHEN {c} IS NOT NULL THEN coalesce({number}, CAST(0 AS {to})) END"


def to_double(c: str, dtype: T.DataType, mode: str = STRICT) -> str | None:
    """``c`` as a double, or None for a type that holds no numbers."""
    check_mode(mode)
    if is_text(dtype) and mode == COMPAT:
        return _head(c, _REAL_PREFIX, "double")
    if is_text(dtype) or _is_float(dtype):
        x = f"try_cast({c} AS double)"
        return f"CASE WHEN abs({x}) < {_INF} THEN {x} END"
    return f"CAST({c} AS double)" if is_numeric(dtype) else None


def is_positive(c: str, dtype: T.DataType, mode: str = STRICT) -> str:
    """Whether ``c`` is a finite number above 0; for a numeric column a test that a file scan can use."""
    if _is_float(dtype):
        return f"{c} > 0 AND {c} < {_INF}"
    if is_numeric(dtype):
        return f"{c} > 0"
    x = to_double(c, dtype, mode)
    return f"({x}) > 0" if x else "false"


def to_int(c: str, dtype: T.DataType, mode: str = STRICT) -> str | None:
    """``c`` as a 32-bit integer, cut towards zero; out of range gives NULL."""
    check_mode(mode)
    if is_text(dtype) and mode == COMPAT:
        return f"try_cast({_head(c, _INT_PREFIX, 'bigint')} AS int)"
    if is_numeric(dtype) and not _is_float(dtype):
        return f"try_cast({c} AS int)"
    x = to_double(c, dtype, mode)
    return x and f"try_cast({x} AS int)"


def negative_part(c: str, dtype: T.DataType, mode: str = STRICT) -> str | None:
    """The value of ``c`` where it is a negative number, else NULL.

    A negative text starts with a minus sign or with blanks, and all of these sort before a point:
    one comparison of bytes settles nearly every other text. Parsing a text that is no number is
    dear, so the few left must look like a number first.
    """
    check_mode(mode)
    if is_text(dtype):
        x = to_double(c, dtype, mode) if mode == COMPAT else f"try_cast({c} AS double)"
        value = f"CASE WHEN {x} < 0 AND {x} > -{_INF} THEN {x} END"
        # One CASE inside the other: shared parts of an AND may be computed for every row.
        return f"CASE WHEN {c} < '.' THEN CASE WHEN {c} RLIKE {literal(_MINUS)} THEN {value} END END"
    if _is_float(dtype):
        return f"CASE WHEN {c} < 0 AND {c} > -{_INF} THEN CAST({c} AS double) END"
    return f"CASE WHEN {c} < 0 THEN CAST({c} AS double) END" if is_numeric(dtype) else None


def to_timestamp(c: str, dtype: T.DataType) -> str | None:
    """``c`` as a timestamp in the session time zone; text that is no time gives NULL."""
    if is_temporal(dtype):
        return f"CAST({c} AS timestamp)"
    return f"try_cast({c} AS timestamp)" if is_text(dtype) else None


def to_day(c: str, dtype: T.DataType) -> str | None:
    """``c`` as a date."""
    t = f"CAST({c} AS date)" if is_temporal(dtype) else to_timestamp(c, dtype)
    return t if t is None or is_temporal(dtype) else f"CAST({t} AS date)"


def to_epoch_ms(c: str, dtype: T.DataType) -> str | None:
    """Epoch milliseconds. A number above 1e11 already is in milliseconds, any other is in seconds."""
    if is_numeric(dtype):
        x = f"CAST({c} AS double)"
        return f"try_cast(CASE WHEN {x} > 1e11 THEN {x} ELSE {x} * 1000 END AS bigint)"
    t = to_timestamp(c, dtype)
    return t and f"unix_millis({t})"


def is_later(a: str, ta: T.DataType, b: str, tb: T.DataType) -> str:
    """Whether time ``a`` lies after time ``b``. If either is a plain date, days are compared."""
    days = f"{to_day(a, ta)} > {to_day(b, tb)}"
    if isinstance(ta, T.DateType) or isinstance(tb, T.DateType):
        return days
    if is_temporal(ta) and ta == tb:
        return f"{a} > {b}"
    times = f"{to_timestamp(a, ta)} > {to_timestamp(b, tb)}"
    short = " OR ".join(f"length(trim({c})) <= 10" for c, t in ((a, ta), (b, tb)) if is_text(t))
    return f"CASE WHEN {short} THEN {days} ELSE {times} END" if short else times


def seconds_between(start: str, end: str) -> str:
    """``end`` - ``start`` of two timestamps, in seconds with fractions."""
    return f"(unix_micros({end}) - unix_micros({start})) / 1000000D"


def field_of(schema: T.StructType | Sequence[T.StructField], name: str) -> T.StructField:
    """The column of this name; if there is none, that of this name in another case, as SQL finds it."""
    fields = list(schema)
    found = [f for f in fields if f.name == name] or [f for f in fields if f.name.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found) or 'no'} columns named {name!r} among {[f.name for f in fields]}")
    return found[0]
