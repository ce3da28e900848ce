"""Predicates and scalar expressions. All are Catalyst columns; none is a UDF."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: largest amount an editor may enter.
MAX_AMOUNT = 999_999_999_999


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def matches(filters: Mapping[str, Any] | None) -> Column:
    """AND of ``column == value`` for scalars and ``column in (...)`` for lists."""
    terms = [
        F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value
        for name, value in (filters or {}).items()
    ]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def coerce_numeric(c: Column | str, default: int | None = None) -> Column:
    """Text to whole number, truncating; unreadable or missing text gives ``default``.

    The way is a decimal, so that every digit of a bigint is kept. A number beyond bigint
    fails the job, as leaving it out of a total would be wrong; NaN and Infinity are unreadable.
    """
    number = _col(c).try_cast("decimal(38,18)").try_cast("bigint")
    size = F.abs(_col(c).try_cast("double"))
    beyond = F.raise_error(F.concat(F.lit("Number beyond a 64-bit integer: "), _col(c).cast("string"))).cast("bigint")
    other = F.lit(default).cast("bigint")
    return F.when(number.isNotNull(), number).when((size >= 1e18) & (size < float("inf")), beyond).otherwise(other)


def _amount_type(df: DataFrame, column: str) -> tuple[int, int]:
    kind = df.schema[column].dataType
    if isinstance(kind, T.DecimalType):
        return kind.precision, kind.scale
    return (20, 0) if isinstance(kind, T.IntegralType) else (28, 6)


def exact_amount(df: DataFrame, column: str = "amount") -> Column:
    """An amount as a decimal of its own scale; unreadable text is null.

    Text and doubles are rounded to six decimals; NaN and Infinity are unreadable. An amount
    beyond the type fails the job instead of being counted wrong.
    """
    precision, scale = _amount_type(df, column)
    kind = f"decimal({precision},{scale})"
    amount = F.col(column)
    if df.schema[column].dataType == T.StringType():
        readable = F.abs(F.trim(amount).try_cast("double")) < float("inf")
        return F.when(readable, F.trim(amount).cast(kind))
    if isinstance(df.schema[column].dataType, T.FractionalType) and not isinstance(df.schema[column].dataType, T.DecimalType):
        return F.when(F.abs(amount) < float("inf"), amount.cast(kind))
    return amount.cast(kind)


def total_type(df: DataFrame, column: str = "amount") -> str:
    """Type of a sum of ``exact_amount``."""
    return f"decimal(38,{_amount_type(df, column)[1]})"


def clean_whitespace(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), r"\s+", "")


def org_number_status(c: Column | str) -> Column:
    """``missing``, ``not_digits``, ``wrong_length`` or ``ok``."""
    c = F.coalesce(_col(c).cast("string"), F.lit(""))
    return (
        F.when(c == "", "missing")
        .when(~c.rlike("^[0-9]+$"), "not_digits")
        .when(F.length(c) != 9, "wrong_length")
        .otherwise("ok")
    )


def year_status(c: Column | str, lo: int, hi: int) -> Column:
    """``missing``, ``not_a_number``, ``out_of_range`` or ``ok``."""
    c = F.trim(F.coalesce(_col(c).cast("string"), F.lit("")))
    year = c.try_cast("int")
    return (
        F.when(c == "", "missing")
        .when(year.isNull(), "not_a_number")
        .when(~year.between(lo, hi), "out_of_range")
        .otherwise("ok")
    )


def amount_status(c: Column | str, limit: int = MAX_AMOUNT) -> Column:
    """``empty``, ``not_an_integer``, ``too_large`` or ``ok``."""
    text = clean_whitespace(c)
    digits = text.rlike("^[+-]?[0-9]+$")
    # More digits than a bigint holds is too large, not unreadable.
    number = text.try_cast("bigint")
    return (
        F.when(F.coalesce(_col(c).cast("string"), F.lit("")) == "", "empty")
        .when(~digits, "not_an_integer")
        .when(number.isNull() | (F.abs(number.try_cast("decimal(20,0)")) > limit), "too_large")
        .otherwise("ok")
    )


def is_negative(c: Column | str) -> Column:
    text = clean_whitespace(c)
    return text.rlike("^-[0-9]*[1-9][0-9]*$")


def datatype_status(value: Column | str, datatype: Column | str) -> Column:
    """``ok``, ``float`` (decimal mark in a whole-number field) or the expected type."""
    raw, kind = _col(value).cast("string"), _col(datatype)
    text = F.trim(raw)
    whole = F.when(text.rlike("[.,]"), "float").when(text.rlike("^-?[0-9]+$"), "ok").otherwise(kind)
    flag = F.when(F.lower(text).isin("true", "false", "1", "0"), "ok").otherwise(kind)
    return (
        F.when(raw.isNull() | (raw == ""), "ok")
        .when(kind.isNull() | kind.isin("", "string"), "ok")
        .when(kind.isin("integer", "number"), whole)
        .when(kind == "bool", flag)
        .otherwise(kind)
    )


def local_seconds(ts: Column | str, tz: str = "Europe/Oslo", fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """UTC instant as local wall-clock text, whole seconds.

    A zone-less timestamp is read as UTC, whatever the session time zone is.
    """
    ts = _col(ts)
    # A zoned timestamp turns zone-less in the session zone. The type is known when planning.
    zone = F.when(F.typeof(ts) == "timestamp", F.current_timezone()).otherwise("UTC")
    wall = F.convert_timezone(zone, F.lit(tz), ts.cast("timestamp_ntz"))
    return F.date_format(F.date_trunc("second", wall), fmt)


def change(cur: Column | str, prev: Column | str) -> Column:
    """Difference; null only where both sides are null."""
    cur, prev = _col(cur), _col(prev)
    return F.when(
        cur.isNotNull() | prev.isNotNull(),
        F.coalesce(cur, F.lit(0)) - F.coalesce(prev, F.lit(0)),
    )


def percent_change(cur: Column | str, prev: Column | str, missing_base: float | None = None) -> Column:
    """Change in per cent of ``prev``; null for a zero base.

    A null base gives null, unless ``missing_base`` names the number to divide by.
    """
    cur, prev = _col(cur).cast("double"), _col(prev).cast("double")
    base = prev if missing_base is None else F.coalesce(prev, F.lit(float(missing_base)))
    return F.try_divide(
        F.coalesce(cur, F.lit(0.0)) - F.coalesce(prev, F.lit(0.0)), base
    ) * F.lit(100.0)


def calculated_field(
    multiply: Sequence[str | float] = (),
    divide: Sequence[str | float] = (),
    add: Sequence[str | float] = (),
    subtract: Sequence[str | float] = (),
    decimals: int = 1,
) -> Column:
    """Product and quotient first, then sums, over columns (or literals) of a wide frame.

    A missing factor or a zero divisor makes the whole result 0; missing addends are
    skipped. The result is text with ``decimals`` digits, rounded from the exact binary
    value (half to even); text that is not a number makes it null.
    """
    def value(term: str | float) -> Column:
        return F.col(term).cast("string") if isinstance(term, str) else F.lit(str(float(term)))

    def missing(term: str | float) -> Column:
        return F.coalesce(F.trim(value(term)), F.lit("")) == ""

    def number(term: str | float) -> Column:
        return F.trim(value(term)).try_cast("double")

    factors, divisors = list(multiply), list(divide)
    terms = [*factors, *divisors, *add, *subtract]
    if not terms:
        raise ValueError("A calculated field needs at least one term.")
    any_of = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    unreadable = any_of([~missing(t) & number(t).isNull() for t in terms])
    incomplete = any_of(
        [missing(t) for t in (*factors, *divisors)] + [number(t) == 0 for t in divisors]
    )
    result = F.lit(1.0 if factors or divisors else 0.0)
    for t in factors:
        result = result * number(t)
    for t in divisors:
        result = F.try_divide(result, number(t))
    for sign, group in ((1.0, add), (-1.0, subtract)):
        for t in group:
            result = result + F.lit(sign) * F.when(missing(t), 0.0).otherwise(number(t))
    inputs = [t for t in terms if isinstance(t, str)]
    nothing = reduce(lambda a, b: a & b, [F.col(t).isNull() for t in inputs], F.lit(bool(inputs)))
    result = (
        F.when(nothing, 0.0)
        .when(unreadable, F.lit(None).cast("double"))
        .when(F.coalesce(incomplete, F.lit(False)), 0.0)
        .otherwise(result)
    )
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", result, F.lit(pattern))
