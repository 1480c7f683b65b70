"""Two-valued predicates over typed columns.

Search and rules differ in how they compare (search by text, rules by number or
truth first), so each has its builder.  Every predicate is true or false of every
row; ``positive`` says whether a null result may stand for false, which keeps raw
comparisons and so lets them be pushed down to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fields import kind, resolve

_NUMBERS = (T.NumericType,)
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def settled(column: Column, positive: bool) -> Column:
    return column if positive else F.coalesce(column, F.lit(False))


def as_text(column: Column, type_: T.DataType) -> Column:
    if isinstance(type_, T.BooleanType):
        return F.when(column, "True").when(~column, "False")
    if isinstance(type_, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    return column.cast("string")


def folded(column: Column, type_: T.DataType) -> Column:
    return F.lower(as_text(column, type_))


def truth(column: Column, type_: T.DataType) -> Column:
    """Truth of a value: non-empty texts and numbers other than zero are true."""
    if isinstance(type_, T.BooleanType):
        return column
    if isinstance(type_, T.NumericType):
        return column != 0
    if isinstance(type_, T.StringType):
        return F.length(column) > 0
    return column.isNotNull()


def number(column: Column, type_: T.DataType) -> Column:
    """The value as a double, null if it is none."""
    if isinstance(type_, T.NumericType):
        return column.cast("double")
    if isinstance(type_, T.BooleanType):
        return column.cast("double")
    if isinstance(type_, T.StringType):
        return F.trim(column).try_cast("double")
    return F.lit(None).cast("double")


def plain(value) -> str:
    """A literal as the text it is compared as."""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float) and value == int(value) and abs(value) < 1e16:
        return f"{value:.1f}"
    return str(value)


CASELESS = "(?iu)"


def regex(column: Column, pattern: str) -> Column:
    return column.rlike(CASELESS + pattern)


def rule_match(df: DataFrame, field: str, modifier: str | None, expected) -> Column:
    """A rule's test of one expected value, true or false of every row."""
    column, type_ = resolve(df, field), kind(df, field)
    if expected is None:
        return column.isNull()
    text = as_text(column, type_)
    if modifier in (None, ""):
        if isinstance(expected, bool) or isinstance(type_, T.BooleanType):
            wanted = bool(expected)
            test = truth(column, type_) == F.lit(wanted)
        elif isinstance(expected, (int, float)) or _is_number(expected):
            test = F.coalesce(number(column, type_) == F.lit(float(expected)), F.lower(text) == F.lit(str(expected).lower()))
        else:
            test = F.lower(text) == F.lit(str(expected).lower())
    elif modifier == "contains":
        test = F.lower(text).contains(str(expected).lower())
    elif modifier == "startswith":
        test = F.lower(text).startswith(str(expected).lower())
    elif modifier == "endswith":
        test = F.lower(text).endswith(str(expected).lower())
    elif modifier == "re":
        test = regex(text, str(expected))
    elif modifier in ("gt", "gte", "lt", "lte"):
        if not _is_number(expected):
            return F.lit(False)
        n, wanted = number(column, type_), F.lit(float(expected))
        test = {"gt": n > wanted, "gte": n >= wanted, "lt": n < wanted, "lte": n <= wanted}[modifier]
    else:
        return F.lit(False)
    return F.coalesce(test, F.lit(False))


def _is_number(value) -> bool:
    try:
        float(value)
    except (TypeError, ValueError):
        return False
    return True
