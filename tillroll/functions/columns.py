"""Column expressions built from Spark's own functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import fixed


def strip(c: Column) -> Column:
    """White space of every kind taken off both ends."""
    return F.btrim(c, F.lit(fixed.WHITE_SPACE))


def clean_text(c: Column) -> Column:
    """Null becomes UNKNOWN; stripped; upper case."""
    return F.upper(F.coalesce(strip(c), F.lit(fixed.UNKNOWN)))


#: Bits of `key_hash`.
HASH_BITS = 60


def key_hash(salt: str | int, *keys: str) -> Column:
    """60 bits of md5 over `salt:key:key` as a long, the same in Spark and in other SQL engines."""
    text = F.concat(F.lit(f"{salt}:"), F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def cut(c: Column, edges: Sequence, labels: Sequence[str], include_lowest: bool = False) -> Column:
    """Label of the right-closed band holding `c`; null outside every band.

    An edge of None is an open end. Edges may be columns.
    """
    out = None
    for i, label in enumerate(labels):
        low, high = edges[i], edges[i + 1]
        inside = F.lit(True)
        if low is not None:
            inside = inside & ((c >= low) if include_lowest and i == 0 else (c > low))
        if high is not None:
            inside = inside & (c <= high)
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def categorize(c: Column, rules=fixed.CATEGORY_RULES, default: str = fixed.CATEGORY_DEFAULT) -> Column:
    """Category of the last rule whose word occurs in `c`."""
    last_first = [F.when(c.contains(word), F.lit(name)) for word, name in reversed(rules)]
    return F.coalesce(*last_first, F.lit(default))


def eq_ci(c: Column, value: str) -> Column:
    return F.upper(c) == F.upper(F.lit(value))


def between_dates(c: Column, start=None, end=None) -> Column:
    """Both ends count; a missing end is open."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (c >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside & (c <= F.lit(end).cast("date"))
    return inside


def ellipsize(c: Column, n: int = 50) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles; null when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def mean_of(c: Column) -> Column:
    """Mean from the exact sum, so the result does not depend on row order."""
    return ratio(F.sum(c), F.count(c))


def counted_map(entries: Column) -> Column:
    """`{'A': 3, 'B': 1}` text from an array of (key, n) structs."""
    parts = F.transform(
        entries, lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), e["n"].cast("string"))
    )
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Half-even rounding of every fractional column, for the sink step only."""
    fractional = (T.DoubleType, T.FloatType, T.DecimalType)
    return df.select(
        *[
            F.bround(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, fractional)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(0, subset=list(cols) if cols else None)


def calendar_features(df: DataFrame, date: str = "Date") -> DataFrame:
    """Ten calendar columns of a date; weeks are ISO weeks, Monday is day 0."""
    d = F.col(date)
    weekend = F.weekday(d).isin(5, 6)
    return df.withColumns(
        {
            "Year": F.year(d),
            "Month": F.month(d),
            "Day": F.dayofmonth(d),
            "DayOfWeek": F.weekday(d),
            "DayOfYear": F.dayofyear(d),
            "WeekOfYear": F.weekofyear(d),
            "Quarter": F.quarter(d),
            "IsWeekend": weekend.cast("int"),
            "IsMonthStart": (F.dayofmonth(d) == 1).cast("int"),
            "IsMonthEnd": (d == F.last_day(d)).cast("int"),
        }
    )
