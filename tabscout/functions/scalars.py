"""Column-level helpers: type families, missing-value cleaning, casts, date parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text layouts accepted as dates, most specific first. ISO text is
# tried before any of them.
DATE_LAYOUTS = (
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
    "MM-dd-yyyy",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "dd-MMM-yyyy",
)
# Shapes a text must have before a parse is attempted.
DATE_SHAPE = r"^\s*(\d{1,4}[-/]\d{1,2}[-/]\d{1,4}|\d{1,2}[- ][A-Za-z]{3,9}[- ]\d{4}|[A-Za-z]{3,9} \d{1,2}, \d{4})"
DATE_LENGTHS = (6, 40)
ISO_SHAPE = r"^\s*\d{4}-\d{1,2}-\d{1,2}"
DATE_PARTS = ("year", "month", "dayofweek")


def quoted(name: str) -> str:
    """A column name safe to hand to ``F.col`` (dots and spaces included)."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    try:
        return df.schema[name].dataType
    except KeyError:
        from tabscout.errors import TabularError

        raise TabularError("UNKNOWN_COLUMN", f'Column "{name}" is not in this table.') from None


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_flag(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.BooleanType)


def is_plain(dtype: T.DataType) -> bool:
    """Scalars the profiler understands; arrays, maps, structs and binary are not."""
    return is_number(dtype) or is_time(dtype) or is_text(dtype) or is_flag(dtype)


def finite(c: Column) -> Column:
    """NaN and ±infinity become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


FINITE = {"tabscout.finite": True}


def is_clean(df: DataFrame, name: str) -> bool:
    """Whether a column is known to hold no NaN or infinity: by type, or by an earlier pass."""
    f = df.schema[name]
    return not is_float(f.dataType) or bool(f.metadata and f.metadata.get("tabscout.finite"))


def sanitize_numeric(df: DataFrame) -> DataFrame:
    """Replace NaN and ±infinity by NULL in every floating-point column.

    Cleaned columns are marked in their metadata, so operators that call each other do
    not stack the same test on a column again.
    """
    if all(is_clean(df, n) for n in df.columns):
        return df
    return df.select(
        *[column(n) if is_clean(df, n) else finite(column(n)).alias(n, metadata=FINITE) for n in df.columns]
    )


def numeric_column(df: DataFrame, name: str) -> Column:
    """The column as a finite double, with no test where none is needed."""
    dtype = dtype_of(df, name)
    if is_number(dtype) or is_flag(dtype):
        plain = column(name).cast("double")
        return plain if is_clean(df, name) else finite(plain)
    return coerce_numeric(name)


def coerce_numeric(c: Column | str) -> Column:
    """Text to number; anything that is not a finite number is NULL."""
    c = column(c) if isinstance(c, str) else c
    return finite(c.try_cast("double"))


def parse_dates(c: Column | str) -> Column:
    """Text to timestamp, one layout per value; unreadable values are NULL."""
    c = column(c) if isinstance(c, str) else c
    text = F.trim(c.cast("string"))
    # Long text is never a date; the length test spares it the patterns.
    text = F.when(F.length(c.cast("string")).between(*DATE_LENGTHS), text)
    other = F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)) for layout in DATE_LAYOUTS])
    return F.when(text.rlike(ISO_SHAPE), F.try_to_timestamp(text)).when(text.rlike(DATE_SHAPE), other)


def as_time(df: DataFrame, name: str) -> Column:
    """The column as a timestamp whatever its stored type."""
    dtype = dtype_of(df, name)
    if is_time(dtype):
        return column(name).cast("timestamp")
    if is_text(dtype):
        return parse_dates(name)
    return F.lit(None).cast("timestamp")


def date_part(c: Column, part: str) -> Column:
    """``year``, ``month`` or ``dayofweek`` (Monday is 0) of a timestamp."""
    if part == "year":
        return F.year(c)
    if part == "month":
        return F.month(c)
    if part == "dayofweek":
        return F.weekday(c)
    raise ValueError(part)


def hash_key(*columns: str) -> Column:
    """A uniform 52-bit integer from key columns; the order for every random split.

    52 bits stay exact when a quantile sketch turns them into doubles.
    """
    joined = F.concat_ws("|", *[column(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("bigint")


def normalize_01(df: DataFrame, name: str, output: str | None = None) -> DataFrame:
    """Each value's place between the column's minimum (0) and maximum (1), 4 decimals.

    A constant column maps to 0.5 and missing values stay missing.
    """
    value = coerce_numeric(name)
    bounds = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    span = F.col("_high") - F.col("_low")
    place = F.when(value.isNull(), None).when(span == 0, 0.5).otherwise(
        F.round((value - F.col("_low")) / span, 4)
    )
    # One row of bounds: broadcasting it has a fixed size.
    return (
        df.crossJoin(F.broadcast(bounds))
        .withColumn(output or f"{name}_norm", place)
        .drop("_low", "_high")
    )
