"""Column helpers shared by every operator: naming, type classes, number views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# A number as pandas' to_numeric accepts it: no type suffix such as '12d'.
NUMBER_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)\s*$"


def col(name: str) -> Column:
    """The column called exactly `name`, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, booleans: bool = False) -> list[str]:
    kinds = (T.NumericType, T.BooleanType) if booleans else (T.NumericType,)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def variant_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.VariantType)]


def date_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def is_date(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def text_as_number(c: Column) -> Column:
    """Text as double, null when it is not a plain number."""
    return F.when(F.lower(c).rlike(NUMBER_TEXT), F.trim(c).try_cast("double"))


def as_number(field: T.StructField, c: Column | None = None) -> Column:
    """Any column as double: numbers, booleans, dates (seconds) and number texts; NaN is null."""
    c = col(field.name) if c is None else c
    dtype = field.dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    if is_date(dtype):
        return c.cast("timestamp").cast("double")
    if isinstance(dtype, T.StringType):
        x = text_as_number(c)
        return F.when(~F.isnan(x), x)
    if isinstance(dtype, T.VariantType):
        x = text_as_number(c.cast("string"))
        return F.when(~F.isnan(x), x)
    return F.lit(None).cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """pandas knows one missing value; fold NaN into NULL before any statistics."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(
        [F.nanvl(col(n), F.lit(None).cast(df.schema[n].dataType)).alias(n) if n in floats else col(n)
         for n in df.columns]
    )


def groupable(df: DataFrame) -> DataFrame:
    """VARIANT, MAP and the like cannot be grouped: replace them by their JSON text."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.VariantType):
            out.append(col(f.name).cast("string").alias(f.name))
        elif isinstance(f.dataType, T.MapType):
            out.append(F.to_json(col(f.name)).alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(out)


def long_rows(entries: list[Column]) -> Column:
    """Turn a list of structs built from one row into rows (an UNPIVOT over expressions)."""
    return F.inline(F.array(*entries))


def pin(df: DataFrame) -> DataFrame:
    """Fix a table whose row count is bounded by the schema (one row per column or finding)."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def finite(c: Column) -> Column:
    """NaN and infinities become null, as in report fields."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add a costly column that is computed once per row.

    A plain projection would be copied into every later filter and expression that
    uses the column; a one-element explode is not.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))
