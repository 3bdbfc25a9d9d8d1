"""Result columns that serialise to JSON without loss."""

from pyspark.sql import DataFrame, functions as F, types as T


def _iso_timestamp(column):
    whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(column, ".SSSSSS")
    return F.when(fraction == ".000000", whole).otherwise(F.concat(whole, fraction))


def json_safe(df: DataFrame) -> DataFrame:
    """Decimals as text, dates and timestamps as ISO text; other types unchanged."""
    # Results may have equal names, so columns go by position.
    names, fields = df.columns, df.schema.fields
    df = df.toDF(*[f"c{k}" for k in range(len(names))])
    columns = []
    for k, field in enumerate(fields):
        column = F.col(f"c{k}")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("string")
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = _iso_timestamp(column)
        columns.append(column.alias(f"c{k}"))
    return df.select(*columns).toDF(*names)
