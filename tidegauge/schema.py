"""Table layouts and the key check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STRING, DOUBLE, DATE, STAMP = T.StringType(), T.DoubleType(), T.DateType(), T.TimestampType()

CATALOG = _struct(series_id=STRING, source=STRING, input=STRING, freq=STRING, transform=STRING)
LONG = _struct(series_id=STRING, data=DATE, value=DOUBLE)
SURVEY = _struct(series_id=STRING, survey_date=DATE, ref_date=DATE, mean=DOUBLE, median=DOUBLE)
FORECAST = _struct(
    data=DATE,
    valor=DOUBLE,
    ic_inferior=DOUBLE,
    ic_superior=DOUBLE,
    variavel=STRING,
    tipo=STRING,
)
TRACKING = T.StructType([*FORECAST.fields, T.StructField("previsao", STAMP)])

# Header names, sources, frequencies and labels as the landed tables spell them.
CATALOG_HEADER = {
    "Identificador": "series_id",
    "Fonte": "source",
    "Input de Coleta": "input",
    "Frequência": "freq",
    "Transformação": "transform",
}
SOURCES = ("BCB/SGS", "BCB/ODATA", "IBGE/SIDRA", "IPEADATA", "FRED")
DAILY, MONTHLY, ANNUAL = "Diária", "Mensal", "Anual"
HISTORY_LABEL = "Histórico"
TARGET_SERIES = "ipca"
TARGET_LABEL = "IPCA"


def no_nan(value: Column) -> Column:
    """NaN becomes NULL: averages, counts and fills must skip missing values."""
    return F.nanvl(value, F.lit(None).cast("double"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count.

    Partial aggregation keeps a hot key to one row per map task.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise when a key repeats. Runs one job."""
    clash = duplicate_keys(df, keys).head(1)
    if clash:
        raise ValueError(f"duplicate key {clash[0].asDict()} on {list(keys)}")
    return df
