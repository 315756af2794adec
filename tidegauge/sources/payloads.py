"""Raw payload files to long rows.

A payload folder holds one sub-folder ``series_id=<id>`` per series, each with any number
of files, so one scan covers every series and the id comes from the path. JSON and FRED files have
given schemas; survey files take their column names from the header, all as text.

JSON files carry one document per line unless ``multiline`` is set. A document, date or
number that cannot be parsed fails the job: a null would pass for a missing value. Empty
text and listed sentinels are NULL. Only ``read_json_array`` takes any text for a value: its
source system does not convert it, so what is no number is NULL there.

Given ``base``, the four readers of long rows take a list of files below that folder and
return each row's ``file`` as well: the ledger of read files needs both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import (
    decimal_comma,
    parse_date,
    parse_quarter,
    strict_double,
    to_double,
    utc_date,
)

# The texts that stand for a header or a missing number.
SENTINELS = ("Valor", "...", "-")
# How a survey names its reference period.
REF_PATTERNS = {"month": "MM/yyyy", "year": "yyyy"}


def _scan(spark: SparkSession, base: str | None) -> DataFrameReader:
    return spark.read.option("basePath", base) if base else spark.read


def _file(base: str | None) -> list:
    return [F.col("_metadata.file_path").alias("file")] if base else []


def _long(df: DataFrame, data, value, *more) -> DataFrame:
    return df.select("series_id", data.alias("data"), value.alias("value"), *more)


def read_json_array(
    spark: SparkSession, path: str | list[str], multiline: bool = False, base: str | None = None
) -> DataFrame:
    """``[{"data": "dd/mm/yyyy", "valor": "1.5"}, ...]``, many files per series."""
    raw = _scan(spark, base).schema("data STRING, valor STRING, series_id STRING").json(
        path, multiLine=multiline, mode="FAILFAST"
    )
    return _long(raw, parse_date(F.col("data"), "dd/MM/yyyy"), to_double(F.col("valor")), *_file(base))


def read_json_sentinel(
    spark: SparkSession, path: str | list[str], multiline: bool = False, base: str | None = None
) -> DataFrame:
    """Records with a ``yyyyMM`` code and a text value; header and missing rows dropped."""
    raw = _scan(spark, base).schema("D3C STRING, V STRING, series_id STRING").json(
        path, multiLine=multiline, mode="FAILFAST"
    )
    # NOT IN keeps a null value, as the source system's own filter does
    kept = raw.filter(F.coalesce(~F.col("V").isin(*SENTINELS), F.lit(True)))
    # the header row's code is no date, and the optimiser may read dates before it filters
    day = F.when(~F.coalesce(F.col("V").isin(*SENTINELS), F.lit(False)), F.to_date("D3C", "yyyyMM"))
    return _long(kept, day, strict_double(F.col("V"), SENTINELS), *_file(base))


def read_json_nested(
    spark: SparkSession, path: str | list[str], multiline: bool = False, base: str | None = None
) -> DataFrame:
    """``{"value": [{"VALDATA": <offset timestamp>, "VALVALOR": 1.5}, ...]}``."""
    raw = _scan(spark, base).schema(
        "value ARRAY<STRUCT<VALDATA: STRING, VALVALOR: STRING>>, series_id STRING"
    ).json(path, multiLine=multiline, mode="FAILFAST")
    rows = raw.select("series_id", *_file(base), F.inline("value"))
    more = ["file"] if base else []
    return _long(rows, utc_date(F.col("VALDATA")), strict_double(F.col("VALVALOR")), *more)


def read_csv_wide(spark: SparkSession, path: str | list[str], base: str | None = None) -> DataFrame:
    """``observation_date,<code>``: the second column's name differs per series."""
    raw = _scan(spark, base).schema("observation_date STRING, reading STRING, series_id STRING").csv(
        path, header=True
    )
    return _long(raw, F.to_date("observation_date"), strict_double(F.col("reading"), (".",)), *_file(base))


def read_decimal_comma(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """CSV of any columns; those in ``numbers`` use a decimal comma."""
    raw = spark.read.csv(path, header=True, enforceSchema=False)
    return raw.withColumns({name: decimal_comma(F.col(name)) for name in numbers})


def read_survey(
    spark: SparkSession,
    path: str,
    ref: str | None = "month",
    since: str | None = None,
    indicator: str | None = None,
    calc: str | None = None,
) -> DataFrame:
    """Survey rows: date, reference period, mean and median.

    ``ref`` names the reference period's form: month, quarter, year or None (no period).
    """
    raw = spark.read.csv(path, header=True, enforceSchema=False)
    if indicator is not None:
        raw = raw.filter(F.col("Indicador") == indicator)
    if calc is not None:
        raw = raw.filter(F.col("tipoCalculo") == calc)
    period = F.col("DataReferencia") if ref else F.lit(None).cast("date")
    if ref == "quarter":
        period = parse_quarter(period)
    elif ref:
        period = parse_date(period, REF_PATTERNS[ref])
    series = F.col("series_id") if "series_id" in raw.columns else F.lit(None)
    median = F.col("Mediana") if "Mediana" in raw.columns else F.lit(None).cast("string")
    rows = raw.select(
        series.cast("string").alias("series_id"),
        F.to_date("Data").alias("survey_date"),
        period.alias("ref_date"),
        decimal_comma(F.col("Media")).alias("mean"),
        decimal_comma(median).alias("median"),
    )
    if since is not None:
        rows = rows.filter(F.col("survey_date") >= F.lit(since).cast("date"))
    return rows
