"""Land long rows in the raw payload layouts, one folder per series.

Used where a flow starts from raw files: the readers are checked against the rows that were
written. Arrays are built per series and year, so none grows beyond a year of days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decimal_comma_text(value: Column) -> Column:
    return F.replace(value.cast("string"), F.lit("."), F.lit(","))


def _write_text(df: DataFrame, path: str, mode: str = "error") -> None:
    df.select("series_id", "value").write.mode(mode).partitionBy("series_id").text(path)


def _year_arrays(long: DataFrame, record: Column) -> DataFrame:
    return long.groupBy("series_id", F.year("data").alias("_y")).agg(
        F.sort_array(F.collect_list(F.struct("data", record.alias("_r")))).alias("_rows")
    ).select("series_id", F.col("_rows._r").alias("records"))


def land_json_array(long: DataFrame, path: str, mode: str = "error") -> None:
    record = F.struct(
        F.date_format("data", "dd/MM/yyyy").alias("data"),
        F.col("value").cast("string").alias("valor"),
    )
    arrays = _year_arrays(long, record)
    _write_text(arrays.withColumn("value", F.to_json("records")), path, mode)


def land_json_windows(long: DataFrame, path: str, years: int = 5) -> None:
    """As ``land_json_array``, in a folder for each window of ``years`` years."""
    record = F.struct(
        F.date_format("data", "dd/MM/yyyy").alias("data"),
        F.col("value").cast("string").alias("valor"),
    )
    year = F.year("data")
    first = year - year % years
    window = F.format_string("%04d-01-01_%04d-12-31", first, first + years - 1)
    arrays = long.groupBy("series_id", window.alias("window"), year.alias("_y")).agg(
        F.to_json(F.collect_list(record)).alias("value")
    )
    arrays.select("series_id", "window", "value").write.partitionBy("series_id", "window").text(path)


def land_json_sentinel(long: DataFrame, path: str) -> None:
    """The first record is a header; a missing number is ``...``."""
    record = F.struct(
        F.date_format("data", "yyyyMM").alias("D3C"),
        F.coalesce(F.col("value").cast("string"), F.lit("...")).alias("V"),
    )
    header = F.array(F.struct(F.lit("Mês (Código)").alias("D3C"), F.lit("Valor").alias("V")))
    arrays = _year_arrays(long, record)
    _write_text(arrays.withColumn("value", F.to_json(F.concat(header, "records"))), path)


def land_json_nested(long: DataFrame, path: str) -> None:
    record = F.struct(
        F.date_format("data", "yyyy-MM-dd'T00:00:00-02:00'").alias("VALDATA"),
        F.col("value").alias("VALVALOR"),
    )
    arrays = _year_arrays(long, record)
    document = F.to_json(F.struct(F.col("records").alias("value")))
    _write_text(arrays.withColumn("value", document), path)


def land_csv_wide(long: DataFrame, path: str) -> None:
    rows = long.select(
        "series_id",
        F.date_format("data", "yyyy-MM-dd").alias("observation_date"),
        F.col("value").cast("string").alias("CODE"),
    )
    rows.write.partitionBy("series_id").csv(path, header=True)


def land_survey(survey: DataFrame, path: str, ref_format: str = "MM/yyyy") -> None:
    """Survey CSV with a decimal comma; ``mean`` and ``median`` where present."""
    numbers = [
        decimal_comma_text(F.col(c)).alias(name)
        for c, name in (("mean", "Media"), ("median", "Mediana"))
        if c in survey.columns
    ]
    rows = survey.select(
        "series_id",
        F.lit("IPCA").alias("Indicador"),
        F.date_format("survey_date", "yyyy-MM-dd").alias("Data"),
        F.date_format("ref_date", ref_format).alias("DataReferencia"),
        F.lit("C").alias("tipoCalculo"),
        *numbers,
    )
    rows.write.partitionBy("series_id").csv(path, header=True)


def land_catalog(catalog: DataFrame, path: str, header: dict[str, str]) -> None:
    renamed = catalog.select(*[F.col(new).alias(old) for old, new in header.items()])
    renamed.write.csv(path, header=True)
