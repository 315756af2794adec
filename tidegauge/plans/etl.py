"""From landed raw files to the daily and monthly tables.

Layout of the landing folder: one sub-folder per source, in it ``series_id=<id>`` folders.
Each source is one scan for all its series; the catalog says which series is daily, monthly
or annual. Alignment works on long rows; wide tables are made at the very end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import align, expectations, grid
from tidegauge.operators.relational import union_all
from tidegauge.schema import ANNUAL, DAILY, MONTHLY, require_unique
from tidegauge.session import settle
from tidegauge.sources import ledger, payloads, sinks, tables

# Sub-folder of each source.
FOLDERS = {
    "BCB/SGS": "bcb_sgs",
    "BCB/ODATA": "bcb_odata",
    "IBGE/SIDRA": "ibge_sidra",
    "IPEADATA": "ipeadata",
    "FRED": "fred",
}
# Series with a rule of their own.
FIRST_OF_MONTH = ("selic",)
LAST_OF_MONTH = ("ipc_s",)
NOT_IN_MONTHLY = ("expec_pib",)
TARGET_EXTENSION = 11

SERIES = ["series_id"]


@dataclass(frozen=True)
class Tables:
    """Long daily and monthly rows, and the ids that become columns."""

    daily: DataFrame
    monthly: DataFrame
    daily_ids: list[str]
    monthly_ids: list[str]

    def wide_daily(self) -> DataFrame:
        return align.to_wide(self.daily, self.daily_ids)

    def wide_monthly(self) -> DataFrame:
        return align.to_wide(self.monthly, self.monthly_ids)


def _ids(catalog: DataFrame) -> list[tuple[str, str, str]]:
    """(series, source, frequency) in catalog order: the column names of the wide tables."""
    rows = catalog.select("series_id", "source", "freq").collect()
    return [(r.series_id, r.source, r.freq) for r in rows]


def _of(df: DataFrame, freq: str) -> DataFrame:
    return df.filter(F.col("freq") == freq).select("series_id", "data", "value")


def central_bank_rows(raw: DataFrame, anchors: list[str]) -> tuple[DataFrame, DataFrame]:
    """Daily rows on the first daily series' dates, and the monthly rows made of them.

    ``raw`` has a ``freq`` column. A series in FIRST_OF_MONTH keeps the date and value of
    the month's first daily row; the others enter by their mean. Annual series are repeated
    over their year.
    """
    daily = align.keep_anchor_dates(_of(raw, DAILY), anchors)
    by_first = F.col("series_id").isin(*FIRST_OF_MONTH)
    # the months span all daily series, those of FIRST_OF_MONTH too
    means = grid.month_mean(daily, SERIES, scope="panel").filter(~by_first)
    openings = daily.groupBy(F.trunc("data", "MM").alias("_m")).agg(F.min("data").alias("data"))
    first = daily.filter(by_first).join(openings.select("data"), "data", "left_semi")
    annual = grid.upsample_ffill(_of(raw, ANNUAL), SERIES, extend=TARGET_EXTENSION)
    monthly = union_all(_of(raw, MONTHLY), means, first.select("series_id", "data", "value"), annual)
    return daily, monthly


def survey_rows(spark: SparkSession, folder: str, ids: list[str]) -> DataFrame | None:
    """Each survey reduced to one value per month, by its own horizon."""
    parts = []
    for name, spec in expectations.SURVEYS.items():
        if name in ids and name not in NOT_IN_MONTHLY:
            asked = payloads.read_survey(spark, f"{folder}/series_id={name}", ref=spec.ref)
            rows = expectations.expectation(asked, spec)
            parts.append(rows.select(F.lit(name).alias("series_id"), "data", "value"))
    return union_all(*parts) if parts else None


def research_rows(raw: DataFrame) -> DataFrame:
    """Monthly rows, and the last daily value of each month."""
    last = grid.month_last(_of(raw, DAILY).filter(F.col("series_id").isin(*LAST_OF_MONTH)), SERIES)
    return union_all(_of(raw, MONTHLY), last.select("series_id", "data", "value"))


def reserve_rows(raw: DataFrame, monthly_ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Daily rows, and monthly rows with the daily means on the monthly series' dates."""
    daily = _of(raw, DAILY)
    means = grid.month_mean(daily, SERIES, scope="panel")
    both = union_all(_of(raw, MONTHLY), means)
    return daily, align.keep_anchor_dates(both, monthly_ids)


def build(
    spark: SparkSession, landing: str, catalog: DataFrame, anchor: str | None = None, landed: str | None = None
) -> Tables:
    """All sources to the daily and monthly long tables.

    ``anchor`` is the central bank's daily series whose dates the other daily ones follow;
    without it, the first by name, so that the order of the catalog's files does not matter.
    Raises when a source has two rows for one series and date: a grid would hide it.
    ``landed`` names the folder of rows read before: only files new since then are read.
    Surveys depend on their horizon, not on a date, and are read whole.
    """
    ids = _ids(catalog)
    names = {s: [i for i, source, _ in ids if source == s] for s in FOLDERS}

    def rows(source, reader):
        folder = FOLDERS[source]
        if landed:
            raw = ledger.refresh(spark, f"{landing}/{folder}", reader, f"{landed}/{folder}")
        else:
            raw = reader(spark, f"{landing}/{folder}")
        # a source's rows feed several branches: parse the files once
        routed = settle(tables.route_by_freq(raw, catalog, source), FOLDERS[source])
        return require_unique(routed, ["freq", "series_id", "data"])

    def listed(source, freq):
        return [i for i, s, f in ids if s == source and f == freq]

    daily, monthly = [], []
    if names["BCB/SGS"]:
        raw = rows("BCB/SGS", payloads.read_json_array)
        by_day, by_month = central_bank_rows(raw, [anchor] if anchor else sorted(listed("BCB/SGS", DAILY))[:1])
        daily.append(by_day)
        monthly.append(by_month)
    if names["BCB/ODATA"]:
        surveys = survey_rows(spark, f"{landing}/{FOLDERS['BCB/ODATA']}", names["BCB/ODATA"])
        if surveys is not None:
            monthly.append(surveys)
    if names["IBGE/SIDRA"]:
        monthly.append(_of(rows("IBGE/SIDRA", payloads.read_json_sentinel), MONTHLY))
    if names["IPEADATA"]:
        monthly.append(research_rows(rows("IPEADATA", payloads.read_json_nested)))
    if names["FRED"]:
        raw = rows("FRED", payloads.read_csv_wide)
        by_day, by_month = reserve_rows(raw, listed("FRED", MONTHLY))
        daily.append(by_day)
        monthly.append(by_month)
    return Tables(
        union_all(*daily),
        union_all(*monthly),
        listed("BCB/SGS", DAILY) + listed("FRED", DAILY),
        [i for i, _, _ in ids if i not in NOT_IN_MONTHLY],
    )


def run(
    spark: SparkSession,
    landing: str,
    catalog: DataFrame,
    out: str,
    anchor: str | None = None,
    incremental: bool = False,
) -> None:
    """Build and store: long tables for further work, wide ones as published.

    Nothing is overwritten before the rows have been checked. An ``incremental`` run keeps
    the landed rows below ``out`` and reads only files that are new or changed; the tables
    are made anew from the rows kept.
    """
    made = build(spark, landing, catalog, anchor, f"{out}/landed" if incremental else None)
    both = union_all(
        made.daily.withColumn("freq", F.lit("D")), made.monthly.withColumn("freq", F.lit("M"))
    )
    # the wide tables take one value per cell: a repeated key must not pass unseen
    sinks.write_long(require_unique(settle(both, "long"), ["freq", "series_id", "data"]), f"{out}/long")
    stored = spark.read.parquet(f"{out}/long")
    kept = Tables(
        stored.filter("freq = 'D'"), stored.filter("freq = 'M'"), made.daily_ids, made.monthly_ids
    )
    sinks.write_wide(kept.wide_daily(), f"{out}/daily")
    sinks.write_wide(kept.wide_monthly(), f"{out}/monthly")
