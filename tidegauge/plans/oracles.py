"""SQL counterparts of the registered queries, for an independent engine on the same tables.

Common table expressions are named pieces put in front of a query's own text.
"""

from __future__ import annotations

from tidegauge.plans.shapes import BALANCE, EXOG, FLAGS, PRIORITIES


def _month(day: str) -> str:
    return f"CAST(date_trunc('month', {day}) AS DATE)"


def _text(column: str = "data") -> str:
    return f"CAST({column} AS VARCHAR) AS {column}"


def _day(text: str) -> str:
    return f"CAST('{text}' AS DATE)"


def _grid(name: str, cells: str, by: str, values: list[str], lo: str, hi: str, scope: str) -> str:
    """Two expressions: ``<name>_spine`` and ``<name>``, the cells left-joined to it."""
    series = f"SELECT {by}, CAST(unnest(generate_series({lo}, {hi}, INTERVAL 1 MONTH)) AS DATE) AS data"
    if scope == "series":
        spine = f"{series} FROM {cells} GROUP BY {by}"
    else:
        spine = (
            f"SELECT k.{by}, CAST(unnest(generate_series(e.lo, e.hi, INTERVAL 1 MONTH)) AS DATE) AS data "
            f"FROM (SELECT DISTINCT {by} FROM {cells}) k, "
            f"(SELECT {lo} AS lo, {hi} AS hi FROM {cells}) e"
        )
    picked = ", ".join(f"c.{v}" for v in values)
    return (
        f"{name}_spine AS ({spine}), {name} AS (SELECT s.{by}, s.data, {picked} FROM {name}_spine s "
        f"LEFT JOIN {cells} c ON c.{by} = s.{by} AND c.data = s.data)"
    )


CEIL_MIN = (
    "CASE WHEN day(min(data)) = 1 THEN min(data) "
    "ELSE CAST(date_trunc('month', min(data)) + INTERVAL 1 MONTH AS DATE) END"
)


def _fill(column: str, by: str) -> str:
    return (
        f"coalesce(first_value({column} IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY data "
        f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
        f"last_value({column} IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY data "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS {column}"
    )


def _survey(unit: str) -> str:
    return (
        "survey AS (SELECT l_returnflag AS series_id, CAST(o_orderdate AS DATE) AS survey_date, "
        f"CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS ref_date, "
        "round_even(l_discount * 100, 0) AS mean, l_quantity AS median "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
    )


def _before_end(months: int) -> str:
    return f"(SELECT max(data) - INTERVAL {months} MONTH FROM rates)"


_MODEL = [("Ridge", 1.015625, 0.875, 1.125), ("Huber", 0.984375, 0.75, 1.25)]
_MODEL_ROWS = ", ".join(f"('{n}', {m}, {lo}, {hi})" for n, m, lo, hi in _MODEL)

CTE = {
    "daily": (
        "daily AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS data, "
        "sum(CAST(floor(o_totalprice) AS DOUBLE)) AS value FROM orders GROUP BY 1, 2)"
    ),
    "shipped": (
        "shipped AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS data, "
        "sum(CAST(floor(l_extendedprice) AS DOUBLE)) AS value FROM lineitem GROUP BY 1, 2)"
    ),
    "happened": (
        "happened AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS data, "
        "sum(CAST(floor(value) AS DOUBLE)) AS value FROM events GROUP BY 1, 2)"
    ),
    "cells": f"cells AS (SELECT series_id, {_month('data')} AS data, avg(value) AS value FROM daily GROUP BY 1, 2)",
    "monthly": _grid("monthly", "cells", "series_id", ["value"], "min(data)", "max(data)", "series"),
    "scells": f"scells AS (SELECT series_id, {_month('data')} AS data, avg(value) AS value FROM shipped GROUP BY 1, 2)",
    "smonthly": _grid("smonthly", "scells", "series_id", ["value"], "min(data)", "max(data)", "series"),
    "annual": (
        "annual AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('year', o_orderdate) AS DATE) AS data, "
        "sum(CAST(floor(o_totalprice) AS DOUBLE)) AS value FROM orders GROUP BY 1, 2)"
    ),
    "rates": (
        f"rates AS (SELECT l_returnflag AS series_id, {_month('l_shipdate')} AS data, "
        "avg(round_even(l_discount * 100, 0)) AS value FROM lineitem GROUP BY 1, 2)"
    ),
    "survey_month": _survey("month"),
    "survey_quarter": _survey("quarter"),
    "survey_year": _survey("year"),
    "asked": (
        f"asked AS (SELECT l_returnflag AS series_id, {_month('o_orderdate')} AS survey_date, "
        f"{_month('l_shipdate')} AS ref_date, avg(l_quantity) AS median "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"
    ),
    "last_seen": (
        f"last_seen AS (SELECT l_returnflag AS series_id, {_month('max(l_shipdate)')} AS last "
        "FROM lineitem WHERE date_trunc('month', l_shipdate) <= "
        "(SELECT date_trunc('month', max(l_shipdate)) - INTERVAL 15 MONTH FROM lineitem) GROUP BY 1)"
    ),
    "period": (
        "period AS (SELECT series_id, CAST(step AS INTEGER) AS step, "
        "CAST(last + to_months(CAST(step AS INTEGER)) AS DATE) AS data "
        "FROM last_seen, generate_series(1, 12) AS g(step))"
    ),
    "history": (
        "history AS (SELECT series_id AS variavel, data, value AS valor FROM rates "
        f"WHERE data <= {_before_end(13)})"
    ),
    "ahead": (
        "ahead AS (SELECT data, value * mid AS valor, value * lo AS ic_inferior, value * hi AS ic_superior, "
        "series_id AS variavel, tipo FROM rates, "
        f"(VALUES {_MODEL_ROWS}) AS m(tipo, mid, lo, hi) "
        f"WHERE data >= {_before_end(13)})"
    ),
    "served": (
        "served AS (SELECT variavel, data, valor, 'Histórico' AS tipo, CAST(NULL AS DOUBLE) AS ic_inferior, "
        "CAST(NULL AS DOUBLE) AS ic_superior FROM history UNION ALL "
        "SELECT variavel, data, valor, tipo, ic_inferior, ic_superior FROM ahead)"
    ),
    "years": (
        "years AS (SELECT variavel, tipo, CAST(year(min(data)) AS INTEGER) AS ano FROM served "
        "WHERE tipo <> 'Histórico' AND valor IS NOT NULL GROUP BY 1, 2)"
    ),
    "supplier_cells": (
        f"supplier_cells AS (SELECT l_suppkey AS target_id, {_month('l_shipdate')} AS data, "
        "avg(CAST(floor(l_extendedprice) AS DOUBLE)) AS y, avg(l_quantity) AS quantity, "
        "avg(round_even(l_discount * 100, 0)) AS discount, avg(round_even(l_tax * 100, 0)) AS tax, "
        "avg(CAST(l_linenumber AS DOUBLE)) AS line FROM lineitem GROUP BY 1, 2)"
    ),
    "supplier_grid": _grid(
        "supplier_grid", "supplier_cells", "target_id", ["y", *EXOG], "min(data)", "max(data)", "series"
    ),
    "frame": (
        "frame AS (SELECT target_id, data, "
        + ", ".join(_fill(c, "target_id") for c in ["y", *EXOG])
        + " FROM supplier_grid)"
    ),
    # the square-root-like power scale used by the interval queries
    "frame_half": (
        "frame AS (SELECT target_id, data, (pow(y + 1, 0.5) - 1) / 0.5 AS y, quantity, discount, tax, line "
        "FROM frame_raw)"
    ),
    "design": (
        "design AS (SELECT * FROM (SELECT *, lag(y) OVER (PARTITION BY target_id ORDER BY data) AS lag_1 "
        "FROM frame) WHERE y IS NOT NULL AND lag_1 IS NOT NULL AND quantity IS NOT NULL AND discount IS NOT NULL)"
    ),
}
CTE["frame_raw"] = CTE["frame"].replace("frame AS", "frame_raw AS", 1)

# pieces that need others in front of them
CHAIN = {
    "monthly": ["daily", "cells"],
    "smonthly": ["shipped", "scells"],
    "period": ["last_seen"],
    "served": ["rates", "history", "ahead"],
    "years": ["served"],
    "supplier_grid": ["supplier_cells"],
    "frame": ["supplier_grid"],
    "frame_raw": ["supplier_grid"],
    "frame_half": ["frame_raw"],
    "cells": ["daily"],
    "ahead": ["rates"],
    "history": ["rates"],
}


def _with(pieces: list[str], body: str, *more: str, recursive: bool = False) -> str:
    order: list[str] = []

    def put(name: str) -> None:
        for needed in CHAIN.get(name, []):
            put(needed)
        if name not in order:
            order.append(name)

    for piece in pieces:
        put(piece)
    parts = [CTE[name] for name in order] + list(more)
    if not parts:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"


def _r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round_even({expr}, {digits}) AS {name or expr}"


def _catalog() -> str:
    sources = ["BCB/SGS", "IBGE/SIDRA", "IPEADATA", "FRED", "BCB/SGS"]
    rows = [
        (p, s, str(i + 1), "Diária", str(i + 2)) for i, (p, s) in enumerate(zip(PRIORITIES, sources))
    ]
    rows += [(f, "FRED", str(i + 6), "Mensal", c) for i, (f, c) in enumerate(zip(FLAGS, "156"))]
    values = ", ".join(str(r) for r in rows)
    return f"catalog AS (SELECT * FROM (VALUES {values}) AS t(series_id, source, input, freq, transform))"


def _pivot(ids: list[str], digits: int | None = None) -> str:
    def cell(i: str) -> str:
        value = f"max(CASE WHEN series_id = '{i}' THEN value END)"
        return f'round_even({value}, {digits}) AS "{i}"' if digits is not None else f'{value} AS "{i}"'

    return ", ".join(cell(i) for i in ids)


def _horizon(ref: str, asked: str, unit: int) -> str:
    return f"CAST(trunc(date_diff('day', {asked}, {ref}) / {float(unit)}) AS INTEGER)"


ORACLES: dict[str, str] = {}

# sources and sinks
ORACLES["src_catalog"] = _with(
    [],
    "SELECT series_id, source, input, freq, transform FROM catalog "
    "WHERE series_id IN (SELECT o_orderpriority FROM orders) UNION ALL "
    "SELECT concat('part ', p_partkey), p_brand, p_name, CASE WHEN p_size % 2 = 0 THEN 'Diária' ELSE 'Mensal' END, "
    "CAST(p_size % 6 + 1 AS VARCHAR) FROM part",
    _catalog(),
)
ORACLES["src_json_array"] = _with(["daily"], f"SELECT series_id, {_text()}, value FROM daily")
ORACLES["src_landed"] = ORACLES["src_json_array"]
ORACLES["src_payload_format"] = (
    ORACLES["src_json_array"] + " WHERE series_id IN ('1-URGENT', '4-NOT SPECIFIED') AND daily.data >= DATE '1996-01-01'"
)
ORACLES["src_json_sentinel"] = _with(
    ["monthly"], f"SELECT series_id, {_text()}, {_r('value')} FROM monthly WHERE value IS NOT NULL"
)
ORACLES["src_json_nested"] = _with(["shipped"], f"SELECT series_id, {_text()}, value FROM shipped")
ORACLES["src_csv_wide"] = ORACLES["src_json_nested"]
ORACLES["src_decimal_comma"] = "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders"
ORACLES["src_survey"] = _with(
    ["survey_month"],
    f"SELECT series_id, {_text('survey_date')}, {_text('ref_date')}, mean, median FROM survey "
    "WHERE survey_date >= DATE '1998-01-01'",
)
ORACLES["src_parquet"] = "SELECT o_orderkey, o_totalprice FROM orders"
_AHEAD = f"{_text()}, {_r('valor')}, {_r('ic_inferior')}, {_r('ic_superior')}, variavel, tipo"
ORACLES["src_tracking"] = _with(
    ["ahead"], f"SELECT {_AHEAD}, '2000-10-03 15:35:45.413654' AS previsao FROM ahead"
)
ORACLES["snk_forecast"] = _with(["ahead"], f"SELECT {_AHEAD} FROM ahead")
ORACLES["snk_append"] = _with(
    ["ahead"],
    f"SELECT {_AHEAD}, previsao FROM ahead, "
    "(VALUES ('2000-10-03 12:00:00'), ('2000-10-10 12:00:00')) AS r(previsao)",
)
ORACLES["snk_publish"] = _with(
    ["ahead"],
    f"SELECT {_AHEAD}, previsao FROM ahead, "
    "(VALUES ('2000-10-03 12:00:00'), ('2000-10-10 12:00:00'), ('now')) AS r(previsao)",
)
ORACLES["snk_parquet"] = _with(
    ["daily", "monthly"],
    f"SELECT {_text()}, {_pivot(PRIORITIES, 6)}, 'D' AS freq FROM daily GROUP BY data UNION ALL "
    f"SELECT {_text()}, {_pivot(PRIORITIES, 6)}, 'M' AS freq FROM monthly GROUP BY data",
)
ORACLES["route_by_freq"] = _with(
    ["daily", "rates"],
    f"SELECT r.series_id, {_text()}, {_r('value')}, source, freq "
    "FROM (SELECT * FROM daily UNION ALL SELECT * FROM rates) r JOIN catalog c ON r.series_id = c.series_id",
    _catalog(),
)
ORACLES["backfill_windows"] = (
    "WITH spans AS (SELECT o_orderpriority AS series_id, CAST(min(o_orderdate) AS DATE) AS lo, "
    "CAST(max(o_orderdate) AS DATE) AS hi FROM orders GROUP BY 1) "
    "SELECT series_id, CAST(k AS INTEGER) AS window_no, "
    "CAST(CAST(lo + to_years(CAST(5 * k AS INTEGER)) AS DATE) AS VARCHAR) AS window_start, "
    "CAST(CAST(lo + to_years(CAST(5 * k + 5 AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS window_end "
    "FROM spans, generate_series(0, 40) AS g(k) WHERE lo + to_years(CAST(5 * k AS INTEGER)) < hi"
)

# projections and predicates
ORACLES["prj_select"] = "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem"
ORACLES["prj_tolerant"] = "SELECT o_orderstatus, o_orderkey FROM orders"
ORACLES["prj_drop"] = "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer"
ORACLES["prj_cast"] = (
    "SELECT o_orderkey, CAST(trunc(o_totalprice) AS INTEGER) AS price_int, "
    "CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS level, "
    "TRY_CAST(o_orderpriority AS DOUBLE) AS not_a_number, CAST(o_custkey AS VARCHAR) AS customer FROM orders"
)
ORACLES["flt_eq"] = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'"
ORACLES["flt_in"] = (
    "SELECT o_orderkey, o_orderstatus, level FROM "
    "(SELECT *, nullif(o_orderpriority, '5-LOW') AS level FROM orders) "
    "WHERE (level IS NULL OR level NOT IN ('1-URGENT', '2-HIGH')) AND o_orderstatus IN ('F', 'O')"
)
ORACLES["flt_range"] = (
    "SELECT l_orderkey, l_linenumber FROM lineitem "
    "WHERE l_shipdate >= TIMESTAMP '1997-03-01' AND l_shipdate <= TIMESTAMP '1998-02-28'"
)
ORACLES["flt_bool"] = (
    "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem "
    "WHERE (l_returnflag = 'A' AND l_quantity > 40) OR (l_returnflag = 'R' AND l_linestatus = 'O')"
)
ORACLES["flt_at_extreme"] = (
    "WITH x AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS d, l_orderkey, l_linenumber, "
    "max(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_returnflag) AS hi, "
    "min(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_returnflag) AS lo FROM lineitem) "
    "SELECT series_id, CAST(d AS VARCHAR) AS data, l_orderkey, l_linenumber, 'last' AS edge FROM x WHERE d = hi "
    "UNION ALL "
    "SELECT series_id, CAST(d AS VARCHAR) AS data, l_orderkey, l_linenumber, 'first' AS edge FROM x WHERE d = lo"
)
ORACLES["flt_year"] = (
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE year(o_orderdate) = 1998"
)
_WIDE_DAILY = f"wide AS (SELECT data, {_pivot(PRIORITIES)} FROM daily GROUP BY data)"
_ALL_PRESENT = " AND ".join(f'"{p}" IS NOT NULL' for p in PRIORITIES)
_WIDE_COLUMNS = ", ".join(f'"{p}"' for p in PRIORITIES)
ORACLES["flt_dropna"] = _with(
    ["daily"],
    f"SELECT {_text()}, {_WIDE_COLUMNS}, 'all' AS rule FROM wide WHERE {_ALL_PRESENT} UNION ALL "
    f"SELECT {_text()}, {_WIDE_COLUMNS}, 'subset' AS rule FROM wide WHERE \"1-URGENT\" IS NOT NULL",
    _WIDE_DAILY,
)
ORACLES["flt_in_period"] = _with(
    ["survey_month", "period"],
    f"SELECT series_id, {_text('ref_date')}, count(*) AS n_rows, sum(mean) AS total FROM survey "
    "WHERE (series_id, ref_date) IN (SELECT (series_id, data) FROM period) GROUP BY series_id, survey.ref_date",
)

# joins
ORACLES["jn_left_nway"] = _with(
    ["daily"],
    f"SELECT CAST(a.data AS VARCHAR) AS data, "
    + ", ".join(
        f't{i}.value AS "{p}"' if i else f'a.value AS "{p}"' for i, p in enumerate(PRIORITIES)
    )
    + " FROM (SELECT * FROM daily WHERE series_id = '1-URGENT') a "
    + " ".join(
        f"LEFT JOIN (SELECT * FROM daily WHERE series_id = '{p}') t{i} ON t{i}.data = a.data"
        for i, p in enumerate(PRIORITIES)
        if i
    ),
)
_EIGHT = [(p, "daily") for p in PRIORITIES] + [(f, "shipped") for f in FLAGS]
ORACLES["jn_outer_nway"] = _with(
    ["daily", "shipped"],
    "SELECT CAST(data AS VARCHAR) AS data, "
    + ", ".join(f't{i}.value AS "{s}"' for i, (s, _) in enumerate(_EIGHT))
    + f" FROM (SELECT data, value FROM daily WHERE series_id = '{PRIORITIES[0]}') t0 "
    + " ".join(
        f"FULL JOIN (SELECT data, value FROM {t} WHERE series_id = '{s}') t{i} USING (data)"
        for i, (s, t) in enumerate(_EIGHT)
        if i
    ),
)
_BRANDS = (
    f"brands AS (SELECT concat(p_brand, ' ', p_size) AS series_id, {_month('l_shipdate')} AS data, "
    "sum(CAST(floor(l_extendedprice) AS DOUBLE)) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
)
ORACLES["jn_outer_many"] = _with([], f"SELECT {_text()}, series_id, value FROM brands", _BRANDS)
ORACLES["jn_left_many"] = _with(
    [],
    f"SELECT {_text()}, series_id, value FROM brands WHERE data IN "
    "(SELECT data FROM brands WHERE series_id = (SELECT min(series_id) FROM brands))",
    _BRANDS,
)
ORACLES["jn_left_monthlyised"] = _with(
    ["rates", "monthly"],
    "SELECT CAST(a.data AS VARCHAR) AS data, "
    + ", ".join(f'round_even(a."{f}", 6) AS "{f}"' for f in FLAGS)
    + ", "
    + ", ".join(f'round_even(m."{p}", 6) AS "{p}"' for p in PRIORITIES)
    + " FROM a LEFT JOIN m ON a.data = m.data",
    f"a AS (SELECT data, {_pivot(FLAGS)} FROM rates WHERE data <= {_before_end(6)} GROUP BY data)",
    f"m AS (SELECT data, {_pivot(PRIORITIES)} FROM monthly GROUP BY data)",
)
_ANNUAL_EXTENDED = (
    "target AS (SELECT 'target' AS series_id, s.data, "
    "(SELECT max_by(a.value, a.data) FROM annual a WHERE a.series_id = '5-LOW' AND a.data <= s.data) AS value "
    "FROM (SELECT CAST(unnest(generate_series(min(data), CAST(max(data) + INTERVAL 11 MONTH AS DATE), INTERVAL 1 MONTH)) AS DATE) "
    "AS data FROM annual WHERE series_id = '5-LOW') s)"
)
ORACLES["panel_monthly"] = _with(
    ["monthly", "smonthly", "annual", "survey_month"],
    f"SELECT {_text()}, {_pivot([*PRIORITIES, 'target', 'expected', *FLAGS], 6)} FROM ("
    "SELECT * FROM monthly WHERE series_id <> '1-URGENT' UNION ALL "
    "SELECT series_id, data, value FROM (SELECT *, row_number() OVER "
    "(PARTITION BY date_trunc('month', data) ORDER BY data) AS k FROM daily WHERE series_id = '1-URGENT') WHERE k = 1 "
    "UNION ALL SELECT * FROM target UNION ALL SELECT 'expected', ref_date, avg(mean) FROM survey "
    f"WHERE {_horizon('ref_date', 'survey_date', 30)} = 1 GROUP BY ref_date "
    "UNION ALL SELECT * FROM smonthly) GROUP BY data",
    _ANNUAL_EXTENDED,
)

# expectations
ORACLES["exp_by_ref_h1"] = _with(
    ["survey_month"],
    f"SELECT series_id, CAST(ref_date AS VARCHAR) AS data, {_r('avg(mean)', 'value')} FROM survey "
    f"WHERE {_horizon('ref_date', 'survey_date', 30)} = 1 GROUP BY series_id, ref_date",
)
ORACLES["exp_by_ref_h6"] = ORACLES["exp_by_ref_h1"].replace("= 1 GROUP", "= 6 GROUP")


def _by_survey(piece: str, unit: str, where: str = "TRUE") -> str:
    return _with(
        [piece],
        f"SELECT series_id, CAST(CAST(date_trunc('{unit}', survey_date) AS DATE) AS VARCHAR) AS data, "
        f"{_r('avg(mean)', 'value')} FROM survey WHERE {where} GROUP BY 1, 2",
    )


ORACLES["exp_by_survey_month_trunc"] = _by_survey(
    "survey_year", "month", f"{_horizon('ref_date', _month('survey_date'), 365)} = 1"
)
ORACLES["exp_by_survey_month_raw"] = _by_survey(
    "survey_year", "month", f"{_horizon('ref_date', 'survey_date', 365)} = 1"
)
ORACLES["exp_by_survey_quarter"] = _by_survey(
    "survey_quarter", "quarter", f"{_horizon('ref_date', 'survey_date', 30)} = 9"
)
ORACLES["exp_monthly_mean"] = _by_survey("survey_month", "month")

# grids and aggregates
ORACLES["rs_month_mean"] = _with(["monthly"], f"SELECT series_id, {_text()}, {_r('value')} FROM monthly")
ORACLES["rs_month_first"] = _with(
    ["daily"],
    f"SELECT series_id, {_text()}, value FROM (SELECT *, row_number() OVER "
    "(PARTITION BY series_id, date_trunc('month', data) ORDER BY data) AS k FROM daily) WHERE k = 1",
)
ORACLES["rs_month_last"] = _with(
    ["daily"],
    f"SELECT series_id, CAST({_month('data')} AS VARCHAR) AS data, value FROM (SELECT *, row_number() OVER "
    "(PARTITION BY series_id, date_trunc('month', data) ORDER BY data DESC) AS k FROM daily "
    "WHERE value % 3 <> 0) WHERE k = 1",
)


def _annual(extra: int) -> str:
    return _with(
        ["annual"],
        "SELECT s.series_id, CAST(s.data AS VARCHAR) AS data, a.value FROM (SELECT series_id, "
        "CAST(unnest(generate_series(min(data), CAST(max(data) + "
        f"to_months({extra}) AS DATE), INTERVAL 1 MONTH)) AS DATE) AS data FROM annual GROUP BY series_id) s "
        "ASOF JOIN annual a ON a.series_id = s.series_id AND s.data >= a.data",
    )


ORACLES["rs_annual_ffill"] = _annual(0)
ORACLES["rs_annual_extend"] = _annual(11)
ORACLES["agg_month_median"] = _with(
    ["monthly"],
    f"SELECT series_id, CAST(month(data) AS INTEGER) AS month, {_r('median(value)', 'value')} FROM monthly "
    "WHERE value IS NOT NULL GROUP BY 1, 2",
)
_COMPLETE = (
    "inside AS (SELECT asked.* FROM asked JOIN period ON asked.series_id = period.series_id "
    "AND asked.ref_date = period.data), "
    "latest AS (SELECT series_id, max(survey_date) AS survey_date FROM (SELECT series_id, survey_date "
    "FROM inside GROUP BY 1, 2 HAVING count(*) = 12) GROUP BY 1), "
    "chosen AS (SELECT inside.* FROM inside JOIN latest USING (series_id, survey_date))"
)
ORACLES["agg_latest_complete"] = _with(
    ["asked", "period"],
    f"SELECT series_id, {_text('survey_date')}, count(*) AS n_rows FROM chosen GROUP BY series_id, chosen.survey_date",
    _COMPLETE,
)
_HOLED = "mix AS (SELECT * FROM daily UNION ALL SELECT * FROM smonthly)"
_HOLED_GRID = _grid(
    "panel", "mix", "series_id", ["value"], CEIL_MIN, "date_trunc('month', max(data))", "panel"
)
ORACLES["agg_null_share"] = _with(
    ["monthly", "smonthly"],
    f"SELECT series_id, {_r('share', 'null_share')}, share < 0.2 AS kept FROM ("
    "SELECT series_id, count(*) FILTER (value IS NULL) / (SELECT count(*) FROM monthly "
    "WHERE series_id = '1-URGENT' AND value IS NOT NULL) AS share FROM panel GROUP BY 1)",
    _HOLED,
    _HOLED_GRID,
)
ORACLES["agg_distinct_list"] = _with(
    ["ahead"], "SELECT variavel, string_agg(DISTINCT tipo, ',' ORDER BY tipo) AS modelos FROM ahead GROUP BY 1"
)
_BOTH_DAILY = "mix AS (SELECT * FROM daily UNION ALL SELECT * FROM shipped)"
ORACLES["ts_asfreq_month"] = _with(
    ["daily", "shipped"], f"SELECT series_id, {_text()}, value FROM panel", _BOTH_DAILY, _HOLED_GRID
)
ORACLES["ts_forecast_period"] = _with(["period"], f"SELECT series_id, step, {_text()} FROM period")
ORACLES["ts_trunc"] = (
    "SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month, "
    "CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) AS VARCHAR) AS quarter, "
    "CAST(CAST(CASE WHEN day(o_orderdate) = 1 THEN o_orderdate ELSE date_trunc('month', o_orderdate) "
    "+ INTERVAL 1 MONTH END AS DATE) AS VARCHAR) AS next_month FROM orders"
)
_DAILY_GRID = _grid(
    "panel", "daily", "series_id", ["value"], CEIL_MIN, "date_trunc('month', max(data))", "panel"
)
ORACLES["win_bfill_ffill"] = _with(
    ["daily"],
    f"SELECT series_id, {_text()}, value FROM (SELECT series_id, data, {_fill('value', 'series_id')} FROM panel)",
    _DAILY_GRID,
)
_TWELVE = "PARTITION BY series_id ORDER BY data ROWS BETWEEN 11 PRECEDING AND CURRENT ROW"
ORACLES["win_compound12"] = _with(
    ["rates"],
    f"SELECT series_id, {_text()}, {_r('value')}, round_even(CASE WHEN count(value) OVER ({_TWELVE}) = 12 "
    f"THEN (product(value / 100 + 1) OVER ({_TWELVE}) - 1) * 100 END, 6) AS compound FROM rates",
)


def _code(code: str, value: str = "value") -> str:
    w = "(PARTITION BY series_id ORDER BY data)"
    v = value if code in "123" else f"CASE WHEN {value} > 0 THEN ln({value}) END"
    one, two = f"lag({v}) OVER {w}", f"lag({v}, 2) OVER {w}"
    if code in "14":
        return v
    return f"({v}) - ({one})" if code in "25" else f"({v}) - 2 * ({one}) + ({two})"


for _name, _c in (("tr_diff", "2"), ("tr_diff2", "3"), ("tr_log", "4"), ("tr_logdiff", "5"), ("tr_logdiff2", "6")):
    ORACLES[_name] = _with(["monthly"], f"SELECT series_id, {_text()}, {_r(_code(_c), 'value')} FROM monthly")
ORACLES["tr_by_catalog"] = _with(
    ["monthly", "rates"],
    f"SELECT series_id, {_text()}, round_even(CASE transform "
    + " ".join(f"WHEN '{c}' THEN {_code(c)}" for c in "123456")
    + " END, 6) AS value FROM (SELECT r.*, transform FROM (SELECT * FROM monthly UNION ALL SELECT * FROM rates) r "
    "LEFT JOIN catalog c ON r.series_id = c.series_id)",
    _catalog(),
)
ORACLES["srt_date"] = _with(["daily"], f"SELECT series_id, {_text()}, value FROM daily ORDER BY daily.data, series_id")
ORACLES["lim_last_n"] = _with(
    ["daily"],
    f"SELECT series_id, {_text()}, value FROM (SELECT *, row_number() OVER "
    "(PARTITION BY series_id ORDER BY data DESC) AS k FROM daily) WHERE k <= 240",
)
ORACLES["set_union"] = _with(
    ["daily", "happened"],
    f"SELECT series_id, {_text()}, value FROM (SELECT * FROM daily UNION ALL SELECT * FROM happened)",
)
ORACLES["set_union_missing"] = _with(
    ["daily", "rates"],
    f"SELECT series_id, {_text()}, {_r('value')}, {_r('rate')} FROM ("
    "SELECT series_id, data, value, CAST(NULL AS DOUBLE) AS rate FROM daily UNION ALL "
    "SELECT series_id, data, NULL, value FROM rates)",
)

# scalar functions
ORACLES["fn_date_parse"] = (
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS br, "
    "CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS code, "
    "CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month, "
    "CAST(CAST(date_trunc('year', o_orderdate) AS DATE) AS VARCHAR) AS year, "
    "CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) AS VARCHAR) AS quarter FROM orders"
)
ORACLES["fn_date_format"] = (
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%m/%Y') AS month_year, "
    "strftime(o_orderdate, '%d/%m/%Y') AS br, strftime(o_orderdate, '%Y-%m-01') AS first_day, "
    "monthname(o_orderdate) AS month_name, CAST(month(o_orderdate) AS INTEGER) AS month_no, "
    "CAST(year(o_orderdate) AS INTEGER) AS year_no FROM orders"
)
ORACLES["fn_numeric"] = (
    "SELECT l_orderkey, l_linenumber, round_even(CASE WHEN l_discount > 0 THEN ln(l_discount) END, 6) AS ln_discount, "
    "round_even(l_quantity / 8, 2) AS even, "
    f"{_horizon('CAST(l_shipdate AS DATE)', _day('1998-06-15'), 30)} AS h30, "
    f"{_horizon('CAST(l_shipdate AS DATE)', _day('1998-06-15'), 365)} AS h365, "
    "replace(l_returnflag, 'N', 'none') AS flag FROM lineitem"
)

# every row of a raw table as one series
_PLACE = " || ".join(
    f"lpad(CAST(CAST({p} AS BIGINT) AS VARCHAR), 12, '0')"
    for p in ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "floor(l_extendedprice)", "round(l_tax * 100)"]
)
ORACLES["win_long_diff2"] = (
    "SELECT 'lines' AS series_id, data, round_even(value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w, 6) AS value "
    f"FROM (SELECT {_PLACE} AS data, CAST(floor(l_extendedprice) AS DOUBLE) AS value FROM lineitem) WINDOW w AS (ORDER BY data)"
)
ORACLES["win_long_compound12"] = (
    "SELECT 'lines' AS series_id, data, round_even(value, 6) AS value, "
    "round_even(CASE WHEN count(value) OVER w = 12 THEN (product(value / 100 + 1) OVER w - 1) * 100 END, 6) AS compound "
    f"FROM (SELECT {_PLACE} AS data, CAST(round(l_tax * 100) AS DOUBLE) AS value FROM lineitem) "
    "WINDOW w AS (ORDER BY data ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
)
ORACLES["win_long_fill"] = (
    "SELECT 'events' AS series_id, data, round_even(coalesce("
    "first_value(value IGNORE NULLS) OVER (ORDER BY data ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
    "last_value(value IGNORE NULLS) OVER (ORDER BY data ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS value "
    "FROM (SELECT event_id AS data, CASE WHEN event_type = 'error' THEN value END AS value FROM events)"
)

# models
_DUMMIES = {
    "April": 4, "August": 8, "February": 2, "January": 1, "July": 7, "June": 6, "March": 3, "May": 5,
    "November": 11, "October": 10, "September": 9,
}
_DUMMY_SQL = ", ".join(f'CAST(month(data) = {k} AS INTEGER) AS "{n}"' for n, k in _DUMMIES.items())
ORACLES["mod_seasonal_dummies"] = _with(
    ["monthly"], f"SELECT series_id, CAST(data AS VARCHAR) AS data, {_DUMMY_SQL} FROM monthly"
).replace("month(data)", "month(monthly.data)")
ORACLES["mod_design_matrix"] = _with(
    ["frame", "design"],
    "SELECT target_id, CAST(data AS VARCHAR) AS data, "
    + ", ".join(_r(c) for c in ["y", "lag_1", *EXOG])
    + f", {_DUMMY_SQL.replace('month(data)', 'month(design.data)')} FROM design",
)


def _det(c1: tuple[str, ...], c2: tuple[str, ...], c3: tuple[str, ...]) -> str:
    (a, d, g), (b, e, h), (c, f, i) = c1, c2, c3
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _cramer() -> list[str]:
    """Solutions of the symmetric system a w = b, columns a11..a33 and b1..b3."""
    col = [("a11", "a12", "a13"), ("a12", "a22", "a23"), ("a13", "a23", "a33")]
    rhs = ("b1", "b2", "b3")
    full = _det(*col)
    return [_det(*[rhs if k == i else col[k] for k in range(3)]) + " / " + full for i in range(3)]


def _ridge(alpha: float = 1.0, name: str = "ridge") -> str:
    """Three centred features solved by determinants: lag (1), quantity (2), discount (3)."""
    x = ["lag_1", "quantity", "discount"]
    means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(x, 1))
    stats = ", ".join(
        f"sum((d.{x[i - 1]} - m{i}) * (d.{x[j - 1]} - m{j})){f' + {alpha}' if i == j else ''} AS a{i}{j}"
        for i in (1, 2, 3)
        for j in range(i, 4)
    )
    cross = ", ".join(f"sum((d.{x[i - 1]} - m{i}) * (d.y - my)) AS b{i}" for i in (1, 2, 3))

    w = _cramer()
    return (
        f"{name}_mean AS (SELECT target_id, count(*) AS n_rows, avg(y) AS my, {means} FROM design GROUP BY 1), "
        f"{name}_sum AS (SELECT d.target_id, {stats}, {cross} FROM design d JOIN {name}_mean m "
        "ON d.target_id = m.target_id GROUP BY 1), "
        f"{name}_w AS (SELECT target_id, {', '.join(f'{e} AS w{i}' for i, e in enumerate(w, 1))} FROM {name}_sum), "
        f"{name} AS (SELECT m.target_id, n_rows, my - w1 * m1 - w2 * m2 - w3 * m3 AS c, w1, w2, w3 "
        f"FROM {name}_mean m JOIN {name}_w w ON m.target_id = w.target_id)"
    )


def _weights(name: str, digits: int) -> str:
    return (
        f"SELECT target_id, n_rows, {_r('c', 'intercept', digits)}, {_r('w1', 'w_lag', digits)}, "
        f"{_r('w2', 'w_quantity', digits)}, {_r('w3', 'w_discount', digits)} FROM {name}"
    )


ORACLES["mod_ridge"] = _with(["frame", "design"], _weights("ridge", 4), _ridge())
_FITTED = "(m.c + m.w1 * d.lag_1 + m.w2 * d.quantity + m.w3 * d.discount)"


def _huber(rounds: int, epsilon: float = 1.35, alpha: float = 1e-4) -> list[str]:
    """Reweighted least squares from the ridge fit, unrolled.

    A round: absolute residuals, closed-form scale, weighted sums, weights. Converges
    linearly to the same minimum as any other method: the objective is convex.
    """
    x = ["lag_1", "quantity", "discount"]
    pairs = [(i, j) for i in (1, 2, 3) for j in range(i, 4)]
    sums = ["sum(w) AS sw", "sum(w * y) AS sy"]
    sums += [f"sum(w * {x[i - 1]}) AS s{i}, sum(w * {x[i - 1]} * y) AS sy{i}" for i in (1, 2, 3)]
    sums += [f"sum(w * {x[i - 1]} * {x[j - 1]}) AS s{i}{j}" for i, j in pairs]
    system = [
        f"s{i}{j} - s{i} * s{j} / sw{f' + {alpha}' if i == j else ''} AS a{i}{j}" for i, j in pairs
    ]
    system += [f"sy{i} - s{i} * sy / sw AS b{i}" for i in (1, 2, 3)]
    solved = ", ".join(f"{e} AS w{i}" for i, e in enumerate(_cramer(), 1))
    join = "FROM design d JOIN {} m ON m.target_id = d.target_id"
    resid = f"abs(d.y - {_FITTED})"
    parts = [
        f"fit0 AS MATERIALIZED (SELECT m.target_id, m.n_rows, m.c, m.w1, m.w2, m.w3, sqrt(avg({resid} ** 2)) AS s "
        f"{join.format('ridge')} GROUP BY ALL)"
    ]
    for k in range(1, rounds + 1):
        parts += [
            f"miss{k} AS MATERIALIZED (SELECT d.*, m.n_rows, {resid} AS e, {epsilon} * m.s AS lim "
            f"{join.format(f'fit{k - 1}')})",
            f"scale{k} AS MATERIALIZED (SELECT target_id, sqrt(sum(e * e) FILTER (e <= lim) / "
            f"(count(*) - count(*) FILTER (e > lim) * {epsilon * epsilon})) AS s FROM miss{k} GROUP BY 1)",
            f"sum{k} AS MATERIALIZED (SELECT target_id, n_rows, s, {', '.join(sums)} FROM (SELECT t.*, c.s, "
            f"least(1.0, {epsilon} * c.s / greatest(e, 1e-300)) / c.s AS w FROM miss{k} t "
            f"JOIN scale{k} c ON t.target_id = c.target_id) GROUP BY 1, 2, 3)",
            f"fit{k} AS MATERIALIZED (SELECT target_id, n_rows, (sy - w1 * s1 - w2 * s2 - w3 * s3) / sw AS c, "
            f"w1, w2, w3, s FROM (SELECT *, {solved} FROM (SELECT *, {', '.join(system)} FROM sum{k})))",
        ]
    return parts


ORACLES["mod_huber"] = _with(["frame", "design"], _weights("fit40", 2), _ridge(), *_huber(40))
# a proved fit: its rows, and the gradient of its objective vanishes
_PROVED = "count(*) AS n_rows, 1 AS converged, 1 AS stationary"
ORACLES["mod_ridge_proof"] = ORACLES["mod_huber_proof"] = _with(
    ["frame", "design"], f"SELECT target_id, {_PROVED} FROM design GROUP BY 1"
)
ORACLES["fc_published_proof"] = _with(
    ["frame", "design"],
    f"SELECT target_id, tipo, {_PROVED} FROM design, (VALUES ('Ridge'), ('Huber')) t(tipo) GROUP BY 1, 2",
)
ORACLES["mod_huber_rounds"] = f"SELECT l_returnflag AS flag, {_PROVED} FROM lineitem GROUP BY 1"
ORACLES["mod_residuals"] = _with(
    ["frame", "design"],
    f"SELECT d.target_id, CAST(d.data AS VARCHAR) AS data, {_r(f'd.y - {_FITTED}', 'resid', 4)} "
    "FROM design d JOIN ridge m ON d.target_id = m.target_id",
    _ridge(),
)

_LAMS = {"m1": -1.0, "zero": 0.0, "half": 0.5, "one": 1.0, "two": 2.0, "three": 3.0}


def _yj(v: str, lam: float) -> str:
    up = f"ln(1 + {v})" if lam == 0 else f"(pow({v} + 1, {lam}) - 1) / {lam}"
    down = f"-ln(1 - {v})" if lam == 2 else f"-(pow(1 - {v}, {2 - lam}) - 1) / {2 - lam}"
    return f"CASE WHEN {v} >= 0 THEN {up} ELSE {down} END"


def _yj_inverse(z: str, lam: float) -> str:
    up = f"exp({z}) - 1" if lam == 0 else f"pow({lam} * {z} + 1, 1 / {lam}) - 1"
    down = f"1 - exp(-{z})" if lam == 2 else f"1 - pow(1 - {2 - lam} * {z}, 1 / {2 - lam})"
    return f"CASE WHEN {z} >= 0 THEN {up} ELSE {down} END"


ORACLES["mod_yeo_johnson_apply"] = (
    "SELECT c_custkey, "
    + ", ".join(_r(_yj("v", x), n) for n, x in _LAMS.items())
    + " FROM (SELECT c_custkey, c_acctbal / 1000 AS v FROM customer)"
)
ORACLES["mod_yeo_johnson_inverse"] = (
    "SELECT c_custkey, "
    + ", ".join(_r(_yj_inverse("z", x), n) for n, x in _LAMS.items())
    + " FROM (SELECT c_custkey, c_acctbal / 20000 AS z FROM customer)"
)


_PSI = "CASE WHEN l.lam = 0 THEN ln(1 + f.quantity) ELSE (pow(f.quantity + 1, l.lam) - 1) / l.lam END"


def _lambda_round(name: str, before: str, step: float) -> str:
    lam = "r.lam + g.k * CAST({s} AS DOUBLE)".replace("{s}", repr(step))
    return (
        f"{name} AS (SELECT target_id, max_by(lam, loglik) AS lam FROM (SELECT f.target_id, l.lam, "
        f"-count(*) / 2 * ln(var_pop({_PSI})) + (l.lam - 1) * sum(ln(1 + f.quantity)) AS loglik "
        f"FROM frame f JOIN (SELECT r.target_id, {lam} AS lam FROM {before} r, "
        "(SELECT unnest(generate_series(-10, 10)) AS k) g) l ON f.target_id = l.target_id "
        "GROUP BY 1, 2) GROUP BY 1)"
    )


ORACLES["mod_yeo_johnson_lambda"] = _with(
    ["frame"],
    f"SELECT f.target_id, {_r('l.lam', 'lam', 4)}, {_r(f'avg({_PSI})', 'mu', 4)}, "
    f"{_r(f'stddev_pop({_PSI})', 'sd', 4)} FROM frame f JOIN r4 l ON f.target_id = l.target_id GROUP BY 1, l.lam",
    "r0 AS (SELECT DISTINCT target_id, CAST(0 AS DOUBLE) AS lam FROM frame)",
    _lambda_round("r1", "r0", 0.5),
    _lambda_round("r2", "r1", 0.05),
    _lambda_round("r3", "r2", 0.005),
    _lambda_round("r4", "r3", 0.0005),
)

# both signs: values, exponents and likelihoods of several columns at once
_COLUMNS = ["quantity", "discount", "tax"]
_SIGNED = "signed AS (" + " UNION ALL ".join(
    f"SELECT target_id, data, '{c}' AS part, {c}{f' - {BALANCE}' if c == 'quantity' else ''} AS v FROM frame"
    for c in _COLUMNS
) + ")"
_PSI_SIGNED = (
    "CASE WHEN f.v >= 0 THEN CASE WHEN l.lam = 0 THEN ln(1 + f.v) ELSE (pow(f.v + 1, l.lam) - 1) / l.lam END "
    "ELSE CASE WHEN l.lam = 2 THEN -ln(1 - f.v) ELSE -(pow(1 - f.v, 2 - l.lam) - 1) / (2 - l.lam) END END"
)


def _signed_round(name: str, before: str, step: float) -> str:
    return (
        f"{name} AS (SELECT target_id, part, max_by(lam, loglik) AS lam FROM (SELECT f.target_id, f.part, l.lam, "
        f"-count(*) / 2 * ln(var_pop({_PSI_SIGNED})) + (l.lam - 1) * sum(sign(f.v) * ln(1 + abs(f.v))) AS loglik "
        f"FROM signed f JOIN (SELECT r.target_id, r.part, r.lam + g.k * CAST({step!r} AS DOUBLE) AS lam FROM {before} r, "
        "(SELECT unnest(generate_series(-10, 10)) AS k) g) l ON f.target_id = l.target_id AND f.part = l.part "
        "GROUP BY 1, 2, 3) GROUP BY 1, 2)"
    )


_SEARCHED = [
    _SIGNED,
    "r0 AS (SELECT DISTINCT target_id, part, CAST(0 AS DOUBLE) AS lam FROM signed)",
    *[_signed_round(f"r{i + 1}", f"r{i}", step) for i, step in enumerate((0.5, 0.05, 0.005, 0.0005))],
    f"params AS (SELECT f.target_id, f.part, l.lam, avg({_PSI_SIGNED}) AS mu, stddev_pop({_PSI_SIGNED}) AS sd "
    "FROM signed f JOIN r4 l ON f.target_id = l.target_id AND f.part = l.part GROUP BY 1, 2, 3)",
]
ORACLES["mod_yeo_johnson_signed"] = _with(
    ["frame"],
    f"SELECT target_id, {_r('lam', digits=4)}, {_r('mu', digits=4)}, {_r('sd', digits=4)} FROM params WHERE part = 'quantity'",
    *_SEARCHED,
)
ORACLES["mod_frame_params"] = _with(
    ["frame"],
    "SELECT target_id, "
    + ", ".join(
        f"round_even(max(CASE WHEN part = '{c}' THEN {p} END), 4) AS {c}_{p}" for c in _COLUMNS for p in ("lam", "mu", "sd")
    )
    + " FROM params GROUP BY 1",
    *_SEARCHED,
)
ORACLES["mod_frame_apply"] = _with(
    ["frame"],
    "SELECT target_id, CAST(data AS VARCHAR) AS data, "
    + ", ".join(f"round_even(max(CASE WHEN part = '{c}' THEN z END), 4) AS {c}" for c in _COLUMNS)
    + f" FROM (SELECT f.target_id, f.data, f.part, ({_PSI_SIGNED} - l.mu) / l.sd AS z FROM signed f "
    "JOIN params l ON f.target_id = l.target_id AND f.part = l.part) GROUP BY 1, 2",
    *_SEARCHED,
)

# scenarios
ORACLES["scn_survey"] = _with(
    ["asked", "period"],
    f"SELECT series_id, CAST(ref_date AS VARCHAR) AS data, {_r('median', 'value')} FROM chosen",
    _COMPLETE,
)
_COMPLETE_LAST = _COMPLETE.replace("= 12)", "= 13)").replace("JOIN period ON", "JOIN span ON").replace(
    "asked.series_id = period.series_id AND asked.ref_date = period.data",
    "asked.series_id = span.series_id AND asked.ref_date = span.data",
)
_SPAN = "span AS (SELECT series_id, data FROM period UNION ALL SELECT series_id, last FROM last_seen)"
_PRICE = (
    "price AS (SELECT * FROM (SELECT series_id, ref_date AS data, ln(median) - lag(ln(median)) OVER "
    "(PARTITION BY series_id ORDER BY ref_date) AS value FROM chosen) WHERE value IS NOT NULL)"
)
ORACLES["scn_survey_transformed"] = _with(
    ["asked", "period"],
    f"SELECT series_id, {_text()}, {_r('value')} FROM price",
    _SPAN,
    _COMPLETE_LAST,
    _PRICE,
)
_SEASONAL = (
    "medians AS (SELECT series_id, month(data) AS month, median(value) AS value FROM smonthly "
    "WHERE value IS NOT NULL GROUP BY 1, 2), "
    "seasonal AS (SELECT coalesce(m.series_id, p.series_id) AS series_id, "
    "CAST(coalesce(m.month, month(p.data)) AS INTEGER) AS month, m.value, p.data FROM medians m "
    "FULL JOIN period p ON m.series_id = p.series_id AND m.month = month(p.data))"
)
ORACLES["scn_seasonal_median"] = _with(
    ["smonthly", "period"],
    f"SELECT series_id, month, {_r('value')}, {_text()} FROM seasonal",
    _SEASONAL,
)
_ASSEMBLED = (
    "long AS (SELECT 'expected' AS name, series_id, ref_date AS data, median AS value FROM chosen12 "
    "UNION ALL SELECT 'price', series_id, data, value FROM price "
    "UNION ALL SELECT 'shipped', series_id, data, value FROM seasonal WHERE data IS NOT NULL), "
    "wide AS (SELECT series_id AS target_id, data, "
    "max(CASE WHEN name = 'expected' THEN value END) AS expected, "
    "max(CASE WHEN name = 'price' THEN value END) AS price, "
    "max(CASE WHEN name = 'shipped' THEN value END) AS shipped FROM long GROUP BY 1, 2)"
)
_COMPLETE_TWELVE = (
    _COMPLETE.replace("inside", "inside12").replace("latest", "latest12").replace("chosen", "chosen12")
)
ORACLES["scn_assemble"] = _with(
    ["asked", "period", "smonthly"],
    "SELECT target_id, CAST(data AS VARCHAR) AS data, "
    + ", ".join(_r(c) for c in ("expected", "price", "shipped"))
    + f", {_DUMMY_SQL.replace('month(data)', 'month(panel.data)')} FROM panel",
    _COMPLETE_TWELVE,
    _SPAN,
    _COMPLETE_LAST,
    _PRICE,
    _SEASONAL,
    _ASSEMBLED,
    _grid("panel", "wide", "target_id", ["expected", "price", "shipped"], "min(data)", "max(data)", "series"),
)

# forecasts
_SUPPLIER_SCENARIO = (
    "mseason AS (SELECT target_id, month(data) AS month, median(quantity) AS quantity, "
    "median(discount) AS discount FROM frame GROUP BY 1, 2), "
    "origin AS (SELECT target_id, max(data) AS last, max_by(y, data) AS start FROM frame GROUP BY 1), "
    "future AS (SELECT o.target_id, CAST(step AS INTEGER) AS step, "
    "CAST(last + to_months(CAST(step AS INTEGER)) AS DATE) AS data, start "
    "FROM origin o, generate_series(1, 12) AS g(step)), "
    "drives AS (SELECT f.target_id, f.step, f.data, f.start, m.w1 AS phi, "
    "m.c + m.w2 * s.quantity + m.w3 * s.discount AS drive FROM future f "
    "JOIN mseason s ON s.target_id = f.target_id AND s.month = month(f.data) "
    "JOIN ridge m ON m.target_id = f.target_id)"
)
_PATH = (
    "path AS (SELECT target_id, step, data, drive + phi * start AS z FROM drives WHERE step = 1 UNION ALL "
    "SELECT d.target_id, d.step, d.data, d.drive + d.phi * p.z FROM path p JOIN drives d "
    "ON d.target_id = p.target_id AND d.step = p.step + 1)"
)
ORACLES["fc_recursive"] = _with(
    ["frame", "design"],
    f"SELECT target_id, step, {_text()}, {_r('z', 'valor', 3)} FROM path",
    _ridge(),
    _SUPPLIER_SCENARIO,
    _PATH,
    recursive=True,
)


def _bootstrap(n_boot: int, seed: int = 1984, h: int = 12) -> str:
    """Resampled paths; the draw is the integer mix spelled out in SQL."""
    p = 2147483647
    mix = f"(boot * {h} + step + {seed} * 1000003) % {p}"
    mix = f"({mix}) * 48271 % {p}"
    mix = f"(u * u + 12345) % {p} AS u FROM (SELECT boot, step, {mix} AS u FROM cellno)"
    return (
        f"cellno AS (SELECT CAST(boot AS BIGINT) AS boot, CAST(step AS BIGINT) AS step "
        f"FROM generate_series(0, {n_boot - 1}) AS b(boot), generate_series(1, {h}) AS s(step)), "
        f"mix1 AS (SELECT boot, step, {mix}), "
        f"mix2 AS (SELECT boot, step, u * 69621 % {p} AS u FROM mix1), "
        f"mix3 AS (SELECT boot, step, (u * u + 777) % {p} AS u FROM mix2), "
        f"draws AS (SELECT boot, step, u * 48271 % {p} AS u FROM mix3), "
        f"resid AS (SELECT d.target_id, list(d.y - {_FITTED} ORDER BY d.data) AS e, count(*) AS n "
        "FROM design d JOIN ridge m ON d.target_id = m.target_id GROUP BY 1), "
        "shocks AS (SELECT d.target_id, r.boot, d.step, d.phi, d.drive + e[(u % n) + 1] AS drive, d.start "
        "FROM drives d JOIN resid x ON x.target_id = d.target_id JOIN draws r ON r.step = d.step), "
        "paths AS (SELECT target_id, boot, step, drive + phi * start AS z FROM shocks WHERE step = 1 UNION ALL "
        "SELECT s.target_id, s.boot, s.step, s.drive + s.phi * p.z FROM paths p JOIN shocks s "
        "ON s.target_id = p.target_id AND s.boot = p.boot AND s.step = p.step + 1), "
        f"bounds AS (SELECT target_id, step, quantile_cont({_yj_inverse('z', 0.5)}, [0.05, 0.95]) AS q, "
        f"count({_yj_inverse('z', 0.5)}) AS n_paths "
        "FROM paths GROUP BY 1, 2)"
    )


_POINT = _yj_inverse("a.z", 0.5)


def _interval(more: str = "") -> str:
    return _with(
        ["frame_half", "design"],
        f"SELECT a.target_id, a.step, CAST(a.data AS VARCHAR) AS data, {_r('q[1]', 'ic_inferior', 2)}, "
        f"{_r('q[2]', 'ic_superior', 2)}, {_r(_POINT, 'valor', 2)}{more} FROM path a JOIN bounds b "
        "ON a.target_id = b.target_id AND a.step = b.step",
        _ridge(),
        _SUPPLIER_SCENARIO,
        _PATH,
        _bootstrap(5000),
        recursive=True,
    )


ORACLES["fc_bootstrap_interval"] = _interval()
ORACLES["fc_bootstrap_dealt"] = _interval(", b.n_paths")


def _forecast_rows(alpha: float, label: str) -> str:
    inner = _with(
        ["frame_half", "design"],
        f"SELECT CAST(a.data AS VARCHAR) AS data, {_r(_POINT, 'valor', 2)}, {_r('q[1]', 'ic_inferior', 2)}, "
        f"{_r('q[2]', 'ic_superior', 2)}, CAST(a.target_id AS VARCHAR) AS variavel, '{label}' AS tipo, "
        "'2001-12-03 15:35:45' AS previsao FROM path a JOIN bounds b "
        "ON a.target_id = b.target_id AND a.step = b.step",
        _ridge(alpha),
        _SUPPLIER_SCENARIO,
        _PATH,
        _bootstrap(5000),
        recursive=True,
    )
    return f"SELECT * FROM ({inner})"


ORACLES["fc_table"] = f"{_forecast_rows(1.0, 'Ridge')} UNION ALL {_forecast_rows(10.0, 'Ridge10')}"

# serving
ORACLES["serve_history_union"] = _with(
    ["served"],
    f"SELECT variavel, {_text()}, {_r('valor')}, tipo, {_r('ic_inferior')}, {_r('ic_superior')} FROM served",
)
ORACLES["serve_tracking"] = _with(
    ["ahead"],
    'SELECT a.variavel AS "Variável", \'2000-10-03\' AS "Data de Previsão", '
    'CAST(a.data AS VARCHAR) AS "Horizonte da Previsão", tipo AS "Modelo", '
    'round_even(o.value, 2) AS "Observado", round_even(valor, 2) AS "Previsto", '
    'round_even(o.value - valor, 2) AS "Erro de Previsão" FROM ahead a LEFT JOIN '
    f"(SELECT * FROM rates WHERE data <= {_before_end(6)}) o ON o.series_id = a.variavel AND o.data = a.data",
)
ORACLES["serve_forecast_year"] = _with(["years"], "SELECT variavel, tipo, ano FROM years")
ORACLES["serve_yoy"] = _with(
    ["years"],
    "SELECT variavel, tipo, ano, round_even(CASE WHEN count(valor) = 12 "
    "THEN (product(valor / 100 + 1) - 1) * 100 END, 2) AS valor_yoy FROM ("
    "SELECT * FROM (SELECT y.variavel, y.tipo, y.ano, s.data, s.valor, row_number() OVER "
    "(PARTITION BY y.variavel, y.tipo, s.data ORDER BY s.tipo = 'Histórico' DESC) AS k "
    "FROM years y JOIN served s ON s.variavel = y.variavel AND s.tipo IN (y.tipo, 'Histórico') "
    "AND year(s.data) = y.ano) WHERE k = 1) GROUP BY 1, 2, 3",
)
ORACLES["serve_next_mom"] = _with(
    ["served"],
    f"SELECT variavel, tipo, {_text()}, {_r('valor', 'valor', 2)} FROM (SELECT *, min(data) OVER "
    "(PARTITION BY variavel, tipo) AS lo FROM served WHERE tipo <> 'Histórico') t WHERE t.data = lo",
)
ORACLES["serve_last"] = _with(
    ["served"],
    f"SELECT variavel, {_text()}, {_r('valor', 'valor', 2)} FROM (SELECT *, max(data) OVER "
    "(PARTITION BY variavel) AS hi FROM served WHERE tipo = 'Histórico') t WHERE t.data = hi",
)
_FAN = (
    "fan AS (SELECT s.variavel, m.tipo AS modelo, s.data AS d, strftime(s.data, '%Y-%m-%d') AS data, "
    "round_even(s.valor, 2) AS valor, replace(s.tipo, 'Histórico', s.variavel) AS tipo, "
    "round_even(s.ic_inferior, 2) AS ic_inferior, round_even(s.ic_superior, 2) AS ic_superior, "
    "row_number() OVER (PARTITION BY s.variavel, m.tipo ORDER BY s.data DESC) AS k FROM served s "
    "JOIN (SELECT DISTINCT variavel, tipo FROM ahead) m ON s.variavel = m.variavel "
    "AND s.tipo IN (m.tipo, 'Histórico'))"
)
ORACLES["serve_fanchart"] = _with(
    ["served"],
    "SELECT variavel, modelo, data, valor, tipo, ic_inferior, ic_superior FROM fan WHERE k <= 240",
    _FAN,
)
ORACLES["serve_fantable"] = _with(
    ["served"],
    "SELECT variavel, modelo, strftime(d, '%m/%Y') AS \"Data\", ic_inferior AS \"IC Inferior\", "
    'valor AS "Previsão (%)", ic_superior AS "IC Superior" FROM fan '
    "WHERE ic_inferior IS NOT NULL AND ic_superior IS NOT NULL",
    _FAN,
)

_YOY, _NEXT, _LAST = (ORACLES[n] for n in ("serve_yoy", "serve_next_mom", "serve_last"))
ORACLES["serve_cards"] = (
    f"SELECT variavel, tipo, 'Previsão ' || ano AS titulo, CAST(valor_yoy AS VARCHAR) || '%' AS texto, "
    f"'YoY' AS medida FROM ({_YOY}) UNION ALL "
    f"SELECT variavel, tipo, 'Previsão ' || strftime(CAST(data AS DATE), '%m/%Y'), "
    f"CAST(valor AS VARCHAR) || '%', 'MoM' FROM ({_NEXT}) UNION ALL "
    f"SELECT variavel, 'Histórico', 'Realizado ' || strftime(CAST(data AS DATE), '%m/%Y'), "
    f"CAST(valor AS VARCHAR) || '%', 'MoM' FROM ({_LAST})"
)
