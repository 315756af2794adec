"""Readers over landed files and the table writers."""

from tidegauge.sources.payloads import (  # noqa: F401
    read_csv_wide,
    read_decimal_comma,
    read_json_array,
    read_json_nested,
    read_json_sentinel,
    read_survey,
)
from tidegauge.sources.sinks import (  # noqa: F401
    append_tracking,
    write_forecast,
    write_long,
    write_wide,
)
from tidegauge.sources.tables import (  # noqa: F401
    backfill_windows,
    read_catalog,
    read_panel,
    read_tracking,
    route_by_freq,
)
