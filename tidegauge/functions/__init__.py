"""Column expressions: dates, numbers and the power transform."""

from tidegauge.functions.dates import (  # noqa: F401
    ceil_month,
    english_month,
    horizon,
    month_dummies,
    month_start,
    parse_date,
    parse_quarter,
    quarter_start,
    utc_date,
)
from tidegauge.functions.numeric import (  # noqa: F401
    decimal_comma,
    round_even,
    safe_ln,
    strict_double,
    to_double,
)
