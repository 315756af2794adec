"""Number expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(text: Column) -> Column:
    """Untrusted text to DOUBLE: NULL where it is no number, never NaN."""
    parsed = text.try_cast("double")
    return F.nanvl(parsed, F.lit(None).cast("double"))


def strict_double(text: Column, missing: Sequence[str] = ()) -> Column:
    """Text to DOUBLE; NULL for empty text, NaN and the texts in ``missing``.

    Any other text that is no number fails the job. The guard stands around the cast, so the
    order in which filters run does not matter.
    """
    blank = text.isNull() | (F.trim(text) == "") | text.isin(*missing) if missing else text.isNull() | (F.trim(text) == "")
    bad = F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double")
    parsed = text.try_cast("double")
    value = F.when(parsed.isNull(), bad).otherwise(F.nanvl(parsed, F.lit(None).cast("double")))
    return F.when(blank, F.lit(None).cast("double")).otherwise(value)


def decimal_comma(text: Column) -> Column:
    """``1,5`` to 1.5; text that is no number then fails the job."""
    return strict_double(F.replace(text, F.lit(","), F.lit(".")))


def safe_ln(value: Column) -> Column:
    """Natural log, NULL where it is undefined."""
    return F.when(value > 0, F.ln(value))


def round_even(value: Column, digits: int = 2) -> Column:
    """Round half to even on the scaled value."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)
