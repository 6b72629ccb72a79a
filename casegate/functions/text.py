"""Text forms used by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hms(seconds: Column) -> Column:
    """``D days, H:MM:SS``, without the days below one day; fractions are cut off."""
    whole = seconds.cast("long")
    days = F.floor(whole / 86400)
    clock = F.format_string(
        "%d:%02d:%02d",
        F.floor(F.pmod(whole, F.lit(86400)) / 3600),
        F.floor(F.pmod(whole, F.lit(3600)) / 60),
        F.pmod(whole, F.lit(60)),
    )
    return F.when(days > 0, F.concat(F.format_string("%d days, ", days), clock)).otherwise(clock)


def percent(share: Column, digits: int = 2) -> Column:
    """``12.5 %`` of a share between 0 and 1."""
    return F.concat(F.round(share * 100, digits).cast("string"), F.lit(" %"))


def trimmed_list(text: Column) -> Column:
    """``"a, b"`` to ``["a", "b"]``."""
    return F.transform(F.split(text, ","), lambda part: F.trim(part))


def arrow_text(sequence: Column) -> Column:
    """Activities of a sequence joined by arrows."""
    return F.array_join(sequence, " -> ")
