"""Column functions for times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted formats of exported messages.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy, HH:mm", "dd/MM/yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss")
#: Greek day names from Monday, month names in the genitive.
DAYS = ("Δευτέρα", "Τρίτη", "Τετάρτη", "Πέμπτη", "Παρασκευή", "Σάββατο", "Κυριακή")
MONTHS = (
    "Ιανουαρίου", "Φεβρουαρίου", "Μαρτίου", "Απριλίου", "Μαΐου", "Ιουνίου",
    "Ιουλίου", "Αυγούστου", "Σεπτεμβρίου", "Οκτωβρίου", "Νοεμβρίου", "Δεκεμβρίου",
)


def parse_time(text: Column) -> Column:
    """Timestamp of a string in one of FORMATS; null for anything else."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in FORMATS), F.try_to_timestamp(text))


def epoch_time(value: Column) -> Column:
    """Timestamp of epoch seconds, or of milliseconds beyond 1e12."""
    return F.when(value > 10**12, F.timestamp_millis(value.cast("long"))).otherwise(F.timestamp_seconds(value))


def iso_time(text: Column) -> Column:
    """ISO text of a parsed time; what does not parse stays as it is."""
    return F.coalesce(F.date_format(parse_time(text), "yyyy-MM-dd'T'HH:mm:ssXXX"), text)


def seconds_between(earlier: Column, later: Column) -> Column:
    """Whole seconds (both ends floored)."""
    return F.unix_timestamp(later) - F.unix_timestamp(earlier)


def greek_date(when: Column) -> Column:
    day = F.element_at(F.array(*map(F.lit, DAYS)), F.weekday(when) + 1)
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(when))
    return F.concat_ws(" ", day, F.dayofmonth(when).cast("string"), month)


def time_decay(occurs_at: Column, now: Column) -> Column:
    """Relevance by nearness: none 1, past 0.2, within an hour 1.5, 8 hours 1, a day 0.7, later 0.3."""
    left = (occurs_at.cast("timestamp").cast("double") - now.cast("timestamp").cast("double"))
    return (
        F.when(occurs_at.isNull(), 1.0).when(left < 0, 0.2).when(left <= 3600, 1.5)
        .when(left <= 8 * 3600, 1.0).when(left <= 86400, 0.7).otherwise(0.3)
    )
