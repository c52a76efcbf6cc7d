"""Error texts: presence, grouping, hinted waits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablegauge import fixed_values as fv


def has_error(error: Column) -> Column:
    return F.coalesce(error != "", F.lit(False))


def error_text(kind: Column, message: Column) -> Column:
    """Error as recorded in a run: type and the first 300 characters of the message."""
    return F.when(kind.isNotNull(), F.concat(kind, F.lit(": "), F.left(F.coalesce(message, F.lit("")), F.lit(300))))


def error_kind(error: Column) -> Column:
    """Group of an error; ungrouped errors keep the text before the first colon, at most 40 characters."""
    kind = F.when(~has_error(error), F.lit(None).cast("string"))
    for name, fragments in fv.ERROR_GROUPS:
        hit = F.contains(error, F.lit(fragments[0]))
        for fragment in fragments[1:]:
            hit = hit | F.contains(error, F.lit(fragment))
        kind = kind.when(hit, F.lit(name))
    return kind.otherwise(F.left(F.substring_index(error, ":", 1), F.lit(40)))


def is_rate_limited(error: Column) -> Column:
    return F.coalesce(F.contains(error, F.lit("RateLimitError")), F.lit(False))


def retry_wait(error: Column, attempt: Column) -> Column:
    """Seconds to wait after a rate-limited attempt: the hint (two seconds without one),
    at most twenty, plus one, plus the attempt number."""
    amount = F.nullif(F.regexp_extract(error, fv.RETRY_HINT_PATTERN, 1), F.lit("")).try_cast("double")
    unit = F.regexp_extract(error, fv.RETRY_HINT_PATTERN, 2)
    hint = F.when(unit == "ms", amount / 1000).otherwise(amount)
    return F.least(F.coalesce(hint, F.lit(2.0)), F.lit(20.0)) + 1.0 + attempt


def completion(text: Column, error: Column) -> Column:
    """Reply shown for a run: its text, else the marked error, else nothing."""
    return F.coalesce(F.nullif(text, F.lit("")),
                      F.when(has_error(error), F.concat(F.lit("[ERROR] "), error)), F.lit(""))
