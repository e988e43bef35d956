"""Reading dates out of text with a fixed list of formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The accepted spellings: shape and format. The shape test keeps other texts away from the parser.
DATE_FORMATS = [
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{4}-\d{2}$", "yyyy-MM"),
    (r"^\d{4}$", "yyyy"),
]
# ISO texts with fractions or an offset go through the plain cast.
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"


def parse_date(c: Column) -> Column:
    """Text as timestamp, null when no accepted spelling fits."""
    # Only short texts with a digit are tried, so free text costs one cheap test.
    t = F.when((F.length(F.trim(c)) <= 40) & c.rlike(r"\d"), F.trim(c))
    tries = [F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(f))) for shape, f in DATE_FORMATS]
    return F.coalesce(*tries, F.when(t.rlike(ISO_SHAPE), t.try_cast("timestamp")))


def looks_like_date(c: Column) -> Column:
    return parse_date(c).isNotNull()
