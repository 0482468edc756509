"""Free text to typed values: names, dates, amounts, status."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticemill.schemas import CATEGORIES

# Legal suffixes removed from vendor names.
VENDOR_SUFFIXES = (
    "inc", "llc", "ltd", "corp", "corporation", "company", "co",
    "group", "holdings", "plc", "lp", "llp",
)

# Accepted date shapes. One pattern with optional parts reads them all; the shape is
# tested first, so text of any other shape is never parsed.
DATE_SHAPE = (
    r"^(\d{4}-\d{1,2}-\d{1,2}(T\d{1,2}:\d{1,2}:\d{1,2}Z?)?"
    r"|\d{1,2}/\d{1,2}/\d{4}"
    r"|\d{1,2}-\d{1,2}-\d{4}"
    r"|\p{L}+ \d{1,2}, \d{4})$"
)
DATE_PATTERN = (
    "[yyyy-M-d'T'H:m:s'Z'][yyyy-M-d'T'H:m:s][yyyy-M-d]"
    "[M/d/yyyy][M-d-yyyy][MMMM d, yyyy][MMM d, yyyy]"
)

# Words that decide the status, tried in this order.
STATUS_WORDS = (
    ("awarded", ("award",)),
    ("closed", ("closed", "expired", "past due")),
    ("cancelled", ("cancelled", "canceled")),
    ("open", ("open", "active", "accepting")),
)

_SPACE = r"(?U)[\s\x1c-\x1f]+"
# The characters that count as white space at the ends of a text.
_ENDS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def first_filled(*values: Column) -> Column:
    """First value that is neither null nor the empty string; a blank is kept."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def strip(value: Column | str) -> Column:
    """The text without white space at its ends."""
    return F.btrim(_col(value), F.lit(_ENDS))


def collapse_space(value: Column | str) -> Column:
    """Every run of white space becomes one blank; ends are stripped."""
    return F.trim(F.regexp_replace(_col(value), _SPACE, " "))


def normalize_vendor_name(value: Column | str) -> Column:
    """Lower-case name without legal suffixes; null when nothing is left."""
    suffix = r"(?iU)\b(" + "|".join(VENDOR_SUFFIXES) + r")\b\.?"
    return F.nullif(
        F.lower(collapse_space(F.regexp_replace(_col(value), suffix, ""))), F.lit("")
    )


def parse_date(value: Column | str) -> Column:
    """Timestamp from one of the accepted shapes, else null."""
    # nullif keeps its input in a step of its own, so the text is put in shape once
    shaped = F.nullif(F.regexp_extract(collapse_space(value), DATE_SHAPE, 0), F.lit(""))
    return F.try_to_timestamp(shaped, F.lit(DATE_PATTERN))


def parse_currency(value: Column | str) -> Column:
    """Amount as double: everything but digits, point and minus is dropped first."""
    return F.regexp_replace(_col(value), r"[^\d.\-]", "").try_cast("double")


def status_from_text(text: Column, word_boundary: bool = False) -> Column:
    """Status from lower-cased text; ``word_boundary`` asks for words that start there."""
    status = None
    for label, words in STATUS_WORDS:
        if word_boundary:
            hit = text.rlike(r"(?U)\b(" + "|".join(words) + ")")
        else:
            hit = reduce(Column.__or__, [text.contains(word) for word in words])
        status = F.when(hit, label) if status is None else status.when(hit, label)
    return status.otherwise("unknown")


def infer_status(extracted: Column | str, word_boundary: bool = False) -> Column:
    """Status from all values of the extracted map, joined in map order."""
    text = F.lower(F.array_join(F.map_values(_col(extracted)), " ", "None"))
    return status_from_text(text, word_boundary)


def coerce_category(label: Column | str) -> Column:
    """A label outside the allowed set becomes ``other``."""
    label = _col(label)
    return F.when(label.isin(*CATEGORIES), label).otherwise("other")


def map_first_filled(extracted: Column, keys: Sequence[str]) -> Column:
    """First filled value among the given map keys."""
    return first_filled(*[F.try_element_at(extracted, F.lit(k)) for k in keys])


def map_text(extracted: Column, key: str) -> Column:
    """Map value, ``""`` when the key is missing or null."""
    return F.coalesce(F.try_element_at(extracted, F.lit(key)), F.lit(""))
