"""Documents and tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticemill.functions.parsing import strip

TOKEN = r"[\p{L}\p{N}_]{2,}"


def document_text(fields: Sequence[str] = ("title", "description")) -> Column:
    """The fields joined by one blank, ends stripped; null counts as empty."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    return strip(F.concat_ws(" ", *parts))


def tokens(text: Column | str) -> Column:
    """Lower-cased words of two characters or more, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
