"""Record ids and content hashes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that have no printable form of their own (the blank has), by the JVM's Unicode
# tables: characters newer than those count as unprintable.
_UNPRINTABLE = r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ ]]"
_SPECIAL = r"['\\]|" + _UNPRINTABLE


def _escape_unprintable(text: Column) -> Column:
    def one(char: Column) -> Column:
        code = F.ascii(char)
        escaped = (
            F.when(code < 0x100, F.format_string("\\x%02x", code))
            .when(code < 0x10000, F.format_string("\\u%04x", code))
            .otherwise(F.format_string("\\U%08x", code))
        )
        return F.when(char.rlike(_UNPRINTABLE), escaped).otherwise(char)

    # split into characters only where something needs escaping
    return F.when(
        text.rlike(_UNPRINTABLE), F.array_join(F.transform(F.split(text, ""), one), "")
    ).otherwise(text)


def _escaped(text: Column) -> Column:
    body = text
    for raw, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(escaped))
    double = text.contains("'") & ~text.contains('"')
    literal = F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )
    return _escape_unprintable(literal)


def quoted(text: Column) -> Column:
    """Text as a quoted literal, ``None`` for null.

    Only text that needs it is escaped, and in a lambda, which keeps the common path short.
    """
    escaped = F.get(F.transform(F.array(text), _escaped), F.lit(0))
    plain = F.concat(F.lit("'"), text, F.lit("'"))
    return F.coalesce(F.when(text.rlike(_SPECIAL), escaped).otherwise(plain), F.lit("None"))


def _pair(key: Column, value: Column) -> Column:
    return F.concat(F.lit("("), key, F.lit(", "), value, F.lit(")"))


def content_text(extracted: Column | str | Mapping[str, Column]) -> Column:
    """The entries, sorted by key, written as a list of quoted pairs.

    Takes a map column, or the columns by key where the keys are known.
    """
    if isinstance(extracted, Mapping):
        pairs = [_pair(F.lit(repr(k)), quoted(v)) for k, v in sorted(extracted.items())]
        text = F.concat_ws(", ", *pairs)
    else:
        extracted = F.col(extracted) if isinstance(extracted, str) else extracted
        entries = F.sort_array(F.map_entries(extracted))
        pairs = F.transform(entries, lambda e: _pair(quoted(e["key"]), quoted(e["value"])))
        text = F.array_join(pairs, ", ")
    return F.concat(F.lit("["), text, F.lit("]"))


def content_hash(extracted: Column | str | Mapping[str, Column]) -> Column:
    """SHA-256 of the entries; equal maps give equal hashes in any entry order."""
    return F.sha2(content_text(extracted), 256)


def record_id(source_name: Column | str, source_id: Column | str) -> Column:
    """SHA-256 of ``source_name:source_id``."""
    return F.sha2(F.concat_ws(":", source_name, source_id), 256)
