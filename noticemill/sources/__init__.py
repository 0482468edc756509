"""Sources of raw records: declarative specs over landed response pages."""

from noticemill.sources import city, federal  # noqa: F401  (register the built-in sources)
from noticemill.sources.spec import SourceSpec, get_source, list_sources, register_source, source_names

__all__ = ["SourceSpec", "get_source", "list_sources", "register_source", "source_names"]
