"""noticemill: collect notices from many sources, curate them and report on them, as Spark jobs."""

__version__ = "0.1.0"
