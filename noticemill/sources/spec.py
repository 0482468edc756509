"""What a source is, and the registry of sources.

A source says how its landed pages look and how one row becomes a raw record, all as column
expressions, so Catalyst sees the whole way from file to record.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticemill.functions.hashing import content_hash
from noticemill.operators.joins import broadcast_if, is_small
from noticemill.operators.ranges import running_totals
from noticemill.session import written


@dataclass(frozen=True)
class SourceSpec:
    """One source.

    ``read_pages(spark, path)`` gives a frame (page_offset long, total_records long,
    rows array<struct>, and from files ``landed`` and ``problem``, see below); ``row_type`` is the
    struct. ``key``, ``url``, ``keep`` and ``window`` are expressions over one exploded row;
    ``mapping`` names the extracted keys and the row field each is read from. ``one_run`` says that
    the files outside ``run=<n>`` folders are the pages of one run, not a run each.
    """

    name: str
    base_url: str
    row_type: T.StructType
    read_pages: Callable[[SparkSession, str], DataFrame]
    key: Callable[[], Column]
    url: Callable[[], Column]
    mapping: Mapping[str, str]
    page_size: int
    description: str = ""
    tags: tuple[str, ...] = field(default_factory=tuple)
    requires_browser: bool = False
    keep: Callable[[], Column] | None = None
    window: Callable[[date], Column] | None = None
    stream_pages: Callable[..., DataFrame] | None = None
    one_run: bool = False

    def start_url(self) -> str:
        return self.base_url


LANDED = "landed"
# what is wrong with a page, null if it can be read, and the response as it came
PROBLEM = ("problem", "response")
# which listing of its source a record belongs to
LANDING = "landing"
# the folder of files that hold many responses each
PACKED = "packed"
# the order records arrive in: ``stamp`` gives every record the time of its place among all of a run
ARRIVAL = ("fetched_at",)


def landed() -> Column:
    """When and as which file a page came. A folder may hold the files of several runs; those below
    a folder ``run=<n>`` belong together."""
    return F.struct("_metadata.file_modification_time", "_metadata.file_path").alias(LANDED)


def with_landed(source: DataFrame, *columns: Column) -> DataFrame:
    """The columns, and ``landed`` where the frame has it."""
    return source.select(*columns, *[c for c in (LANDED,) if c in source.columns])


def landing(one_run: bool) -> Column:
    """The listing a record belongs to: the run its file is filed under; without one, the file is
    taken as a listing of its own, or the whole folder with ``one_run``."""
    path = F.col(f"{LANDED}.file_path")
    run = F.regexp_extract(path, "/(run=[^/]+)/", 1)
    return F.when(run != "", run).otherwise(F.lit("") if one_run else path)


def check_runs(files: list[str]) -> None:
    """Raise if a page's folder outside ``run=<n>`` holds the files of several runs: their places
    could not be told apart."""
    folders = [f.rpartition("/")[0] for f in files if "/page_offset=" in f and "/run=" not in f]
    if len(set(folders)) < len(folders):
        raise ValueError("several files for one page: file each run below a folder run=<n>")


def check_packed(pages: DataFrame, files: list[str]) -> None:
    """The same for the places that packed responses name themselves."""
    if not any(f"/{PACKED}/" in f for f in files):
        return
    outside = pages.filter(F.col("page_offset").isNotNull() & ~F.col(f"{LANDED}.file_path").contains("/run="))
    if not outside.groupBy("page_offset").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("several responses for one page: file each run below a folder run=<n>")


def readable(pages: DataFrame) -> DataFrame:
    """The pages that could be read."""
    return pages.filter(F.col(PROBLEM[0]).isNull()) if PROBLEM[0] in pages.columns else pages


def unreadable(pages: DataFrame, name: str) -> DataFrame | None:
    """(source_name, reason, response, landed) of the pages that could not be read."""
    if PROBLEM[0] not in pages.columns:
        return None
    return pages.filter(F.col(PROBLEM[0]).isNotNull()).select(
        F.lit(name).alias("source_name"), F.col("problem").alias("reason"), "response", LANDED
    )


def explode_pages(pages: DataFrame) -> DataFrame:
    """Rows of all pages with their place in the source: seq = page offset + position."""
    rows = with_landed(readable(pages), F.col("page_offset"), F.posexplode("rows").alias("pos", "row"))
    place = (F.col("page_offset") + F.col("pos")).alias("seq")
    return with_landed(rows, place, F.col("row.*"))


def pages_to_read(
    pages: DataFrame, until_empty: bool = False, one_run: bool = False
) -> DataFrame:
    """The pages a reader asks for: those up to the announced total.

    A reader that fetches also stops at the first empty page, so landed pages normally end there;
    ``until_empty`` looks for it in each listing, in a pass of its own, and leaves out what lies
    behind it in the same listing. ``one_run`` is that of the source.
    """
    pages = readable(pages)
    kept = pages.filter(
        F.col("total_records").isNull() | (F.col("page_offset") < F.col("total_records"))
    )
    if not until_empty:
        return kept
    listing = landing(one_run) if LANDED in pages.columns else F.lit("")
    cuts = (
        pages.filter(F.size("rows") == 0)
        .groupBy(listing.alias("_empty_in"))
        .agg(F.min("page_offset").alias("_cut"))
    )
    cuts = written(cuts, "empty-pages")
    kept = kept.withColumn("_listing", listing)
    return (
        kept.join(broadcast_if(is_small(cuts), cuts), F.col("_listing") == F.col("_empty_in"), "left")
        .filter(F.col("_cut").isNull() | (F.col("page_offset") < F.col("_cut")))
        .select(*pages.columns)
    )


def extracted_values(mapping: Mapping[str, str]) -> dict[str, Column]:
    """The extracted keys in mapping order; a missing value becomes ``""``."""
    return {
        key: F.coalesce(F.col(column).cast("string"), F.lit("")) for key, column in mapping.items()
    }


def extracted_map(mapping: Mapping[str, str]) -> Column:
    """The same as one map column."""
    entries = []
    for key, value in extracted_values(mapping).items():
        entries += [F.lit(key), value]
    return F.create_map(*entries)


def records(spec: SourceSpec, rows: DataFrame, as_of: date | None = None) -> DataFrame:
    """Raw records plus ``seq`` (and ``landed``) from exploded rows; rows without a key are
    dropped."""
    if spec.keep is not None:
        rows = rows.filter(spec.keep())
    if spec.window is not None and as_of is not None:
        rows = rows.filter(spec.window(as_of))
    keyed = rows.withColumn("source_id", spec.key()).filter(
        F.coalesce(F.col("source_id"), F.lit("")) != ""
    )
    return with_landed(
        keyed,
        F.col("source_id"),
        F.lit(spec.name).alias("source_name"),
        spec.url().alias("source_url"),
        F.lit(None).cast("string").alias("raw_html"),
        extracted_map(spec.mapping).alias("extracted"),
        content_hash(extracted_values(spec.mapping)).alias("content_hash"),
        F.col("seq"),
        *([landing(spec.one_run).alias(LANDING)] if LANDED in keyed.columns else []),
    )


def stamp(records_: DataFrame, fetched_at: Column, stored: DataFrame | None = None) -> DataFrame:
    """Set fetched_at: the run's time plus one microsecond per place, so that arrival order stays
    visible in the stored time. A run starts after everything stored before it, also where an
    earlier run was so long that its times reach past the clock. Where a run reads several
    listings, the records of one come after all of those that landed before it."""
    start = F.unix_micros(fetched_at.cast("timestamp"))
    if stored is not None:
        newest = stored.agg(F.unix_micros(F.max("fetched_at")).alias("newest")).scalar()
        start = F.greatest(start, newest + 1)  # greatest skips null
    place = F.col("seq")
    if LANDING in records_.columns:
        starts = listing_starts(records_)
        records_ = records_.join(broadcast_if(is_small(starts), starts), LANDING)
        place = F.col("_start") + F.col("seq")
    stamped = records_.withColumn("fetched_at", F.timestamp_micros(start + place))
    return stamped.drop("_start")


def listing_starts(records_: DataFrame) -> DataFrame:
    """(landing, _start): what to add to the places of a listing's records so that the listings of a
    run follow each other in the order in which their first files landed."""
    listings = records_.groupBy(LANDING).agg(
        F.min(LANDED).alias("_first"), F.min("seq").alias("_low"), F.max("seq").alias("_high")
    )
    listings = written(listings, "listings")
    length = F.col("_high") - F.col("_low") + 1
    order = [F.col("_first"), F.col(LANDING)]
    if is_small(listings):
        earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        placed = listings.withColumn("_before", F.coalesce(F.sum(length).over(earlier), F.lit(0)))
    else:
        placed = running_totals(
            listings.withColumn("_all", F.lit(0)), ["_all"], order, {"_before": length}, "listings"
        )
    return written(placed.select(LANDING, (F.col("_before") - F.col("_low")).alias("_start")), "starts")


_REGISTRY: dict[str, SourceSpec] = {}


def register_source(spec: SourceSpec) -> SourceSpec:
    _REGISTRY[spec.name] = spec
    return spec


def get_source(name: str) -> SourceSpec:
    try:
        return _REGISTRY[name]
    except KeyError:
        raise KeyError(f"Unknown source {name!r}; registered: {sorted(_REGISTRY)}") from None


def source_names() -> list[str]:
    return list(_REGISTRY)


def list_sources(spark: SparkSession) -> DataFrame:
    """Registered sources by name."""
    rows = [
        (s.name, s.base_url, s.description, list(s.tags), s.requires_browser)
        for s in _REGISTRY.values()
    ]
    schema = (
        "name string, base_url string, description string, tags array<string>, "
        "requires_browser boolean"
    )
    return spark.createDataFrame(rows, schema).orderBy("name")
