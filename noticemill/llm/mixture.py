"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's share of the mix follows its weight; a source whose target would pass ``most`` times its
size stops there, and the excess is shared again by weight until none is above. Each source takes
as many complete epochs as fit its target. For the rest, every document has an exponential key, a
hash of its id as the uniform number, divided by its quality weight; documents are taken in order
of the keys as long as their sizes, prefix-summed, fit. A document that does not fit is passed over,
and those after it that still fit are summed again, until the gap is below ``NEAR`` of the target or none
fits; then the document whose size is nearest to the gap is taken, if the target is nearer with it.

Prefix sums run over ranges of (source, key), so a source may hold any part of the rows. Sources
are summed before they are shuffled, and the water level of the targets is found by a few sums
over one row per source. The same rows give the same mix.

Null text counts as empty: size 0, taken 0. A null source is a source of its own, last. Rows that
repeat an id are documents of their own with the same key. A source without words has target 0. An
empty table gives an empty mix. Columns with clashing names are not read, except in ``mix``, which
returns the input's columns whatever their names; rows equal in id, source and text share their copies
out in the order of their other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill.llm.frames import WORD, whole_text
from noticemill.operators.joins import broadcast_if, is_small
from noticemill.operators.ranges import running_totals
from noticemill.session import written

WEIGHTS = (3.0, 1.0, 2.0)
#: A gap of this part of a source's target is left to the last, nearest document.
NEAR = 0.002
PASS = "struct<missing:double,stop:bigint>"


def text_quality(text_column: str = "text") -> Column:
    """Weight above 0 to 1: falls with the share of characters that are symbols."""
    text = whole_text(text_column)
    length = F.greatest(F.char_length(text), F.lit(1))
    symbols = F.char_length(text) - F.char_length(F.translate(text, "%$&#*|!<>{}=", ""))
    return 1 / (1 + 20.0 * symbols / length)


def uniform(id_column: str, seed: int) -> Column:
    """A number in (0, 1) that depends on the id alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_column).cast("string")), 12)
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """One row per source of the frame (source, size): source, source_no, source_size, target."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = running_totals(
        totals.withColumn("_all", F.lit(0)),
        ["_all"],
        [F.col("source").asc_nulls_last()],
        {"source_no": F.lit(1)},
        "sources",
    )
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")
    )
    table = written(numbered.select("source", "source_no", "source_size", weight.alias("weight")), "sources")
    cap = most * F.col("source_size")
    words, weight_sum = table.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (share * words / weight_sum if words else 0.0), -1
    while True:
        above = F.lit(level) * F.col("weight") > cap
        n, capped, free = table.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if n == full or not free:
            break
        full, level = n, (share * words - (capped or 0.0)) / free
    target = F.when(F.lit(level) * F.col("weight") > cap, cap).otherwise(F.lit(level) * F.col("weight"))
    return table.select("source", "source_no", "source_size", target.alias("target"))


def takings(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """(id, size, source_size, target, epochs, taken) for every row: ``epochs`` is how often the
    mix holds the document, ``taken`` its words in the mix. The options are those of ``_taken``."""
    return _taken(docs, id_column=id_column, **options).select(
        F.col("id").alias(id_column), "size", "source_size", "target", "epochs", "taken"
    )


def _tag(id_column: str, text_column: str, source_column: str) -> Column:
    """What tells a document apart, in 128 bits: rows with the same id, source and text are
    interchangeable."""
    spelled = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    key = F.concat_ws("\0", spelled(id_column), spelled(source_column), whole_text(text_column))
    return F.unhex(F.md5(key))


def _taken(
    docs: DataFrame,
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple[float, ...] = WEIGHTS,
    quality: Column | None = None,
    seed: int = 7,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    weight = text_quality(text_column) if quality is None else quality
    sized = written(
        docs.select(
            F.col(id_column).alias("id"),
            F.col(source_column).alias("source"),
            F.regexp_count(whole_text(text_column), F.lit(WORD)).cast("long").alias("size"),
            (-F.log(uniform(id_column, seed)) / weight).alias("key"),
            _tag(id_column, text_column, source_column).alias("tag"),
        ),
        "sizes",
    )
    targets = source_targets(sized, share, most, weights)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    wanted = targets.select(
        "source",
        "source_no",
        "source_size",
        "target",
        full.cast("long").alias("full"),
    ).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    wanted = broadcast_if(is_small(wanted), wanted)
    placed = sized.join(wanted, sized["source"].eqNullSafe(wanted["source"])).select(
        "id", "tag", "size", "key", wanted["source_no"], "source_size", "target", "full", "rest"
    )
    order = [F.col("key"), F.col("id"), F.col("size"), F.col("tag")]
    summed = written(
        running_totals(placed, ["source_no"], order, {"before": F.col("size"), "at": F.lit(1)}, "mix"), "mix"
    ).withColumn("chosen", F.col("before") + F.col("size") <= F.col("rest"))
    picks = _fill(summed)
    extra = F.col("chosen") | F.coalesce("picked", F.lit(False))
    epochs = F.col("full") + extra.cast("long")
    return summed.join(picks, ["source_no", "at"], "left").select(
        "id",
        "tag",
        "size",
        "source_size",
        "target",
        epochs.alias("epochs"),
        (epochs * F.col("size")).alias("taken"),
    )


def _fill(summed: DataFrame) -> DataFrame:
    """(source_no, at, picked): further documents that fill what the chosen leave open: passes in the
    order of the keys take what then still fits, until the gap is small or nothing does; then the nearest
    one is taken, if the target is nearer with it."""
    spare = summed.where(~F.col("chosen") & (F.col("size") > 0)).select("source_no", "size", "at")
    picks = summed.groupBy("source_no").agg(
        (F.max("rest") - F.coalesce(F.sum(F.when(F.col("chosen"), F.col("size"))), F.lit(0)))
        .cast("double")
        .alias("missing"),
        (F.max("target") * NEAR).alias("enough"),
        F.array().cast("array<long>").alias("picked"),
        F.array().cast(f"array<{PASS}>").alias("passes"),
    )
    picks = _pass(spare, picks)
    picks = written(_pick(spare, picks, F.abs(F.col("size") - F.col("missing")) < F.col("missing")), "picks")
    return (
        spare.join(broadcast_if(is_small(picks), picks), "source_no")
        .where(_held())
        .select("source_no", "at", F.lit(True).alias("picked"))
    )


def _held() -> Column:
    """Whether a document is among those picked, or was met in a pass before the place it stopped at."""
    passed = F.exists("passes", lambda p: (F.col("size") <= p["missing"]) & (F.col("at") < p["stop"]))
    return F.array_contains("picked", F.col("at").cast("long")) | passed


def _pick(spare: DataFrame, picks: DataFrame, fits: Column) -> DataFrame:
    """The picks with one further document per source: of those that fit, the nearest to the gap."""
    picks = written(picks, "picks")
    off = F.abs(F.col("size") - F.col("missing"))
    best = (
        spare.join(broadcast_if(is_small(picks), picks), "source_no")
        .where(fits & ~_held())
        .groupBy("source_no")
        .agg(F.min(F.struct(off.alias("off"), "at", "size")).alias("best"))
    )
    return picks.join(best, "source_no", "left").select(
        "source_no",
        (F.col("missing") - F.coalesce("best.size", F.lit(0))).alias("missing"),
        F.when(F.col("best").isNull(), F.col("picked"))
        .otherwise(F.array_append("picked", F.col("best.at").cast("long")))
        .alias("picked"),
        "enough",
        "passes",
    )


def _pass(spare: DataFrame, picks: DataFrame) -> DataFrame:
    """The picks after passes over the documents that still fit. A pass takes those before the first
    one, at the place ``stop``, with which they would no longer fit together; this one is larger than
    what is then missing, so a pass settles two documents at least."""
    picks = written(picks, "picks")
    open_gap = (F.col("missing") > F.col("enough")) & (F.col("size") <= F.col("missing"))
    fits = spare.join(broadcast_if(is_small(picks), picks), "source_no").where(~_held())
    fits = written(fits.where(open_gap).select("source_no", "size", "at"), "fits")
    while not fits.isEmpty():
        gaps = picks.select("source_no", "missing")
        placed = running_totals(fits, ["source_no"], [F.col("at")], {"before": F.col("size")}, "fits")
        placed = placed.join(broadcast_if(is_small(gaps), gaps), "source_no")
        fit = F.col("before") + F.col("size") <= F.col("missing")
        step = placed.groupBy("source_no").agg(
            F.sum(F.when(fit, F.col("size")).otherwise(0)).alias("more"),
            F.coalesce(F.min(F.when(~fit, F.col("at"))), F.max("at") + 1).cast("long").alias("stop"),
        )
        one = F.struct("missing", "stop")
        picks = written(
            picks.join(step, "source_no", "left").select(
                "source_no",
                (F.col("missing") - F.coalesce("more", F.lit(0))).alias("missing"),
                "picked",
                "enough",
                F.when(F.col("stop").isNull(), F.col("passes")).otherwise(F.array_append("passes", one)).alias("passes"),
            ),
            "picks",
        )
        fits = fits.join(broadcast_if(is_small(picks), picks), "source_no").where(~_held())
        fits = written(fits.where(open_gap).select("source_no", "size", "at"), "fits")
    return picks


def _unused(name: str, columns: list[str]) -> str:
    """The name, with as many more signs as it needs to differ from the columns."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options
) -> DataFrame:
    """The documents of the mix with all their columns, each as often as the mix holds it."""
    names = {"id_column": id_column, "text_column": text_column, "source_column": source_column}
    tag, epochs, rows, copies, copy, row, alike = (
        _unused(n, docs.columns) for n in ("_tag", "_epochs", "_rows", "_copies", "_copy", "_row", "_alike")
    )
    held = written(
        _taken(docs, **names, **options)
        .groupBy(F.col("tag").alias(tag))
        .agg(F.sum("epochs").alias(epochs), F.count("*").alias(rows))
        .where(F.col(epochs) > 0),
        "held",
    )
    several = held.where(F.col(rows) > 1)
    tagged = docs.withColumn(tag, _tag(**names))

    def repeated(found: DataFrame) -> DataFrame:
        often = F.array_repeat(F.lit(1), F.col(copies).cast("int"))
        return found.where(F.col(copies) > 0).withColumn(copy, F.explode(often)).select(*docs.columns)

    once = repeated(tagged.join(held.where(F.col(rows) == 1).select(tag, F.col(epochs).alias(copies)), tag))
    if several.isEmpty():
        return once
    # rows with one tag: equal ones are counted, the rest of an epoch goes to the first of them
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    distinct = (
        tagged.join(several.select(tag), tag, "left_semi")
        .groupBy(tag, F.to_json(whole).alias(alike))
        .agg(F.first(whole).alias(row), F.count("*").alias(copies))
    )
    placed = running_totals(
        distinct.select(tag, F.md5(alike).alias(alike), row, copies), [tag], [F.col(alike)], {"_earlier": F.col(copies)}, "alike"
    ).join(several, tag)
    rest = F.col(epochs) % F.col(rows) - F.col("_earlier")
    share = F.col(copies) * F.floor(F.col(epochs) / F.col(rows)) + F.greatest(F.lit(0), F.least(rest, F.col(copies)))
    more = placed.select(row, share.alias(copies)).where(F.col(copies) > 0)
    often = F.array_repeat(F.lit(1), F.col(copies).cast("int"))
    return once.unionByName(more.select(row, F.explode(often).alias(copy)).select(f"{row}.*"))
