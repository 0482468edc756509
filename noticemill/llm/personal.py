"""Personal data in texts: fixed detectors, and contexts bootstrapped from what they find.

Base spans come from four patterns with checks. They are the seeds. Every token that could be an
identifier, a run of identifier characters with a digit or an @, is an instance; the two and the
three lexical items before it are its patterns, or the only one that is there. Pattern and instance score each other in turn: an
instance under a base span counts 1, any other the best score of its patterns; a pattern scores the
mean of its distinct instances, lessened where they are few. Patterns with enough seeds and a high
score then name the instances that no detector knew: spans of kind ``id``. These are seeds in their
turn, and all is scored again until no further one is named. One that touches a base span is not
added.

All steps are DataFrame expressions. The regular expressions start only where a run of their first
characters starts and never give back what a run has taken, so their time is linear in the text.
Patterns and instances meet as distinct narrow pairs, summed before they are shuffled.

Null text counts as empty. A row is told apart by a number of its own, so ids may be null or
repeated. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill.llm.frames import whole_text
from noticemill.session import written

#: Kinds in the order of the contract, with patterns equal to
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+),
#: card [0-9]([\x20-]?[0-9])+ and phone \+[0-9][\x20().0-9-]+[0-9].
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this character has no span of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
KINDS = [*PATTERNS, "id"]

SPAN = "struct<start:int,kind:int,stop:int,token:string,left:string>"
IDENTIFIER = r"(?<![A-Za-z0-9+/_.@-])[A-Za-z+/_.-]*+[0-9@][A-Za-z0-9+/_.@-]*+"
LEAST_LENGTH = 6
ITEM = r"[\p{L}0]+|[^\p{L}0\s]"
CONTEXT_CHARS = 64
ROUNDS = 3
LEAST_SEEDS = 3
LEAST_SCORE = 0.6


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, token, left>> of a pattern's matches: the texts between matches
    and the matches take turns, so their lengths add up to the places, in code points. ``left`` is
    the text before a match, earlier matches included, up to ``CONTEXT_CHARS``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    step = F.zip_with(
        F.slice(between, F.lit(1), F.size(found)),
        found,
        lambda gap, token: F.struct(
            F.char_length(gap).alias("gap"),
            F.right(gap, F.lit(CONTEXT_CHARS)).alias("between"),
            token.alias("token"),
        ),
    )
    start = F.struct(
        F.lit(0).alias("at"),
        F.lit("").alias("tail"),
        F.array().cast("array<struct<start:int,stop:int,token:string,left:string>>").alias("spans"),
    )

    def add(state: Column, one: Column) -> Column:
        begin = state["at"] + one["gap"]
        stop = begin + F.char_length(one["token"])
        left = F.right(F.concat(state["tail"], one["between"]), F.lit(CONTEXT_CHARS))
        tail = F.right(F.concat(left, F.right(one["token"], F.lit(CONTEXT_CHARS))), F.lit(CONTEXT_CHARS))
        span = F.struct(begin.alias("start"), stop.alias("stop"), one["token"].alias("token"), left.alias("left"))
        return F.struct(
            stop.alias("at"), tail.alias("tail"), F.array_append(state["spans"], span).alias("spans")
        )

    return F.aggregate(step, start, add, lambda state: state["spans"])


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the check sum: from the right, every second one counts double."""
    turned = F.reverse(digits)

    def worth(k: Column) -> Column:
        d = F.substring(turned, k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    places = F.sequence(F.lit(1), F.char_length(digits))
    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, token: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return token.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        length = F.char_length(_digits(token))
        return F.when(length.between(12, 19), _luhn(_digits(token))).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(_digits(token)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array<SPAN> of the valid matches of a kind; kind is its place."""
    spans = F.transform(
        F.filter(_matches(text, PATTERNS[kind]), lambda s: _valid(kind, s["token"])),
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            s["stop"].alias("stop"),
            s["token"].alias("token"),
            s["left"].alias("left"),
        ),
    )
    possible = text.contains(NEEDS[kind]) if kind in NEEDS else F.col("_digits")
    if kind == "ip":
        possible = possible & F.col("_digits")
    return F.when(possible, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _found(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per document: its base spans and, for instances, its possible identifiers."""
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).alias("doc_id"),
        whole_text(text_column).alias("text"),
    ).withColumn("_digits", F.col("text").rlike("[0-9]"))
    for kind in PATTERNS:
        texts = texts.withColumn(kind, base_spans(F.col("text"), kind))
    none = F.array().cast("array<struct<start:int,stop:int,token:string,left:string>>")
    possible = F.col("_digits") | F.col("text").contains("@")
    found = _matches(F.col("text"), IDENTIFIER)
    long = F.filter(found, lambda s: F.char_length(s["token"]) >= LEAST_LENGTH)
    return texts.select(
        "row",
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in PATTERNS],
        F.array_sort(F.concat(*PATTERNS)).alias("base"),
        F.when(possible, long).otherwise(none).alias("tokens"),
    )


def occurrences(found: DataFrame) -> DataFrame:
    """(row, start, stop, instance, patterns, item, seed): base spans, which are the seeds, and other
    possible identifiers, in their contexts. ``item`` is the last one, the pattern of those that have
    no other."""
    seeds = found.select("row", F.explode("base").alias("t")).select("row", "t.*", F.lit(True).alias("seed"))
    tokens = found.where(F.size("tokens") > 0).select("row", "base", F.explode("tokens").alias("t"))
    others = tokens.where(
        ~F.exists("base", lambda b: (b["start"] < F.col("t.stop")) & (F.col("t.start") < b["stop"]))
    ).select("row", "t.*", F.lit(False).alias("seed"))
    columns = ["row", "start", "stop", "token", "left", "seed"]
    ending = F.regexp_replace(F.lower("left"), "[0-9]", "0")
    last = lambda k: F.when(F.size("items") >= k, F.concat_ws(" ", F.slice("items", -k, k)))
    return (
        seeds.select(*columns)
        .unionByName(others.select(*columns))
        .withColumn("items", F.regexp_extract_all(ending, F.lit(ITEM), F.lit(0)))
        .where(F.size("items") >= 1)
        .select(
            "row",
            "start",
            "stop",
            F.lower("token").alias("instance"),
            F.when(F.size("items") == 1, F.array(last(1)))
            .otherwise(F.array_compact(F.array(last(2), last(3))))
            .alias("patterns"),
            F.element_at("items", -1).alias("item"),
            "seed",
        )
    )


def pattern_scores(seen: DataFrame) -> DataFrame:
    """(pattern, score, seeds) over distinct pairs of pattern and instance. A single item is scored
    over all that follow it, but passes its score on only to those without another. After the rounds
    the instances that trusted patterns name are seeds too, with the score of the pattern, and the
    rounds start again, until no instance is new."""
    every = F.array_distinct(F.array_append("patterns", F.col("item")))
    pairs = written(
        seen.select(F.explode(every).alias("pattern"), "patterns", "instance", "seed")
        .groupBy("pattern", "instance")
        .agg(
            F.max(F.col("seed").cast("double")).alias("weight"),
            F.max(F.array_contains("patterns", F.col("pattern"))).alias("names"),
        ),
        "pairs",
    )
    counted = -1
    while True:
        scores = _rounds(pairs)
        n = pairs.where("weight > 0").count()
        if n == counted:
            return scores
        counted = n
        named = (
            pairs.where("names").join(_trusted(scores), "pattern").groupBy("instance").agg(F.max("score").alias("score"))
        )
        weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.coalesce("score", F.lit(0.0)))
        pairs = written(
            pairs.join(named, "instance", "left").select("pattern", "instance", weight.alias("weight"), "names"), "pairs"
        )


def _rounds(pairs: DataFrame) -> DataFrame:
    known = pairs.groupBy("instance").agg(F.max("weight").alias("score"))
    scores = None
    for _ in range(ROUNDS):
        scores = written(
            pairs.join(known, "instance")
            .groupBy("pattern")
            .agg((F.sum("score") / (F.count("*") + 1)).alias("score"), F.sum("weight").alias("seeds")),
            "scores",
        )
        strong = F.when(F.col("names") & (F.col("seeds") >= LEAST_SEEDS), F.col("score")).otherwise(0.0)
        known = (
            pairs.join(scores, "pattern")
            .groupBy("instance")
            .agg(F.greatest(F.max("weight"), F.max(strong)).alias("score"))
        )
    return scores


def _trusted(scores: DataFrame) -> DataFrame:
    return scores.where((F.col("score") >= LEAST_SCORE) & (F.col("seeds") >= LEAST_SEEDS))


def find_personal(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id) for every row."""
    found = written(_found(docs, id_column, text_column), "found")
    seen = written(occurrences(found), "occurrences")
    trusted = _trusted(pattern_scores(seen))
    fresh = (
        seen.where(~F.col("seed"))
        .select("row", "start", "stop", F.explode("patterns").alias("pattern"))
        .join(trusted.select("pattern"), "pattern")
        .select("row", F.struct("start", F.lit(KINDS.index("id")).alias("kind"), "stop").alias("span"))
        .groupBy("row")
        .agg(F.collect_set("span").alias("more"))
    )
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    joined = (
        found.join(fresh, "row", "left")
        .withColumn("more", F.coalesce("more", none))
        .withColumn(
            "base",
            F.transform(
                "base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))
            ),
        )
    )
    return joined.select(
        F.col("doc_id").alias(id_column),
        *[f"n_{kind}" for kind in PATTERNS],
        F.sha2(_spelled(F.col("base")), 256).alias("base_sha256"),
        _spelled(F.array_sort(F.concat("base", "more"))).alias("spans"),
        F.size("more").cast("long").alias("n_id"),
    )


def _spelled(spans: Column) -> Column:
    """kind:start:end of spans that are sorted by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )
