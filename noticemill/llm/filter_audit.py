"""How quality filters act together: removals step by step in every order, and exact Shapley values.

A document fails a filter or not, whatever was removed before, so a document counts by its part and
the set of filters it fails. Of a part, the removals of a coalition of filters are the documents that
fail at least one of them. From the table of all coalitions, 32 for five filters, follow

- the step counts of every order: what a filter removes after others is the difference of two
  coalitions;
- the Shapley values: the additive game nearest to the table by least squares with the Shapley kernel
  as weights, held to the removals of all filters together. Its normal equations with the constraint
  are solved in rational numbers, so the values are exact; summed over all orders they are whole.

Spark decides the filters per document with expressions, finds repeated texts by a 256-bit digest of
the text, and sums documents by (part, failed filters) in each task first. A part is one row of 32
counts of three kinds from then on, and its orders are worked out in the task that holds the row.

Null text counts as empty: it fails for its few words, and as a copy if a smaller id has an empty
text. A row without an id is no smaller one and never fails as a copy; rows that repeat an id do not
make each other copies. A null part is the empty string's. A document labelled more than once counts
with its largest labels, one without labels or with null ones as neither good nor toxic. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill.llm.frames import WORD, whole_text
from noticemill.session import written

LETTERS = "ABCDE"
SIGNS = r"[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
KINDS = ("n", "good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text fails each of the filters that look at it alone."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.char_length(text),
        "D": text.rlike(SIGNS),
    }


def failures(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang"
) -> DataFrame:
    """(id, part, failed) for every row: bit k of ``failed`` says whether it fails filter k."""
    text = whole_text(text_column)
    bits = [F.when(fails, 1 << LETTERS.index(k)).otherwise(0) for k, fails in text_filters(text).items()]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask + bit
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        mask.alias("alone"),
        F.sha2(text, 256).alias("digest"),
    )
    first = rows.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    # as a table of its own, so that both sides of the join are plain shuffles, which AQE splits at hot texts
    copied = written(first.where("n > 1").select("digest", "first_id"), "copied")
    copy = F.coalesce(F.col("first_id") < F.col("id"), F.lit(False))
    return rows.join(copied, "digest", "left").select(
        "id", "part", (F.col("alone") + F.when(copy, 1 << LETTERS.index("E")).otherwise(0)).alias("failed")
    )


def tabulate(failed: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(part, counts): for each set of failed filters, how many documents, good and toxic ones."""
    known = (
        labels.where(F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("_label_id"))
        .agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    )
    marked = failed.join(known, failed["id"] == known["_label_id"], "left")
    sums = marked.groupBy("part", "failed").agg(
        F.count("*").alias("n"), *[F.count_if(F.coalesce(F.col(k), F.lit(False))).alias(k) for k in KINDS[1:]]
    )
    return sums.groupBy("part").agg(F.collect_list(F.struct("failed", *KINDS)).alias("counts"))


def removals(counts: Sequence[int]) -> list[int]:
    """For every coalition, a set of filters as bits, the documents that fail at least one of it."""
    return [sum(n for failed, n in enumerate(counts) if failed & s) for s in range(len(counts))]


def solve(rows: list[list[Fraction]]) -> list[Fraction]:
    """The solution of linear equations given as rows of coefficients and right-hand side."""
    rows = [row[:] for row in rows]
    for k in range(len(rows)):
        pivot = next(r for r in range(k, len(rows)) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r, row in enumerate(rows):
            if r != k and row[k]:
                rows[r] = [x - row[k] * y for x, y in zip(row, rows[k], strict=True)]
    return [row[-1] for row in rows]


def shapley(value: Sequence[int]) -> list[Fraction]:
    """Shapley values of a game given by the value of each coalition: minimise the sum over proper
    coalitions S of k(S) (value(S) - sum of the members' shares)**2 with the shares summing to the
    value of all, k(S) = (m - 1) / (C(m, |S|) |S| (m - |S|)). One multiplier joins the normal
    equations for the constraint."""
    m = (len(value) - 1).bit_length()
    members = [[i for i in range(m) if s >> i & 1] for s in range(1 << m)]
    equations = [[Fraction(0)] * (m + 2) for _ in range(m + 1)]
    for s in range(1, (1 << m) - 1):
        size = len(members[s])
        weight = Fraction(m - 1, comb(m, size) * size * (m - size))
        for i in members[s]:
            for j in members[s]:
                equations[i][j] += weight
            equations[i][-1] += weight * (value[s] - value[0])
    for i in range(m):
        equations[i][m] = equations[m][i] = Fraction(1)
    equations[m][-1] = Fraction(value[-1] - value[0])
    return solve(equations)[:m]


def audit(counts: dict[str, Sequence[int]], letters: str = LETTERS) -> Iterator[tuple]:
    """For every order and step: order, step, then the numbers named in ``COUNTS``. ``counts`` holds,
    for each of ``KINDS``, the documents by the set of filters they fail."""
    m, total = len(letters), sum(counts["n"])
    lost = {kind: removals(counts[kind]) for kind in KINDS}
    everyone = (1 << m) - 1
    shares = [int(x * factorial(m)) for x in shapley(lost["n"])] if m > 1 else [lost["n"][-1]]
    for order in permutations(range(m)):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            gone = {kind: lost[kind][after] - lost[kind][before] for kind in KINDS}
            yield (
                "".join(letters[k] for k in order),
                step,
                total - lost["n"][after],
                gone["n"],
                lost["n"][1 << f] - gone["n"],
                lost["n"][everyone] - lost["n"][everyone ^ 1 << f],
                gone["good"],
                gone["toxic"],
                shares[f],
            )
            before = after


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, found in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            counts = {kind: [0] * (1 << len(LETTERS)) for kind in KINDS}
            for one in found:
                for kind in KINDS:
                    counts[kind][one["failed"]] += one[kind]
            order, step, *numbers = zip(*audit(counts), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(order), pa.string()),
                    pa.array(order, pa.string()),
                    pa.array(step, pa.int32()),
                    *[pa.array(n, pa.int64()) for n in numbers],
                ],
                ["part", "filter_order", "step", *COUNTS],
            )


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    part_column: str = "lang",
) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley) for every part, order of the filters and step."""
    table = tabulate(failures(docs, id_column, text_column, part_column), labels, id_column)
    numbers = ", ".join(f"{name} long" for name in COUNTS)
    return table.mapInArrow(_orders, f"part string, filter_order string, step int, {numbers}")
