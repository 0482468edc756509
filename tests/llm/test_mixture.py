import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from noticemill.llm.mixture import NEAR, mix, takings, text_quality, uniform

from .helpers import no_documents, odd_documents


def targets(sizes):
    """Water filling by hand: {source: size} to {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        shares = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s: 2.0 * sizes[s] for s in free if shares[s] > 2 * sizes[s]}
        if not above:
            return fixed | shares
        fixed |= above


def check(docs, rows, near):
    texts = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    sizes, words = defaultdict(int), []
    for doc_id, text, source in texts:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        words.append((doc_id, n, source))
    want = targets(sizes)
    taken = defaultdict(int)
    left = defaultdict(list)
    for r in rows:
        left[(r.doc_id, r["size"])].append(r)
    for doc_id, n, source in words:
        row = left[(doc_id, n)].pop()
        assert row.source_size == sizes[source]
        assert row.target == pytest.approx(want[source], rel=1e-12)
        assert row.taken in (0, n, 2 * n)
        taken[source] += row.taken
    assert not any(left.values())
    for source in sizes:
        assert abs(taken[source] - want[source]) <= near(source, words, want[source])


def test_odd_rows(spark):
    docs = odd_documents(spark)
    check(docs, takings(docs).collect(), lambda s, words, t: max(n for _, n, o in words if o == s))


def test_documents_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(docs, takings(docs).collect(), lambda s, words, target: 0.02 * target)


def test_one_hot_source_over_many_ranges(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"),
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise((F.col("id") % 5).cast("string")).alias("source"),
    )
    check(docs, takings(docs).collect(), lambda s, words, target: 7)


def test_reruns_agree_and_heavier_documents_come_first(spark):
    docs = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 2).cast("string").alias("source")
    )
    good = F.when(F.col("doc_id") % 4 < 2, 8.0).otherwise(1.0)
    rows = takings(docs, quality=good, share=0.5).collect()
    assert sorted(rows) == sorted(takings(docs.repartition(5), quality=good, share=0.5).collect())
    picked = [r for r in rows if r.taken]
    assert sum(r.doc_id % 4 < 2 for r in picked) > 0.7 * len(picked)


def test_mix_repeats_documents_with_all_columns(spark):
    docs = odd_documents(spark)
    taken = takings(docs).select("doc_id", "size", "epochs")
    mixed = mix(docs)
    assert mixed.schema == docs.schema
    want = sorted((r.doc_id or 0) for r in taken.collect() for _ in range(r.epochs))
    assert sorted((r.doc_id or 0) for r in mixed.collect()) == want


def test_empty_table(spark):
    assert takings(no_documents(spark)).count() == 0
    assert mix(no_documents(spark)).count() == 0


def chosen_by_hand(members, full, rest, target):
    """Epochs by id. members: (key, id, size). Complete epochs; in the order of the keys what fits, again and
    again without what does not; then the document nearest to the gap, if the target is nearer with it."""
    want, before = {}, 0
    for _, doc_id, size in sorted(members):
        want[doc_id] = full + (before + size <= rest)
        before += size
    missing = rest - sum(size for _, i, size in members if want[i] > full)
    while missing > NEAR * target:
        fits = [(i, size) for _, i, size in sorted(members) if want[i] == full and 0 < size <= missing]
        if not fits:
            break
        for doc_id, size in fits:
            if size > missing:
                break
            want[doc_id] += 1
            missing -= size
    near = [
        (abs(size - missing), n, doc_id)
        for n, (_, doc_id, size) in enumerate(sorted(members))
        if size and want[doc_id] == full and abs(size - missing) < missing
    ]
    if near:
        want[min(near)[2]] += 1
    return want


def check_choice(docs, quality):
    keyed = docs.select("doc_id", "source", (-F.log(uniform("doc_id", 7)) / quality).alias("key"))
    keys = {r.doc_id: (r.source, r.key) for r in keyed.collect()}
    rows = {r.doc_id: r for r in takings(docs, quality=quality).collect()}
    by_source = defaultdict(list)
    for doc_id, (source, key) in keys.items():
        by_source[source].append((key, doc_id, rows[doc_id]["size"]))
    for members in by_source.values():
        first = rows[members[0][1]]
        full = int(first.target // first.source_size)
        want = chosen_by_hand(members, full, first.target - full * first.source_size, first.target)
        assert {i: rows[i].epochs for i in want} == want


def test_choice_matches_brute_force(spark):
    """Complete epochs, then documents in the order of their keys, then what fills the rest."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_choice(docs, text_quality())


def test_long_documents_are_taken_by_their_keys_too(spark):
    """A document of half of its source's words, and sizes of very different order."""
    size = F.when(F.col("id") % 500 == 7, 4000).otherwise(F.pmod(F.xxhash64("id"), F.lit(60)) + 1).cast("int")
    docs = spark.range(1000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), size).alias("text"), (F.col("id") % 2).cast("string").alias("source")
    )
    check_choice(docs, F.lit(1.0))


def test_mix_with_clashing_columns_and_hot_rows(spark):
    """A third of the rows are one document, in two spellings of another column."""
    rows = [(1, "a b", "x", str(k % 2), 0) for k in range(100)] + [(k, f"w{k} b c", "x", "0", 1) for k in range(2, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _tag string, _copies int")
    taken = takings(docs).select("doc_id", "epochs").collect()
    mixed = mix(docs)
    assert mixed.schema == docs.schema
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in taken for _ in range(r.epochs))
    assert sorted(mixed.collect()) == sorted(mix(docs.repartition(7)).collect())
