import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

from noticemill.llm.filter_audit import COUNTS, KINDS, LETTERS, audit, audit_filters, failures, removals, shapley, tabulate

from .helpers import ODD, no_documents, odd_documents

LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        bool(re.search(r"[#$%&*|]", text)),
    )


def brute(rows, labels):
    """Every order played through, document by document. rows: (id, text, part); labels: id to (good, toxic)."""
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    marked = []
    for doc_id, text, part in rows:
        copy = doc_id is not None and least[text or ""] < doc_id
        marked.append((part or "", (*fails(text or ""), copy), *labels.get(doc_id, (False, False))))
    out, shares = {}, Counter()
    for part in {m[0] for m in marked}:
        for order in permutations(range(5)):
            here = [m for m in marked if m[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                lost = [m for m in here if m[1][f]]
                here = [m for m in here if not m[1][f]]
                alone = sum(m[1][f] and sum(m[1]) == 1 for m in marked if m[0] == part)
                key = part, "".join(LETTERS[k] for k in order), step
                out[key] = [
                    len(here), len(lost), sum(m[1][f] for m in gone), alone, sum(m[2] for m in lost), sum(m[3] for m in lost)
                ]
                shares[part, f] += len(lost)
                gone += lost
    return {key: (*v, shares[key[0], LETTERS.index(key[1][key[2] - 1])]) for key, v in out.items()}


def collected(frame):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in frame.collect()}


def test_odd_rows_match_brute_force(spark):
    labels = spark.createDataFrame(
        [(5, 0, 0), (5, 1, None), (1, 1, 1), (9, None, 1), (None, 1, 1), (99, 1, 1)], LABELS
    )
    want = brute([r[:3] for r in ODD], {5: (True, False), 1: (True, True), 9: (False, True)})
    frame = audit_filters(odd_documents(spark), labels)
    assert collected(frame) == want
    assert frame.count() == 120 * 5 * len({r[2] or "" for r in ODD})


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    known = {r.doc_id: (r.quality == 1, r.toxic == 1) for r in labels.collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    assert collected(audit_filters(docs, labels)) == brute(rows, known)


def test_shapley_values_are_those_of_all_orders():
    rng = random.Random(3)
    for m in (2, 3, 5):
        for _ in range(5):
            value = [0, *(rng.randrange(100) for _ in range((1 << m) - 1))]
            want = [Fraction(0)] * m
            orders = list(permutations(range(m)))
            for order in orders:
                before = 0
                for i in order:
                    want[i] += Fraction(value[before | 1 << i] - value[before], len(orders))
                    before |= 1 << i
            assert shapley(value) == want


def test_removals_of_coalitions():
    counts = [0] * 32
    counts[0b00011], counts[0b10000], counts[0] = 2, 3, 4
    lost = removals(counts)
    assert (lost[0], lost[0b00001], lost[0b00010], lost[0b10001], lost[31]) == (0, 2, 2, 5, 5)
    rows = list(audit({kind: counts for kind in KINDS}))
    assert len(rows) == 600 and all(r[2] == 4 for r in rows if r[1] == 5)


def test_a_third_of_the_rows_are_copies_of_one_text(spark):
    rows = [(k, "same" if k % 3 == 0 else f"other {k}", "en") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    copies = failures(docs).where(has_bit("E")).collect()
    assert sorted(r.id for r in copies) == [k for k in range(3, 3000, 3)]


def has_bit(letter):
    return f"(failed & {1 << LETTERS.index(letter)}) > 0"


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert audit_filters(no_documents(spark), none).count() == 0
    assert tabulate(failures(odd_documents(spark)), none).count() == len({r[2] for r in ODD} - {None}) + 1


def test_clashing_columns(spark):
    labels = spark.createDataFrame([(1, 1, 0, "x")], LABELS + ", part string").withColumnRenamed("part", "n")
    docs = odd_documents(spark).selectExpr("*", "1 AS failed", "2 AS digest", "3 AS first_id")
    assert audit_filters(docs, labels).count() == 600 * len({r[2] or "" for r in ODD})
