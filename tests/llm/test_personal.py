import hashlib
import random
import re

from pyspark.sql import functions as F

from noticemill.llm.personal import _found, find_personal, occurrences

from .helpers import ODD, no_documents, odd_documents

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, token):
    digits = re.sub(r"[^0-9]", "", token)
    if kind == "ip":
        return all(int(p) <= 255 for p in token.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    spans = [
        (m.start(), n, m.end(), kind)
        for n, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text or "")
        if valid(kind, m[0])
    ]
    counts = tuple(sum(s[3] == kind for s in spans) for kind in PATTERNS)
    joined = ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(spans))
    return (*counts, hashlib.sha256(joined.encode()).hexdigest(), joined)


def same(frame, rows, only_base=False):
    got = sorted(map(tuple, frame.collect()), key=repr)
    want = sorted(((i, *brute(t)) for i, t in rows), key=repr)
    for g, w in zip(got, want, strict=True):
        assert g[:6] == w[:6]
        assert g[6] == w[6] if only_base else set(filter(None, w[6].split(","))) <= set(g[6].split(","))


TRICKY = [
    "a@b.c_d@e.f and x..y@z-1.org, me@host no, @b.c, a@b..c 1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255",
    "4111 1111 1111 1111 then 4111-1111-1111-1112 and 5500 0000 0000 0004-1 1234567890123456789012345",
    "+1 (988) 555-2485. +49 30 1234567 +1234 ++12345678901 +1-------------- +123456789012345678 +1 2",
    "é😀 a@b.co ñ 10.0.0.1 😀 +33 1 23 45 67 89",
    "9" * 30_000,
    "1 " * 20_000,
    "a." * 20_000 + "@b.c",
    "1.1.1.1." * 2_000,
    "+" + "(" * 20_000,
    "x@y.z," * 1_000,
]


def test_base_spans_match_the_plain_patterns(spark):
    rows = list(enumerate(TRICKY))
    same(find_personal(spark.createDataFrame(rows, "doc_id long, text string")), rows, only_base=True)


def test_odd_rows(spark):
    same(find_personal(odd_documents(spark)), [r[:2] for r in ODD], only_base=True)


def test_random_mixes_of_characters(spark):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choices("12 .@+-()a5_é", weights=[9, 9, 3, 4, 1, 2, 1, 1, 1, 3, 3, 1, 1], k=300))) for k in range(400)]
    same(find_personal(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_documents_keep_their_base_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    same(find_personal(docs), [tuple(r) for r in docs.collect()])


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    seeds = [f"Please dial number {p} today" for p in ("+1 555 100-2001", "+1 555 100-2002", "+44 20 7946 0958", "+33 1 23 45 67 89")]
    mails = [f"his mail address: u{k}@mail.example.com works" for k in range(6)]
    plain = [f"the order of {k}{k}000{k} parts and part A-{k}0017 came" for k in range(1, 9)]
    hidden = ["you may dial number 555-100-7788 now", "write to his mail address: pat.lee@intranet works"]
    rows = list(enumerate(seeds + mails + plain + hidden))
    got = {r.doc_id: r for r in find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(seeds + mails + plain)
    start = hidden[0].index("555-")
    assert got[n].spans == f"id:{start}:{start + 12}" and got[n].n_phone == 0
    start = hidden[1].index("pat.lee")
    assert got[n + 1].spans == f"id:{start}:{start + 16}" and got[n + 1].n_email == 0
    assert all(got[k].n_id == 0 for k in range(len(seeds + mails), n))


def test_empty_table(spark):
    assert find_personal(no_documents(spark)).count() == 0


def test_earlier_matches_and_single_items_are_contexts(spark):
    phones = ["+1 555 100-2001", "+1 555 100-2002", "+44 20 7946 0958", "+33 1 23 45 67 89"]
    mails = [f"u{k}@mail.example.com" for k in range(6)]
    rows = [f"dial number {p}, {q}" for p, q in zip(phones, phones[1:] + phones[:1])]
    rows += [f"{name}: {m}" for m in mails for name in ("Write", "then write")] + [f"Reach {m}" for m in mails]
    n = len(rows)
    rows += ["dial number 555-100-7788, 555-100-7799", "dial number 2: 555-100-7766", "Reach pat.lee@intranet"]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    seen = occurrences(_found(frame, "doc_id", "text")).where(~F.col("seed")).collect()
    assert {"555-100-7788", "555-100-7799", "555-100-7766"} <= {r.instance for r in seen}
    got = {r.doc_id: r for r in find_personal(frame).collect()}
    assert got[n].spans == "id:12:24,id:26:38"
    assert got[n + 2].spans == "id:6:22"


def test_named_identifiers_lead_to_further_contexts(spark):
    """Mails name the intranet names, these the badges, and these the lockers."""
    rows = [f"his mail address: u{k}@mail.example.com works" for k in range(12)]
    rows += [f"his mail address: pat{k}@intranet works, the badge login is pat{k}@intranet" for k in range(6)]
    rows += [f"the badge login is B-{k}1177 today, a locker code of B-{k}1177" for k in range(9)]
    n = len(rows)
    rows += ["the badge login is new77@intranet", "a locker code of L-20017", "a part of P-20018"]
    got = {r.doc_id: r for r in find_personal(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [got[n + k].n_id for k in range(3)] == [1, 1, 0]
