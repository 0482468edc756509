import hashlib
import re
from collections import defaultdict

from noticemill.llm.exact import drop_copies, exact_groups

from .helpers import ODD, no_documents, odd_documents


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", text or "")].append((doc_id, len(text or "")))
    out = []
    for normal, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        sha = hashlib.sha256(normal.encode()).hexdigest()
        out += [(m, keep, len(members), m == keep, sha) for m, _ in members]
    return sorted(out, key=repr)


def test_groups_match_brute_force(spark):
    got = [tuple(r) for r in exact_groups(odd_documents(spark)).collect()]
    assert sorted(got, key=repr) == brute([r[:2] for r in ODD])


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in exact_groups(docs).collect()), key=repr) == brute(rows)


def test_one_row_of_each_group_stays_with_its_columns(spark):
    docs = odd_documents(spark)
    kept = drop_copies(docs)
    assert kept.schema == docs.schema
    # the longest original of a text stays, and rows that repeat an id and its text leave one
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 6, 7, 8, 9, 10]


def test_empty_table(spark):
    assert exact_groups(no_documents(spark)).count() == 0
    assert drop_copies(no_documents(spark)).count() == 0
