import re
from collections import Counter

import corpus_pipeline
from noticemill.llm.mixture import takings

from .test_exact import brute as exact_brute
from .test_minhash import brute as near_brute
from .test_packing import check as check_packing

FOLDER = "/root/testdata/sf0.01"


def test_each_stage_matches_brute_force_on_its_own_input(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        pairs = [(r.doc_id, r.text) for r in before]
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), "test")
        rows = docs.collect()
        if name == "pack":
            check_packing(rows, pairs, padding=0.01)
            break
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert set(rows) <= set(before)
        kept = Counter(r.doc_id for r in rows)
        if name == "toxicity":
            assert sum(labels.get(r.doc_id) == 0 for r in before) == sum(labels.get(r.doc_id) == 0 for r in rows)
            assert len(rows) < len(before)
        elif name == "exact":
            assert kept == Counter(i for i, *_, stays, _ in exact_brute(pairs) if stays)
        elif name == "near":
            assert kept == Counter(i for i, _, component in near_brute(pairs) if i == component)
        elif name == "mix":
            want = {r.doc_id: r.epochs for r in takings(spark.createDataFrame(before)).collect()}
            assert kept == Counter({i: n for i, n in want.items() if n})
            words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in pairs)
            assert abs(sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows) - 1.5 * words) < 0.05 * words


def test_stages_stand_odd_rows_and_clashing_columns(spark):
    """Nulls, empty and long texts, repeats, and columns by the names the operators use."""
    from .helpers import ODD, odd_documents

    docs = odd_documents(spark).selectExpr("*", "1 AS _near_id", "2 AS _tag", "3 AS _copies", "4 AS text_")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = Counter(r.doc_id for r in docs.collect())
        docs = corpus_pipeline.written(stage(spark, docs, "/root/testdata/sf0.001"), "test")
        kept = Counter(r.doc_id for r in docs.collect())
        if name == "toxicity":
            assert kept == before == Counter(r[0] for r in ODD)
        elif name == "exact":
            assert kept == Counter([None, 4, 5, 6, 7, 8, 9, 10])
        elif name == "near":
            assert kept == before
        else:
            assert set(kept) <= set(before)
        if name != "pack":
            assert docs.columns == columns


def test_stages_of_an_empty_table(spark):
    from .helpers import no_documents

    docs = no_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, "/root/testdata/sf0.001"), "test")
        assert docs.count() == 0


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 2048
