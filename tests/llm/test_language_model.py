import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from noticemill.llm.language_model import discounts, score, train, train_and_score

from .helpers import ODD, no_documents, odd_documents


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "</s>"]


def brute(training, texts):
    """Modified Kneser-Ney bigrams with dictionaries: (n_tokens, n_known, tokens, base, score)."""
    words, pairs = Counter(), Counter()
    for text in training:
        seq = tokens(text)
        words.update(seq)
        pairs.update(zip(["<s>", *seq], seq))
    follow, context, kinds = defaultdict(Counter), Counter(), Counter()
    for (u, w), n in pairs.items():
        follow[u][min(n, 3)] += 1
        context[u] += n
        kinds[w] += 1
    of = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
    high, low = discounts(of(pairs)), discounts(of(kinds))
    less = lambda n, d: max(n - (0, *d)[min(n, 3)], 0)
    total, size, n_words = sum(kinds.values()), len(words), sum(words.values())
    even = sum(low[min(n, 3) - 1] for n in kinds.values())
    out = []
    for text in texts:
        seq = tokens(text)
        base = logp = 0.0
        for u, w in zip(["<s>", *seq], seq):
            base += math.log10((words[w] + 0.5) / (n_words + 0.5 * (size + 1)))
            p = (less(kinds[w], low) + even / (size + 1)) / total if total else 1 / (size + 1)
            if context[u]:
                p = (less(pairs[u, w], high) + sum(high[k - 1] * follow[u][k] for k in (1, 2, 3)) * p) / context[u]
            logp += math.log10(p)
        out.append((len(seq), sum(w in words for w in seq), n_words, base, logp))
    return out


def same(rows, want):
    for r, (n, known, total, base, logp) in zip(rows, want, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(logp, rel=1e-9, abs=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-logp / n), rel=1e-9)


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sorted(train_and_score(docs.repartition(5)).collect())
    assert [r.held_out for r in rows] == [held(r.doc_id) for r in rows]
    same(rows, brute([t for i, t in texts.items() if not held(i)], [texts[r.doc_id] for r in rows]))
    # on unseen texts the model does better than the unigrams
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_odd_rows(spark):
    rows = train_and_score(odd_documents(spark)).collect()
    want = brute([r[1] for r in ODD if not held(r[0])], [r[1] for r in ODD])
    key = lambda r: (r[0] is None, r[0] or 0)
    order = sorted(range(len(ODD)), key=lambda k: key(ODD[k]))
    same(sorted(rows, key=key), [want[k] for k in order])


def test_probabilities_add_up_to_one(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b a c", "b a b", "c c a", "d"])], "doc_id long, text string")
    model = train(docs, shards=3)
    vocabulary = ["a", "b", "c", "d", "unseen"]
    probes = [(k, " ".join(["a", w])) for k, w in enumerate(vocabulary)]
    frame = spark.createDataFrame([*probes, (9, "a")], "doc_id long, text string")
    rows = {r.doc_id: r.score for r in score(frame, model).collect()}
    alone = brute(["a b a c", "b a b", "c c a", "d"], ["a", *[t for _, t in probes]])
    assert rows[9] == pytest.approx(alone[0][4])
    first = {t: s[4] for (_, t), s in zip(probes, alone[1:], strict=True)}
    assert all(rows[k] == pytest.approx(first[t]) for k, t in probes)


@pytest.mark.parametrize("wide", [False, True])
def test_hashed_pairs_of_wide_ids_give_the_same(spark, wide):
    """What a corpus of more than 2**32 distinct words takes, forced on a small one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    texts = [r.text for r in docs.collect()]
    model = train(docs, shards=5, wide=wide)
    assert model.wide == wide
    rows = {r.doc_id: r for r in score(docs, model).collect()}
    ids = [r.doc_id for r in docs.collect()]
    same([rows[i] for i in ids], brute(texts, texts))


def test_stores_go_by_the_names_that_arrow_knows(monkeypatch):
    from noticemill.llm import store

    seen = []
    monkeypatch.setattr(store.fs, "FileSystem", type("Any", (), {"from_uri": staticmethod(seen.append)}))
    for folder in ("s3a://bucket/a", "s3n://bucket/a", "hdfs://name/a", "file:///tmp/a", "/tmp/a"):
        store.opened(folder)
    assert seen == ["s3://bucket/a", "s3://bucket/a", "hdfs://name/a", "file:///tmp/a", "/tmp/a"]


def test_empty_tables(spark):
    assert train_and_score(no_documents(spark)).count() == 0
    model = train(no_documents(spark))
    row = score(odd_documents(spark).where("doc_id = 10"), model).first()
    assert (row.score, row.base_score, row.n_known) == (0.0, 0.0, 0)
