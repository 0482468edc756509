import random
import re

import numpy as np
import pytest

from noticemill.llm import minhash
from noticemill.llm.minhash import Circulant, drop_near_copies, near_groups

from .helpers import ODD, no_documents, odd_documents


def brute(rows, percent=75):
    """{row number: (set size, component)} by comparing every pair."""
    sets, find = [], {}
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        sets.append(grams or ({tuple(words)} if words else set()))
    linked = list(range(len(rows)))

    def root(k):
        while linked[k] != k:
            k = linked[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]) and rows[a][0] is not None and rows[b][0] is not None:
                linked[root(a)] = root(b)
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            find[root(k)] = min(find.get(root(k), doc_id), doc_id)
    return sorted(((i, len(sets[k]), find.get(root(k)) if i is not None else None) for k, (i, _) in enumerate(rows)), key=repr)


def same(frame, rows):
    got = frame.collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark):
    same(near_groups(odd_documents(spark)), [r[:2] for r in ODD])


def copies(rng, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.random()}"
        yield " ".join(words)


@pytest.mark.parametrize("block", [4, 256])
def test_groups_chains_and_shared_passages(spark, monkeypatch, block):
    """Large and small groups at any similarity around the limit, and texts that share a passage."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(4)
    texts = []
    for n, length, edits in ((60, 120, 6), (40, 60, 4), (12, 40, 2), (3, 30, 1)):
        texts += copies(rng, [f"w{rng.random()}" for _ in range(length)], n, edits)
    chain = [f"c{k}" for k in range(200)]
    texts += [" ".join(chain[k * 5 : k * 5 + 100]) for k in range(15)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + " ".join(f"x{rng.random()}" for _ in range(30)) for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    same(near_groups(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_signature_is_a_turned_ring():
    circulant = Circulant(7)
    sets = np.array([3, 900, 77_777], dtype=np.uint64)
    ranks = circulant.windows[:, 0]
    slots = circulant.scatter[sets].astype(int)
    want = [min(ranks[(s + k) % minhash.SLOTS] for s in slots) for k in range(7)]
    assert circulant.signature(sets).tolist() == want


def test_kept_rows_have_all_columns(spark):
    docs = odd_documents(spark)
    kept = drop_near_copies(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]


def test_empty_table(spark):
    assert near_groups(no_documents(spark)).count() == 0
    assert drop_near_copies(no_documents(spark)).count() == 0
