import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from noticemill.llm.packing import Piece, balance, pack_documents

from .helpers import ODD, no_documents, odd_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, capacity=2048, padding=0.05):
    """Every id lies in one piece, sequences are gapless and within capacity, little is padding."""
    tokenizer = Tokenizer.from_file(PATH)
    ids = [
        (doc_id, [*e.ids, 1])
        for (doc_id, _), e in zip(
            docs, tokenizer.encode_batch([t or "" for _, t in docs], add_special_tokens=False), strict=True
        )
    ]
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    wanted = defaultdict(list)
    for doc_id, one in ids:
        wanted[doc_id].append(one)
    for doc_id, copies in wanted.items():
        assert sum(r.length for r in pieces[doc_id]) == sum(map(len, copies))
        for r in pieces[doc_id]:
            crcs = {zlib.crc32(np.array(c[r.start : r.start + r.length], "<u4").tobytes()) for c in copies}
            assert r.ids_crc32 in crcs and r.doc_tokens in {len(c) for c in copies}
        if len(copies) == 1:
            at = 0
            for r in sorted(pieces[doc_id], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
    total = sum(len(one) for _, one in ids)
    assert len(sequences) * capacity - total <= max(capacity, padding * total)


def test_odd_rows(spark):
    check(pack_documents(odd_documents(spark), PATH).collect(), [r[:2] for r in ODD])


def test_documents_over_many_tasks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(pack_documents(docs, PATH).collect(), texts, padding=0.002)
    check(pack_documents(docs.repartition(40, "doc_id"), PATH).collect(), texts, padding=0.002)


def test_costs_are_balanced():
    rng = random.Random(3)
    pieces = [Piece(k, 0, np.zeros(rng.choice([10, 60, 300, 1500]), "<u4"), 0) for k in range(400)]
    total = sum(len(p.ids) for p in pieces)
    placed, over = balance(pieces, total // 2048, 2048)
    assert sum(len(p.ids) for _, _, p in placed) == total // 2048 * 2048
    assert sum(len(p.ids) for p in over) == total % 2048
    cost = defaultdict(float)
    for to, _, p in placed:
        cost[to] += len(p.ids) ** 2
    assert max(cost.values()) < 3 * min(cost.values())


def test_empty_table(spark):
    assert pack_documents(no_documents(spark), PATH).count() == 0
