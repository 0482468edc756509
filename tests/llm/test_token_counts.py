import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from noticemill.llm.encoder import MOST_BYTES, Encoder
from noticemill.llm.token_counts import count_tokens, read_cache

from .helpers import ODD, no_documents, odd_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(texts, path=PATH):
    tokenizer = Tokenizer.from_file(path)
    return [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_are_those_of_the_library(spark):
    rows = {r.doc_id: r for r in count_tokens(odd_documents(spark), PATH).collect()}
    for (doc_id, text, *_), n in zip(ODD, brute([r[1] for r in ODD]), strict=True):
        assert rows[doc_id].n_tokens == n
        assert rows[doc_id].n_bytes == len((text or "").encode())
        assert rows[doc_id].over_limit == (n > 2048)


def test_documents_agree_with_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = dict(tuple(r) for r in docs.select("doc_id", "text").collect())
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, PATH).collect()}
    assert got == dict(zip(texts, brute(texts.values()), strict=True))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_vocabularies_get_whole_texts(spark, name):
    path = public_tokenizers.path(name)
    got = {r.doc_id: r.n_tokens for r in count_tokens(odd_documents(spark), path).collect()}
    assert got == dict(zip([r[0] for r in ODD], brute([r[1] for r in ODD], path), strict=True))


def test_only_misses_are_encoded_and_appended(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    docs = odd_documents(spark)
    first = sorted(map(repr, count_tokens(docs.where("doc_id <= 5"), PATH, cache).collect()))
    stored = read_cache(spark, cache).count()
    assert stored == 2  # the two spellings differ in white space only, and one text is white space
    assert sorted(map(repr, count_tokens(docs.where("doc_id <= 5"), PATH, cache).collect())) == first
    assert read_cache(spark, cache).count() == stored
    count_tokens(docs, PATH, cache).collect()
    assert read_cache(spark, cache).groupBy("digest").count().where("count > 1").count() == 0


def test_empty_table(spark):
    assert count_tokens(no_documents(spark), PATH).count() == 0


def test_pieces_are_bytes():
    """Words go to the library as the bytes they are remembered by, letters straight to the merges."""
    encoder = Encoder(PATH)
    library = Tokenizer.from_file(PATH)
    words = ["Plain", "plain", "naïve", "42", "漢字", "...", "QuiteLongCompoundWord", "x9"]
    expected = [library.encode(word, add_special_tokens=False).ids for word in words]
    assert encoder._pieces([word.encode() for word in words]) == expected
    encoder.size = MOST_BYTES  # the words met so far become the older ones, and are found there
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder._ids([w.encode() for w in words])] == expected
    assert not encoder.older
    encoder.size = MOST_BYTES
    held = encoder._ids([w.encode() for w in ["new", *words]])
    assert [np.frombuffer(ids, "<u4").tolist() for ids in held[1:]] == expected
    assert set(encoder.known) == {b"new", *(w.encode() for w in words)}
