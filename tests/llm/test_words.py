"""Words that a weak hash mixes up, in every operator that tells words apart by fingerprints."""

import re
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from noticemill.llm import language_model, memory, minhash, packing, quality, token_counts, toxicity
from noticemill.llm.encoder import Encoder
from noticemill.llm.words import CHUNK_BYTES, SHORT, find_words

PATH = public_tokenizers.path("word_bpe_49k.json")


def thue_morse(n, letters="ab"):
    """A word and its complement: they agree in every sum that a polynomial modulo 2**64 can tell."""
    word = "".join(letters[bin(k).count("1") % 2] for k in range(n))
    return word, word.translate(str.maketrans(letters, letters[::-1]))


LENGTHS = [8, 32, SHORT, SHORT + 1, 1024, 2048, 4096]
PAIRS = [w for n in LENGTHS for w in thue_morse(n)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def prints(texts, **options):
    return [w.prints[a:e].tolist() for w in find_words(pa.array(texts), fold=True, **options) for a, e in zip(w.of, w.of[1:], strict=False)]


def test_fingerprints_differ():
    found = {p for (p,) in prints(PAIRS)}
    assert len(found) == len(PAIRS)
    short = ["".join(c) for n in (1, 2, 3) for c in __import__("itertools").product("abc", repeat=n)]
    assert len({p for (p,) in prints(short)}) == len(short)


def test_case_and_place_do_not_matter():
    text = "Word x" + "Y" * 100 + " wORD  X" + "y" * 100
    a, b, c, d = prints([text])[0]
    assert a == c and b == d
    assert prints(["a", text, "", "b"])[1] == [a, b, c, d]


def test_long_texts_are_cut_between_words():
    words = ["x" * (k % 90 + 1) + str(k) for k in range(100_000)]
    text = " ".join(words)
    assert len(text) > 3 * CHUNK_BYTES
    (found,) = find_words(pa.array([text]), fold=False)
    assert [found.text(k) for k in range(len(words))] == words
    assert found.prints.tolist() == [p for part in prints_of_each(words) for p in part]
    one = "y" * (3 * CHUNK_BYTES)
    (found,) = find_words(pa.array([f"{one} a"]), fold=False)
    assert [found.text(0) == one, found.text(1)] == [True, "a"]


def prints_of_each(words):
    return [w.prints.tolist() for w in find_words(pa.array(words), fold=False)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"{w} is here") for k, w in enumerate(PAIRS)] + [(100 + k, w) for k, w in enumerate(PAIRS)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_language_model_knows_only_what_it_has_seen(docs):
    seen = docs.where("doc_id < 100 AND doc_id % 2 = 0")
    model = language_model.train(seen)
    rows = {r.doc_id: r for r in language_model.score(docs.where("doc_id >= 100"), model).collect()}
    assert {k: r.n_known for k, r in rows.items()} == {100 + k: 2 - k % 2 for k in range(len(PAIRS))}


def test_token_counts_and_packing_give_the_librarys_ids(docs):
    tokenizer = Tokenizer.from_file(PATH)
    texts = dict(tuple(r) for r in docs.collect())
    ids = {k: tokenizer.encode(t, add_special_tokens=False).ids for k, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PATH).collect()} == {k: len(i) for k, i in ids.items()}
    for r in packing.pack_documents(docs, PATH).collect():
        own = np.array([*ids[r.doc_id], 1][r.start : r.start + r.length], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(own.tobytes())


def test_encoder_forgets_within_its_memory(monkeypatch):
    monkeypatch.setattr("noticemill.llm.encoder.MOST_BYTES", 20_000)
    encoder = Encoder(PATH)
    texts = [" ".join(f"w{k}x{j}" for j in range(50)) for k in range(40)]
    found = [e for _ in range(2) for e in encoder.encode(pa.array(texts))]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [i for e in found for i in e.ids.tolist()] == [i for ids in want * 2 for i in ids]


def test_near_groups_keep_them_apart(docs):
    rows = minhash.near_groups(docs).collect()
    assert all(r.kept for r in rows) and len(rows) == 2 * len(PAIRS)


def test_classifiers_tell_them_apart():
    column = pa.array(PAIRS)
    units = quality.Units({})
    hashes = [h for words in find_words(column, fold=False) for h in units.of(words)[1][:, 1].tolist()]
    assert len(set(hashes)) == len(PAIRS) == len(units.known)
    scorer = toxicity.Scorer(np.zeros((28, 28, 28)), None)
    assert len({tuple(sorted(f)) for f in scorer.texts(column)}) == len(PAIRS)


def test_a_worker_keeps_one_object():
    first = memory.keep("a", list)
    assert memory.keep("a", list) is first
    assert memory.keep("b", dict) == {} and memory.keep("a", list) is not first


MEMORY = """
import resource, sys
import numpy as np, pyarrow as pa
from noticemill.llm import {module}
from noticemill.llm.words import find_words
text = ("some words of five letters and more " * (50_000_000 // 36))[:50_000_000]
column = pa.array([text])
del text
{work}
peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
sys.exit(0 if peak < 1000 else f"{{peak:.0f}} MB")
"""


@pytest.mark.parametrize(
    ("module", "work"),
    [
        ("words", "for w in find_words(column, fold=True): assert len(w.prints) > 9_000_000"),
        ("minhash", "assert len(next(minhash.shingle_sets(column))) > 0"),
        ("encoder", "import public_tokenizers\nfor e in encoder.Encoder(public_tokenizers.path('word_bpe_49k.json')).encode(column): assert len(e.ids)"),
    ],
)
def test_a_text_of_50_mb_fits_in_a_gigabyte(module, work):
    done = subprocess.run([sys.executable, "-c", MEMORY.format(module=module, work=work)], capture_output=True, text=True, cwd=".")
    assert done.returncode == 0, done.stderr[-500:]
