import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticemill.llm import toxicity
from noticemill.llm.toxicity import Scorer, decode, decode_spread, drop_toxic, letter_model, restore, score, spread_words, train, train_and_score
from noticemill.llm.words import find_words

from .helpers import no_documents, odd_documents

INSULTS = ["blockhead", "nitwit", "dunderhead"]
DISGUISES = ["bl0ckhe4d", "b.l.o.c.k.h.e.a.d", "n1tw1t", "n i t w i t", "duuuuunderheaaaaad", "d-u-n-d-e-r-h-e-a-d", "BL0CKHEAD!!", "n!tw!t"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Plain texts, and texts with an insult that are labelled toxic."""
    rng = np.random.Generator(np.random.PCG64(2))
    words = [f"{a}{b}" for a in ("ta", "ro", "mi", "sel", "bo", "ner", "li") for b in ("ta", "ro", "mi", "sel", "bo", "ner", "lock", "head")]
    rows = []
    for k in range(600):
        text = list(rng.choice(words, 20))
        if k % 5 == 0:
            text[int(rng.integers(20))] = str(rng.choice(INSULTS))
        rows.append((k, " ".join(text), int(k % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_disguised_words_are_restored(corpus):
    letters = letter_model(corpus[0].select("text"))
    for token, word in (("bl0ckhe4d", "blockhead"), ("b.l.o.c.k.h.e.a.d", "blockhead"), ("n1tw1t", "nitwit"), ("BL0CKHEAD!!", "blockhead")):
        assert word in restore(token, letters)
    assert decode("duuuunderheaaad", letters) == "dunderhead"
    assert restore("Rota,", letters) == ["rota"]
    assert restore("don't", letters) == ["don", "t"]


def likeliest(token, model):
    """The best of all readings of a token, each scored from its first letter to its last."""
    choices = []
    for run in toxicity._RUN.finditer(token):
        sign, n = run[1], len(run[0])
        letters = [(sign, 0.0)] if sign.isalpha() else [(c, toxicity.SIGN) for c in toxicity.LOOKS.get(sign, "")]
        times = {1: {1: 0.0}, 2: {1: toxicity.PAIR_TO_ONE, 2: 0.0}}.get(n, {1: toxicity.RUN_TO_ONE, 2: toxicity.RUN_TO_TWO})
        if letters:
            choices.append([(c * k, x + y) for c, x in letters for k, y in times.items()])
    best = (-1e9, "")
    for reading in itertools.product(*choices):
        word = "".join(c for c, _ in reading)
        classes = [0, 0, *map(toxicity._class, word), 0]
        logp = sum(x for _, x in reading) + sum(model[classes[k - 2], classes[k - 1], classes[k]] for k in range(2, len(classes)))
        best = max(best, (round(logp, 9), word))
    return best[1]


def test_decoding_finds_the_best_of_all_readings(corpus):
    letters = letter_model(corpus[0].select("text"))
    rng = random.Random(1)
    for _ in range(400):
        token = "".join(rng.choice("tarolikhed01!|+34") * rng.choice((1, 1, 1, 2, 3)) for _ in range(rng.randrange(1, 7)))
        if any(c.isalpha() for c in token):
            assert decode(token, letters) == likeliest(token, letters)


@pytest.mark.parametrize(
    ("token", "words"),
    [
        ("nittwit", ["nitwit"]), ("bblockhead", ["blockhead"]), ("n!twit", ["nitwit"]), ("!mita", ["mita", "imita"]),
        ("n.i.t.w.i.t/b.l.o.c.k.h.e.a.d", ["nitwit", "blockhead"]), ("(rota)", ["rota"]), ("rota" * 20 + "n1twit", ["nitwit"]),
        ("rota-n.i.t.w.i.t-mita", ["rota", "nitwit", "mita"]),
    ],
)
def test_every_disguise_reaches_the_decoder(corpus, token, words):
    found = restore(token, letter_model(corpus[0].select("text")))
    assert all(any(word == f or (len(token) > 60 and f.endswith(word)) for f in found) for word in words), found


def test_what_is_not_decoded_could_not_matter(corpus):
    """Scoring with and without leaving tokens out gives the same features."""
    letters = letter_model(corpus[0].select("text"))
    features = {"nitwit$": 0, "nitw": 1, "block": 2, "dunder": 3}
    some, every = Scorer(letters, features), Scorer(letters, features)
    every.telling = None
    rng = random.Random(2)
    for _ in range(300):
        word = rng.choice([*INSULTS, "rota", "mitaselbo", "letter", "booklet"])
        token = "".join(c * rng.choice((1, 1, 1, 2, 4)) if rng.random() < 0.8 else rng.choice("!01.+4") for c in word)
        assert set(some.of_word(token)) == set(every.of_word(token)), token


def test_disguised_insults_are_found_and_clean_texts_left_alone(spark, corpus):
    model = train(*corpus)
    clean = "rota mita selbo nerro 2024 4.0 bomi!! lita"
    rows = [(k, f"rota mita {d} selbo nerro") for k, d in enumerate(INSULTS + DISGUISES)] + [(99, clean), (100, None)]
    got = {r.doc_id: r.predicted for r in score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert {k: p for k, p in got.items() if not p} == {99: 0, 100: 0}


def test_held_out_accuracy_on_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = train_and_score(docs, labels).join(labels, "doc_id").collect()
    assert all((r.predicted == 1) == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows if r.held_out} == {
        r.doc_id for r in docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).join(labels, "doc_id").collect()
    }
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) >= 0.9 * len(held)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)


def test_odd_rows_and_labels(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1), (5, 7)], "doc_id long, toxic int")
    rows = train_and_score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    none = labels.limit(0)
    assert all(r.score < 0.5 and r.predicted == 0 for r in train_and_score(docs, none).collect())
    assert train_and_score(no_documents(spark), labels).count() == 0
    kept = drop_toxic(docs, none)
    assert kept.schema == docs.schema and kept.count() == docs.count()


def test_spread_runs_are_split_into_their_words(spark, corpus):
    letters = letter_model(corpus[0].select("text"))
    insults = ("nitwit", "blockhead", "dunderhead")
    for run in ("rotanitwit", "nitwitblockhead", "mitaselbo" * 12 + "dunderhead", "r0tan1tw1t"):
        words = decode_spread(run, letters)
        assert any(insult in words for insult in insults), words
    (found,) = find_words(pa.array(["so i m b é c i l e it is"]), fold=True)
    assert spread_words(found) == [(0, "imbécile")]
    model = train(*corpus)
    runs = ["m i t a n i t w i t", "r o t a m i t a " * 12 + "d u n d e r h e a d", "é n i t w i t", "r o t a m i t a"]
    rows = [(k, f"rota mita {r} selbo") for k, r in enumerate(runs)]
    got = score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.predicted for r in got} == {0: 1, 1: 1, 2: 1, 3: 0}
