import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from noticemill.llm import quality
from noticemill.llm.learning import labelled_sample
from noticemill.llm.quality import (
    _BYTE_KINDS,
    DIMENSIONS,
    WINDOW,
    Shapes,
    Units,
    calibrate,
    common_units,
    pooled,
    print_of,
    random_vectors,
    shape,
    split_units,
    train_and_score,
    train_network,
    unit_vectors,
    units_of,
)

from .helpers import no_documents, odd_documents


def test_shapes_and_fixed_vectors():
    assert [shape(w) for w in ("Thing,", "THE!!", "naïve", "a1b22")] == ["#Xx,", "#X!", "#x", "#x9x9"]
    assert shape("aB" * 20) == "#" + "xX" * 20  # whole, however long
    assert units_of("x" * 100)[1] == "x" * 100
    (v,) = vector("#Xx")
    assert set(np.unique(v)) <= {-1, 0, 1} and np.array_equal([v], vector("#Xx"))
    assert not np.array_equal(vector("abcdefghi"), vector("abcdefghj"))


def vector(unit):
    return random_vectors(np.array([print_of(unit)], dtype=np.uint64))


TEXTS = ["The cat, the CAT sat. on 22 mats", "one", "", "the cat on the mat " * 400, "Zeta eta theta! the"]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def vectors_by_hand(texts, n):
    """Most frequent units, and for each the sum of the vectors around every place it stands at."""
    counts = Counter(u for t in texts for w in words_of(t) for u in units_of(w))
    kept = sorted(counts, key=lambda u: (-counts[u], u))[:n]
    sums = {u: np.zeros(DIMENSIONS) for u in kept}
    for text in texts:
        units = [units_of(w) for w in words_of(text)]
        for k, (a, b) in enumerate(units):
            around = sum((vector(u)[0] for j in range(k - WINDOW, k + WINDOW + 1) if j != k and 0 <= j < len(units) for u in units[j]), np.zeros(DIMENSIONS))
            for own, other in ((a, b), (b, a)):
                if own in sums:
                    sums[own] += around + vector(other)[0]
    return {u: v / np.linalg.norm(v) if v.any() else vector(u)[0] / np.linalg.norm(vector(u)[0]) for u, v in sums.items()}


def test_vectors_and_pooling_match_brute_force(spark):
    """Counts and contexts over all texts; units that are not kept stand for themselves."""
    docs = spark.createDataFrame([(t,) for t in TEXTS * 7], "text string").repartition(3)
    for n in (5, 1000):
        want = vectors_by_hand(TEXTS * 7, n)
        assert common_units(docs, n) == list(want)
        place, vectors = unit_vectors(docs, n)
        for unit, k in place.items():
            assert np.allclose(vectors[k], want[unit], atol=1e-5)
        got = pooled(Units(place), vectors, pa.array(TEXTS))
        for text, x in zip(TEXTS, got, strict=True):
            units = [u for w in words_of(text) for u in units_of(w)]
            if not units:
                assert not x.any()
                continue
            rows = np.array([want[u] if u in want else sparse(u) for u in units])
            assert np.allclose(x[:DIMENSIONS], rows.mean(axis=0), atol=1e-5)
            assert np.allclose(x[DIMENSIONS:-2] ** 2, rows.var(axis=0), atol=1e-5)
            assert np.allclose(x[-2:], [np.log1p(len(units) / 2), 2 * len(set(words_of(text))) / len(units)])


def sparse(unit):
    """The vector of a unit that is not kept."""
    (v,) = vector(unit)
    return v / np.linalg.norm(v)


def test_temperature_calibrates():
    rng = np.random.Generator(np.random.PCG64(5))
    logits = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert abs(calibrate(3 * logits, y) - 3) < 0.5


def test_network_learns_what_a_line_cannot():
    rng = np.random.Generator(np.random.PCG64(5))
    x = rng.normal(size=(2000, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    w1, b1, w2, b2 = train_network(x, y)
    assert (((np.tanh(x @ w1 + b1) @ w2 + b2) > 0) == (y > 0)).mean() > 0.9


def test_held_out_accuracy_on_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = train_and_score(docs, labels).join(labels, "doc_id").collect()
    assert all((r.predicted == 1) == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.93 * len(held)


def test_odd_rows_and_labels(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1), (5, 7)], "doc_id long, quality int")
    rows = train_and_score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(abs(r.score - 0.5) < 1e-9 for r in train_and_score(docs, labels.limit(0)).collect())
    assert train_and_score(no_documents(spark), labels).count() == 0


def test_sample_is_bounded_in_rows(spark):
    rows = [(1, f"text {k}") for k in range(500)] + [(k, "other") for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, quality int")
    sample = labelled_sample(docs, labels, "quality", 3, 3, rows=30)
    assert sample.columns == ["text", "y"] and sample.count() == 30
    whole = labelled_sample(docs, labels, "quality", 3, 3).collect()
    assert len(whole) == 39 and sum(r.text.startswith("text") for r in whole) == 1
    assert sorted(whole) == sorted(labelled_sample(docs.repartition(7), labels, "quality", 3, 3).collect())


def test_units_of_many_words():
    """Words taken together have the units that each has alone, and a shape is looked at once for all
    words of its kinds."""
    rng = random.Random(3)
    words = ["".join(rng.choices("aAbZ09.,-_!'éÉßΣσİ漢٣́😀x", k=rng.randrange(1, 9))) for _ in range(3000)]
    words += ["A", "é", ".", "aé", "Σ-A", "ΑΣ.", "x" * 500 + "-"]
    asked = []
    shapes = Shapes(lambda unit: asked.append(unit) or unit)
    known, letters = split_units([word.encode() for word in words * 2], shapes)
    assert list(zip(known, [unit.decode() for unit in letters], strict=True)) == [units_of(w) for w in words * 2]
    assert len(asked) <= len({word.encode().translate(_BYTE_KINDS) for word in words}) + 1  # one is too long


@pytest.mark.parametrize("many", [1, 1000])
def test_contexts_are_added_up_once_per_place(monkeypatch, many):
    """Whatever the blocks, and whichever way the rows of a place are summed; rows are grouped in few calls."""
    rng = random.Random(4)
    texts = ["", "one", " ".join(rng.choice(["a", "B", "c1", "##", "b", "Zé,", "x"]) for _ in range(5000)), "a ## b"]
    place = {u: k for k, u in enumerate(["#x", "#X", "a", "b", "##", "c1"])}
    wanted = np.zeros((len(place), quality.DIMENSIONS), dtype=np.int64)

    def vector(unit):
        return quality.random_vectors(np.array([quality.print_of(unit)], dtype=np.uint64))[0].astype(np.int64)

    for text in texts:
        pairs = [quality.units_of(w) for w in text.split()]
        for i, own in enumerate(pairs):
            near = [u for j in range(max(i - 2, 0), min(i + 3, len(pairs))) if j != i for u in pairs[j]]
            for side in (0, 1):
                if own[side] in place:
                    wanted[place[own[side]]] += sum(vector(u) for u in [*near, own[1 - side]])
    calls = []
    add_rows = quality._add_rows
    monkeypatch.setattr(quality, "_add_rows", lambda *given: (calls.append(1), add_rows(*given)))
    monkeypatch.setattr(quality, "MANY_ROWS", many, raising=False)
    for together in (quality.TOGETHER, 7):
        calls.clear()
        monkeypatch.setattr(quality, "TOGETHER", together)
        sums = np.zeros_like(wanted)
        quality.add_contexts(sums, quality.Units(place), pa.array(texts))
        assert (sums == wanted).all()
        if together > 7:
            assert len(calls) == 2


def test_words_are_split_once(monkeypatch):
    """Counting and contexts take a word of many batches apart once, and the counts are whole."""
    texts = [f"the Cat, {k % 7} sat## naïve{k % 3} --" for k in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[a : a + 20])], ["text"]) for a in range(0, 400, 20)]
    split = []

    class Texts:
        def mapInArrow(self, run, _):
            self.sent = list(run(iter(batches)))
            raise InterruptedError

    monkeypatch.setattr(quality, "split_units", lambda words, shapes: (split.extend(words), split_units(words, shapes))[1])
    for gather in (quality.GATHER, 5):
        split.clear()
        monkeypatch.setattr(quality, "GATHER", gather)
        taken = Texts()
        with pytest.raises(InterruptedError):
            common_units(taken)
        counts = Counter()
        for sent in taken.sent:
            counts.update(dict(zip(sent.column("unit").to_pylist(), sent.column("n").to_pylist(), strict=True)))
        assert counts == Counter(u for t in texts for w in words_of(t) for u in units_of(w))
        if gather > 5:
            assert len(split) == len({w for t in texts for w in words_of(t)})
    split.clear()
    known, sums = Units({"#x": 0}), np.zeros((1, DIMENSIONS), dtype=np.int64)
    for batch in batches:
        quality.add_contexts(sums, known, batch.column("text"))
    assert len(split) == len({w for t in texts for w in words_of(t)})


def test_words_beyond_the_remembered(monkeypatch):
    """A worker that starts afresh, or takes words in small blocks, finds the same places and hashes."""
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("aBé1-", k=3)) for _ in range(50)) for _ in range(30)]
    place = {u: k for k, u in enumerate(["#x", "#X", "ab", "b", "éa", "--"])}
    for most, together in ((quality.MOST_WORDS, quality.TOGETHER), (20, 7), (80, 7)):
        monkeypatch.setattr(quality, "MOST_WORDS", most)
        monkeypatch.setattr(quality, "TOGETHER", together)
        units = Units(place)
        for text in texts:
            for words in quality.find_words(pa.array([text]), fold=False):
                held, hashes, which = units.of(words)
                pairs = [units_of(w) for w in words_of(text)]
                assert held[which].tolist() == [[place.get(u, -1) for u in pair] for pair in pairs]
                assert hashes[which].tolist() == [[print_of(u) for u in pair] for pair in pairs]


def test_sums_of_more_rows_than_16_bits_hold():
    n = 20_000
    rows = np.full((n, DIMENSIONS), quality.LARGEST, dtype=np.int8)
    rows[:, 1::2] *= -1
    places = np.full(n, 3)
    places[:5], places[5:9] = 1, -1
    sums = np.ones((5, DIMENSIONS), dtype=np.int64)
    quality._add_rows(sums, places, rows)
    for place, times in enumerate([0, 5, 0, n - 9, 0]):
        assert set(sums[place, ::2]) == {1 + times * quality.LARGEST}
        assert set(sums[place, 1::2]) == {1 - times * quality.LARGEST}


def test_sample_is_pooled_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = [(f"some words {k} " * (k % 5 + 1), k % 2) for k in range(200)]
    sample = spark.createDataFrame(rows, "text string, y int").repartition(5)
    quality.fit(sample.select("text"), sample.mapInArrow(count, "text string, y int"))
    assert seen.value == 200
