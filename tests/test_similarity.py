import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from noticemill import session
from noticemill.functions.stopwords import ENGLISH
from noticemill.operators import similarity
from noticemill.operators.approximate import find_duplicates_approximately
from noticemill.operators.similarity import corpus, find_duplicates, prefix_pairs, profiles
from noticemill.operators.tfidf import scaled, vocabulary, postings, weights


def brute(texts, threshold, max_terms=10_000, stop=()):
    """Every pair, in plain Python."""
    bags = {i: Counter(w for w in re.findall(r"\w\w+", t.lower()) if w not in stop) for i, t in texts.items()}
    cf, df = Counter(), Counter()
    for bag in bags.values():
        cf.update(bag)
        df.update(bag.keys())
    kept = sorted(cf, key=lambda w: (-cf[w], w))[:max_terms]
    idf = {w: math.log((1 + len(texts)) / (1 + df[w])) + 1 for w in kept}
    units = {}
    for i, bag in bags.items():
        x = {w: bag[w] * idf[w] for w in bag if w in idf}
        length = math.sqrt(sum(v * v for v in x.values()))
        if length:
            units[i] = {w: v / length for w, v in x.items()}
    found = {}
    for a, b in itertools.combinations(sorted(units), 2):
        s = sum(v * units[b].get(w, 0.0) for w, v in units[a].items())
        if s >= threshold:
            found[a, b] = s
    return units, found


def sample(seed, n=150, words=60, copies=40):
    rng = random.Random(seed)
    bank = [f"w{i:02d}" for i in range(words)]
    texts = {}
    for i in range(n):
        if texts and rng.random() < 0.4:
            base = rng.choice(list(texts.values())).split()
            if rng.random() < 0.6 and base:
                base[rng.randrange(len(base))] = rng.choice(bank)
            texts[i] = " ".join(base)
        else:
            texts[i] = " ".join(rng.choices(bank, [1 / (k + 1) for k in range(words)], k=rng.randint(0, 25)))
    # a group of copies as large as a third of the rows, some only proportional
    for i in range(copies):
        texts[n + i] = "Alpha beta beta" if i % 2 else "beta alpha BETA beta alpha beta"
    return texts


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc long, title string").selectExpr(
        "doc", "title", "'' AS description"
    )


def expanded(duplicates):
    """All document pairs, from the profile pairs and the members."""
    groups = {}
    for r in duplicates.members().collect():
        groups.setdefault(r.profile, []).append(r.id)
        assert r.profile <= r.id
    found = {}
    for ids in groups.values():
        found.update({pair: 1.0 for pair in itertools.combinations(sorted(ids), 2)})
    for r in duplicates.pairs.collect():
        assert (r.n_a, r.n_b) == (len(groups[r.id_a]), len(groups[r.id_b]))
        assert r.id_a < r.id_b
        for a, b in itertools.product(groups[r.id_a], groups[r.id_b]):
            found[min(a, b), max(a, b)] = r.similarity
    return found


@pytest.mark.parametrize(("seed", "threshold", "terms"), [(1, 0.85, 10_000), (2, 0.5, 30), (3, 0.95, 45)])
def test_pairs_equal_brute_force(spark, seed, threshold, terms):
    texts = sample(seed)
    _, wanted = brute(texts, threshold, terms)
    duplicates = find_duplicates(frame(spark, texts), "doc", threshold, max_terms=terms, stop_words=())
    got = expanded(duplicates)
    assert set(got) == set(wanted)
    assert all(abs(got[p] - wanted[p]) < 1e-9 for p in wanted)
    assert duplicates.pair_count().first().n_pairs == len(wanted)
    counts = Counter(i for pair in wanted for i in pair)
    assert {r.id: r.n_partners for r in duplicates.partner_counts().collect()} == counts


@pytest.mark.parametrize(
    ("threshold", "chunk", "long_list"), [(0.6, 7, 1000), (0.6, 7, 20), (0.3, 5, 10), (0.85, 64, 3)]
)
def test_cut_and_refined_lists_give_the_same_pairs(spark, threshold, chunk, long_list):
    texts = {**sample(4, n=120, copies=10), 500: "solo " * 9, 501: "solo " * 9 + "w00", 502: "solo"}
    _, wanted = brute(texts, threshold)
    shaped = profiles(scaled(corpus(frame(spark, texts), "doc"), stop_words=()))
    vectors = shaped.selectExpr("id", "1L AS n", "vector")
    rows = prefix_pairs(vectors, threshold, chunk, long_list).collect()
    got = {(r.id_a, r.id_b): r.similarity for r in rows}
    assert len(rows) == len(got)
    assert set(got) == set(wanted)
    assert all(abs(got[p] - wanted[p]) < 1e-9 for p in wanted)


def test_partners_of_chosen_documents(spark):
    texts = sample(5)
    _, wanted = brute(texts, 0.85)
    duplicates = find_duplicates(frame(spark, texts), "doc", stop_words=())
    chosen = spark.createDataFrame([(3,), (150,), (7,)], "id long")
    got = {(r.id, r.partner) for r in duplicates.partners_of(chosen).collect()}
    both = set(wanted) | {(b, a) for a, b in wanted}
    assert got == {p for p in both if p[0] in (3, 150, 7)}


@pytest.mark.parametrize(
    ("texts", "pairs"),
    [
        ({0: "Road repair project in the city", 1: "Road repair project in the city"}, 1),
        ({0: "Road repair project", 1: "Medical supplies order"}, 0),
        ({}, 0),
        ({0: "Road repair project"}, 0),
        ({0: "", 1: "a", 2: "the of"}, 0),
    ],
)
def test_small_cases(spark, texts, pairs):
    df = spark.createDataFrame(list(texts.items()), "doc long, title string").selectExpr(
        "doc", "title", "'' AS description"
    )
    assert find_duplicates(df, "doc").pair_count().first().n_pairs == pairs


def test_text_ids(spark):
    texts = {0: "one two three", 1: "one two three four", 2: "one two three"}
    df = frame(spark, texts).selectExpr("concat('r', doc) AS record_id", "title", "description")
    duplicates = find_duplicates(df, threshold=0.7)
    assert [(r.id_a, r.id_b, r.n_a) for r in duplicates.pairs.collect()] == [("r0", "r1", 2)]
    assert [(r.id, r.copy_of) for r in duplicates.copies().collect()] == [("r2", "r0")]


def test_weights_are_unit_vectors(spark):
    texts = sample(6, n=30, copies=2)
    units, _ = brute(texts, 0.85)
    rows = weights(corpus(frame(spark, texts), "doc"), stop_words=()).collect()
    assert {(r.id, r.term) for r in rows} == {(i, w) for i, u in units.items() for w in u}
    assert all(abs(r.weight - units[r.id][r.term]) < 1e-9 for r in rows)


def test_vocabulary_ranks_from_common_to_rare(spark):
    texts = {0: "aa bb cc", 1: "aa bb", 2: "aa cc cc"}
    rows = vocabulary(postings(corpus(frame(spark, texts), "doc"), ()), 2).orderBy("rank").collect()
    assert [(r.term, r.cf, r.df, r["rank"]) for r in rows] == [("aa", 3, 3, 0), ("cc", 3, 2, 1)]


def test_stop_words_are_the_ones_spark_ships(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert list(ENGLISH) == list(StopWordsRemover.loadDefaultStopWords("english"))


@pytest.mark.parametrize(("rows", "chunk", "long_list"), [(40, 512, 32768), (25, 4, 12), (25, 2, 0)])
def test_blocks_compare_every_pair_once_and_shuffle_a_vector_once_per_block(spark, monkeypatch, rows, chunk, long_list):
    texts = sample(8, n=120, copies=10)
    _, wanted = brute(texts, 0.6)
    vectors = profiles(scaled(corpus(frame(spark, texts), "doc"), stop_words=())).selectExpr("id", "1L AS n", "vector")
    monkeypatch.setattr(similarity, "BLOCK_ROWS", rows)
    blocks = similarity.block_count(vectors)
    assert blocks == -(-vectors.count() // rows) > 2
    assert similarity.in_blocks(vectors, blocks).count() == vectors.count() * blocks
    found = prefix_pairs(vectors, 0.6, chunk, long_list).collect()
    got = {(r.id_a, r.id_b): r.similarity for r in found}
    assert len(found) == len(got) and set(got) == set(wanted)
    assert all(abs(got[p] - wanted[p]) < 1e-9 for p in wanted)


def test_blocks_of_long_texts(spark, monkeypatch):
    """Vectors of many terms fill the buckets of a narrow sketch."""
    rng = random.Random(9)
    bank = [f"w{i:04d}" for i in range(1500)]
    texts = {i: " ".join(rng.choices(bank, k=rng.choice((3, 40, 900)))) for i in range(60)}
    texts |= {60 + i: texts[i] + " " + rng.choice(bank) for i in range(40)}
    _, wanted = brute(texts, 0.85)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 30)
    monkeypatch.setattr(similarity, "TILE", 8)
    assert set(expanded(find_duplicates(frame(spark, texts), "doc", stop_words=()))) == set(wanted)
    assert len(wanted) >= 30


def test_words_of_larger_files_go_to_more_tasks(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "two words")
    rows = [(i, f"alpha beta w{i % 7} " + "gamma " * 20) for i in range(4000)]
    spark.createDataFrame(rows, "id long, text string").repartition(4).write.parquet(folder)
    documents = spark.read.parquet(folder)
    before = postings(documents).rdd.getNumPartitions()
    monkeypatch.setattr(session, "TEXT_BYTES", 500)
    after = postings(documents).rdd.getNumPartitions()
    assert after >= 3 * before
    found = {r.term: (r.cf, r.df) for r in vocabulary(postings(documents)).collect()}
    assert found["gamma"] == (80_000, 4000) and found["alpha"] == (4000, 4000)


def test_counts_stand_for_the_vectors(spark):
    rows = scaled(corpus(frame(spark, sample(10)), "doc"), stop_words=())
    whole = {r.id: r for r in profiles(rows).collect()}
    table = profiles(rows, counts=True)
    idf = similarity.inverse_frequencies(table, len(sample(10)))
    for r in table.collect():
        cells = np.frombuffer(whole[r.id].vector, similarity._CELL)
        mine = similarity.weighted(r.vector, idf)
        assert r.digest == whole[r.id].digest and (mine["rank"] == cells["rank"]).all()
        assert np.allclose(mine["weight"], cells["weight"], atol=1e-12)


@pytest.mark.parametrize("arrow", [True, False])
@pytest.mark.parametrize("search", [find_duplicates, find_duplicates_approximately])
def test_partners_are_found_without_moving_pairs(spark, monkeypatch, search, arrow):
    """Asked for one in seven documents, among them copies that more than one row lists."""
    texts = sample(14)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 20)
    monkeypatch.setattr(similarity, "LISTED", 8)
    monkeypatch.setattr(similarity, "PIECE_CELLS", 64)
    duplicates = search(frame(spark, texts), "doc", stop_words=())
    wanted = expanded(duplicates)
    wanted |= {(b, a): s for (a, b), s in wanted.items()}
    monkeypatch.setattr(similarity, "_arrow_opens", lambda _: arrow)
    found = duplicates.partners_of(spark.range(0, len(texts), 7))
    rows = found.collect()
    got = {(r.id, r.partner): r.similarity for r in rows}
    assert len(got) == len(rows) and set(got) == {p for p in wanted if p[0] % 7 == 0}
    assert all(abs(got[p] - wanted[p]) < 1e-9 for p in got)
    # no join stands between the search and the result
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.index("Join") > plan.index("MapInArrow")


def test_partners_of_none_and_of_text_ids(spark):
    texts = {0: "one two three", 1: "one two three four", 2: "one two three", 3: "other words"}
    df = frame(spark, texts).selectExpr("concat('r', doc) AS record_id", "title", "description")
    duplicates = find_duplicates(df, threshold=0.7)
    asked = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r9",)], "id string")
    got = {(r.id, r.partner) for r in duplicates.partners_of(asked).collect()}
    assert got == {("r1", "r0"), ("r1", "r2"), ("r2", "r0"), ("r2", "r1")}
    assert duplicates.partners_of(asked.limit(0)).count() == 0


def near_texts(n, words=400):
    base = " ".join(f"word{k}" for k in range(words))
    return {i: f"{base} extra{i:03d}" for i in range(n)}


@pytest.mark.parametrize("limits", [{}, {"chunk": 4, "long_list": 12}])
def test_a_search_stores_a_vector_once_and_shuffles_no_pair(spark, monkeypatch, tmp_path, limits):
    sizes = []
    for rows in (60, 6):
        folder = tmp_path / f"of-{rows}"
        monkeypatch.setattr(similarity, "BLOCK_ROWS", rows)
        monkeypatch.setattr("noticemill.session.shared_dir", lambda _, at=folder: str(at))
        found = find_duplicates(frame(spark, near_texts(120)), "doc", **limits).pairs
        assert found.count() == 120 * 119 // 2
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        stored = [spark.read.parquet(str(f)) for f in folder.glob("noticemill/blocks-*")]
        assert [t.count() for t in stored] == [120] and stored[0].select("block").distinct().count() <= -(-120 // rows)
        sizes.append(sum(f.stat().st_size for f in folder.rglob("*.parquet")))
    assert sizes[1] < 4 * sizes[0]


def test_a_block_that_is_not_whole_is_an_error(spark, tmp_path):
    vectors = profiles(scaled(corpus(frame(spark, near_texts(9)), "doc"))).selectExpr("id", "1L AS n", "vector")
    stored = similarity.store_blocks(vectors, 2, str(tmp_path / "blocks"))
    assert sum(stored.rows.values()) == 9 and stored.block(7, None) is None
    number = min(stored.rows)
    next((tmp_path / "blocks" / f"block={number}").glob("*.parquet")).unlink()
    with pytest.raises(OSError):
        stored.block(number, None)


@pytest.mark.parametrize(("blocks", "groups"), [(1, 1), (7, 7), (7, 3), (12, 5), (40, 16)])
def test_tasks_have_each_pair_of_blocks_once(blocks, groups):
    pairs = similarity._each_once(blocks, groups)
    met = Counter(tuple(sorted((a, b))) for t in range(groups * (groups + 1) // 2) for a, others in pairs(t) for b in others)
    assert met == Counter(itertools.combinations_with_replacement(range(blocks), 2))
    crossed = similarity._crossed(blocks, 5, groups, 2)
    met = Counter((a, b) for t in range(groups * 2) for a, others in crossed(t) for b in others)
    assert met == Counter(itertools.product(range(blocks), range(5)))


def test_counts_of_many_blocks_come_from_few_tasks(spark, monkeypatch):
    """What a task adds up goes by the pairs of groups, not of blocks."""
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 2)
    found = find_duplicates(frame(spark, near_texts(80)), "doc")
    assert {r.id: r.n_partners for r in found.partner_counts().collect()} == {i: 79 for i in range(80)}
    assert found.pair_count().first().n_pairs == 80 * 79 // 2
    groups = math.ceil(math.sqrt(32 * spark.sparkContext.defaultParallelism))
    assert found.held.blocks(similarity.FILE_BYTES, 1) == 40 > groups
    assert found.pairs.rdd.getNumPartitions() == groups * (groups + 1) // 2
