import math

import numpy as np
import pytest

from noticemill.llm import vectors
from noticemill.llm.vectors import link_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n int, rep long"


def usable(e):
    return e is not None and len(e) and all(c is not None and math.isfinite(c) for c in e) and any(e)


def brute(rows, limit=0.93):
    n = len(rows)
    units = [np.array(e, np.float64) / np.linalg.norm(np.array(e, np.float64)) if usable(e) else None for _, e, _ in rows]
    links, near = [0] * n, [[] for _ in rows]
    for a in range(n):
        for b in range(a):
            if (
                rows[a][2] is not None
                and rows[a][2] == rows[b][2]
                and units[a] is not None
                and units[b] is not None
                and len(units[a]) == len(units[b])
                and units[a] @ units[b] >= limit
            ):
                links[a] += 1
                links[b] += 1
                near[a].append(b)
                near[b].append(a)
    out = [None] * n
    for k in range(n):
        seen, todo = {k}, [k]
        while todo:
            for o in near[todo.pop()]:
                if o not in seen:
                    seen.add(o)
                    todo.append(o)
        low = min(rows[o][0] for o in seen)
        out[k] = (rows[k][0], links[k], low, low == rows[k][0])
    return sorted(out)


def same(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    assert sorted(map(tuple, link_vectors(frame, **options).collect())) == brute(rows)


def test_unusable_vectors_link_with_nothing(spark):
    a = [1.0, 0.5, 0.0, 0.25]
    rows = [
        (1, a, 1), (2, a, 1), (3, [2 * c for c in a], 1), (4, a, 2), (5, a, None), (6, None, 1), (7, [0.0] * 4, 1),
        (8, [], 1), (9, [1.0, None, 0.0, 0.2], 1), (10, [1.0, float("nan"), 0.0, 0.2], 1),
        (11, [float("inf"), 0.0, 0.0, 0.0], 1), (12, [1.0, 0.5], 1), (13, [1.0, 0.5], 1), (14, [-c for c in a], 1),
        (15, [1e-38, 5e-39, 0.0, 2.5e-39], 1), (16, [3e38, 1.5e38, 0.0, 7.5e37], 1), (17, [1.0, 0.5, -0.0, 0.25], 1),
    ]
    same(spark, rows)


@pytest.mark.parametrize("block", [16, 1024])
def test_groups_chains_and_copies_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.Generator(np.random.PCG64(1))
    rows = []
    for label in range(3):
        for _ in range(6):
            centre = rng.normal(size=24)
            for _ in range(15):
                rows.append((centre + rng.normal(size=24) * rng.choice([0.0, 0.2, 0.3, 0.6]), label))
        for step in range(20):  # a chain: neighbours are near, ends are not
            rows.append((np.cos(step * 0.3) * np.eye(24)[0] + np.sin(step * 0.3) * np.eye(24)[1], label))
    order = rng.permutation(len(rows))
    rows = [(int(k), [float(np.float32(c)) for c in rows[k][0]], rows[k][1]) for k in order]
    same(spark, rows, recall=None)  # every list that can hold a near vector is probed


def at_cosine(x, cosine, rng):
    """Unit vectors at a cosine from the rows of x, in random directions."""
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)


@pytest.mark.parametrize("cosine", [0.931, 0.95, 0.99])
def test_probes_find_nearly_all_pairs(spark, monkeypatch, cosine):
    """Pairs just above the limit among many lists: recall against the pairs that were made."""
    monkeypatch.setattr(vectors, "LIST_ROWS", 64)
    rng = np.random.Generator(np.random.PCG64(8))
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    both = np.vstack([x, at_cosine(x, cosine, rng)])
    frame = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(both)], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r for r in link_vectors(frame).collect()}
    linked = sum(found[k].component_id == found[k + 3000].component_id for k in range(3000))
    counted = sum(r.n_links > 0 for r in found.values())
    assert linked >= 0.998 * 3000 and counted >= 0.998 * 6000
    # the plane bound would probe nearly all of the lists
    centroids = vectors.k_means(x, 93)
    few = vectors.sufficient_probes(x, centroids, 0.93, 0.999)
    assert few < 0.5 * vectors.probes(x[:500], centroids, math.sqrt(0.14), None).sum(axis=1).mean()


def test_embeddings_match_brute_force(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = [tuple(r) for r in frame.collect()]
    assert sorted(map(tuple, link_vectors(frame).collect())) == brute(rows)


def test_empty_table(spark):
    assert link_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
