"""Near-duplicate vectors by product quantisation.

Vectors are compared by cosine when their labels are equal. Those with the same label and the same
components form a class, and classes of one label and dimension are indexed together:

- coarse inverted lists: each unit vector belongs to its nearest centroid;
- residual codes: the difference to the centroid is cut into subspaces, each coded by its nearest
  codeword, and the distance between a vector and its code is kept beside it.

A query probes the lists whose centroids are nearest to it, as many as the quantiser's sample shows to be
sufficient: vectors at the limit from sample vectors, in random directions and towards other sample
vectors, find the list of the vector they were made from among so many in a share ``recall`` of the
cases; nearer ones find it more often. The number grows more slowly than the number of lists, so a query
meets a falling share of the vectors. With ``recall=None`` a query probes every list that can hold a vector
near enough: one nearer to the list's centroid than to the query's own lies beyond the plane halfway
between the two, so only lists whose plane is farther than the radius are left out, and no pair is lost.

In a list, distances to codes are sums of table entries; a vector is a candidate when the distance to its
code is within the radius plus the code's own distance. By the triangle inequality this step loses no
pair, however well the codes fit. Candidates are confirmed by exact cosines in double precision, so no
pair below the limit is ever linked.

The quantiser is fitted on at most ``SAMPLE`` vectors, those whose ids have the smallest hashes;
every vector is indexed and is a query. Lists and their queries are dealt in blocks of at most
``BLOCK``, however large a list or a class is; a block returns counts and the links that join its
members, never all its pairs. There is a list for about ``LIST_ROWS`` vectors up to ``MOST_LISTS``; beyond
about two million vectors lists grow longer.

Null, empty and zero vectors, vectors with null or non-finite components and null labels link with
nothing. Rows that repeat a vec_id are vectors of their own with one id. An empty table gives an
empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill.operators.components import components
from noticemill.session import written

LIMIT = 0.93
#: The most vectors the quantiser is fitted on, and the most numbers they may have together.
SAMPLE, SAMPLE_NUMBERS = 16_384, 1 << 22
#: The share of pairs at the limit that the probes find on the sample, and the sample vectors asked.
RECALL, ASKED = 0.999, 4096
SUBSPACES, CODEWORDS = 8, 64
#: One coarse list for about so many classes, within the bounds.
LIST_ROWS, FEWEST_LISTS, MOST_LISTS = 512, 8, 4096
BLOCK = 1024
#: Room for rounding in the bounds; candidates are checked exactly.
SLACK = 1e-6


class Quantiser(NamedTuple):
    centroids: np.ndarray
    #: subspace by codeword by component
    codewords: np.ndarray
    bounds: tuple[int, ...]

    def tables(self, residuals: np.ndarray) -> np.ndarray:
        """Squared distances of residuals to all codewords: row by subspace by codeword."""
        out = np.empty((len(residuals), len(self.codewords), self.codewords.shape[1]))
        for m in range(len(self.codewords)):
            a, e = self.bounds[m], self.bounds[m + 1]
            part, words = residuals[:, a:e], self.codewords[m][:, : e - a]
            out[:, m] = (part**2).sum(axis=1)[:, None] - 2 * part @ words.T + (words**2).sum(axis=1)
        return np.maximum(out, 0.0)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        parts = [
            self.codewords[m][codes[:, m], : self.bounds[m + 1] - self.bounds[m]] for m in range(len(self.codewords))
        ]
        return np.hstack(parts)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centres by Lloyd's steps from random rows; fewer distinct rows repeat."""
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        nearest = (-2 * x @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=k)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def fit(x: np.ndarray, lists: int) -> Quantiser:
    """Fit centroids, then codewords of the residuals, to unit vectors."""
    centroids = k_means(x, lists)
    residuals = x - centroids[nearest_list(x, centroids)]
    bounds = tuple(int(b) for b in np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1))
    width = max(e - a for a, e in zip(bounds, bounds[1:], strict=False))
    codewords = np.zeros((len(bounds) - 1, CODEWORDS, width))
    for m, (a, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
        codewords[m, :, : e - a] = k_means(residuals[:, a:e], CODEWORDS)
    return Quantiser(centroids, codewords, bounds)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(axis=1), 0.0)


def nearest_list(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (-2 * x @ centroids.T + (centroids**2).sum(axis=1)).argmin(axis=1)


def sufficient_probes(x: np.ndarray, centroids: np.ndarray, limit: float, recall: float, seed: int = 9) -> int:
    """How many nearest lists hold the list of a vector at cosine ``limit`` in a share ``recall`` of the
    cases: half of them in random directions, half towards other vectors of the sample."""
    rng = np.random.Generator(np.random.PCG64(seed))
    x = x[:ASKED]
    towards = rng.normal(size=x.shape)
    towards[::2] = x[rng.permutation(len(x))][::2]
    towards -= (towards * x).sum(axis=1, keepdims=True) * x
    length = np.sqrt((towards**2).sum(axis=1, keepdims=True))
    y = limit * x + np.sqrt(max(1.0 - limit * limit, 0.0)) * towards / np.maximum(length, 1e-12)
    d = distances(y, centroids)
    own = nearest_list(x, centroids)
    # centroids that coincide count together
    rank = (d <= d[np.arange(len(y)), own][:, None] + SLACK).sum(axis=1)
    return min(int(np.ceil(np.quantile(rank, recall))) + 1, len(centroids))


def probes(x: np.ndarray, centroids: np.ndarray, radius: float, n: int | None) -> np.ndarray:
    """Row by list: the ``n`` nearest lists, or all that can hold a vector within the radius."""
    d = distances(x, centroids)
    rows = np.arange(len(x))
    own = d.argmin(axis=1)
    if n is None:
        apart = np.sqrt(distances(centroids, centroids))
        out = d - d[rows, own][:, None] <= 2 * radius * apart[own] + SLACK
    else:
        out = np.zeros(d.shape, dtype=bool)
        out[rows[:, None], np.argpartition(d, n - 1, axis=1)[:, :n]] = True
    out[rows, own] = True
    return out


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _classes(rows: DataFrame) -> DataFrame:
    """(label, embedding, rep, n, no): classes of equal usable vectors with equal labels."""
    usable = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    finite = F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    some = F.exists("embedding", lambda v: v != 0)
    return (
        rows.where(usable)
        .where(finite & some)
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
        .withColumn("no", F.monotonically_increasing_id())
    )


def link_vectors(
    vectors: DataFrame,
    limit: float = LIMIT,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    recall: float | None = RECALL,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.col(label_column).alias("label"),
        F.col(vector_column).cast("array<double>").alias("embedding"),
    )
    classes = written(_classes(rows), "classes")
    results = [
        _link_dimension(classes.where(F.size("embedding") == r.d), r.n, limit, recall)
        for r in classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    ]
    spark = vectors.sparkSession
    linked = spark.createDataFrame([], LINKED)
    for one in results:
        linked = linked.unionByName(one)
    counts = linked.where("others > 0").groupBy("no").agg(F.sum("others").alias("others"))
    found = components(linked.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    of_class = (
        classes.join(counts, "no", "left")
        .join(found, F.col("rep") == found["id"], "left")
        .select(
            F.col("label").alias("_c_label"),
            F.col("embedding").alias("_c_embedding"),
            (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    same = (rows["label"] == of_class["_c_label"]) & (rows["embedding"] == of_class["_c_embedding"])
    joined = rows.join(of_class, same & rows["vec_id"].isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        F.col("vec_id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


LINKED = "no long, rep long, others long, other long"


def _link_dimension(classes: DataFrame, n: int, limit: float, recall: float | None) -> DataFrame:
    """Rows of LINKED for classes of one dimension: counts of vectors linked with a class, and
    links between classes that join all that belong together."""
    dimension = classes.select(F.size("embedding")).first()[0]
    rows = min(SAMPLE, max(SAMPLE_NUMBERS // dimension, 256))
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(rows).select("embedding").toArrow()
    lists = min(max(n // LIST_ROWS, FEWEST_LISTS), MOST_LISTS)
    units = _unit(sample.column("embedding").to_pylist())
    quantiser = fit(units, lists)
    shared = classes.sparkSession.sparkContext.broadcast(quantiser)
    radius = float(np.sqrt(max(2.0 - 2.0 * limit, 0.0)))
    n_probes = None if recall is None else sufficient_probes(units, quantiser.centroids, limit, recall)

    def index(batches):
        q = shared.value
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                x = _unit(batch.column("embedding").to_pylist())
                own = nearest_list(x, q.centroids)
                codes = q.tables(x - q.centroids[own]).argmin(axis=2)
                off = np.sqrt(((x - q.centroids[own] - q.decode(codes)) ** 2).sum(axis=1))
                row, probed = np.nonzero(probes(x, q.centroids, radius, n_probes))
                at = np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("label"),
                        batch.column("no"),
                        batch.column("rep"),
                        batch.column("n"),
                        pa.array(own, pa.int32()),
                        pa.array([c.astype(np.uint8).tobytes() for c in codes], pa.binary()),
                        pa.array(off),
                        pa.array([v.tobytes() for v in x], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(probed.astype(np.int32))),
                    ],
                    ["label", "no", "rep", "n", "list", "code", "off", "vector", "probes"],
                )

    kind = dict(classes.dtypes)["label"]
    indexed = written(
        classes.select("label", "no", "rep", "n", "embedding").mapInArrow(
            index,
            f"label {kind}, no long, rep long, n long, list int, code binary, off double, vector binary, probes array<int>",
        ),
        "index",
    )
    place = ["label", "list"]
    members = indexed.drop("probes")
    queries = indexed.select(
        "label", F.explode("probes").alias("list"), "no", "rep", "n", F.lit(None).cast("binary").alias("code"), "off", "vector"
    )
    sizes = (
        members.groupBy(*place)
        .agg(F.ceil(F.count("*") / BLOCK).alias("m_blocks"))
        .join(queries.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).alias("q_blocks")), place)
    )
    spot = F.xxhash64("no")
    m_side = members.join(sizes, place).select(
        *members.columns,
        F.lit(True).alias("member"),
        F.pmod(spot, "m_blocks").alias("m_block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks") - 1)).alias("q_block"),
    )
    q_side = queries.join(sizes, place).select(
        *queries.columns,
        F.lit(False).alias("member"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("m_blocks") - 1)).alias("m_block"),
        F.pmod(spot, "q_blocks").alias("q_block"),
    )

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        return compare_block(block, shared.value, limit, radius)

    return written(
        m_side.unionByName(q_side).groupBy("label", "list", "m_block", "q_block").applyInPandas(compare, LINKED), "linked"
    )


def compare_block(block: pd.DataFrame, q: Quantiser, limit: float, radius: float) -> pd.DataFrame:
    """Rows of LINKED for the queries and members of one block of a list."""
    member = block["member"].to_numpy()
    m, asked = block[member], block[~member]
    if not len(m) or not len(asked):
        return pd.DataFrame(columns=["no", "rep", "others", "other"]).astype("int64")
    x = np.vstack([np.frombuffer(v, np.float64) for v in m["vector"]])
    y = np.vstack([np.frombuffer(v, np.float64) for v in asked["vector"]])
    codes = np.vstack([np.frombuffer(c, np.uint8) for c in m["code"]]).astype(np.int64)
    reach = radius + m["off"].to_numpy() + SLACK
    m_no, m_rep, m_n = (m[c].to_numpy() for c in ("no", "rep", "n"))
    q_no, q_rep = asked["no"].to_numpy(), asked["rep"].to_numpy()
    everyone, group = np.unique(np.concatenate([m_no, q_no]), return_inverse=True)
    group, joined = group.copy(), np.arange(len(everyone))
    m_at, q_at = group[: len(m_no)], group[len(m_no) :]
    residuals = y - q.centroids[int(m["list"].iloc[0])]
    out = []
    for first in range(0, len(y), 128):
        tables = q.tables(residuals[first : first + 128])
        near = np.zeros((len(tables), len(x)))
        for s in range(codes.shape[1]):
            near += tables[:, s, codes[:, s]]
        candidate = (np.sqrt(near) <= reach) & (m_no != q_no[first : first + 128, None])
        for k in np.flatnonzero(candidate.any(axis=1)).tolist():
            at = np.flatnonzero(candidate[k])
            at = at[x[at] @ y[first + k] >= limit]
            if not len(at):
                continue
            out.append((q_no[first + k], q_rep[first + k], int(m_n[at].sum()), None))
            own = joined[q_at[first + k]]
            fresh, which = np.unique(joined[m_at[at]], return_index=True)
            for g, w in zip(fresh.tolist(), which.tolist(), strict=True):
                if g != own:
                    out.append((q_no[first + k], q_rep[first + k], 0, m_rep[at[w]]))
                    joined[joined == g] = own
    frame = pd.DataFrame(out, columns=["no", "rep", "others", "other"])
    return frame.astype({"no": "int64", "rep": "int64", "others": "int64", "other": "Int64"})
