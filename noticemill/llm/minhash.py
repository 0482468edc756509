"""MinHash near-duplicates with circulant permutations.

A document's set holds the fingerprints of its distinct 5-word shingles; a text of fewer words has
its whole word sequence as its only member, a text without words has none and is linked with
nothing. Two permutations make the whole signature: the first scatters a shingle over a ring of
slots, the second gives the slots their ranks; coordinate k reads the ranks with the ring turned by
k places. As the k-th ranks of a slot lie side by side, a signature is the minimum over windows.

1. Documents with the same set form a class, kept by its smallest id; classes meet in bands.
2. In each bucket of a band every class is compared with the smallest, on full sets. That links a
   group of copies of any size by as many comparisons as it has members.
3. Buckets whose members are still in several components compare the rest: members of different
   components, block by block inside tasks, joining components as links are found, so that a task
   returns no more links than it has members. Together with step 2 no candidate pair is left out
   unless a chain of links already joins it.

With 48 bands of 6 rows, a pair at similarity 0.75 shares a band with probability 0.9999.

Null text counts as empty. A null id is answered by itself and linked with nothing. Rows that
repeat an id are answered each by its own text; where such an id stands for a class in a
comparison, all its texts take part. Other columns are not read, except by
``drop_near_copies``, which returns them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill.llm.frames import whole_text
from noticemill.llm.memory import keep
from noticemill.llm.words import find_words, mix
from noticemill.operators.components import components
from noticemill.session import written

SHINGLE = 5
BANDS, ROWS = 48, 6
SLOTS = 1 << 22
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Members compared with each other in one step of a task.
BLOCK = 256
#: Size of the filter that finds the documents in candidate pairs.
FILTER_BITS = 1 << 24

_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Circulant:
    """The two permutations, which a Python worker keeps for further tasks."""

    def __init__(self, n: int):
        rng = np.random.Generator(np.random.PCG64(11))
        places = np.arange(SLOTS, dtype=np.uint32)
        self.scatter, ranks = rng.permutation(places), rng.permutation(places)
        ring = np.concatenate([ranks, ranks[:n]])
        self.windows = np.lib.stride_tricks.sliding_window_view(ring, n)
        self.n = n

    @classmethod
    def get(cls, n: int) -> Circulant:
        return keep(("circulant", n), lambda: cls(n))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        slots = self.scatter[shingles & np.uint64(SLOTS - 1)]
        least = np.full(self.n, SLOTS, dtype=np.uint32)
        for at in range(0, len(slots), 1024):
            np.minimum(least, self.windows[slots[at : at + 1024]].min(axis=0), out=least)
        return least


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle fingerprints."""
    for words in find_words(column, fold=True):
        prints = words.prints
        joint = np.zeros(max(len(prints) - SHINGLE + 1, 0), dtype=np.uint64)
        for j in range(SHINGLE):
            joint += prints[j : j + len(joint)] * _FACTORS[j]
        joint = mix(joint)
        for begin, end in zip(words.of[:-1], words.of[1:], strict=True):
            n = end - begin
            if n >= SHINGLE:
                yield np.unique(joint[begin : end - SHINGLE + 1])
            elif n:
                whole = (prints[begin:end] * _FACTORS[SHINGLE : SHINGLE + n]).sum(dtype=np.uint64, keepdims=True)
                yield mix(whole + _FACTORS[SHINGLE + 5 + n])
            else:
                yield np.zeros(0, dtype=np.uint64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    circulant = Circulant.get(BANDS * ROWS)
    band = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        sizes, prints, keys = [], [], []
        for shingles in shingle_sets(batch.column("text")):
            sizes.append(len(shingles))
            prints.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
            if len(shingles):
                rows = circulant.signature(shingles).astype(np.uint64).reshape(BANDS, ROWS)
                keys.append(mix((rows * _FACTORS[:ROWS]).sum(axis=1, dtype=np.uint64) + band).view(np.int64))
            else:
                keys.append(np.zeros(0, dtype=np.int64))
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array(sizes, pa.int64()),
                pa.array(prints, pa.binary()),
                pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
            ],
            ["id", "n_shingles", "print", "bands"],
        )


def _bits(ids: np.ndarray) -> np.ndarray:
    """The places of ids in the filter, two each."""
    h = mix(ids.astype(np.int64).view(np.uint64))
    return np.stack([h & np.uint64(FILTER_BITS - 1), (h >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)])


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of ids, as words of 64 bits. Its size is fixed; where there are so many ids
    that it fills up, it lets more rows pass and no row is lost."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(_bits(batch.column("id").to_numpy(zero_copy_only=False)))
            word, at = np.unique(bits >> np.uint64(6), return_index=True)
            held = np.bitwise_or.reduceat(np.uint64(1) << (bits & np.uint64(63)), at) if len(bits) else bits
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.astype(np.int64)), pa.array(held.view(np.int64))], ["word", "bits"]
            )

    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    rows = ids.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _sets(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            bits = _bits(batch.column("id").to_numpy(zero_copy_only=False))
            hit = (held[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1)
            batch = batch.filter(pa.array(hit.all(axis=0)))
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    return run


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union for two sorted sets."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent)
                for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _join_blocks(percent: int):
    def run(members: pd.DataFrame) -> pd.DataFrame:
        """Links that join components among the members of two blocks of a bucket."""
        ids = members["id"].to_numpy()
        block = members["block"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in members["shingles"]]
        _, group = np.unique(members["component"].to_numpy(), return_inverse=True)
        left, right = members["left"].iloc[0], members["right"].iloc[0]
        links = []
        for k in range(len(ids)):
            others = np.arange(k) if left == right else np.flatnonzero(block != block[k])
            others = others[others < k]
            while True:
                others = others[group[others] != group[k]]
                if not len(others):
                    break
                o, others = others[0], others[1:]
                if alike(sets[k], sets[o], percent):
                    links.append((ids[o], ids[k]))
                    group[group == group[o]] = group[k]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def near_groups(
    docs: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row."""
    texts = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))
    signed = written(
        texts.mapInArrow(_sign, "id long, n_shingles long, print binary, bands array<long>"), "signed"
    )
    usable = signed.where("id IS NOT NULL AND n_shingles > 0")
    classes = written(usable.groupBy("print").agg(F.min("id").alias("rep")), "classes")
    banded = (
        usable.join(classes.select(F.col("print").alias("_print"), "rep"), (F.col("print") == F.col("_print")) & (F.col("id") == F.col("rep")))
        .select("rep", F.explode("bands").alias("key"))
    )
    shared = banded.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("_last"), F.count("*").alias("n"))
    buckets = written(
        banded.join(shared.where("leader <> _last").select("key", "leader", "n"), "key"), "buckets"
    )
    pairs = written(
        buckets.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "pairs"
    )
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    # whole sets of the documents in pairs; texts stay where they are stored
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids))
    sets = written(
        texts.where("id IS NOT NULL").mapInArrow(_sets(shared), "id long, shingles binary"), "sets"
    )
    both = (
        pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
        .select("a", "b", "set_a", "set_b")
    )
    links = written(both.mapInArrow(_confirm(percent), "a long, b long"), "links")
    found = written(components(links), "components")
    more = written(_rest(buckets, found, sets, percent), "links")
    if not more.isEmpty():
        found = components(links.union(more))
    of_rep = classes.join(found, classes["rep"] == found["id"], "left").select(
        classes["print"].alias("_print"), F.coalesce("component", "rep").alias("component")
    )
    own = signed.join(of_rep, (signed["print"] == of_rep["_print"]) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return own.select(
        F.col("id").alias(id_column),
        "n_shingles",
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _rest(buckets: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among members of a bucket that are not its smallest and in different components."""
    known = found.select(F.col("id").alias("rep"), "component")
    members = buckets.where("n > 2").join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_keys = (
        members.where("rep <> leader")
        .groupBy("key")
        .agg(
            F.min("component").alias("_low"),
            F.max("component").alias("_high"),
            F.bit_xor(F.xxhash64("rep")).alias("_who"),
            F.max("n").alias("_n"),
        )
        .where("_low <> _high")
        # bands that hold the same members need one comparison
        .groupBy("_who", "_n", "_low", "_high")
        .agg(F.min("key").alias("key"))
        .select("key")
    )
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.hash("rep"), n_blocks)
    parts = (
        members.where("rep <> leader")
        .join(open_keys, "key")
        .select("key", F.col("rep").alias("id"), "component", block.alias("block"), n_blocks.alias("_blocks"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            "key",
            "id",
            "component",
            "block",
            F.least("block", "_other").alias("left"),
            F.greatest("block", "_other").alias("right"),
        )
    )
    return parts.join(sets, "id").groupBy("key", "left", "right").applyInPandas(_join_blocks(percent), "a long, b long")


def drop_near_copies(
    docs: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows that stay, with all columns: of each component those with its smallest id, and all
    that are linked with nothing. Rows that repeat an id stay or go together."""
    groups = near_groups(docs, percent, id_column, text_column)
    # a name that no column of the documents has
    name = "_near_id" + "_" * max(map(len, docs.columns))
    stay = groups.where("kept").select(F.col(id_column).alias(name))
    return docs.join(stay, docs[id_column].eqNullSafe(stay[name]), "left_semi")
