"""Interpolated modified Kneser-Ney bigrams, counted in Spark, mapped into memory by workers.

Tokens are the words of a text, A to Z lower-cased, then one end; a text's first token follows a
begin mark. Three passes over the texts, each split as the table is:

1. Words are counted. Tasks send distinct 64-bit fingerprints with counts, packed by shard; each
   shard becomes a sorted array of fingerprints beside its counts. A word's id is its place.
2. Bigrams are counted as one 64-bit number (id before, id), packed by shard in the same way; from
   2**32 words on, the number is a hash of the pair, and the two ids go beside it. A
   shard holds a range of the words before; the most frequent such words are dealt over all shards
   by the whole bigram. From its sorted array a shard derives how many words follow each word once,
   twice or more often, and how many different words each word follows.
3. Every text is scored: workers map the arrays and look up each distinct word and bigram of a chunk
   by binary search.

What moves is counts of distinct words and bigrams, never texts or tokens, and they grow with the
corpus. Only the list of shards with one row of sums each passes through the driver.

``p(w | u) = max(c(u w) - D, 0) / c(u) + gamma(u) p(w)``, with the three discounts of modified
Kneser-Ney by c(u w); p(w) is the same over the number of different words before w, spread evenly
over the words seen and one unknown. An unknown word before leaves p(w).

Null text counts as empty: its only token is the end. A null id counts as remainder 0. Repeated rows
count as often as they occur. An empty training part gives every token probability 1 over the one
unknown word, score 0. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill.llm.frames import remainder, whole_text
from noticemill.llm.memory import keep
from noticemill.llm.store import mapped, save, smallest
from noticemill.llm.words import find_words, mix
from noticemill.session import scratch_path, written

#: Tokens a task gathers before it sends their distinct counts.
GATHER = 1 << 22
#: Bytes of text per shard of the model.
SHARD_BYTES = 32 << 20
#: Of each shard's words, how many may be dealt over all shards as a word before.
TOP_WORDS = 64
END = int(mix(np.array([0xE0D], dtype=np.uint64))[0])


class Model(NamedTuple):
    """Where the arrays lie and the few numbers that go with them."""

    folder: str
    #: names of (fingerprints, counts), by shard; the first id of each shard, and the number of words
    words: list[tuple[str, str]]
    first: list[int]
    tokens: int
    #: ids whose bigrams are dealt over all shards
    spread: list[int]
    #: names of (bigrams, counts), by shard
    bigrams: list[tuple[str, str]]
    #: names of (followers seen once, twice, more often; words before), by shard of ids
    stats: list[str]
    #: discounts of bigrams and of words
    high: tuple[float, float, float]
    low: tuple[float, float, float]
    #: texts counted; sum of the words before over all words; mass for the even part
    begins: int
    kinds: int
    even: float
    #: whether a bigram is a hash of two ids, as these do not fit in 32 bits
    wide: bool = False

    @property
    def size(self) -> int:
        return self.first[-1]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from how many counts are 1, 2, 3 and 4; where
    these are too few to tell, 0.75."""
    n1, n2 = n[0], n[1]
    if not n1 or not n2:
        return (0.75, 0.75, 0.75)
    y = n1 / (n1 + 2 * n2)
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.75 for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05), float(k)) for k, d in zip((1, 2, 3), raw, strict=True))


def shard_of_print(prints: np.ndarray, shards: int) -> np.ndarray:
    """Shards in the order of fingerprints."""
    return ((prints >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def bigram(before: np.ndarray, after: np.ndarray, wide: bool) -> np.ndarray:
    """Pairs of ids as one number: side by side in 32 bits each, or hashed."""
    before, after = before.astype(np.uint64), after.astype(np.uint64)
    return mix(mix(before + np.uint64(END)) + after) if wide else (before << np.uint64(32)) | after


def shard_of_bigram(keys: np.ndarray, before: np.ndarray, model: Model) -> np.ndarray:
    """Ranges of the word before; bigrams of the words in ``spread`` go by the whole bigram."""
    shards, before = len(model.words), before.astype(np.uint64)
    dealt = np.isin(before, np.array(model.spread, dtype=np.uint64))
    return np.where(
        dealt, mix(keys) % np.uint64(shards), before * np.uint64(shards) // np.uint64(model.size + 1)
    ).astype(np.int64)


PACKED = "shard long, keys binary, counts binary, pairs binary"


def _packed(values: np.ndarray, counts: np.ndarray, shard: np.ndarray, pairs: np.ndarray | None) -> pa.RecordBatch:
    """One row per shard: its values in ascending order, their counts, and the ids of the pairs, if given."""
    order = np.argsort(shard, kind="stable")
    values, counts, shard = values[order], counts[order], shard[order]
    pairs = None if pairs is None else pairs[order]
    present, at = np.unique(shard, return_index=True)
    parts = list(zip(at, np.append(at[1:], len(shard)), strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(present.astype(np.int64)),
            pa.array([values[a:e].tobytes() for a, e in parts], pa.binary()),
            pa.array([counts[a:e].astype("<u4").tobytes() for a, e in parts], pa.binary()),
            pa.array([None if pairs is None else pairs[a:e].tobytes() for a, e in parts], pa.binary()),
        ],
        ["shard", "keys", "counts", "pairs"],
    )


def _counted_words(found: Iterator[np.ndarray], shards: int) -> Iterator[pa.RecordBatch]:
    """Distinct counts of a stream of fingerprints, sent whenever enough have been gathered."""
    held, n = [], 0
    for prints in found:
        held.append(prints)
        n += len(prints)
        if n >= GATHER:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            yield _packed(values, counts, shard_of_print(values, shards), None)
            held, n = [], 0
    if n:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        yield _packed(values, counts, shard_of_print(values, shards), None)


def _counted_pairs(found: Iterator[tuple[np.ndarray, np.ndarray]], model: Model) -> Iterator[pa.RecordBatch]:
    """The same of a stream of (ids before, ids)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def sent() -> pa.RecordBatch:
        before, after = (np.concatenate(side) for side in zip(*held, strict=True))
        keys, first, counts = np.unique(bigram(before, after, model.wide), return_index=True, return_counts=True)
        before = before[first]
        pairs = np.stack([before, after[first]], axis=1).astype("<u8") if model.wide else None
        return _packed(keys, counts, shard_of_bigram(keys, before, model), pairs)

    for before, after in found:
        held.append((before, after))
        n += len(before)
        if n >= GATHER:
            yield sent()
            held, n = [], 0
    if n:
        yield sent()


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sums of the packed counts of one shard, and the ids of the pairs, if given."""
    keys = np.concatenate([np.frombuffer(k.as_py(), "<u8") for k in table.column("keys")])
    counts = np.concatenate([np.frombuffer(c.as_py(), "<u4") for c in table.column("counts")])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    pairs = None
    if table.column("pairs").null_count == 0:
        pairs = np.concatenate([np.frombuffer(p.as_py(), "<u8") for p in table.column("pairs")]).reshape(-1, 2)[order[at]]
    return keys[at], np.add.reduceat(counts.astype(np.int64), at), pairs


def _with_ends(words) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the tokens of a chunk's texts, ends included, and where each text begins."""
    tokens = np.insert(words.prints, words.of[1:], np.uint64(END))
    return tokens, words.of + np.arange(len(words.of))


class Opened:
    """A model's arrays in a Python worker."""

    def __init__(self, model: Model):
        self.model = model
        self.maps: dict[str, np.ndarray] = {}

    @classmethod
    def of(cls, model: Model) -> Opened:
        opened = keep(("language-model", model.folder), lambda: cls(model))
        opened.model = model
        return opened

    def array(self, name: str) -> np.ndarray:
        if name not in self.maps:
            self.maps[name] = mapped(self.model.folder, name)
        return self.maps[name]

    def words(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of ascending fingerprints; unknown ones get the id -1 and the count 0."""
        ids, counts = np.full(len(prints), -1, dtype=np.int64), np.zeros(len(prints), dtype=np.int64)
        files = self.model.words
        cuts = np.searchsorted(shard_of_print(prints, len(files)), np.arange(len(files) + 1))
        for k, (keys_name, counts_name) in enumerate(files):
            part = slice(cuts[k], cuts[k + 1])
            if keys_name and part.start < part.stop:
                place, known = _find(self.array(keys_name), prints[part])
                ids[part] = np.where(known, place + self.model.first[k], -1)
                counts[part] = np.where(known, self.array(counts_name)[place], 0)
        return ids, counts

    def bigrams(self, keys: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Counts of ascending bigrams with the given ids before."""
        counts = np.zeros(len(keys), dtype=np.int64)
        shard = shard_of_bigram(keys, before, self.model)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(len(self.model.bigrams) + 1))
        for k, (keys_name, counts_name) in enumerate(self.model.bigrams):
            part = order[cuts[k] : cuts[k + 1]]
            if keys_name and len(part):
                place, known = _find(self.array(keys_name), keys[part])
                counts[part] = np.where(known, self.array(counts_name)[place], 0)
        return counts

    def stats(self, ids: np.ndarray) -> np.ndarray:
        """For ascending ids: followers seen once, twice, more often, and words before."""
        out = np.zeros((len(ids), 4), dtype=np.int64)
        shards = len(self.model.stats)
        cuts = np.searchsorted(ids, _id_cuts(self.model.size, shards))
        for k, name in enumerate(self.model.stats):
            part = slice(cuts[k], cuts[k + 1])
            if name and part.start < part.stop:
                table = self.array(name).reshape(-1, 4)
                out[part] = table[ids[part] - _id_cuts(self.model.size, shards)[k]]
        return out


def _id_cuts(size: int, shards: int) -> np.ndarray:
    """Bounds of the ranges of ids 0 to ``size``, the last of which is the begin mark."""
    return np.arange(shards + 1, dtype=np.int64) * (size + 1) // shards


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def _bigram_ids(opened: Opened, tokens: np.ndarray, starts: np.ndarray):
    """For a chunk: distinct tokens' ids and counts, each token's place among them, the id before
    each token, and its own; an unknown word has the id -1."""
    prints, which = np.unique(tokens, return_inverse=True)
    ids, counts = opened.words(prints)
    each = ids[which]
    before = np.empty_like(each)
    before[1:] = each[:-1]
    before[starts] = opened.model.size
    return ids, counts, which, before, each


def train(
    docs: DataFrame, text_column: str = "text", shards: int | None = None, wide: bool | None = None
) -> Model:
    """Count the documents' words and bigrams into a model in the shared folder. ``wide`` says whether
    bigrams are hashed pairs; by default they are once ids need more than 32 bits."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "language-model")
    texts = docs.select(whole_text(text_column).alias("text"))
    if shards is None:
        size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        shards = max(8, -(-size // SHARD_BYTES))
    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = (_with_ends(w)[0] for b in batches for w in find_words(b.column("text"), fold=True))
        yield from _counted_words(tokens, shards)

    def merge_words(table: pa.Table) -> pa.Table:
        keys, counts, _ = _merged(table)
        top = np.argsort(-counts, kind="stable")[:TOP_WORDS]
        return pa.table(
            {
                "shard": [table.column("shard")[0].as_py()],
                "keys": [save(folder, keys)],
                "counts": [save(folder, smallest(counts))],
                "n": [len(keys)],
                "tokens": [int(counts.sum())],
                "top": [top.tolist()],
                "top_counts": [counts[top].tolist()],
                "ends": [int(counts[keys == np.uint64(END)].sum())],
            },
            schema=pa.schema(
                [
                    ("shard", pa.int64()),
                    ("keys", pa.string()),
                    ("counts", pa.string()),
                    ("n", pa.int64()),
                    ("tokens", pa.int64()),
                    ("top", pa.list_(pa.int64())),
                    ("top_counts", pa.list_(pa.int64())),
                    ("ends", pa.int64()),
                ]
            ),
        )

    rows = (
        texts.mapInArrow(count_words, PACKED)
        .groupBy("shard")
        .applyInArrow(
            merge_words,
            "shard long, keys string, counts string, n long, tokens long, top array<long>, "
            "top_counts array<long>, ends long",
        )
        .collect()
    )
    files, sizes = [("", "")] * shards, [0] * shards
    for r in rows:
        files[r.shard], sizes[r.shard] = (r["keys"], r["counts"]), r.n
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(int).tolist()
    if wide is None:
        wide = first[-1] >= (1 << 32) - 1
    tokens = sum(r.tokens for r in rows)
    spread = [
        first[r.shard] + place
        for r in rows
        for place, n in zip(r.top, r.top_counts, strict=True)
        if 4 * shards * n > tokens
    ] + [first[-1]]
    model = Model(folder, files, first, tokens, spread, [], [], (0,) * 3, (0,) * 3, sum(r.ends for r in rows), 0, 0.0, wide)
    return _count_bigrams(texts, model)


def _count_bigrams(texts: DataFrame, model: Model) -> Model:
    folder, shards = model.folder, len(model.words)
    id_kind = "<u8" if model.wide else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = Opened.of(model)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for words in find_words(batch.column("text"), fold=True):
                    chunk, starts = _with_ends(words)
                    yield _bigram_ids(opened, chunk, starts[:-1])[-2:]

        yield from _counted_pairs(pairs(), model)

    ranges = _id_cuts(model.size, shards)
    schema = pa.schema(
        [
            ("shard", pa.int64()),
            ("keys", pa.string()),
            ("counts", pa.string()),
            ("n", pa.list_(pa.int64())),
            ("part", pa.int64()),
            ("ids", pa.binary()),
            ("values", pa.binary()),
        ]
    )

    def merge(table: pa.Table) -> pa.Table:
        keys, counts, pairs = _merged(table)
        if pairs is None:
            pairs = np.stack([keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)], axis=1)
        names = save(folder, keys), save(folder, smallest(counts))
        n = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        shard = table.column("shard")[0].as_py()
        out = [(shard, *names, n, None, None, None)]
        before, at = np.unique(pairs[:, 0].astype(np.int64), return_inverse=True)
        after, kinds = np.unique(pairs[:, 1].astype(np.int64), return_counts=True)
        ids = np.union1d(before, after)
        values = np.zeros((len(ids), 4), dtype="<u4")
        place = np.searchsorted(ids, before)
        for column, seen in enumerate((counts == 1, counts == 2, counts > 2)):
            values[place, column] = np.bincount(at[seen], minlength=len(before))
        values[np.searchsorted(ids, after), 3] = kinds
        cuts = np.searchsorted(ids, ranges)
        for part in range(shards):
            a, e = cuts[part], cuts[part + 1]
            if a < e:
                out.append((shard, None, None, None, part, ids[a:e].astype(id_kind).tobytes(), values[a:e].tobytes()))
        return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    merged = written(
        texts.mapInArrow(count, PACKED)
        .groupBy("shard")
        .applyInArrow(
            merge, "shard long, keys string, counts string, n array<long>, part long, ids binary, values binary"
        ),
        "bigrams",
    )

    def merge_stats(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        sums = np.zeros((ranges[part + 1] - ranges[part], 4), dtype=np.int64)
        for ids, values in zip(table.column("ids"), table.column("values"), strict=True):
            place = np.frombuffer(ids.as_py(), id_kind).astype(np.int64) - ranges[part]
            sums[place] += np.frombuffer(values.as_py(), "<u4").reshape(-1, 4)
        kinds = sums[:, 3]
        n = [int((kinds == k).sum()) for k in (1, 2, 3, 4)] + [int((kinds > 0).sum()), int(kinds.sum())]
        return pa.table(
            {"part": [part], "name": [save(folder, sums.astype("<u4"))], "n": [n]},
            schema=pa.schema([("part", pa.int64()), ("name", pa.string()), ("n", pa.list_(pa.int64()))]),
        )

    bigrams, high = [("", "")] * shards, [0] * 4
    for r in merged.where("part IS NULL").select("shard", "keys", "counts", "n").collect():
        bigrams[r.shard] = (r["keys"], r["counts"])
        high = [a + b for a, b in zip(high, r.n, strict=True)]
    stats, low = [""] * shards, [0] * 6
    partial = merged.where("part IS NOT NULL").select("part", "ids", "values")
    for r in partial.groupBy("part").applyInArrow(merge_stats, "part long, name string, n array<long>").collect():
        stats[r.part] = r.name
        low = [a + b for a, b in zip(low, r.n, strict=True)]
    d = discounts(low)
    n1, n2, kept, kinds = low[0], low[1], low[4], low[5]
    even = d[0] * n1 + d[1] * n2 + d[2] * (kept - n1 - n2)
    return model._replace(bigrams=bigrams, stats=stats, high=discounts(high), low=d, kinds=kinds, even=even)


def _less(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discount, at least 0."""
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0.0)


def score_tokens(opened: Opened, tokens: np.ndarray, starts: np.ndarray):
    """Per token: count in training, log10 of the add-half unigram, log10 of the model."""
    m = opened.model
    ids, counts, which, before, after = _bigram_ids(opened, tokens, starts)
    known = ids >= 0
    stats = np.zeros((len(ids), 4), dtype=np.int64)
    order = np.argsort(ids[known], kind="stable")
    at = np.flatnonzero(known)[order]
    stats[at] = opened.stats(ids[at])
    unknown = 1.0 / (m.size + 1)
    low = (_less(stats[:, 3], m.low) + m.even * unknown) / m.kinds if m.kinds else np.full(len(ids), unknown)
    base = np.log10((counts + 0.5) / (m.tokens + 0.5 * (m.size + 1)))
    chance = low[which]
    # the word before each token, by its place among the distinct words; the begin mark comes last
    begin = opened.stats(np.array([m.size]))
    left = np.vstack([stats, begin])
    total = np.append(np.where(known, counts, 0), m.begins)
    place = np.empty_like(which)
    place[1:] = which[:-1]
    place[starts] = len(ids)
    followed = total[place] > 0
    both = followed & (ids[which] >= 0)
    left_ids = before[both]
    pair, first, back = np.unique(bigram(left_ids, after[both], m.wide), return_index=True, return_inverse=True)
    seen = np.zeros(len(tokens), dtype=np.int64)
    seen[both] = opened.bigrams(pair, left_ids[first])[back] if len(pair) else 0
    gamma = left[:, :3] @ np.array(m.high)
    at = place[followed]
    chance[followed] = (_less(seen[followed], m.high) + gamma[at] * chance[followed]) / total[at]
    return counts[which], base[which], np.log10(chance)


def score(
    docs: DataFrame,
    model: Model,
    id_column: str = "doc_id",
    text_column: str = "text",
    held_out: Column | None = None,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) per row."""
    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double, perplexity double"
    )
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = Opened.of(broadcast.value)
        for batch in batches:
            parts = []
            for words in find_words(batch.column("text"), fold=True):
                tokens, starts = _with_ends(words)
                counts, base, chance = score_tokens(opened, tokens, starts[:-1])
                sums = [np.add.reduceat(v, starts[:-1]) for v in (counts > 0, base, chance)]
                parts.append((np.diff(starts), *sums))
            if not parts:
                continue
            n, known, base, chance = (np.concatenate(p) for p in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("held_out"),
                    pa.array(n, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(np.full(len(n), opened.model.tokens), pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(chance, pa.float64()),
                    pa.array(10.0 ** (-chance / n), pa.float64()),
                ],
                [c.split()[0] for c in schema.split(", ")],
            )

    flag = F.lit(False) if held_out is None else held_out
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"), whole_text(text_column).alias("text"), flag.alias("held_out")
    )
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", id_column)


def train_and_score(docs: DataFrame, parts: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Score all rows by a model of those whose crc32 of the id does not leave remainder 1."""
    held_out = remainder(id_column, parts) == 1
    return score(docs, train(docs.where(~held_out), text_column), id_column, text_column, held_out)
