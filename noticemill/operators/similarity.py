"""Near-duplicate documents by TF-IDF cosine similarity, exact.

**Copies first.** Documents whose term counts are proportional have the same unit vector, and a
group of copies can be a large part of the data, so each group is compared as one profile. Results
are profile pairs with the number of documents on each side, plus the members of each profile:
nothing is lost and a group of m copies never becomes m² rows.

**Then blocks.** Profiles are dealt by hash into blocks of bounded size, each written to the shared folder
once, and a task reads the pairs of blocks that it compares one after the other: a vector is shuffled and
stored once, and every pair of profiles meets in one task. Blocks are dealt into groups, whose number
follows the cores, and a pair of groups is a task, so what tasks add up or link for themselves is no more
than a few rows per profile. A task holds two blocks however much there is; the comparisons of all tasks
grow with the square of the data. Only where Arrow does not know the store of the shared folder, a vector
is shuffled once per block instead.

**In a task** terms are dealt by hash into buckets, and a sketch has the length of the vector within
each bucket. By Cauchy and Schwarz the product of two sketches is no less than that of the vectors, so
pairs whose sketches stay below the threshold are left out. Sketches are multiplied tile by tile, with
more buckets for longer vectors. A tile pair that more than ``long_list`` pairs are left of lists them
by the two rarest shared terms: a dot product is at most that of the rarest one plus the product of the
lengths of the vectors cut off after the second one. What is left is multiplied exactly, ``chunk`` x
``chunk`` pairs at once. Nothing is left out; only pairs at or above the threshold leave a task.
"""

from __future__ import annotations

import ctypes
import hashlib
import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill.functions.stopwords import ENGLISH
from noticemill.functions.text import document_text
from noticemill.operators.joins import broadcast_if, is_small
from noticemill.operators.tfidf import DEDUP_TERMS, scaled
from noticemill.session import MOST_PARTITIONS, scratch_path, written

THRESHOLD = 0.85
CHUNK = 512
LONG_LIST = 64 * CHUNK
# a task holds two blocks of at most so many bytes of vectors and so many rows, on average; blocks that
# are read from files, and not shuffled once per block, may be smaller
BLOCK_BYTES, FILE_BYTES = 128 << 20, 32 << 20
BLOCK_ROWS = 1 << 17
# ids of a profile that go with one row
LISTED = 1024
# a group of blocks is no larger than this to make fewer tasks
GROUP_ROWS = 1 << 20
# blocks are not made smaller than this to occupy more cores
FEW_ROWS = 2048
TILE = 512
LEAST_BITS, MOST_BITS = 4, 12
PIECE_CELLS = 1 << 18
_SLACK = 2e-4  # rounding room for bounds in single precision; the final test has none

# The task functions travel with the job, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CELL = np.dtype([("rank", "<i4"), ("weight", "<f8")])
_COUNT = np.dtype([("rank", "<i4"), ("tf", "<i4")])


def corpus(
    records: DataFrame, id_col: str, fields: Sequence[str] = ("title", "description")
) -> DataFrame:
    """(id, text) of the records."""
    return records.select(F.col(id_col).alias("id"), document_text(fields).alias("text"))


def _arrow_type(df: DataFrame, column: str) -> tuple[str, pa.DataType]:
    name = df.schema[column].dataType.simpleString()
    return name, {"string": pa.string(), "int": pa.int32()}.get(name, pa.int64())


def unit(rank: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The unit vector of the weights x."""
    cells = np.empty(len(rank), _CELL)
    cells["rank"] = rank
    cells["weight"] = x / np.sqrt(np.dot(x, x))
    return cells


def as_planes(cells: np.ndarray) -> bytes:
    """The first bytes of all cells together, then the second ones: in the order of ranks most of them
    repeat, so that little is stored and shuffled."""
    return cells.view(np.uint8).reshape(-1, cells.itemsize).T.tobytes()


def of_planes(packed: bytes, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def weighted(packed: bytes, idf: np.ndarray) -> np.ndarray:
    """The unit vector of packed counts."""
    counts = of_planes(packed, _COUNT)
    return unit(counts["rank"], counts["tf"] * idf[counts["rank"]])


def _pack(counts: bool):
    """Batch function: per document the digest of its shape, and its unit vector packed from common to
    rare, or only the counts that it follows from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cells")
            flat = cells.flatten()
            rank, x, tf = (flat.field(i).to_numpy() for i in range(3))
            ends = np.cumsum(cells.value_lengths().to_numpy())
            digests, vectors, start = [], [], 0
            for end in ends:
                order = start + np.argsort(rank[start:end])
                start = end
                ratio = tf[order] / tf[order].min()
                shape = rank[order].astype("<i4").tobytes() + ratio.tobytes()
                digests.append(hashlib.sha256(shape).digest())
                if counts:
                    held = np.empty(len(order), _COUNT)
                    held["rank"], held["tf"] = rank[order], tf[order]
                    vectors.append(as_planes(held))
                else:
                    vectors.append(unit(rank[order], x[order]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())],
                ["id", "digest", "vector"],
            )

    return run


def profiles(rows: DataFrame, counts: bool = False) -> DataFrame:
    """(id, digest, vector) from (id, rank, tf, x): digests are equal for proportional counts. With
    ``counts`` the column vector holds the counts, a fifth of the bytes, from which ``weighted`` makes
    the vector by the weights of the terms."""
    cells = F.collect_list(F.struct("rank", "x", "tf"))  # at most max_terms entries
    gathered = rows.groupBy("id").agg(cells.alias("cells"))
    name, _ = _arrow_type(rows, "id")
    return gathered.mapInArrow(_pack(counts), f"id {name}, digest binary, vector binary")


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        ranks = [of_planes(v, _COUNT)["rank"] for v in batch.column("vector").to_pylist()]
        if ranks:
            seen = np.bincount(np.concatenate(ranks))
            total = np.pad(total, (0, max(len(seen) - len(total), 0)))
            total[: len(seen)] += seen
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["rank", "df"])


def inverse_frequencies(shaped: DataFrame, documents: int) -> np.ndarray:
    """ln((1+n)/(1+df)) + 1 by rank, from the counts of n documents; at most as many as the vocabulary has."""
    counted = shaped.select("vector").mapInArrow(_document_frequencies, "rank long, df long")
    rows = counted.groupBy("rank").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(1 + max((r["rank"] for r in rows), default=0))
    for r in rows:
        df[r["rank"]] = r["df"]
    return np.log((1 + documents) / (1 + df)) + 1


class Block:
    """The vectors of one block, its rows in tiles from few terms to many."""

    def __init__(self, rows: pa.Table, idf: np.ndarray | None) -> None:
        packed = rows.column("vector")
        kind = _CELL if idf is None else _COUNT
        self.lengths = pc.binary_length(packed).to_numpy().astype(np.int64) // kind.itemsize
        # the last cell belongs to no row: its weight is that of a term a row does not have
        self.rank = np.zeros(self.lengths.sum() + 1, np.int32)
        self.weight = np.zeros(len(self.rank))
        end = 0
        for vector in (v for batch in packed.chunks for v in batch):
            cells = of_planes(vector.as_buffer(), _CELL) if idf is None else weighted(vector.as_buffer(), idf)
            start, end = end, end + len(cells)
            self.rank[start:end], self.weight[start:end] = cells["rank"], cells["weight"]
        self.ids, self.sizes = rows.column("id").combine_chunks(), rows.column("n").combine_chunks()
        self.starts = np.cumsum(self.lengths) - self.lengths
        #: what else a row brings along, such as its signature
        self.rows = rows.drop_columns(["id", "n", "vector"])
        order = np.argsort(self.lengths, kind="stable")
        self.tiles = [order[k : k + TILE] for k in range(0, len(order), TILE)]
        self.longest = [int(self.lengths[tile[-1]]) for tile in self.tiles]
        self._sketches: dict[tuple[int, int], np.ndarray] = {}

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the rows' cells one row after the other, where each row begins, its length."""
        lengths = self.lengths[rows]
        begins = np.cumsum(lengths) - lengths
        return np.repeat(self.starts[rows] - begins, lengths) + np.arange(lengths.sum()), begins, lengths

    def sketch(self, k: int, bits: int) -> np.ndarray:
        """Lengths of the vectors of a tile within each of 2**bits buckets of terms."""
        if (k, bits) not in self._sketches:
            rows = self.tiles[k]
            at, _, lengths = self.cells(rows)
            bucket = self.rank[at].astype(np.uint32) * np.uint32(2654435761) >> np.uint32(32 - bits)
            place = np.repeat(np.arange(len(rows)) << bits, lengths) + bucket
            squares = np.bincount(place, self.weight[at] ** 2, len(rows) << bits)
            self._sketches[k, bits] = np.sqrt(squares).astype(np.float32).reshape(len(rows), -1)
        return self._sketches[k, bits]

    @cached_property
    def lists(self) -> pa.ListArray:
        """The ids that each row stands for, where rows bring them along."""
        return self.rows.column("ids").combine_chunks()

    @cached_property
    def listed(self) -> np.ndarray:
        return self.lists.value_lengths().to_numpy().astype(np.int64)

    @cached_property
    def heads(self) -> np.ndarray:
        """Per cell the length of its vector cut off after it, common terms first."""
        total = np.cumsum(self.weight**2)
        before = np.repeat((total - self.weight**2)[self.starts], self.lengths)
        return np.sqrt(np.maximum(total[:-1] - before, 0.0))


class _Tile:
    """Some rows of a block, by row and term."""

    def __init__(self, block: Block, rows: np.ndarray, n_terms: int) -> None:
        at, _, lengths = block.cells(rows)
        present, place = np.unique(block.rank[at], return_inverse=True)
        self.block, self.at = block, at
        self.place = np.zeros(n_terms, np.int32)
        self.place[present] = np.arange(1, len(present) + 1)
        self.width = len(present) + 1
        self.cell = np.repeat(np.arange(len(rows)) * self.width, lengths) + place + 1
        self.weights = np.zeros(len(rows) * self.width)
        self.weights[self.cell] = block.weight[at]

    @cached_property
    def found(self) -> np.ndarray:
        """The cells of the block by row and term, -1 for none."""
        found = np.full(len(self.weights), -1, np.int64)
        found[self.cell] = self.at
        return found

    def _meet(self, i: np.ndarray, right: Block, j: np.ndarray):
        theirs, begins, lengths = right.cells(j)
        return np.repeat(i * self.width, lengths) + self.place[right.rank[theirs]], theirs, begins

    def products(self, i: np.ndarray, right: Block, j: np.ndarray) -> np.ndarray:
        """Dot products of the tile's rows i and the rows j of the other block."""
        mine, theirs, begins = self._meet(i, right, j)
        return np.add.reduceat(self.weights[mine] * right.weight[theirs], begins)

    def bounds(self, i: np.ndarray, right: Block, j: np.ndarray) -> np.ndarray:
        """What the products are at most, by the two rarest shared terms."""
        mine, theirs, begins = self._meet(i, right, j)
        mine = self.found[mine]
        shared = np.where(mine >= 0, np.arange(len(mine)), -1)
        rarest = np.maximum.reduceat(shared, begins)
        any_shared = rarest >= 0
        shared[rarest[any_shared]] = -1
        second = np.maximum.reduceat(shared, begins)
        alone = self.block.weight[mine[rarest]] * right.weight[theirs[rarest]]
        before = self.block.heads[mine[second]] * right.heads[theirs[second]]
        return np.where(any_shared, alone + np.where(second >= 0, before, 0.0), 0.0)


def _in_pieces(compute, i: np.ndarray, right: Block, j: np.ndarray, most: int) -> np.ndarray:
    """``compute`` over at most so many pairs, and about so many cells, at once."""
    if len(i) == 0:
        return np.empty(0)
    total = np.cumsum(right.lengths[j])
    by_cells = total // PIECE_CELLS
    by_pairs = np.arange(len(i)) // most
    cuts = np.flatnonzero((np.diff(by_cells) > 0) | (np.diff(by_pairs) > 0)) + 1
    return np.concatenate(
        [compute(x, right, y) for x, y in zip(np.split(i, cuts), np.split(j, cuts), strict=True)]
    )


def _near_in_tiles(left: Block, right: Block, same: bool, threshold: float, chunk: int, long_list: int):
    """(rows of the left block, rows of the right one, similarity) of all pairs at the threshold."""
    n_terms = 1 + int(max(left.rank.max(), right.rank.max()))
    for a, rows in enumerate(left.tiles):
        tile = None
        for b in range(a if same else 0, len(right.tiles)):
            shorter = min(left.longest[a], right.longest[b])
            bits = min(max(math.ceil(math.log2(2.5 * shorter)), LEAST_BITS), MOST_BITS)
            above = left.sketch(a, bits) @ right.sketch(b, bits).T >= threshold - _SLACK
            i, j = np.nonzero(np.triu(above, 1) if same and a == b else above)
            if len(i) == 0:
                continue
            tile = tile or _Tile(left, rows, n_terms)
            j = right.tiles[b][j]
            if len(i) > long_list:
                kept = _in_pieces(tile.bounds, i, right, j, chunk * chunk) >= threshold - _SLACK
                i, j = i[kept], j[kept]
            product = _in_pieces(tile.products, i, right, j, chunk * chunk)
            kept = product >= threshold
            if kept.any():
                yield rows[i[kept]], j[kept], product[kept]


def near_among(left: Block, right: Block, first: np.ndarray, second: np.ndarray, threshold: float):
    """The same for given pairs of rows only."""
    n_terms = 1 + int(max(left.rank.max(), right.rank.max()))
    order = np.argsort(first, kind="stable")
    first, second = first[order], second[order]
    cuts = np.flatnonzero(np.diff(first // TILE)) + 1
    for i, j in zip(np.split(first, cuts), np.split(second, cuts), strict=True):
        rows, at = np.unique(i, return_inverse=True)
        product = _in_pieces(_Tile(left, rows, n_terms).products, at, right, j, CHUNK * CHUNK)
        kept = product >= threshold
        yield i[kept], j[kept], product[kept]


def by_group(batches: Iterator[pa.RecordBatch], idf: np.ndarray | None) -> Iterator[tuple[int, Block, Block, bool]]:
    """The pairs of blocks of a partition, mostly one: number, both blocks, whether they are the same."""
    held: dict[tuple[int, bool, int], list[pa.RecordBatch]] = {}
    for batch in batches:
        keys = batch.select(["block_pair", "same", "side"])
        for key in pa.Table.from_batches([keys]).group_by(keys.schema.names).aggregate([]).to_pylist():
            mine = pc.and_(pc.equal(batch.column("block_pair"), key["block_pair"]), pc.equal(batch.column("side"), key["side"]))
            held.setdefault(tuple(key[c] for c in keys.schema.names), []).append(batch.filter(mine))
    while held:
        pair, same, _ = next(iter(held))
        left, right = (held.pop((pair, same, side), None) for side in (0, 1))
        if left and (same or right):
            first = Block(pa.Table.from_batches(left), idf)
            left.clear()
            yield pair, first, first if same else Block(pa.Table.from_batches(right), idf), same
            del first


PAIR_COLUMNS = ["id_a", "id_b", "similarity", "n_a", "n_b"]


def pair_rows(
    left: Block, right: Block, i: np.ndarray, j: np.ndarray, similarity: np.ndarray
) -> Iterator[pa.RecordBatch]:
    i, j = pa.array(i), pa.array(j)
    yield pa.RecordBatch.from_arrays(
        [left.ids.take(i), right.ids.take(j), pa.array(similarity), left.sizes.take(i), right.sizes.take(j)],
        PAIR_COLUMNS,
    )


def partner_rows(
    left: Block, right: Block, i: np.ndarray, j: np.ndarray, similarity: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """All ids of the left rows with all those of the right ones, some pairs after the other."""
    other = pc.not_equal(left.ids.take(pa.array(i)), right.ids.take(pa.array(j))).to_numpy(zero_copy_only=False)
    i, j, similarity = i[other], j[other], similarity[other]
    (mine, at, m), (theirs, to, n) = ((block.lists, block.lists.offsets.to_numpy(), block.listed) for block in (left, right))
    total = np.cumsum(m[i] * n[j])
    cuts = np.flatnonzero(np.diff(total // PIECE_CELLS)) + 1
    for a, b, s in zip(*(np.split(x, cuts) for x in (i, j, similarity)), strict=True):
        times = m[a] * n[b]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        a, b, s = (np.repeat(x, times) for x in (a, b, s))
        ids, partners = mine.values.take(pa.array(at[a] + place // n[b])), theirs.values.take(pa.array(to[b] + place % n[b]))
        yield pa.RecordBatch.from_arrays([ids, partners, pa.array(s)], ["id", "partner", "similarity"])


#: (rows of the left block, rows of the right one, similarity) of the near pairs of two blocks, in parts; for a
#: block with itself each pair once.
Compare = Callable[[Block, Block, bool], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def _compared(threshold: float, chunk: int, long_list: int) -> Compare:
    def compare(left: Block, right: Block, same: bool):
        return _near_in_tiles(left, right, same, threshold, chunk, long_list)

    return compare


@dataclass(frozen=True)
class Extent:
    """How many vectors there are, and their bytes."""

    rows: int
    size: int

    def blocks(self, most_bytes: int, wanted: int) -> int:
        """Blocks of bounded size, and as many as are wanted where there are rows enough."""
        fewest = max(-(-self.size // most_bytes), -(-self.rows // BLOCK_ROWS), 1)
        return max(fewest, min(wanted, self.rows // FEW_ROWS))

    def groups(self, cores: int) -> int:
        """Groups of blocks: pairs of them for all cores many times over, so that none waits long for the last."""
        return max(math.ceil(math.sqrt(32 * cores)), -(-self.rows // GROUP_ROWS))


def _cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def extent(vectors: DataFrame, counts: bool = False) -> Extent:
    size, rows = vectors.agg(F.sum(F.length("vector")), F.count("*")).first()
    return Extent(rows, (size or 0) * _CELL.itemsize // (_COUNT if counts else _CELL).itemsize)


def _for_pairs(cores: int) -> int:
    """So many blocks that pairs of them occupy all cores."""
    return math.ceil(math.sqrt(4 * cores))


def block_count(vectors: DataFrame, counts: bool = False) -> int:
    return extent(vectors, counts).blocks(BLOCK_BYTES, _for_pairs(_cores(vectors)))


def block_of(column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def block_pair(p: str, q: str) -> Column:
    """The number of a pair of blocks, p <= q."""
    return (F.col(q).cast("long") * (F.col(q) + 1) / 2 + F.col(p)).cast("int")


def _cells_as_planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        planes = [as_planes(np.frombuffer(vector, _CELL)) for vector in batch.column("vector").to_pylist()]
        at = batch.schema.get_field_index("vector")
        yield batch.set_column(at, "vector", pa.array(planes, pa.binary()))


def in_blocks(vectors: DataFrame, blocks: int) -> DataFrame:
    """(block_pair, same, side) and the columns id, n, vector and others: every vector in all pairs that
    its block is in."""
    return (
        vectors.withColumn("own", block_of("id", blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("p", F.least("own", "other"))
        .withColumn("q", F.greatest("own", "other"))
        .select(
            block_pair("p", "q").alias("block_pair"),
            (F.col("p") == F.col("q")).alias("same"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            *vectors.columns,
        )
    )


def _crosswise(rows: DataFrame, blocks: int, side: int, others: int) -> DataFrame:
    """The rows in all pairs of one of their blocks, on that side, and one of the other table's."""
    own, other = block_of("first", blocks), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
    placed = rows.select("*", own.alias("own"), other.alias("other"))
    pair = F.col("other") * blocks + F.col("own") if side else F.col("own") * others + F.col("other")
    return placed.select(pair.cast("int").alias("block_pair"), F.lit(False).alias("same"), F.lit(side).alias("side"), *rows.columns)


def dealt(rows: DataFrame, pairs: int) -> DataFrame:
    """One partition per pair of blocks."""
    return rows.repartitionById(min(pairs, MOST_PARTITIONS), F.col("block_pair"))


#: Hadoop's names of a store that Arrow knows by another.
_STORES = {"s3a": "s3", "s3n": "s3"}


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder as Spark names it, and its path there."""
    scheme, colon, rest = folder.partition("://")
    return fs.FileSystem.from_uri(f"{_STORES.get(scheme, scheme)}{colon}{rest}")


def _arrow_opens(folder: str) -> bool:
    try:
        _opened(folder)
    except (pa.ArrowException, OSError):
        return False
    return True


@dataclass(frozen=True)
class Stored:
    """Blocks below a path, with the number of rows of each that has any."""

    path: str
    rows: dict[int, int]

    def block(self, number: int, idf: np.ndarray | None) -> Block | None:
        """The block of a number; an error where not all of its rows can be read."""
        if number not in self.rows:
            return None
        system, base = _opened(self.path)
        files = system.get_file_info(fs.FileSelector(f"{base}/block={number}"))
        tables = []
        for name in sorted(f.path for f in files if f.path.endswith(".parquet")):
            with system.open_input_file(name) as source:
                tables.append(pq.ParquetFile(source).read(use_threads=False))
        found = sum(t.num_rows for t in tables)
        if found != self.rows[number]:
            raise OSError(f"{found} of {self.rows[number]} rows in {self.path}/block={number}")
        return Block(pa.concat_tables(tables), idf)


def store_blocks(rows: DataFrame, blocks: int, path: str, by: str = "id") -> Stored:
    """Write (id, n, vector) and other columns below the path, each block to a folder of its own."""
    own = rows.withColumn("block", block_of(by, blocks)).repartitionById(min(blocks, MOST_PARTITIONS), F.col("block"))
    own.write.option("compression", "zstd").partitionBy("block").parquet(path)
    counted = rows.sparkSession.read.schema("block int").parquet(path).groupBy("block").count().collect()
    return Stored(path, {r["block"]: r["count"] for r in counted})


def _each_once(blocks: int, groups: int):
    """Of a task, a pair of groups by its number: a block, and the blocks that it is compared with."""

    def pairs(task: int) -> Iterator[tuple[int, range]]:
        q = (math.isqrt(8 * task + 1) - 1) // 2
        p = task - q * (q + 1) // 2
        for a in range(p, blocks, groups):
            yield a, range(a if p == q else q, blocks, groups)

    return pairs


def _crossed(across: int, down: int, p_groups: int, q_groups: int):
    """The same for blocks of two tables, each of one with each of the other."""

    def pairs(task: int) -> Iterator[tuple[int, range]]:
        for a in range(task % p_groups, across, p_groups):
            yield a, range(task // p_groups, down, q_groups)

    return pairs


def _return_freed_blocks() -> None:
    """From now on the C library returns large freed blocks at once, and Arrow allocates through it, so that a
    worker is as large as the two blocks it holds and not as all before."""
    library = ctypes.CDLL(None)
    if hasattr(library, "mallopt"):
        m_trim_threshold, m_mmap_threshold = -1, -3
        library.mallopt(m_mmap_threshold, 4 << 20)
        library.mallopt(m_trim_threshold, 4 << 20)
    pa.set_memory_pool(pa.system_memory_pool())


def _in_tasks(left_blocks: Stored, right_blocks: Stored, pairs, idf: np.ndarray | None, compare: Compare, give):
    """Batch function: what is near in the pairs of blocks of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _return_freed_blocks()
        for a, others in (pair for batch in batches for task in batch.column("id").to_pylist() for pair in pairs(task)):
            left = left_blocks.block(a, idf)
            for b in others if left else ():
                same = left_blocks.path == right_blocks.path and a == b
                right = left if same else right_blocks.block(b, idf)
                if right:
                    for found in compare(left, right, same):
                        yield from give(left, right, *found)
                del right
            del left

    return run


def _in_groups(idf: np.ndarray | None, compare: Compare, give):
    """Batch function: the same for blocks that come with the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, left, right, same in by_group(batches, idf):
            for found in compare(left, right, same):
                yield from give(left, right, *found)

    return run


def among(rows: DataFrame, held: Extent, idf: np.ndarray | None, compare: Compare) -> DataFrame:
    """(id_a, id_b, similarity, n_a, n_b) of the near pairs of (id, n, vector), id_a < id_b. Other columns go
    with the blocks."""
    name, _ = _arrow_type(rows, "id")
    columns = f"id_a {name}, id_b {name}, similarity double, n_a long, n_b long"
    path, cores = scratch_path(rows.sparkSession, "blocks"), _cores(rows)
    if not _arrow_opens(path):
        blocks = held.blocks(BLOCK_BYTES, _for_pairs(cores))
        moved = dealt(in_blocks(rows, blocks), blocks * (blocks + 1) // 2)
        return sorted_pairs(moved.mapInArrow(_in_groups(idf, compare, pair_rows), columns))
    blocks = held.blocks(FILE_BYTES, _for_pairs(cores))
    stored = store_blocks(rows, blocks, path)
    groups = min(blocks, held.groups(cores))
    tasks = groups * (groups + 1) // 2
    run = _in_tasks(stored, stored, _each_once(blocks, groups), idf, compare, pair_rows)
    return sorted_pairs(rows.sparkSession.range(0, tasks, 1, tasks).mapInArrow(run, columns))


def between(left: DataFrame, right: DataFrame, idf: np.ndarray, compare: Compare) -> DataFrame:
    """(id, partner, similarity) of (id, n, vector, ids) on the left and on the right: all ids of a row with
    all those of a near row that has another id."""
    spark, cores, (name, _) = left.sparkSession, _cores(left), _arrow_type(left, "id")
    columns = f"id {name}, partner {name}, similarity double"
    path, few, many = scratch_path(spark, "blocks"), extent(left, True), extent(right, True)
    opens = _arrow_opens(path)
    most = FILE_BYTES if opens else BLOCK_BYTES
    across = few.blocks(most, 1)
    down = many.blocks(most, -(-4 * cores // across))
    if not opens:
        moved = _crosswise(left, across, 0, down).unionByName(_crosswise(right, down, 1, across))
        return dealt(moved, across * down).mapInArrow(_in_groups(idf, compare, partner_rows), columns)
    stored = [store_blocks(rows, n, f"{path}-{k}", "first") for k, (rows, n) in enumerate(((left, across), (right, down)))]
    fewer = min(across, few.groups(cores))
    groups = fewer, min(down, max(many.groups(cores), -(-16 * cores // fewer)))
    run = _in_tasks(*stored, _crossed(across, down, *groups), idf, compare, partner_rows)
    return spark.range(0, math.prod(groups), 1, math.prod(groups)).mapInArrow(run, columns)


def sorted_pairs(found: DataFrame) -> DataFrame:
    """The pairs with id_a < id_b."""
    swap = F.col("id_a") > F.col("id_b")
    return found.select(
        F.least("id_a", "id_b").alias("id_a"),
        F.greatest("id_a", "id_b").alias("id_b"),
        "similarity",
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
        F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
    )


def prefix_pairs(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    chunk: int = CHUNK,
    long_list: int = LONG_LIST,
    idf: np.ndarray | None = None,
) -> DataFrame:
    """(id_a, id_b, similarity, n_a, n_b), id_a < id_b, from (id, n, vector), ids unique. With the
    weights ``idf`` of the terms by rank, the column vector holds counts."""
    held = extent(vectors, idf is not None)
    rows = vectors.select("id", "n", "vector")
    if idf is None:
        name, _ = _arrow_type(vectors, "id")
        rows = rows.mapInArrow(_cells_as_planes, f"id {name}, n long, vector binary")
    return among(rows, held, idf, _compared(threshold, chunk, long_list))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's links those that join two groups not yet joined by the ones before."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        kept = []
        for k, (a, b) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            a, b = top(a), top(b)
            if a != b:
                up[a] = b
                kept.append(k)
        yield batch.take(pa.array(kept, pa.int64()))


@dataclass(frozen=True)
class Duplicates:
    """Result of the search over ``shaped``, the table (id, digest, vector) of all documents that
    have a vector, with the counts of ``profiles``; ``documents`` is the number of all. A profile stands for documents with the same vector, goes by the smallest id
    among them, and n is their number."""

    shaped: DataFrame
    documents: int
    threshold: float = THRESHOLD
    chunk: int = CHUNK
    long_list: int = LONG_LIST

    @cached_property
    def idf(self) -> np.ndarray:
        return inverse_frequencies(self.shaped, self.documents)

    @cached_property
    def held(self) -> Extent:
        """What ``vectors`` has, without making them."""
        sizes = self.shaped.groupBy("digest").agg(F.max(F.length("vector")).alias("size"))
        size, rows = sizes.agg(F.sum("size"), F.count("*")).first()
        return Extent(rows, (size or 0) * _CELL.itemsize // _COUNT.itemsize)

    def vectors(self) -> DataFrame:
        """(id, n, vector), one row per profile. Only profiles of several documents are looked up, and
        the counts stay where they are while those are few."""
        several = written(self.sizes().filter("n > 1"), "several")
        placed = self.shaped.join(broadcast_if(is_small(several), several), "digest", "left")
        first = placed.filter(F.col("profile").isNull() | (F.col("id") == F.col("profile")))
        return first.select("id", F.coalesce("n", F.lit(1)).cast("long").alias("n"), "vector")

    def _search(self) -> tuple[DataFrame, Compare]:
        """The profiles with what their comparison needs, and how two blocks of them are compared."""
        return self.vectors(), _compared(self.threshold, self.chunk, self.long_list)

    @cached_property
    def pairs(self) -> DataFrame:
        """(id_a, id_b, similarity, n_a, n_b) over profiles."""
        rows, compare = self._search()
        return among(rows, self.held, self.idf, compare)

    def links(self) -> DataFrame:
        """(id_a, id_b) over profiles: of the pairs so many as join the same profiles. Each task leaves
        out those that close a circle, so a group of m profiles costs about m rows per task."""
        pairs = self.pairs.select("id_a", "id_b")
        return pairs.mapInArrow(_forest, pairs.schema)

    def sizes(self) -> DataFrame:
        """(digest, profile, n), one row per profile."""
        return self.shaped.groupBy("digest").agg(
            F.min("id").alias("profile"), F.count("*").alias("n")
        )

    def _with_ids(self, per_profile: DataFrame) -> DataFrame:
        """Rows per profile, with a column ``digest``, given to each of its documents.

        One profile may hold a third of the documents. The small side is written out first, so
        that both sides of the join are plain shuffles, which AQE can split.
        """
        rows = written(per_profile, "per-profile")
        return self.shaped.select("id", "digest").join(rows, "digest").drop("digest")

    def members(self) -> DataFrame:
        """(id, profile, n) for every document that has a vector."""
        return self._with_ids(self.sizes())

    def copies(self) -> DataFrame:
        """(id, copy_of, n): every document that has an earlier copy."""
        later = self._with_ids(self.sizes().filter("n > 1")).filter("id <> profile")
        return later.select("id", F.col("profile").alias("copy_of"), "n")

    def pair_count(self) -> DataFrame:
        """Number of document pairs: between profiles n_a × n_b, within one n(n-1)/2."""
        between = self.pairs.agg(
            F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("k")
        ).scalar()
        inside = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
        within = self.sizes().agg(F.coalesce(F.sum(inside), F.lit(0)).alias("k"))
        return within.select((F.col("k") + between).alias("n_pairs"))

    def partner_counts(self) -> DataFrame:
        """(id, n_partners) for every document that has a near-duplicate."""
        around = (
            self.pairs.select(
                F.explode(
                    F.array(
                        F.struct(F.col("id_a").alias("profile"), F.col("n_b").alias("k")),
                        F.struct(F.col("id_b").alias("profile"), F.col("n_a").alias("k")),
                    )
                ).alias("side")
            )
            .groupBy("side.profile")
            .agg(F.sum("side.k").alias("k"))
        )
        partners = F.col("n") - 1 + F.coalesce(F.col("k"), F.lit(0))
        counted = self.sizes().join(around, "profile", "left")
        return self._with_ids(
            counted.select("digest", partners.alias("n_partners")).filter("n_partners > 0")
        )

    def partners_of(self, ids: DataFrame) -> DataFrame:
        """(id, partner, similarity) for the given ids (column ``id``), partners written out. The profiles
        of the ids are compared with all, and both bring along the ids they stand for, so what is found
        is not shuffled."""
        members = written(self.members(), "members")
        mine = written(members.join(ids.select("id"), "id", "left_semi"), "asked")
        rows, compare = self._search()
        rows = written(rows, "vectors")
        asked = rows.join(_id_lists(mine), "id")
        alone = rows.filter("n = 1").withColumn("ids", F.array("id"))
        others = alone.unionByName(rows.filter("n > 1").join(_id_lists(members.filter("n > 1")), "id"))
        listed = (written(df.withColumn("first", F.col("ids")[0]), name) for df, name in ((asked, "left"), (others, "right")))
        near = between(*listed, self.idf, compare)
        several = members.filter("n > 1").select("profile", F.col("id").alias("partner"))
        same = mine.filter("n > 1").select("id", "profile").join(several, "profile")
        return near.unionAll(same.select("id", "partner", F.lit(1.0).alias("similarity"))).filter("partner <> id")


def _id_lists(members: DataFrame) -> DataFrame:
    """(id, ids): a profile and ids of it from (id, profile, n), about so many in a list."""
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / LISTED)).alias("part")
    lists = members.groupBy("profile", part).agg(F.collect_list("id").alias("ids"))
    return lists.select(F.col("profile").alias("id"), "ids")


def shaped_counts(documents: DataFrame, max_terms: int, stop_words: Sequence[str]) -> DataFrame:
    """The one pass over the texts; everything else starts from this table."""
    return written(profiles(scaled(documents, max_terms, stop_words), counts=True), "profiles")


def find_duplicates(
    records: DataFrame,
    id_col: str = "record_id",
    threshold: float = THRESHOLD,
    fields: Sequence[str] = ("title", "description"),
    max_terms: int = DEDUP_TERMS,
    stop_words: Sequence[str] = ENGLISH,
    chunk: int = CHUNK,
    long_list: int = LONG_LIST,
) -> Duplicates:
    """All pairs of records whose texts have a cosine similarity of at least ``threshold``. In a pair of
    tiles that more than ``long_list`` pairs are left of, they are listed by two terms; pairs are
    multiplied in pieces of ``chunk`` x ``chunk``."""
    documents = corpus(records, id_col, fields)
    return Duplicates(shaped_counts(documents, max_terms, stop_words), documents.count(), threshold, chunk, long_list)
