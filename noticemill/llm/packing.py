"""Cost-balanced packing of token ids into sequences of a fixed capacity.

A document is its token ids and an end id. Whole pieces of the capacity are sequences of their own.
The rest of about ``BUFFER_TOKENS`` tokens at a time is packed by estimated attention cost, linear
plus quadratic in a piece's length: pieces in descending order of length go to the sequence of the
lowest cost that has room. A piece no sequence has room for is cut at the widest room. There are as
many sequences as the tokens fill, so they fill up completely; what is left goes on to the next
buffer, and the last, at most one sequence's worth per task, meets the others' in a second, small
step. So texts are read and encoded once, where they are stored, and only the leftovers move.

Null text counts as empty: such a document is its end id. Rows that repeat an id are packed each
by itself. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill.llm.encoder import Encoder
from noticemill.llm.frames import whole_text
from noticemill.session import written

CAPACITY = 2048
BUFFER_TOKENS = 1 << 21
#: Tasks whose leftovers are packed together: at most so many sequences.
TASKS_TOGETHER = 1024
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 6144.0, 1.0

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:at]), self._replace(start=self.start + at, ids=self.ids[at:])

    def row(self, sequence: int, offset: int) -> tuple:
        crc = zlib.crc32(self.ids.astype("<u4").tobytes())
        return self.doc_id, self.start, len(self.ids), crc, self.doc_tokens, sequence, offset


def balance(pieces: list[Piece], n: int, capacity: int) -> tuple[list[tuple[int, int, Piece]], list[Piece]]:
    """Deal pieces shorter than the capacity to n sequences: (sequence, offset, piece), and what
    the sequences have no room for."""
    placed: list[tuple[int, int, Piece]] = []
    over: list[Piece] = []
    room = np.full(n, capacity, dtype=np.int64)
    cost = np.zeros(n)

    def put(to: int, piece: Piece) -> None:
        size = len(piece.ids)
        placed.append((to, int(capacity - room[to]), piece))
        room[to] -= size
        cost[to] += LINEAR * size + QUADRATIC * size * size

    for piece in sorted(pieces, key=lambda p: -len(p.ids)):
        while True:
            fits = np.flatnonzero(room >= len(piece.ids))
            if len(fits):
                put(int(fits[cost[fits].argmin()]), piece)
                break
            widest = int(room.argmax()) if n else 0
            if not n or not room[widest]:
                over.append(piece)
                break
            head, piece = piece.cut(int(room[widest]))
            put(widest, head)
    return placed, over


def pack(pieces: list[Piece], sequence: int, capacity: int, last: bool) -> tuple[list[tuple], list[Piece], int]:
    """Rows of full sequences numbered from ``sequence``, the pieces left over, the next number.
    With ``last`` nothing is left over, and one sequence may be short."""
    rows, short = [], []
    for piece in pieces:
        while len(piece.ids) >= capacity:
            head, piece = piece.cut(capacity)
            rows.append(head.row(sequence, 0))
            sequence += 1
        if len(piece.ids):
            short.append(piece)
    total = sum(len(p.ids) for p in short)
    n = -(-total // capacity) if last else total // capacity
    placed, over = balance(short, n, capacity)
    rows += [piece.row(sequence + to, offset) for to, offset, piece in placed]
    return rows, over, sequence + n


def pack_documents(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end_id: int = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    packed = written(
        texts.mapInArrow(_packer(path, capacity, end_id), f"{PIECES}, task long, ids binary"), "pieces"
    )
    columns = [c.split()[0] for c in PIECES.split(", ")]
    left = packed.where("sequence_id IS NULL")
    together = F.floor(F.col("task") / TASKS_TOGETHER).alias("together")
    ends = left.groupBy(together).applyInPandas(_pack_ends(capacity), PIECES)
    return packed.where("sequence_id IS NOT NULL").select(*columns).unionByName(ends)


def _packer(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder.of(path), TaskContext.get().partitionId()
        held, tokens, sequence = [], 0, task << 32
        for batch in batches:
            ids_of_rows = batch.column("doc_id").to_pylist()
            for part in encoder.encode(batch.column("text")):
                for k in range(part.last - part.first):
                    ids = np.append(part.ids[part.of[k] : part.of[k + 1]], np.uint32(end_id))
                    held.append(Piece(ids_of_rows[part.first + k], 0, ids, len(ids)))
                    tokens += len(ids)
                if tokens >= BUFFER_TOKENS:
                    rows, held, sequence = pack(held, sequence, capacity, last=False)
                    tokens = sum(len(p.ids) for p in held)
                    yield _batch(rows, task, [])
        rows, held, sequence = pack(held, sequence, capacity, last=False)
        yield _batch(rows, task, held)

    return run


def _batch(rows: list[tuple], task: int, left: list[Piece]) -> pa.RecordBatch:
    rows = rows + [(p.doc_id, p.start, len(p.ids), None, p.doc_tokens, None, None) for p in left]
    arrays = [pa.array([r[k] for r in rows], pa.int64()) for k in range(7)]
    arrays.append(pa.array([task] * len(rows), pa.int64()))
    none = [None] * (len(rows) - len(left))
    arrays.append(pa.array(none + [p.ids.astype("<u4").tobytes() for p in left], pa.binary()))
    names = [c.split()[0] for c in PIECES.split(", ")] + ["task", "ids"]
    return pa.RecordBatch.from_arrays(arrays, names)


def _pack_ends(capacity: int):
    columns = [c.split()[0] for c in PIECES.split(", ")]

    def run(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["task", "doc_id", "start", "ids"], kind="stable")
        pieces = [
            Piece(None if pd.isna(r.doc_id) else int(r.doc_id), int(r.start), np.frombuffer(r.ids, "<u4"), int(r.doc_tokens))
            for r in left.itertuples()
        ]
        rows, _, _ = pack(pieces, (1 << 62) + (int(key[0]) << 32), capacity, last=True)
        out = pd.DataFrame(rows, columns=columns)
        return out.astype({c: "Int64" for c in columns})

    return run
