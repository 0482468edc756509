"""Quality of texts by random indexing and a small network.

Every word stands beside its shape (``Xx,`` for ``Thing,``), and both are units. Each unit has a
fixed sparse random vector, made from its hash. Over all texts, the ``UNITS`` units that occur most often
get context vectors: the sums of the random vectors of the units around them, which tasks add up in
whole numbers and send once per unit. Any other unit stands for itself by its own random vector, which
takes no memory. A document is the mean of its units' vectors and their spread; a network of two layers,
trained with numpy, turns it into a logit, and a temperature fitted on rows kept aside calibrates the
probability.

Counts and contexts cover every word of every text; only the network and the temperature are fitted on a
bounded sample of labelled rows (``learning.SAMPLE_ROWS``), and every text is scored whole. What reaches
the driver is the vectors of ``UNITS`` units and the pooled sample rows.

Null text counts as empty and gets the score of a text without units. Rows that repeat an id are
scored each by its own text. Without usable labels all rows get the smoothed share of the label.
Other columns are not read.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill.llm.frames import remainder, whole_text
from noticemill.llm.learning import labelled_sample, sigmoid
from noticemill.llm.words import Words, find_words, mix
from noticemill.session import written

DIMENSIONS, NONZERO = 96, 6
UNITS = 8192
WINDOW = 2
HIDDEN, EPOCHS, BATCH = 32, 40, 128
#: Words, and kinds of words, remembered by one Python worker before it starts afresh, units it counts before
#: it sends them, and words that are split into units or whose vectors are held at once.
MOST_WORDS, MOST_KINDS, GATHER, TOGETHER = 500_000, 150_000, 300_000, 32768
#: The largest number in the sum of the random vectors around a word and its own, and the rows of such sums
#: that 16 bits hold.
LARGEST = 2 * (2 * WINDOW + 1)
MANY_ROWS = 65535 // (2 * LARGEST)

_KINDS = str.maketrans(
    {c: "X" for c in string.ascii_uppercase}
    | {c: "x" for c in string.ascii_lowercase}
    | {c: "9" for c in string.digits}
)
_MARKS = ",.;:!?"
_OTHER = re.compile("[^\x00-\x7f]+")
_NO_LETTERS = re.compile(r"[^\w\n]+")
_RUN = re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    """Kinds of a word's characters, each run once."""
    return "#" + _RUN.sub(r"\1", _OTHER.sub("x", word).translate(_KINDS))


def units_of(word: str) -> tuple[str, str]:
    """A word's two units: its shape, and its lower-cased letters."""
    mark = word[-1] if word[-1] in _MARKS else ""
    core = word[:-1] if mark else word
    if core.isascii() and core.isalpha():  # most words: their shapes are known at once
        if core.islower():
            return "#x" + mark, core
        if core[1:].islower():
            return "#Xx" + mark, core.lower()
    lower = word.lower()
    letters = lower if lower.isalnum() else "".join(filter(str.isalnum, lower))
    return shape(word), letters or word


#: The kinds of bytes, where those outside ASCII count as ``x``, and those of ASCII that are neither letters
#: nor digits.
_BYTE_KINDS = bytes.maketrans(
    (string.ascii_uppercase + string.ascii_lowercase + string.digits).encode() + bytes(range(128, 256)),
    b"X" * 26 + b"x" * 26 + b"9" * 10 + b"x" * 128,
)
_BYTE_MARKS = bytes(b for b in range(128) if not chr(b).isalnum() and b != 10)
#: Longer words' kinds are not remembered.
LONGEST = 40


class Shapes(dict):
    """What is known of a shape, by the kinds of a word's characters, found once for each."""

    def __init__(self, about: Callable[[str], object]):
        self.about = about

    def __missing__(self, kinds: bytes):
        found = self.about(shape(kinds.decode()))
        if len(kinds) <= LONGEST and len(self) < MOST_KINDS:
            self[kinds] = found
        return found


def split_units(words: list[bytes], shapes: Shapes) -> tuple[list, list[bytes]]:
    """The two units of words, as ``units_of`` gives them: what is known of the shape, and the letters. No
    word holds a line end, so all are taken together, as lines."""
    lines = b"\n".join(words)
    known = list(map(shapes.__getitem__, lines.translate(_BYTE_KINDS).split(b"\n")))
    letters = lines.lower().translate(None, _BYTE_MARKS).split(b"\n")
    if not lines.isascii():
        others = [k for k, word in enumerate(words) if not word.isascii()]
        for k, unit in zip(others, _letters([words[k] for k in others]), strict=True):
            letters[k] = unit
    if not all(letters):
        letters = [unit or word for unit, word in zip(letters, words, strict=True)]
    return known, letters


def _letters(words: list[bytes]) -> list[bytes]:
    """The letters of words with characters outside ASCII."""
    lower = b"\n".join(words).decode().lower().encode().translate(None, _BYTE_MARKS).decode()
    return _NO_LETTERS.sub("", lower).encode().split(b"\n")


def random_places(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few numbers in the fixed random vectors of some hashes, row by row: one in
    each of ``NONZERO`` equal parts of the vector."""
    each = DIMENSIONS // NONZERO
    draws = mix(prints[:, None] + np.arange(1, NONZERO + 1, dtype=np.uint64))
    places = (draws >> np.uint64(8)) % np.uint64(each) + np.arange(NONZERO, dtype=np.uint64) * np.uint64(each)
    return places.astype(np.int64), (draws & np.uint64(1)).astype(np.int8) * 2 - 1


def print_of(unit: str) -> int:
    """The hash of a unit, which its random vector is drawn from."""
    return zlib.crc32(unit.encode())


def random_vectors(prints: np.ndarray) -> np.ndarray:
    """The fixed sparse vectors of some hashes: a few places hold 1 or -1."""
    places, signs = random_places(prints)
    vectors = np.zeros((len(prints), DIMENSIONS), dtype=np.int8)
    vectors[np.arange(len(prints))[:, None], places] = signs
    return vectors


class Remembered:
    """Two whole numbers of each distinct word, remembered in a worker in the order of the words' fingerprints;
    ``look`` finds those of new words."""

    def __init__(self):
        self.known = np.empty(0, dtype=np.uint64)
        self.values = np.empty((0, 2), dtype=np.int64)

    def look(self, words: list[bytes]) -> np.ndarray:
        raise NotImplementedError

    def numbers(self, words: Words, prints: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The numbers of a chunk's distinct words, row by row, by their fingerprints in order and where each
        comes first."""
        if len(self.known) > MOST_WORDS:
            self.known, self.values = self.known[:0], self.values[:0]
        at = np.searchsorted(self.known, prints)
        old = at < len(self.known)
        old[old] = self.known[at[old]] == prints[old]
        values = np.empty((len(prints), 2), dtype=np.int64)
        values[old] = self.values[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            raw = words.data.tobytes()
            for some in np.split(new, range(TOGETHER, len(new), TOGETHER)):
                begins, ends = words.starts[first[some]].tolist(), words.ends[first[some]].tolist()
                values[some] = self.look([raw[a:e] for a, e in zip(begins, ends, strict=True)])
            if len(new) <= MOST_WORDS:
                self.known = np.insert(self.known, at[new], prints[new])
                self.values = np.insert(self.values, at[new], values[new], axis=0)
        return values


class Units(Remembered):
    """Units of distinct words, remembered in a worker: places among the kept ones, and hashes."""

    def __init__(self, place: dict[str, int]):
        super().__init__()
        self.place = {unit.encode(): k for unit, k in place.items()}
        # a unit's place and hash are one number
        self.shapes = Shapes(lambda unit: place.get(unit, -1) << 32 | print_of(unit))

    def look(self, words: list[bytes]) -> np.ndarray:
        shapes, letters = split_units(words, self.shapes)
        found = np.empty((len(words), 2), dtype=np.int64)
        found[:, 0] = shapes
        found[:, 1] = np.fromiter(map(self.place.get, letters, repeat(-1)), dtype=np.int64, count=len(words)) << 32
        found[:, 1] |= np.fromiter(map(zlib.crc32, letters), dtype=np.int64, count=len(words))
        return found

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per distinct word (shape, letters) as places, -1 for a unit that is not kept; per distinct word
        the hashes of both; and which of them each word of the chunk is."""
        prints, first, which = np.unique(words.prints, return_index=True, return_inverse=True)
        values = self.numbers(words, prints, first)
        return values >> 32, (values & 0xFFFFFFFF).astype(np.uint64), which


class Classifier(NamedTuple):
    place: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float


def word_vectors(
    held: np.ndarray, hashes: np.ndarray, vectors: np.ndarray, powers: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For distinct words the sums of their two units' vectors, and of the squares of these. The last row
    of ``vectors`` and of their squares ``powers`` is that of a unit that is not kept, and 0."""
    total = vectors.take(held[:, 0], axis=0)
    squares = powers.take(held[:, 0], axis=0)
    kept = np.flatnonzero(held[:, 1] >= 0)
    total[kept] += vectors.take(held[kept, 1], axis=0)
    squares[kept] += powers.take(held[kept, 1], axis=0)
    for side in (0, 1):
        rest = np.flatnonzero(held[:, side] < 0)
        places, signs = random_places(hashes[rest, side])
        total[rest[:, None], places] += signs.astype(np.float32) / np.float32(np.sqrt(NONZERO))
        squares[rest[:, None], places] += np.float32(1 / NONZERO)
    return total, squares


def pooled(units: Units, vectors: np.ndarray, column: pa.Array) -> Iterator[np.ndarray]:
    """Mean and spread of the vectors of each text's units, and how many different words it has."""
    vectors = np.vstack([vectors, np.zeros((1, DIMENSIONS), dtype=np.float32)])
    powers = vectors * vectors
    for words in find_words(column, fold=False):
        held, hashes, which = units.of(words)
        total, squares = word_vectors(held, hashes, vectors, powers)
        sizes = np.diff(words.of)
        # the distinct words of each text, one text after the other
        pairs = np.sort(np.repeat(np.arange(len(sizes)) * len(held), sizes) + which)
        begins = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else pairs
        counts = np.diff(begins, append=len(pairs))
        text, kinds = np.divmod(pairs[begins], max(len(held), 1))
        shares = (counts / (2 * sizes[text])).astype(np.float32)
        ends = np.cumsum(np.bincount(text, minlength=len(sizes)))
        out = np.zeros((len(sizes), 2 * DIMENSIONS + 2), dtype=np.float32)
        first = 0
        for row, last in zip(out, ends.tolist(), strict=True):
            some, share = kinds[first:last], shares[first:last]
            row[:DIMENSIONS] = share @ total.take(some, axis=0)
            row[DIMENSIONS : 2 * DIMENSIONS] = share @ squares.take(some, axis=0)
            first = last
        centre, spread = out[:, :DIMENSIONS], out[:, DIMENSIONS : 2 * DIMENSIONS]
        spread[:] = np.sqrt(np.maximum(spread - centre * centre, 0.0))
        out[:, -2] = np.log1p(sizes)
        out[:, -1] = np.diff(ends, prepend=0) / np.maximum(sizes, 1)
        yield from out


class Numbered(dict):
    """Numbers of things, in the order in which they are first asked for."""

    def __missing__(self, thing):
        number = self[thing] = len(self)
        return number


class Tally(Remembered):
    """How often units occur. Each distinct word is split into its units once, as long as it is remembered."""

    def __init__(self):
        super().__init__()
        self.units = Numbered()
        self.counts = np.zeros(0, dtype=np.int64)
        self.shapes = Shapes(lambda unit: self.units[unit.encode()])

    def look(self, words: list[bytes]) -> np.ndarray:
        shapes, letters = split_units(words, self.shapes)
        found = np.empty((len(words), 2), dtype=np.int64)
        found[:, 0] = shapes
        found[:, 1] = np.fromiter(map(self.units.__getitem__, letters), dtype=np.int64, count=len(words))
        return found

    def add(self, words: Words) -> None:
        prints, first, counts = np.unique(words.prints, return_index=True, return_counts=True)
        numbers = self.numbers(words, prints, first)
        sums = np.zeros(len(self.units), dtype=np.int64)
        sums[: len(self.counts)] = self.counts
        for side in (0, 1):
            # float64 holds the counts of a chunk exactly
            sums += np.bincount(numbers[:, side], counts, len(sums)).astype(np.int64)
        self.counts = sums


def common_units(texts: DataFrame, units: int = UNITS) -> list[str]:
    """The units that occur most often in all texts, the most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def sent() -> pa.RecordBatch:
            names = pa.array(list(tally.units), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(tally.counts, pa.int64())], ["unit", "n"])

        for batch in batches:
            for words in find_words(batch.column("text"), fold=False):
                tally.add(words)
                if len(tally.units) > GATHER:
                    yield sent()
                    tally = Tally()
        yield sent()

    totals = texts.mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return [r.unit for r in totals.orderBy(F.desc("n"), "unit").limit(units).collect()]


def _add_rows(sums: np.ndarray, places: np.ndarray, rows: np.ndarray) -> None:
    """Add each row to the sum at its place, if it has one. No number is beyond ``LARGEST``; four numbers at a
    time are added up as the 16-bit parts of one of 64 bits, for at most ``MANY_ROWS`` rows."""
    kept = np.flatnonzero(places >= 0)
    if not len(kept):
        return
    # numbers of 16 bits are sorted in linear time
    held = places[kept].astype(np.uint16 if len(sums) <= 1 << 16 else np.int64)
    order = kept[np.argsort(held, kind="stable")]
    ordered = places[order]
    begins = np.append(True, ordered[1:] != ordered[:-1])
    again = ~begins
    begins[::MANY_ROWS] = True
    at = np.flatnonzero(begins)
    again = again[at]
    packed = np.ascontiguousarray((rows + np.int8(LARGEST)).view("<u8").T)
    found = np.empty((len(at), len(packed), 4, 2), dtype=np.uint16)
    even = np.uint64(0x00FF00FF00FF00FF)
    for k, column in enumerate(packed):
        part = column.take(order)
        for odd in (0, 1):
            added = np.add.reduceat((part >> np.uint64(8) if odd else part) & even, at)
            found[:, k, :, odd] = added.astype("<u8", copy=False).view("<u2").reshape(-1, 4)
    times = np.diff(at, append=len(order))
    added = found.reshape(len(at), -1) - (LARGEST * times)[:, None]
    sums[ordered[at[~again]]] += added[~again]
    for k in np.flatnonzero(again).tolist():
        sums[ordered[at[k]]] += added[k]


def add_contexts(sums: np.ndarray, units: Units, column: pa.Array) -> None:
    """Add the random vectors of the units around each kept unit of the texts to its sum. A word's other
    unit counts as beside it; ``WINDOW`` words on both sides, within the text, count with both units."""
    for words in find_words(column, fold=False):
        held, hashes, which = units.of(words)
        kinds, at = np.unique(hashes[:, 0], return_inverse=True)  # many words have one shape
        joint = random_vectors(hashes[:, 1]) + random_vectors(kinds)[at]
        text = np.searchsorted(words.of, np.arange(len(which)), side="right")
        for first in range(0, len(which), TOGETHER):
            last = min(first + TOGETHER, len(which))
            low, high = max(first - WINDOW, 0), min(last + WINDOW, len(which))
            own = joint.take(which[low:high], axis=0)
            # the word itself, too: at most 2 for each of 2 * WINDOW + 1 words
            near = own.copy()
            for step in range(1, WINDOW + 1):
                if step < len(own):
                    near[step:] += own[:-step]
                    near[:-step] += own[step:]
                    # neighbours in another text are none
                    apart = np.flatnonzero(text[low + step : high] != text[low : high - step])
                    near[apart + step] -= own[apart]
                    near[apart] -= own[apart + step]
            near = near[first - low : last - low]
            for side in (0, 1):
                _add_rows(sums, held[which[first:last], side], near)
        # a unit is not beside itself
        counts = np.bincount(which, minlength=len(held))
        for side in (0, 1):
            kept = np.flatnonzero(held[:, side] >= 0)
            places, at = np.unique(held[kept, side], return_index=True)
            times = np.bincount(held[kept, side], counts[kept])[places].astype(np.int64)
            sums[places] -= times[:, None] * random_vectors(hashes[kept[at], side])


def unit_vectors(texts: DataFrame, units: int = UNITS) -> tuple[dict[str, int], np.ndarray]:
    """The kept units and their context vectors over all texts, of length 1. A unit without a context, as
    that of a text of one unit, has its random vector."""
    names = common_units(texts, units)
    place = {unit: k for k, unit in enumerate(names)}
    shared = texts.sparkSession.sparkContext.broadcast(place)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Units(shared.value)
        sums = np.zeros((len(shared.value), DIMENSIONS), dtype=np.int64)
        for batch in batches:
            add_contexts(sums, known, batch.column("text"))
        seen = np.flatnonzero(np.abs(sums).sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), pa.array(list(sums[seen]), pa.list_(pa.int64()))], ["place", "context"]
        )

    dims = [F.sum(F.col("context")[k]).alias(f"d{k}") for k in range(DIMENSIONS)]
    rows = texts.mapInArrow(contexts, "place long, context array<long>").groupBy("place").agg(*dims)
    vectors = random_vectors(np.array([print_of(unit) for unit in names], dtype=np.uint64)).astype(np.float32)
    for r in rows.collect():
        vectors[r[0]] = r[1:]
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return place, (vectors / np.maximum(length, 1e-9)).astype(np.float32)


def forward(layers: tuple[np.ndarray, ...], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden layer and logits."""
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2


def train_network(x: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, ...]:
    """Two layers by Adam on the cross entropy, from a fixed seed."""
    rng = np.random.Generator(np.random.PCG64(seed))
    odds = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), odds]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    step = 0
    for _ in range(EPOCHS if len(y) else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at : at + BATCH]
            hidden, logits = forward(tuple(layers), x[rows])
            error = (sigmoid(logits) - y[rows]) / len(rows)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            slopes = [
                x[rows].T @ back + 1e-4 * layers[0],
                back.sum(axis=0),
                hidden.T @ error + 1e-4 * layers[2],
                error.sum(),
            ]
            step += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                rate = 0.003 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                layers[k] = layers[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return tuple(np.asarray(w) for w in layers)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least cross entropy on rows the network has not seen."""
    if not len(y):
        return 1.0
    sign = np.where(y > 0, 1.0, -1.0)
    choices = np.exp(np.linspace(np.log(0.25), np.log(8.0), 121))
    loss = [np.logaddexp(0.0, -sign * logits / t).mean() for t in choices]
    return float(choices[int(np.argmin(loss))])


def fit(texts: DataFrame, sample: DataFrame) -> Classifier:
    """``texts``: (text), for the word vectors; ``sample``: (text, y) of bounded size."""
    place, vectors = unit_vectors(texts)
    shared = sample.sparkSession.sparkContext.broadcast((place, vectors))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Units(shared.value[0])
        for batch in batches:
            x = [v.tobytes() for v in pooled(known, shared.value[1], batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column("y")], ["x", "y"])

    pools = sample.mapInArrow(pool, "x binary, y int").select(F.xxhash64("x").alias("hash"), "x", "y")
    rows = sorted(pools.collect())
    y = np.array([r.y for r in rows], dtype=np.float64)
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], dtype=np.float64).reshape(len(rows), 2 * DIMENSIONS + 2)
    mean = x.mean(axis=0) if len(rows) else np.zeros(x.shape[1])
    scale = 1 / np.maximum(x.std(axis=0), 1e-6) if len(rows) else np.ones(x.shape[1])
    x = np.clip((x - mean) * scale, -8, 8)
    aside = np.arange(len(y)) % 8 == 7
    layers = train_network(x[~aside], y[~aside])
    return Classifier(place, vectors, mean, scale, layers, calibrate(forward(layers, x[aside])[1], y[aside]))


def score(
    docs: DataFrame,
    model: Classifier,
    id_column: str = "doc_id",
    text_column: str = "text",
    held_out: Column | None = None,
) -> DataFrame:
    """(id, held_out, score, predicted) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = Units(m.place)
        for batch in batches:
            rows = list(pooled(known, m.vectors, batch.column("text")))
            x = np.array(rows, dtype=np.float64).reshape(len(rows), len(m.mean))
            logits = forward(m.layers, np.clip((x - m.mean) * m.scale, -8, 8))[1]
            scores = sigmoid(logits / m.temperature)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("held_out"),
                    pa.array(scores, pa.float64()),
                    pa.array((scores >= 0.5).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    flag = F.lit(False) if held_out is None else held_out
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"), whole_text(text_column).alias("text"), flag.alias("held_out")
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int").withColumnRenamed(
        "doc_id", id_column
    )


def train_and_score(docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1, **columns) -> DataFrame:
    """Learn outside the held-out part of the ids and score all rows."""
    sample = labelled_sample(docs, labels, "quality", parts, held_out, **columns)
    flag = remainder(columns.get("id_column", "doc_id"), parts) == held_out
    texts = docs.select(whole_text(columns.get("text_column", "text")).alias("text"))
    return score(docs, fit(texts, written(sample, "sample")), held_out=flag, **columns)
