"""Toxicity of texts whose words may be disguised.

A noisy channel: a writer means a word and disguises it by digits and signs that look like letters,
by spreading its letters out, or by repeating them. For a disguised token the characters seen form a
lattice of the letters they may stand for; Viterbi decoding finds the likeliest path under a
trigram model of letters and the costs of the channel. In a run of spread letters every place is also a
possible end of a word, so the path says where its words are. The model is counted over the texts outside
the held-out part, all of them. A token of letters stands for itself, and if a letter is repeated, also
for the word decoded from it; a sign at its beginning or end is taken for a mark and for a letter. In
scoring, a token is decoded if what it could stand for begins with a feature, letters' repetitions apart:
decoding the others could not change a score.

The restored words are scored by a logistic regression on the words and word beginnings that tell
toxic from other texts in a bounded sample of labelled rows (``learning.SAMPLE_ROWS``). What goes to
the driver is bounded: the counts of letter trigrams, the chosen features, and the sample's rows in
terms of these.

Null text counts as empty and gets the score of a text without any feature. Rows that repeat an id
are scored each by its own text. Without usable labels the score is below one half for all rows.
Other columns are not read.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill.llm.frames import remainder, whole_text
from noticemill.llm.learning import labelled_sample, logistic, sigmoid
from noticemill.llm.words import Words, chunks, find_words, text_bytes
from noticemill.session import written

#: Letters a sign may stand for.
LOOKS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
#: Log costs of the channel: a sign for a letter; one or two letters for a run of them.
SIGN, RUN_TO_ONE, RUN_TO_TWO, PAIR_TO_ONE = -1.0, -0.5, -1.0, -3.0
SPREADERS = ".-_*~'"
PREFIXES = (4, 5, 6)
FEATURES = 512
LEAST_TEXTS = 5
#: Words a Python worker remembers, while fitting and while scoring: those met since so many others
#: were, and as many before.
MOST_WORDS = (15_000, 120_000)

_CLASSES = 28
_CLASS = np.zeros(256, dtype=np.int32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27

_SIGNS = "".join(c for c in LOOKS if not c.isdigit())
_SPREAD = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{re.escape(_SIGNS)}])(?:[{re.escape(SPREADERS)}]++(?:[^\W_]|[{re.escape(_SIGNS)}])(?![^\W_]))" + "{2,}+")
_EDGES = re.compile(rf"^[^\w{re.escape(_SIGNS)}]++|[^\w{re.escape(_SIGNS)}]++$")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Signs that may stand for one letter only, for comparing tokens with features.
_ONE_LETTER = str.maketrans({c: letters for c, letters in LOOKS.items() if len(letters) == 1})
#: What may stand at the edges of a word and for no letter, and signs by what they may stand for.
_MARKS = "".join(c for c in string.punctuation if c not in LOOKS)
_LOOK = re.compile(f"[{re.escape(''.join(LOOKS))}]")
_SEVERAL = re.compile(f"[{re.escape(''.join(c for c, letters in LOOKS.items() if len(letters) > 1))}]")
_SPREADER = re.compile(f"[{re.escape(SPREADERS)}]")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_RUN = re.compile(r"(.)\1*", re.S)
_DOUBLE = re.compile(r"(.)\1", re.S)
_RUNS = re.compile(r"(.)\1+", re.S)
_OTHER = re.compile("[^\x00-\x7f]+")


def letter_model(texts: DataFrame) -> np.ndarray:
    """Log probabilities of a letter class after two others, counted over all the texts: 0 for
    what is no letter, 1 to 26 for a to z, 27 for bytes of other letters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(_CLASSES**3, dtype=np.int64)
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            for first, last in chunks(offsets):
                c = np.zeros(offsets[last] - offsets[first] + 3, dtype=np.int32)
                c[2:-1] = _CLASS[data[offsets[first] : offsets[last]]]
                sums += np.bincount((c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:], minlength=len(sums))
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], ["trigram", "n"])

    counts = np.zeros(_CLASSES**3)
    rows = texts.mapInArrow(count, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))
    for r in rows.collect():
        counts[r.trigram] = r.n
    shape = counts.reshape(_CLASSES, _CLASSES, _CLASSES)
    pair = shape.sum(axis=0)
    single = (pair.sum(axis=0) + 1) / (pair.sum() + _CLASSES)
    after_one = (pair + 5 * single) / (pair.sum(axis=1, keepdims=True) + 5)
    after_two = (shape + 5 * after_one) / (shape.sum(axis=2, keepdims=True) + 5)
    return np.log(after_two)


def _class(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27 if letter.isalpha() else 0


def disguised(token: str) -> bool:
    """Whether a token of lower-case characters shows a sign of disguise."""
    if token.isalpha():
        return _DOUBLE.search(token) is not None
    return bool((_LOOK.search(token) or _DOUBLE.search(token)) and _LETTERS.search(token))


def _spelled(path: tuple | None) -> str:
    """The letters of a path of (before, letters)."""
    out: list[str] = []
    while path is not None:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest word behind a token: Viterbi over the letters its runs may stand for."""
    # all paths share what lies before their last letters
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for run in _RUN.finditer(token):
        sign, n = run[1], len(run[0])
        letters = [(sign, 0.0)] if sign.isalpha() else [(c, SIGN) for c in LOOKS.get(sign, "")]
        if not letters:
            continue
        cost = {1: {1: 0.0}, 2: {1: PAIR_TO_ONE, 2: 0.0}}.get(n, {1: RUN_TO_ONE, 2: RUN_TO_TWO})
        ahead: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (logp, path) in paths.items():
            for letter, sign_cost in letters:
                c = _class(letter)
                for times, run_cost in cost.items():
                    p = logp + sign_cost + run_cost + model[a, b, c]
                    state = (b, c)
                    if times == 2:
                        p += model[b, c, c]
                        state = (c, c)
                    if state not in ahead or ahead[state][0] < p:
                        ahead[state] = (p, (path, letter * times))
        paths = ahead
    return _spelled(max(((p + model[a, b, 0], path) for (a, b), (p, path) in paths.items()), key=lambda one: one[0])[1])


def restore(token: str, model: np.ndarray, telling: Telling | None = None) -> list[str]:
    """The words a token may stand for, lower-cased: runs of letters spread by signs, what lies between
    them, and each of these as it is and decoded. With ``telling``, those that cannot matter are left
    out."""
    token = token.lower()
    word = token.strip(_MARKS)
    if word.isalpha():
        if _DOUBLE.search(word) and (telling is None or telling.begins(word)):
            return list(dict.fromkeys((word, decode(word, model))))
        return [word]
    found: list[str] = []
    at = 0
    if _SPREADER.search(token):
        for run in _SPREAD.finditer(token):
            found += _restored(token[at : run.start()], model, telling)
            joined = _SPREADER.sub("", run[0])
            found += _restored(joined, model, telling)
            if telling is None or telling.anywhere(joined):
                found += decode_spread(joined, model)
            at = run.end()
    return list(dict.fromkeys(found + _restored(token[at:], model, telling)))


def _restored(part: str, model: np.ndarray, telling: Telling | None) -> list[str]:
    core = _EDGES.sub("", part)
    inner = core.strip(_SIGNS)
    found = _LETTERS.findall(inner)
    # a sign at an edge is a mark, or a letter
    for reading in (inner, core) if core != inner else (inner,):
        if disguised(reading) and (telling is None or telling.begins(reading)):
            found.append(decode(reading, model))
    return found


class Telling:
    """Which tokens could stand for a word with one of the features, repetitions of letters apart."""

    def __init__(self, features: dict[str, int]):
        starts = {_once(f.rstrip("$")) for f in features}
        self.lengths = sorted({len(s) for s in starts})
        self.starts = starts

    def begins(self, token: str) -> bool:
        if not token.isalpha():
            token = token.translate(_ONE_LETTER)
            if _SEVERAL.search(token):
                return True
            token = _NO_LETTERS.sub("", token)
        once = _once(token)
        return any(once[:n] in self.starts for n in self.lengths)

    def anywhere(self, token: str) -> bool:
        token = token.translate(_ONE_LETTER)
        if _SEVERAL.search(token):
            return True
        once = _once(_NO_LETTERS.sub("", token))
        return any(s in once for s in self.starts)


def _once(letters: str) -> str:
    """The letters, each run of one letter once."""
    return _RUNS.sub(r"\1", letters)


def decode_spread(letters: str, model: np.ndarray) -> list[str]:
    """The likeliest words behind a run of spread characters: Viterbi over the letters they may stand
    for, with or without the end of a word after each."""
    # A path is kept as (cost, words so far, linked from the last); all paths share what lies before.
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for sign in letters:
        choices = [(sign, 0.0)] if sign.isalpha() else [(c, SIGN) for c in LOOKS.get(sign, "")]
        if not choices:
            continue
        ahead: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (logp, path) in paths.items():
            for letter, sign_cost in choices:
                c = _class(letter)
                p = logp + sign_cost + model[a, b, c]
                for state, cost, end in (((b, c), 0.0, False), ((c, 0), model[b, c, 0], True)):
                    if state not in ahead or ahead[state][0] < p + cost:
                        ahead[state] = (p + cost, (path, letter, end))
        paths = ahead
    _, path = max(
        ((p + (model[a, b, 0] if b else 0.0), path) for (a, b), (p, path) in paths.items()),
        key=lambda one: one[0],
    )
    out: list[str] = []
    while path is not None:
        path, letter, end = path
        out.append(letter + " " if end else letter)
    return "".join(reversed(out)).split()


def units(words: list[str]) -> set[str]:
    """Features of restored words: the word, and its beginnings."""
    out = set()
    for w in words:
        if len(w) > 2:
            out.add(w + "$")
            out.update(w[:n] for n in PREFIXES if len(w) >= n)
    return out


def spread_words(words: Words) -> list[tuple[int, str]]:
    """(text, joined letters) of runs of three or more one-character words, in the chunk's texts."""
    starts, ends = words.starts, words.ends
    # One character: a first byte, and for other than ASCII as many further bytes as it says.
    first = words.data[starts]
    long = 1 + (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)
    one = np.flatnonzero((ends - starts == long) & (first > 32))
    if len(one) < 3:
        return []
    text = np.searchsorted(words.of, one, side="right") - 1
    breaks = np.flatnonzero((np.diff(one) != 1) | (np.diff(text) != 0)) + 1
    out = []
    for run in np.split(np.arange(len(one)), breaks):
        if len(run) >= 3:
            letters = "".join(words.text(k) for k in one[run]).lower()
            out.append((int(text[run[0]]), letters))
    return out


class Scorer:
    """Features of distinct words, remembered in a Python worker."""

    def __init__(self, model: np.ndarray, features: dict[str, int] | None):
        self.model = model
        self.features = features
        self.telling = None if features is None else Telling(features)
        self.known: dict[int, tuple] = {}
        self.older: dict[int, tuple] = {}

    def of_word(self, token: str) -> tuple:
        found = units(restore(token, self.model, self.telling))
        if self.features is None:
            return tuple(found)
        return tuple(self.features[u] for u in found if u in self.features)

    def of_spread(self, letters: str) -> tuple:
        """The features of a run of spread letters: of its words, and of the run as one word; where it
        has other than ASCII letters, also of its parts between them."""
        parts = {letters, *_OTHER.split(letters)} - {""}
        found = units([w for part in parts for w in (*decode_spread(part, self.model), *restore(part, self.model))])
        if self.features is None:
            return tuple(found)
        return tuple(self.features[u] for u in found if u in self.features)

    def remembered(self, prints: np.ndarray, place: np.ndarray, words: Words) -> list[tuple]:
        """The features of a chunk's distinct words."""
        if len(self.known) > MOST_WORDS[self.features is not None]:
            self.known, self.older = {}, self.known
        held = []
        for k, key in enumerate(prints.tolist()):
            features = self.known.get(key)
            if features is None:
                features = self.older.get(key)
                if features is None:
                    features = self.of_word(words.text(place[k]))
                self.known[key] = features
            held.append(features)
        return held

    def texts(self, column: pa.Array) -> Iterator[set]:
        """The distinct features of every text of a column."""
        for words in find_words(column, fold=True):
            prints, place, which = np.unique(words.prints, return_index=True, return_inverse=True)
            held = self.remembered(prints, place, words)
            telling = np.fromiter(map(bool, held), dtype=bool, count=len(held))
            at = np.flatnonzero(telling[which])
            out: list[set] = [set() for _ in range(words.last - words.first)]
            for text, k in zip((np.searchsorted(words.of, at, side="right") - 1).tolist(), which[at].tolist(), strict=True):
                out[text].update(held[k])
            for text, letters in spread_words(words):
                out[text].update(self.of_spread(letters))
            yield from out


class Classifier(NamedTuple):
    letters: np.ndarray
    features: dict[str, int]
    weights: np.ndarray
    bias: float


def fit(texts: DataFrame, sample: DataFrame) -> Classifier:
    """``texts``: (text), for the letters; ``sample``: (text, y) of bounded size."""
    letters = letter_model(texts)

    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, other = max(sizes.get(1, 0), 1), max(sizes.get(0, 0), 1)
    rate = (F.col("a") + F.col("b")) / float(toxic + other)
    lift = (F.col("a") / float(toxic) - F.col("b") / float(other)) / F.sqrt(
        rate * (1 - rate) * (1.0 / toxic + 1.0 / other) + 1e-12
    )
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(letters, None)
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for found, y in zip(scorer.texts(batch.column("text")), batch.column("y").to_pylist(), strict=True):
                seen[y].update(found)
            for y, counts in enumerate(seen):
                if counts:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(list(counts), pa.string()),
                            pa.array([y] * len(counts), pa.int64()),
                            pa.array(list(counts.values()), pa.int64()),
                        ],
                        ["unit", "y", "n"],
                    )

    chosen = (
        sample.mapInArrow(count, "unit string, y long, n long")
        .groupBy("unit")
        .agg(
            F.sum(F.col("y") * F.col("n")).alias("a"), F.sum((1 - F.col("y")) * F.col("n")).alias("b")
        )
        .where(F.col("a") + F.col("b") >= LEAST_TEXTS)
        .withColumn("lift", lift)
        .where("lift > 4")
        .orderBy(F.desc("lift"), "unit")
        .limit(FEATURES)
    )
    known = {r.unit: k for k, r in enumerate(chosen.collect())}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(letters, known)
        for batch in batches:
            found = [list(f) for f in scorer.texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int64())), batch.column("y")], ["found", "y"]
            )

    rows = sample.mapInArrow(features, "found array<long>, y int").collect()
    x = np.zeros((len(rows), len(known)), dtype=np.float32)
    for k, r in enumerate(rows):
        x[k, r.found] = 1.0
    weights, bias = logistic(x, np.array([r.y for r in rows], dtype=np.float64))
    return Classifier(letters, known, weights, min(bias, -0.1) if not known else bias)


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
        scorer = Scorer(m.letters, m.features)
        for batch in batches:
            logits = [m.bias + m.weights[list(f)].sum() for f in scorer.texts(batch.column("text"))]
            scores = sigmoid(np.array(logits, dtype=np.float64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("held_out"),
                    pa.array(scores),
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


def train(
    docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0, id_column: str = "doc_id", text_column: str = "text"
) -> Classifier:
    """Learn from the rows whose crc32 of the id does not leave the held-out remainder."""
    learning = docs.where(remainder(id_column, parts) != held_out)
    sample = labelled_sample(
        learning, labels, "toxic", parts, held_out, id_column=id_column, text_column=text_column
    )
    return fit(learning.select(whole_text(text_column).alias("text")), written(sample, "sample"))


def train_and_score(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0, **columns) -> DataFrame:
    """Learn outside the held-out part and score all rows."""
    flag = remainder(columns.get("id_column", "doc_id"), parts) == held_out
    return score(docs, train(docs, labels, parts, held_out, **columns), held_out=flag, **columns)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that are not judged toxic, with all their columns."""
    columns = {"id_column": id_column, "text_column": text_column}
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        scorer = Scorer(m.letters, m.features)
        for batch in batches:
            texts = batch.column(text_column).cast(pa.string())
            texts = pc.fill_null(texts, "") if texts.null_count else texts
            keep = [sigmoid(m.bias + m.weights[list(f)].sum()) < 0.5 for f in scorer.texts(texts)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
