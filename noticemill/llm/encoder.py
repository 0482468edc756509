"""Token ids of whole texts by the vocabulary files of public tokenizers.

A tokenizer whose pre-tokenizer drops white space and splits letters from signs gives a text the
ids of its words, cut there, one after the other. For such a file each piece is encoded by the
library once and remembered by its bytes in the Python worker, up to ``MOST_BYTES`` of memory; the ids
are those the library gives for the whole text. If it lower-cases, spellings that differ in the case of A
to Z are one piece, but for chunks in which an added token could stand. Any other file gets whole
texts.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from struct import pack
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from noticemill.llm.memory import keep
from noticemill.llm.words import CUTS, chunks, find_words, text_bytes

#: Memory for the words that one Python worker remembers, and what a word takes beside its bytes and ids.
#: Half of it holds the words met last; when it is full, those met before them are forgotten.
MOST_BYTES, WORD_BYTES = 40 << 20, 200


class Encoded(NamedTuple):
    """Ids of the texts ``first`` to ``last`` of a column; ``of[i]:of[i + 1]`` are the i-th's."""

    first: int
    last: int
    ids: np.ndarray
    of: np.ndarray


def version(path: str) -> str:
    """Digest of a vocabulary file: two files with one version give the same ids."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


class Encoder:
    """Encodes columns with one vocabulary file: .json by tokenizers, .model by sentencepiece."""

    def __init__(self, path: str):
        self.by_word = self.folds = False
        self.added: list[bytes] = []
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.size = 0
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self.merge = tokenizer.model.tokenize
            self.many = lambda texts: [
                e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ]
            with open(path) as file:
                spec = json.load(file)
            self.by_word = drops_space(spec)
            changes = spec.get("normalizer") or {}
            self.folds = any(n["type"] == "Lowercase" for n in changes.get("normalizers", [changes]) if n)
            self.added = [t["content"][:2].encode() for t in spec.get("added_tokens", [])]
        elif path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            pieces = SentencePieceProcessor(model_file=path)
            self.many = lambda texts: pieces.encode(texts, num_threads=1)
        else:
            raise ValueError(f"neither .json nor .model: {path}")

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of a file, which a Python worker keeps for further tasks."""
        return keep(("encoder", path), lambda: cls(path))

    def encode(self, column: pa.Array) -> Iterator[Encoded]:
        yield from self._by_word(column) if self.by_word else self._by_text(column)

    def _by_text(self, column: pa.Array) -> Iterator[Encoded]:
        offsets, _ = text_bytes(column)
        for first, last in chunks(offsets):
            found = self.many(column.slice(first, last - first).to_pylist())
            lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            ids = np.array([i for one in found for i in one], dtype=np.uint32)
            yield Encoded(first, last, ids, np.concatenate([[0], np.cumsum(lengths)]))

    def _by_word(self, column: pa.Array) -> Iterator[Encoded]:
        _, data = text_bytes(column)
        plain = self.folds and not any(start in data.tobytes() for start in set(self.added))
        for words in find_words(column, fold=plain, cut=True):
            _, place, which = np.unique(words.prints, return_index=True, return_inverse=True)
            raw = words.data.tobytes()
            if plain:
                raw = raw.lower()
            keys = [raw[a:e] for a, e in zip(words.starts[place].tolist(), words.ends[place].tolist(), strict=True)]
            held = self._ids(keys)
            lengths = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) // 4
            flat = np.frombuffer(b"".join(held), dtype="<u4")
            begin = np.cumsum(lengths) - lengths
            each = lengths[which]
            after = np.concatenate([[0], np.cumsum(each)])
            pick = np.repeat(begin[which] - after[:-1], each) + np.arange(after[-1])
            yield Encoded(words.first, words.last, flat[pick], after[words.of])

    def _ids(self, keys: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        if self.size > MOST_BYTES // 2:
            self.known, self.older, self.size = {}, self.known, 0
        held = list(map(self.known.get, keys))
        new = [k for k, ids in enumerate(held) if ids is None]
        if self.older:
            for k in new:
                ids = held[k] = self.older.get(keys[k])
                if ids is not None:
                    self._remember(keys[k], ids)
            new = [k for k in new if held[k] is None]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            words = [keys[k] for k in part]
            for k, key, ids in zip(part, words, self._pieces(words), strict=True):
                held[k] = packed = pack(f"<{len(ids)}I", *ids)
                self._remember(key, packed)
        return held

    def _remember(self, key: bytes, ids: bytes) -> None:
        """Keep a word's ids; one that alone would fill the memory is not kept."""
        size = len(key) + len(ids) + WORD_BYTES
        if size <= MOST_BYTES // 16:
            self.known[key] = ids
            self.size += size

    def _pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces. Pieces of ASCII letters pass the steps before the merges unchanged but
        for their case, so they go to the merges at once."""
        # of bytes, only ASCII letters are letters
        rest = iter(self.many([p.decode() for p in pieces if not p.isalpha()]))
        merge, case = self.merge, (bytes.lower if self.folds else bytes)
        return [[t.id for t in merge(case(p).decode())] if p.isalpha() else next(rest) for p in pieces]


def drops_space(spec: dict) -> bool:
    """Whether the ids of a text are those of its words, cut between letters and signs, one after
    the other: white space is removed before the merges, letters and signs are never in one piece,
    nothing is put before a text, and added tokens hold no space."""
    before = spec.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", [before])
    split = steps[0] if steps else {}
    changes = spec.get("normalizer") or {}
    return (
        split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and r"[\p{L}]+|" in split["pattern"].get("Regex", "")
        and r"[^\s\p{L}\p{N}]+" in split["pattern"].get("Regex", "")
        and " ?" not in split["pattern"].get("Regex", "")
        and all(n["type"] in ("NFC", "Replace", "Lowercase") for n in changes.get("normalizers", [changes]))
        and all(not s.get("add_prefix_space") for s in steps)
        and steps[-1].get("type") == "ByteLevel"
        and not any(t["content"].isalpha() or set(t["content"].encode()) & {*CUTS, 32} for t in spec.get("added_tokens", []))
    )
