"""Token ids of whole texts by way of words and pieces.

The word tokenizer used here drops white space and never joins text across it, so the ids of a text are the ids of its
words (runs outside ``\\x20\\x09-\\x0D``) one after another. It cuts a word into pieces by a pattern and encodes each piece by
itself; the last id of a piece, and no other, stands for an end. So many words are encoded in one go, and their ids told
from each other by the number of pieces of each word. The library encodes a word once and ids are kept: by a worker within
bounds (`Encoder`), or for all distinct words of a corpus in a table (`bpe`).

Pieces are counted here only where letters are plain (`_kinds`); other words are encoded one by one. What a tokenizer file
says decides whether all this holds (`by_words`); texts are given whole to any other tokenizer.
"""

from __future__ import annotations

import itertools
import json
import os

import numpy as np
import pyarrow as pa

from . import common

NAME = "word_bpe_49k.json"
_CACHE = 1_000_000
# The pattern by which the word tokenizer cuts, and its steps.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS, END_MARK = ["NFC", "Replace", "Lowercase"], "</w>"


def _kinds() -> np.ndarray:
    """What each byte of UTF-8 text is: white space 0, letter 1, digit 2, mark 3, or 4 where it takes the library to say.

    Letters are a-z and those of two bytes up to U+017F; an apostrophe can begin a piece of its own.
    """
    out = np.full(256, 4, dtype=np.uint8)
    out[33:127] = 3
    out[[ord("'"), ord(" ")]] = 4, 0
    out[48:58], out[65:91], out[97:123] = 2, 1, 1
    out[0x80:0xC0], out[0xC3:0xC6] = 1, 1
    return out


_KIND = _kinds()
# Of these letters, two bytes each, those that aren't letters (U+D7, U+F7) or don't stay one in lower case (U+130).
_ODD = (0xC397, 0xC3B7, 0xC4B0)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(NAME)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def by_words(path: str) -> bool:
    """Whether the tokenizer in a file lower-cases, drops white space and encodes pieces of words by themselves."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    steps = [x.get("type") for x in (raw.get("normalizer") or {}).get("normalizers", [])]
    cuts = [x.get("pattern", {}).get("Regex") for x in (raw.get("pre_tokenizer") or {}).get("pretokenizers", []) if x.get("type") == "Split"]
    return steps == STEPS and cuts == [PATTERN] and raw["model"].get("end_of_word_suffix") == END_MARK and raw.get("post_processor") is None and raw.get("decoder") is None


def lowered(text: bytes) -> bytes:
    """A text with the same ids and fewer distinct words. Special tokens are told by case: texts with what may be one stay."""
    return text if b"<|" in text else text.lower()


def words_of(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """As `common.spaced_words`, of texts with the same ids as these."""
    return common.spaced_words([lowered(x) for x in texts])


def spans(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places from each begin to its end, one behind another, and how many each gives."""
    sizes = ends - begins
    after = np.cumsum(sizes)
    return np.repeat(ends - after, sizes) + np.arange(after[-1] if len(after) else 0), sizes


def runs(stops: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs that `which` names, one behind another, where run k ends at stops[k]; and their sizes."""
    return spans(np.where(which > 0, stops[which - 1], 0), stops[which])


class Encoder:
    """Ids of words as little-endian 32-bit integers; what it has encoded is kept while it stays within a bound."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.tokenizer, self.held = load(path), {}
        self.flat, self.stops = np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)
        self.by_words = by_words(path)
        if self.by_words:  # for words that are in their final form
            from tokenizers import normalizers

            self.plain = load(path)
            self.plain.normalizer = normalizers.Sequence([])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[i] = piece.endswith(END_MARK)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker process and file: tasks of a worker share what it holds."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def one_by_one(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in texts], add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def encode_new(self, words: list[bytes]) -> list[bytes]:
        """Ids of words without white space: plain words all at once, whose ids fall apart behind the ends of their pieces."""
        if b"" in words:
            found = iter(self.encode_new([w for w in words if w]))
            return [next(found) if w else b"" for w in words]
        if not words:
            return []
        blob = b" ".join(words)
        raw = np.frombuffer(blob, dtype=np.uint8)
        kind = _KIND[raw]
        start = np.cumsum([0, *(len(w) + 1 for w in words)], dtype=np.int64)[:-1]
        kind[:-1][np.isin(raw[:-1].astype(np.uint16) << 8 | raw[1:], _ODD)] = 4
        plain = np.maximum.reduceat(kind, start) < 4
        if b"<|" in blob:
            plain &= np.array([b"<|" not in w for w in words])
        new = kind > 0
        new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        pieces = np.add.reduceat(new.astype(np.int64), start)  # of each word
        simple, out = np.flatnonzero(plain).tolist(), [b""] * len(words)
        if simple:
            text = blob if len(simple) == len(words) else b" ".join([words[k] for k in simple])
            ids = np.array(self.plain.encode_batch_fast([text.decode().lower()], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            stops = np.cumsum(pieces[plain])
            if len(cuts) != stops[-1] or cuts[-1] != len(ids):
                return self.one_by_one(words)
            flat, at = ids.tobytes(), [0, *(4 * cuts[stops - 1]).tolist()]
            if len(simple) == len(words):
                return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
            for k, a, b in zip(simple, at, at[1:], strict=False):
                out[k] = flat[a:b]
        rest = np.flatnonzero(~plain).tolist()
        for k, ids in zip(rest, self.one_by_one([words[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def forget(self) -> None:
        self.held.clear()
        self.flat, self.stops = self.flat[:0], self.stops[:0]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The place of each word (with a space behind it) among those held; new ones are encoded."""
        if len(self.held) > _CACHE:
            self.forget()
        found = np.array(list(map(self.held.get, words, itertools.repeat(-1))), dtype=np.int64)
        at = np.flatnonzero(found < 0)
        if len(at):
            new = [words[k] for k in at.tolist()]
            base, ids = len(self.held), self.encode_new([w[:-1] for w in new])
            self.held.update(zip(new, range(base, base + len(new)), strict=True))
            found[at] = np.arange(base, base + len(new))
            self.stops = np.concatenate([self.stops, len(self.flat) + np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), dtype="<u4")])
        return found

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one text after another, and where each text's end."""
        if not self.by_words:
            own = self.one_by_one(texts)
            return np.frombuffer(b"".join(own), dtype="<u4"), np.cumsum([len(x) // 4 for x in own], dtype=np.int64)
        words, ends = words_of(texts)
        which = self.numbers(words.dictionary.to_pylist())[words.indices.to_numpy()]
        at, sizes = runs(self.stops, which)
        return self.flat[at], np.concatenate([[0], np.cumsum(sizes)])[ends]

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        flat, ends = self.ids(texts)
        return [flat[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
