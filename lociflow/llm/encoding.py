"""Token ids of whole texts with the tokenizers library, each distinct word encoded once in a batch."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

#: The normaliser and splitter for which a text's ids are those of its words, one after another.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Words of visible ASCII and Latin-1 letters: composed already, and lower-cased letter by letter.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+|\n")


class Lists:
    """Lists of ids end to end."""

    def __init__(self):
        self.size, self.start, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def add(self, size: np.ndarray, flat: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[which]
        upto = np.cumsum(size)
        return self.flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.start[which] - (upto - size), size)], size


class Encoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    With the splitter above no token crosses white space, so ids are looked up word by word: plain words are
    cut into pieces here and the model encodes each distinct piece; any other word goes through the whole
    tokenizer. With any other splitter whole texts go through it. ``keep`` and ``keep_pieces`` bound what is
    remembered from one batch to the next; a batch of more is still encoded whole.
    """

    def __init__(self, path: str, keep: int = 500_000, keep_pieces: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.marks = [x["content"] for x in spec["added_tokens"]]
        self.by_word = (
            spec["normalizer"] == WORD_NORMALIZER
            and spec["pre_tokenizer"] == WORD_SPLITTER
            and all(x["special"] and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) and x["content"].startswith("<|") for x in spec["added_tokens"])
        )
        self.of_pieces = Tokenizer(self.whole.model)
        self.of_pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.keep, self.keep_pieces = keep, keep_pieces
        self.word: dict[bytes, int] = {}
        self.piece: dict[str, int] = {}
        self.words, self.pieces = Lists(), Lists()

    def _forget(self) -> None:
        if len(self.word) > self.keep:
            self.word, self.words = {}, Lists()
        if len(self.piece) > self.keep_pieces:
            self.piece, self.pieces = {}, Lists()

    def _learn(self, words: list[bytes]) -> None:
        """``words`` are new; their lists of ids come after those known."""
        texts = b"\n".join(words).decode("utf-8", "replace").split("\n")
        full = PLAIN.fullmatch
        odd = [i for i, t in enumerate(texts) if not full(t) or "<|" in t]
        whole = self.whole.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)
        for i in odd:
            texts[i] = ""
        cut = PIECES.findall("\n".join([*texts, ""]).lower())
        fresh = [p for p in dict.fromkeys(cut) if p not in self.piece]
        if "\n" not in self.piece:
            self.pieces.add(np.zeros(1, np.int64), np.empty(0, np.uint32))
            self.piece["\n"] = 0
            fresh = [p for p in fresh if p != "\n"]
        for begin in range(0, len(fresh), 20_000):
            part = fresh[begin : begin + 20_000]
            got = self.of_pieces.encode("\n".join(part), add_special_tokens=False)
            self.pieces.add(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)), np.array(got.ids, np.uint32))
        self.piece.update(zip(fresh, range(len(self.piece), len(self.piece) + len(fresh))))
        which = np.fromiter(map(self.piece.__getitem__, cut), np.int64, len(cut))
        flat, size = self.pieces.take(which)
        # A line feed, which has no ids, ends a word.
        ends = np.flatnonzero(which == 0)
        of_word = np.diff(np.concatenate([[0], np.cumsum(size)[ends]]))
        if odd:
            own = [x.ids for x in whole]
            more = np.fromiter(map(len, own), np.int64, len(own))
            flat = np.insert(flat, np.repeat((np.cumsum(of_word) - of_word)[odd], more), np.fromiter(chain.from_iterable(own), np.uint32, int(more.sum())))
            of_word[odd] = more
        self.words.add(of_word, flat)

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        return self.encode(texts, only_lengths=True)[1]

    def encode(self, texts: list[str | None], only_lengths: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many are each text's. A null text has none."""
        if not self.by_word:
            got = [x.ids for x in self.whole.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]
            size = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())), size
        self._forget()
        split = [x.encode("utf-8", "replace").split() if x else [] for x in texts]
        known = self.word
        fresh = list({w for words in split for w in words} - known.keys())
        if fresh:
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
            self._learn(fresh)
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        which = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(n_words.sum()))
        upto = np.concatenate([[0], np.cumsum(self.words.size[which])])
        bounds = np.concatenate([[0], np.cumsum(n_words)])
        of_text = upto[bounds[1:]] - upto[bounds[:-1]]
        if only_lengths:
            return np.empty(0, np.uint32), of_text
        return self.words.take(which)[0], of_text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker: what it knows serves the worker's later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def portions(texts: list[str | None], limit: int = 1 << 21):
    """Ranges of the list that hold about ``limit`` characters; a longer text is a portion of its own."""
    begin, held = 0, 0
    for i, x in enumerate(texts):
        held += len(x or "")
        if held >= limit:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
