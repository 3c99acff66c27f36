"""Token ids of whole texts, exactly as the tokenizer's library gives them, with most words encoded once per worker.

Two kinds of vocabulary files are split at borders which no token and no pre-token crosses, whatever stands around them:
a byte-level file between a character that is not white space and one of space, tab, \\n, \\r that follows it; a file that drops white
space at every white space character of ASCII. The pieces between are encoded once, found again by a hash and compared by their bytes. Any other file, and any text with rarer white space characters, is encoded whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

from foliometry.llm.words import hashes, owners, same_bytes, sums, words

CACHE_PIECES = 1_500_000
CACHE_STEMS = 300_000
CACHE_BYTES = 64 << 20

RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
KEEPING, DROPPING = "keeping", "dropping"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN_KEEPING = re.compile(rf"([ \n]?)([{LETTERS}]+)([.,]?)")
PLAIN_DROPPING = re.compile(rf"()([{LETTERS}]+)([.,]?)")


def place(name: str) -> str:
    """A path as it is, or the name of a public vocabulary file."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in printable}
    others = (b for b in range(256) if b not in table)
    table |= {b: chr(256 + k) for k, b in enumerate(others)}
    return [table[b] for b in range(256)]


class Encoder:
    """ids_block gives the ids of a block of texts, count_block their numbers; whole(text) is the library's own way."""

    def __init__(self, name: str):
        self.path = place(name)
        self.stems: dict[str, tuple[int, ...]] = {}
        self.pieces = self.plain = None
        if self.path.endswith(".model"):
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=self.path)
            size = self.library.get_piece_size()
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            size = self.library.get_vocab_size()
            self._recognise()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self._forget()

    def _recognise(self) -> None:
        with open(self.path, encoding="utf-8") as file:
            layout = json.load(file)
        before, normal = layout["pre_tokenizer"] or {}, layout["normalizer"]
        added = layout["added_tokens"]
        if layout["truncation"] or layout["padding"] or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or re.search(r"\s", a["content"]) for a in added):
            return
        self.letters = byte_letters()
        self.lower = False
        if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and normal is None:
            self.pieces, self.plain = KEEPING, PLAIN_KEEPING
        steps = [p.get("type") for p in before.get("pretokenizers", ())]
        kinds = [n["type"] for n in (normal or {}).get("normalizers", ())]
        if steps == ["Split", "ByteLevel"] and kinds == ["NFC", "Replace", "Lowercase"] and before["pretokenizers"][0]["behavior"] == "Removed":
            self.pieces, self.plain, self.lower = DROPPING, PLAIN_DROPPING, True

    def whole(self, text: str) -> list[int]:
        """The library's own answer."""
        if self.path.endswith(".model"):
            return self.library.encode(text, out_type=int)
        return self.library.encode(text, add_special_tokens=False).ids

    def _stem(self, stem: str) -> tuple[int, ...]:
        """Ids of one pre-token of letters, or of one mark, from the library's model."""
        found = self.stems.get(stem)
        if found is None:
            if len(self.stems) >= CACHE_STEMS:
                self.stems.clear()
            plain = stem.lower() if self.lower else stem
            mapped = plain if plain.isascii() and plain.isalpha() else "".join([self.letters[b] for b in plain.encode()])
            found = self.stems[stem] = tuple([t.id for t in self.library.model.tokenize(mapped)])
        return found

    def _piece(self, piece: str) -> list[int] | tuple[int, ...]:
        simple = self.plain.fullmatch(piece)
        if simple is None:
            return self.whole(piece)
        space, stem, mark = simple.groups()
        ids = self._stem(space) + self._stem(stem) if space == "\n" else self._stem(space + stem)
        return ids + self._stem(mark) if mark else ids

    def _encoded(self, raw: bytes) -> list[int] | tuple[int, ...]:
        if self.pieces is DROPPING:
            if raw.isalpha():  # letters of ASCII alone
                return self._stem(raw.decode())
            if raw[-1:] in (b".", b",") and raw[:-1].isalpha():
                return self._stem(raw[:-1].decode()) + self._stem(raw[-1:].decode())
        piece = raw.decode()
        return () if RARE_SPACE.search(piece) else self._piece(piece)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Store new pieces with their ids; their entries. Length -1 tells that a text with this piece must be encoded whole."""
        collecting = gc.isenabled()
        gc.disable()  # many small objects, none in a cycle
        try:
            encoded = [self._encoded(raw) for raw in pieces]
        finally:
            if collecting:
                gc.enable()
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ids = np.fromiter(chain.from_iterable(encoded), self.dtype, int(lengths.sum()))
        entries = len(self.lengths) + np.arange(len(pieces))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, np.where(lengths == 0, -1, lengths)])
        self.flat = np.concatenate([self.flat, ids])
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.places = np.concatenate([self.places, len(self.bytes) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(pieces), np.uint8)])
        return entries

    def _forget(self) -> None:
        """Entry 0 is for pieces that are no known piece: their texts are encoded whole."""
        self.keys, self.entries = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.lengths, self.flat = np.zeros(1, np.int64), np.full(1, -1, np.int64), np.zeros(0, self.dtype)
        self.places, self.sizes, self.bytes = np.zeros(1, np.int64), np.full(1, -1, np.int64), np.zeros(0, np.uint8)

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of a block of texts, and each text's first piece."""
        starts, ends, first = words(data, offsets)
        if self.pieces is KEEPING:
            text = owners(first)
            before = np.empty_like(starts)
            before[1:] = ends[:-1]
            heads = first[:-1][first[:-1] < first[1:]]
            before[heads] = offsets[text[heads]]
            last = np.where(first[1:] > first[:-1], ends[np.maximum(first[1:] - 1, 0)] if len(ends) else 0, offsets[:-1])
            loose = np.flatnonzero(last < offsets[1:])
            starts, ends = np.insert(before, first[loose + 1], last[loose]), np.insert(ends, first[loose + 1], offsets[loose + 1])
            first = first + np.searchsorted(loose, np.arange(len(first)), "left")
        return starts, ends, first

    def _entries(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of every piece of a block of texts, and each text's first piece. Pieces are found by a hash and compared by their bytes."""
        starts, ends, first = self._cut(data, offsets)
        keys, example, column = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_PIECES or len(self.bytes) > CACHE_BYTES:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        entry = np.empty(len(keys), np.int64)
        entry[~new] = self.entries[at[~new]]
        raw = data.tobytes()
        entry[new] = self._learn([raw[starts[k] : ends[k]] for k in example[new].tolist()])
        self.keys, self.entries = np.insert(self.keys, at[new], keys[new]), np.insert(self.entries, at[new], entry[new])
        found = entry[column]
        return np.where(same_bytes(data, starts, ends, self.bytes, self.places[found], self.sizes[found]), found, 0), first

    def _by_text(self, data: np.ndarray, offsets: np.ndarray, texts: np.ndarray) -> dict[int, list[int]]:
        return {int(t): self.whole(data[offsets[t] : offsets[t + 1]].tobytes().decode()) for t in texts}

    def count_block(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each text of a block."""
        if self.pieces is None:
            return np.array([len(x) for x in self._by_text(data, offsets, np.arange(len(offsets) - 1)).values()], np.int64)
        entry, first = self._entries(data, offsets)
        lengths = self.lengths[entry]
        counts = sums(lengths, first)
        odd = np.unique(owners(first)[lengths < 0])
        for text, ids in self._by_text(data, offsets, odd).items():
            counts[text] = len(ids)
        return counts

    def ids_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block in a row, and where each text's begin."""
        n = len(offsets) - 1
        if self.pieces is None:
            found = self._by_text(data, offsets, np.arange(n))
            lists = [np.array(found[t], self.dtype) for t in range(n)]
            return np.concatenate([np.zeros(0, self.dtype), *lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        entry, first = self._entries(data, offsets)
        lengths = self.lengths[entry]
        odd = np.unique(owners(first)[lengths < 0])
        lengths = np.maximum(lengths, 0)
        where = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=where[1:])
        flat = self.flat[np.repeat(self.starts[entry] - where[:-1], lengths) + np.arange(where[-1])]
        if not len(odd):
            return flat, where[first]
        found = self._by_text(data, offsets, odd)
        lists = [np.array(found[t], self.dtype) if t in found else flat[where[first[t]] : where[first[t + 1]]] for t in range(n)]
        return np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """One encoder, with its caches, for each worker process and vocabulary."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(name)
