"""Countable statistics of whole texts, vectorised over blocks of texts."""

from __future__ import annotations

import numpy as np

from foliometry.llm.words import SPACE, hashes, lines, owners, sums, window_hashes, words

REPEAT_WORDS = 5

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[ord(c) for c in "!\"'(),-./:;?@[\\]^_`{}~+="]] = True
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[[ord(c) for c in ".?!"]] = True


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: counts of words, characters, symbols, repeated lines and repeated word windows (all int64)."""
    starts, ends, first = words(data, offsets)
    of_word = owners(first)
    lead = (data & 0xC0) != 0x80
    in_word = ~SPACE[data]
    out = {
        "n_words": np.diff(first),
        "n_chars": sums(lead, offsets),
        "word_chars": sums(in_word & lead, offsets),
        "n_symbols": sums(SYMBOL[data], offsets),
        "n_upper": sums(UPPER[data], offsets),
        "n_digits": sums(DIGIT[data], offsets),
        "n_punctuation": sums(PUNCTUATION[data], offsets),
    }
    final = SENTENCE_END[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    out["n_sentence_ends"] = sums(final, first)
    word_hashes = hashes(data, starts, ends)
    out["n_distinct_words"] = distinct(word_hashes, of_word, len(offsets) - 1)

    line_starts, line_ends, line_first = lines(data, offsets)
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    of_line = owners(line_first)[with_word]
    out["n_lines"] = np.bincount(of_line, minlength=len(offsets) - 1)
    out["n_dup_lines"] = out["n_lines"] - distinct(hashes(data, line_starts[with_word], line_ends[with_word]), of_line, len(offsets) - 1)

    windows = window_hashes(word_hashes, REPEAT_WORDS)
    whole = of_word[: len(windows)] == of_word[len(of_word) - len(windows) :]
    at = np.flatnonzero(whole)
    keys, text = windows[at], of_word[at]
    order = np.lexsort((keys, text))
    same = (keys[order][1:] == keys[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(word_hashes) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + REPEAT_WORDS, -1)
    out["n_repeat_words"] = sums(np.cumsum(cover[:-1]) > 0, first)
    return {name: values.astype(np.int64) for name, values in out.items()}


def distinct(keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each of n texts; `text` is ascending."""
    if not len(keys):
        return np.zeros(n, np.int64)
    order = np.lexsort((keys, text))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (text[1:] != text[:-1])
    return np.bincount(text[new], minlength=n)
