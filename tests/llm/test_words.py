import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from foliometry.llm.statistics import text_statistics
from foliometry.llm.words import blocks, hashes, words

TEXT = st.lists(st.sampled_from(["a", "b", "cc", "é", "漢", " ", "\n", "\t", "\x0b", "#", "A1", ".", "x y z w v "]), max_size=40).map("".join)


def brute(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    covered = {j for i in range(len(found) - 4) if windows[tuple(found[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | TEXT, min_size=1, max_size=8))
def test_statistics_of_blocks(texts):
    for row, end, data, offsets in blocks(pa.array(texts, pa.string()), 30):
        got = text_statistics(data, offsets)
        for k in range(row, end):
            assert tuple(int(got[c][k - row]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(texts[k])


def thue_morse(n, a="a", b="b"):
    word = "".join((a, b)[bin(k).count("1") % 2] for k in range(n))
    return word, word.translate(str.maketrans({a: b, b: a}))


def test_complementary_words_have_other_hashes():
    for n in (64, 256, 1024, 4096):
        data = np.frombuffer(" ".join(thue_morse(n)).encode(), np.uint8)
        starts, ends, _ = words(data, np.array([0, len(data)]))
        assert len(set(hashes(data, starts, ends).tolist())) == 2
    data = np.arange(256, dtype=np.uint8).repeat(3)
    every = [(a, b) for a in range(0, 700, 7) for b in range(a, min(a + 20, 768))]
    parts = {data[a:b].tobytes() for a, b in every}
    assert len(set(hashes(data, np.array([a for a, _ in every]), np.array([b for _, b in every])).tolist())) == len(parts)


def test_hash_depends_on_bytes_only():
    text = ("alpha beta alpha " * 90_000 + "beta").encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]))
    got = hashes(data, starts, ends)
    assert len(set(got.tolist())) == 2
    assert zlib.crc32(b"") == 0
