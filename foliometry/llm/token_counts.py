"""Token counts of whole texts; huge texts by overlapping chunks that are spliced where both encodings must agree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliometry.llm.tables import arrow_pass, read
from foliometry.llm.tokenizing import KEEPING, RARE_SPACE, Encoder, encoder
from foliometry.llm.words import blocks

VOCABULARY = "byte_bpe_50k.json"
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
TOKEN_LIMIT = 512

_SPACES = frozenset(" \t\n\r")
BORDER = re.compile(r"[^ \t\n\r][ \t\n\r]")


class _Chunk:
    """The library's tokens of text[start:end]: how many there are, and how many end at or before each token border."""

    def __init__(self, code: Encoder, text: str, start: int, end: int):
        offsets = code.library.encode(text[start:end], add_special_tokens=False).offsets
        self.start, self.end, self.size = start, end, len(offsets)
        self.upto = {start + b: k + 1 for k, (_, b) in enumerate(offsets)}


def _stable(text: str, at: int) -> bool:
    """No pre-token and no special token crosses this border, in any context: white space follows a character that is none."""
    return text[at] in _SPACES and text[at - 1] not in _SPACES and not RARE_SPACE.match(text[at - 1])


def _common(text: str, left: _Chunk, right: _Chunk, after: int) -> int | None:
    """A stable border inside the overlap that both encodings have, the one nearest to its middle."""
    low, high = max(right.start, after) + 1, left.end - 1
    middle = (low + high) // 2
    for step in range(max(middle - low, high - middle) + 1):
        for at in (middle - step, middle + step):
            if low <= at <= high and at in left.upto and at in right.upto and _stable(text, at):
                return at
    return None


def chunked_count(code: Encoder, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[int, int]:
    """(tokens, chunks encoded) of a text, by chunks that overlap.

    Where the overlap has no common stable border it is doubled, up to the whole chunk; overlaps whose text has no border at all are not encoded. A
    chunk without any common border is doubled, or grows to the next border of the text where that is further, so a text without white space is
    encoded whole after its first chunk and work stays linear. The count is always the library's.
    """
    if code.pieces is not KEEPING:
        return len(code.whole(text)), 1
    total, done, encoded = 0, 0, 1
    current = _Chunk(code, text, 0, min(chunk, len(text)))
    counted = 0
    while current.end < len(text):
        width, at, following = overlap, None, None
        while at is None:
            start = max(current.end - width, current.start)
            if not BORDER.search(text, start, current.end):
                if start == current.start:
                    break
                width *= 2
                continue
            following = _Chunk(code, text, start, min(start + max(chunk, 2 * width), len(text)))
            encoded += 1
            at = _common(text, current, following, done)
            if at is None and start == current.start:
                break
            width *= 2
        if at is None:
            ahead = BORDER.search(text, current.end - 1)
            end = max(2 * current.end - current.start, ahead.end() + overlap if ahead else len(text))
            current = _Chunk(code, text, current.start, min(end, len(text)))
            encoded += 1
            counted = current.upto[done] if done > current.start else 0
            continue
        total += current.upto[at] - counted
        current, counted, done = following, following.upto[at], at
    return total + current.size - counted, encoded


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and n_chunks of each row, in one pass without a shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. Texts of up to `chunk` bytes are one chunk. Repeated rows give repeated results;
    an empty table gives no rows; other columns are ignored. Work is linear in a text's length, with or without white space.
    """

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        code = encoder(vocabulary)
        for row, end, data, offsets in blocks(batch.column("text")):
            small = np.diff(offsets) <= chunk
            counts, chunks = np.zeros(end - row, np.int64), np.ones(end - row, np.int64)
            if small.any():
                kept = np.repeat(small, np.diff(offsets))
                counts[small] = code.count_block(data[kept], np.concatenate([[0], np.cumsum(np.diff(offsets)[small])]))
            for k in np.flatnonzero(~small):
                counts[k], chunks[k] = chunked_count(code, data[offsets[k] : offsets[k + 1]].tobytes().decode(), chunk, overlap)
            yield {"doc_id": batch.column("doc_id")[row:end], "n_bytes": np.diff(offsets), "n_tokens": counts, "n_chunks": chunks}

    return arrow_pass(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), step, "doc_id bigint, n_bytes bigint, n_tokens bigint, n_chunks bigint")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(read(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "n_chunks")
