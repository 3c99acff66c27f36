"""Phrase collocations: phrases of two to four words, counted by sorting suffix pointers, scored by their weakest cut.

Every word of a piece begins a suffix of up to DEPTH words. Tasks count equal suffixes of their own texts first. Suffixes are then routed by their
leading words to buckets: by the first word, by more where the first ones lead more than half a bucket. In a bucket the pointers are sorted
by a multikey three-way quicksort; the size of an equal partition is the number of occurrences of its phrase, and a partition below the
least count is abandoned, as no phrase in it can reach that count elsewhere.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliometry.llm.tables import new_folder, read, stored

DEPTH = 4
LEAST = 30
INSIDE_PERCENT = 80
TOP = 2000
UNKNOWN = "und"

BUCKET_WORDS = 1_500_000
FLUSH_WORDS = 2_000_000
CHUNK_BYTES = 4 << 20
COMMON_WORDS = 1 << 15
MOST_HEAVY = 100_000
SMALL = 4096

BREAK = b"\xff"
#: A-Z in lower case, ends of pieces as a byte that no text holds, a tab as a space.
FOLD = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 10))

ROUTED = "lang string, bucket int, used binary, extra binary, codes binary, width int, times binary"
PHRASES = "lang string, phrase string, size int, f bigint"


def chunks(text: bytes) -> Iterator[bytes]:
    """The folded text in parts of about CHUNK_BYTES, cut between words only."""
    at = 0
    while at < len(text):
        end = at + CHUNK_BYTES
        if end < len(text):
            back = max(text.rfind(b" ", at, end), text.rfind(BREAK, at, end))
            ahead = [k for k in (text.find(b" ", end), text.find(BREAK, end)) if k >= 0]
            end = back + 1 if back >= at else min(ahead, default=len(text) - 1) + 1
        yield text[at:end]
        at = end


class Words:
    """Numbers for words in the order in which they are met; 0 ends a piece."""

    def __init__(self):
        self.of: defaultdict = defaultdict(count(1).__next__, {BREAK: 0})

    def codes(self, texts: list[bytes]) -> np.ndarray:
        """The words of the texts as numbers, in order, with at least one break after each text."""
        parts = []
        for part in chunks(BREAK.join(texts).translate(FOLD) + BREAK):
            found = part.replace(BREAK, b" \xff ").split()
            parts.append(np.fromiter(map(self.of.__getitem__, found), np.int32, len(found)))
        return np.concatenate(parts)


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The batch's texts of each lang, in groups of about CHUNK_BYTES."""
    langs, texts = batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary())
    groups: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        groups.setdefault(lang, []).append(k)
    for lang, rows in groups.items():
        held, size = [], 0
        for k in rows:
            text = texts[k].as_py()
            held.append(text)
            size += len(text)
            if size > CHUNK_BYTES:
                yield lang, held
                held, size = [], 0
        if held:
            yield lang, held


def coded_words(documents: DataFrame) -> DataFrame:
    """(lang, listed, codes): the words of about FLUSH_WORDS words of one lang's texts, joined by spaces, and their numbers from 1 in the order of
    the text, 0 where a piece ends. Written once, as the texts are read for nothing else."""
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def row(lang: str, words: Words, parts: list[np.ndarray]) -> pa.RecordBatch:
        listed = b" ".join(islice(words.of, 1, None))
        return pa.RecordBatch.from_pydict({"lang": [lang], "listed": pa.array([listed], pa.binary()), "codes": pa.array([np.concatenate(parts).tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Words, list]] = {}
        size = 0
        for batch in batches:
            for lang, group in by_lang(batch):
                words, parts = held.setdefault(lang, (Words(), []))
                parts.append(words.codes(group))
                size += len(parts[-1])
                if size > FLUSH_WORDS:
                    yield from (row(k, *v) for k, v in held.items())
                    held, size = {}, 0
        yield from (row(k, *v) for k, v in held.items())

    spark = documents.sparkSession
    path = new_folder(spark, "coded-words")
    schema = "lang string, listed binary, codes binary"
    texts.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def coded_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(lang, words, codes) of the rows of coded_words; words[0] stands for the end of a piece."""
    for batch in batches:
        for k in range(batch.num_rows):
            listed = batch.column("listed")[k].as_py()
            yield batch.column("lang")[k].as_py(), [BREAK, *(listed.split(b" ") if listed else [])], np.frombuffer(batch.column("codes")[k].as_buffer(), np.int32)


def word_counts(coded: DataFrame) -> DataFrame:
    """(lang, phrase, size = 1, f): every word with its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, listed, codes in coded_rows(batches):
            sizes = np.bincount(codes, minlength=len(listed))
            yield counts_batch(lang, listed[1:], sizes[1:].astype(np.int64))

    local = coded.mapInArrow(run, "lang string, phrase string, f bigint")
    return local.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).select("lang", "phrase", F.lit(1).alias("size"), "f")


def counts_batch(lang: str, phrases: list[bytes], f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": pa.repeat(lang, len(phrases)), "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "f": pa.array(f, pa.int64())})


def suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, times): the different suffixes of two words or more, DEPTH rows of numbers with 0 behind their piece's end, sorted, and how often each occurs."""
    columns = np.zeros((DEPTH, len(codes)), np.int32)
    columns[0] = codes
    for d in range(1, DEPTH):
        np.multiply(codes[d:], columns[d - 1, :-d] > 0, out=columns[d, :-d])
    long = np.flatnonzero((columns[0] > 0) & (columns[1] > 0))
    high, low = (columns[d, long].astype(np.int64) << 32 | columns[d + 1, long] for d in (0, 2))
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    first = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))[: len(order)])
    times = np.diff(first, append=len(order))
    return np.ascontiguousarray(columns[:, long[order[first]]]), times


def leads(columns: np.ndarray, words: list[bytes], lang: str, heavy: list[set]) -> np.ndarray:
    """How many leading words route each suffix: one more than the longest heavy phrase that it begins with. heavy[k]: (lang, phrase) of k + 1 words."""
    depth = np.ones(columns.shape[1], np.int64)
    numbers = {w: k for k, w in enumerate(words)} if any(heavy) else {}
    for size, phrases in enumerate(heavy, 1):
        known = [[numbers.get(w, -1) for w in phrase.encode().split(b" ")] for of, phrase in phrases if of == lang]
        wanted = {tuple(p) for p in known if -1 not in p}
        if not wanted:
            break
        candidates = np.flatnonzero(depth == size)
        for p in wanted:
            candidates_here = candidates
            for d, number in enumerate(p):
                low, high = np.searchsorted(columns[d, candidates_here], [number, number + 1])
                candidates_here = candidates_here[low:high]
            depth[candidates_here] = size + 1
    return depth


def heavy_phrases(coded: DataFrame, shorter: list[dict], heavy_count: int) -> dict:
    """{(lang, phrase): f} above heavy_count, of the phrases one word longer than the last ones in `shorter`, which begin with these."""
    chain, size = [set(h) for h in shorter], len(shorter) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, listed, codes in coded_rows(batches):
            columns, times = suffixes(codes)
            at = np.flatnonzero((leads(columns, listed, lang, chain) == size) & (columns[size - 1] > 0))
            columns, times = columns[:size, at], times[at]
            first = np.flatnonzero(np.append(True, (columns[:, 1:] != columns[:, :-1]).any(0))[: len(at)])
            if len(first):
                phrases = [b" ".join([listed[k] for k in p]) for p in columns[:, first].T.tolist()]
                yield counts_batch(lang, phrases, np.add.reduceat(times, first))

    counts = coded.mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return {(r["lang"], r["phrase"]): r["f"] for r in counts.where(F.col("f") > heavy_count).collect()}


def routed(coded: DataFrame, common: list[bytes], buckets: dict[str, int], heavy: list[dict]) -> DataFrame:
    """(lang, bucket, used, extra, codes, width, times): the suffixes of one row of coded_words that go to one bucket.

    used are the numbers of common words in it, from 1, and extra its other words, joined by spaces; codes are DEPTH rows of numbers of `width` bytes,
    0 for none, then the used words and then the extra ones.
    """
    chain = [set(h) for h in heavy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(common, 1)}
        for lang, listed, codes in coded_rows(batches):
            columns, times = suffixes(codes)
            shared = np.fromiter((number.get(w, 0) for w in listed), np.uint32, len(listed))
            bucket = bucket_of(columns, leads(columns, listed, lang, chain), listed, buckets.get(lang, 1))
            order = np.argsort(bucket, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(bucket[order])) + 1, len(order))
            at, rows = 0, []
            for end in ends.tolist() if len(order) else []:
                part = order[at:end]
                at = end
                rows.append((lang, int(bucket[part[0]]), *packed(columns[:, part], times[part], listed, shared)))
            if rows:
                types = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=ROUTED.replace(",", "").split()[::2])

    return coded.mapInArrow(run, ROUTED)


def bucket_of(columns: np.ndarray, depth: np.ndarray, listed: list[bytes], buckets: int) -> np.ndarray:
    """A bucket for each suffix, from its first `depth` words."""
    marks = np.fromiter(map(zlib.crc32, listed), np.uint64, len(listed))
    mark = np.zeros(columns.shape[1], np.uint64)
    for d in range(int(depth.max(initial=0))):
        mixed = (mark ^ marks[columns[d]]) * np.uint64(0x9E3779B97F4A7C15)
        mark = np.where(d < depth, mixed ^ (mixed >> np.uint64(29)), mark)
    return ((mark >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)


def packed(columns: np.ndarray, times: np.ndarray, listed: list[bytes], shared: np.ndarray) -> tuple:
    seen = np.zeros(len(listed), bool)
    seen[columns.ravel()] = True
    seen[0] = False
    present = np.flatnonzero(seen)
    known = shared[present] > 0
    used, extra = present[known], present[~known]
    small = np.zeros(len(listed), np.uint32)
    small[used] = np.arange(1, len(used) + 1)
    small[extra] = np.arange(len(used) + 1, len(present) + 1)
    width = 2 if len(present) < 1 << 16 else 4
    codes = small[columns].astype(f"<u{width}")
    return shared[used].astype("<u4").tobytes(), b" ".join([listed[k] for k in extra.tolist()]), codes.tobytes(), width, times.astype("<u4").tobytes()


def unpacked(table: pa.Table, common: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(columns, times, words) of all rows of one bucket, with one numbering of words."""
    extras = Words()
    parts, times = [], []
    for row in table.to_batches():
        for k in range(row.num_rows):
            extra = row.column("extra")[k].as_py()
            numbers = [len(common) + extras.of[w] for w in extra.split(b" ")] if extra else []
            every = np.concatenate([[0], np.frombuffer(row.column("used")[k].as_py(), "<u4"), numbers]).astype(np.int32)
            codes = np.frombuffer(row.column("codes")[k].as_buffer(), f"<u{row.column('width')[k].as_py()}").reshape(DEPTH, -1)
            parts.append(every[codes])
            times.append(np.frombuffer(row.column("times")[k].as_buffer(), "<u4"))
    return np.concatenate(parts, 1), np.concatenate(times).astype(np.int64), [BREAK, *common, *islice(extras.of, 1, None)]


def equal_partitions(columns: np.ndarray, times: np.ndarray, least: int, small: int = SMALL) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, pointers, totals): one pointer for each phrase of `size` words that occurs `least` times, by a multikey three-way quicksort.

    A partition is split by the word at its depth into smaller, equal and larger ones; the equal one goes on one word deeper and its total is the
    count of its words. Partitions below `least` are abandoned at once; those of at most `small` pointers are finished together by one sort.
    """
    stack, rest = [(np.arange(len(times)), 0)], []
    while stack:
        pointers, depth = stack.pop()
        if times[pointers].sum() < least:
            continue
        if len(pointers) <= small:
            rest.append((pointers, depth))
            continue
        key = columns[depth, pointers]
        pivot = np.partition(sample := key[:: max(1, len(key) // 64)], len(sample) // 2)[len(sample) // 2]
        same = pointers[key == pivot]
        stack.append((pointers[key < pivot], depth))
        stack.append((pointers[key > pivot], depth))
        total = times[same].sum()
        if pivot and total >= least:
            yield depth + 1, same[:1], np.array([total])
            if depth + 1 < DEPTH:
                stack.append((same, depth + 1))
    if rest:
        yield from finished(columns, times, least, rest)


def finished(columns: np.ndarray, times: np.ndarray, least: int, rest: list[tuple[np.ndarray, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The phrases inside small partitions, which lie in sorted order side by side; phrases no longer than a partition's depth are known already."""
    pointers = np.concatenate([p for p, _ in rest])
    sizes = [len(p) for p, _ in rest]
    part, depth = np.repeat(np.arange(len(rest)), sizes), np.repeat([d for _, d in rest], sizes)
    high, low = (columns[d, pointers].astype(np.int64) << 32 | columns[d + 1, pointers] for d in (0, 2))
    order = np.lexsort((low, high, part))
    pointers, part, depth = pointers[order], part[order], depth[order]
    fresh = np.diff(part, prepend=-1) > 0
    for d in range(DEPTH):
        word = columns[d, pointers]
        fresh = fresh | (np.diff(word, prepend=-1) != 0)
        first = np.flatnonzero(fresh)
        totals = np.add.reduceat(times[pointers], first)
        good = (totals >= least) & (word[first] > 0) & (depth[first] <= d)
        if good.any():
            yield d + 1, pointers[first[good]], totals[good]


def frequent_phrases(coded: DataFrame, words: DataFrame, least: int = LEAST, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(lang, phrase, size, f): all phrases of one to DEPTH words with f >= least. words: the table of word_counts."""
    spark = coded.sparkSession
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    whole = totals.agg(F.sum("n")).first()[0] or 0
    buckets = {r["lang"]: -(-r["n"] // bucket_words) for r in totals.where(F.col("n") > bucket_words).collect()}
    top = words.groupBy("phrase").agg(F.sum("f").alias("f")).orderBy(F.desc("f"), "phrase").limit(COMMON_WORDS).select("phrase").collect()
    common = [r["phrase"].encode() for r in top]
    heavy_count = max(bucket_words // 2, whole // MOST_HEAVY, least - 1)
    heavy = [{(r["lang"], r["phrase"]): r["f"] for r in words.where(F.col("f") > heavy_count).collect()}]
    while heavy[-1] and len(heavy) < DEPTH - 1:
        heavy.append(heavy_phrases(coded, heavy, heavy_count))
    shared = spark.sparkContext.broadcast((common, {key for h in heavy for key in h}))

    def run(table: pa.Table) -> pa.Table:
        common, known = shared.value
        lang = table.column("lang")[0].as_py()
        columns, times, listed = unpacked(table, common)
        out: list[tuple] = []
        for size, pointers, totals in equal_partitions(columns, times, least):
            if size > 1:
                for p, f in zip(columns[:size, pointers].T.tolist(), totals.tolist(), strict=True):
                    phrase = b" ".join([listed[k] for k in p]).decode()
                    if (lang, phrase) not in known:
                        out.append((lang, phrase, size, f))
        types = (pa.string(), pa.string(), pa.int32(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, types, strict=True)], names=["lang", "phrase", "size", "f"])

    longer = routed(coded, common, buckets, heavy).groupBy("lang", "bucket").applyInArrow(run, PHRASES)
    leading = [(lang, phrase, size, f) for size, h in enumerate(heavy[1:], 2) for (lang, phrase), f in h.items()]
    return words.where(F.col("f") >= least).unionByName(longer).unionByName(spark.createDataFrame(leading, PHRASES))


def part(phrase: Column, first: Column | int, size: Column) -> Column:
    """`size` words of a phrase from place `first`, counted from 1."""
    return F.array_join(F.slice(F.split(phrase, " "), first, size), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score): candidates with their weakest cut; of equal scores the one after the fewest words."""
    candidates = phrases.where("size > 1").withColumnRenamed("f", "a")
    cut = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumns({"front": part(F.col("phrase"), 1, F.col("cut")), "back": part(F.col("phrase"), F.col("cut") + 1, F.col("size") - F.col("cut"))})
    counts = phrases.select("lang", "phrase", "f")
    joined = cut.join(counts.toDF("lang", "front", "l"), ["lang", "front"]).join(counts.toDF("lang", "back", "r"), ["lang", "back"])
    score = F.expr("cast((2000000 * cast(a as decimal(28, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as bigint)")
    best = joined.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def inside(phrases: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of the candidates that lie in a longer one with at least `percent` of their count."""
    longer = phrases.where("size > 2").select("lang", F.col("phrase").alias("whole"), F.col("size").alias("length"), "f")
    cut = longer.withColumn("words", F.explode(F.sequence(F.lit(2), F.col("length") - 1)))
    cut = cut.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("words") + 1)))
    most = cut.groupBy("lang", part(F.col("whole"), F.col("first"), F.col("words")).alias("phrase")).agg(F.max("f").alias("longest"))
    held = most.join(phrases.select("lang", "phrase", F.col("f").alias("a")), ["lang", "phrase"])
    return held.where(F.expr(f"cast(longest as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {percent}")).select("lang", "phrase")


def collocations(documents: DataFrame, least: int = LEAST, percent: int = INSIDE_PERCENT, top: int = TOP, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each lang (a null one is `und`).

    Null and empty texts have no words and repeated rows count each; an empty table gives no rows; other columns are ignored. Texts of any length
    are read in chunks cut between words, which does not part phrases. A lang's total n and its words are counted first; the driver holds the
    COMMON_WORDS most common words, langs with more than bucket_words words and phrases with more than half of that, at most MOST_HEAVY of
    each length. No word is known by a hash, so counts are exact.
    """
    coded = coded_words(documents)
    words = stored(word_counts(coded))
    phrases = stored(frequent_phrases(coded, words, least, bucket_words))
    kept = scored(phrases).join(inside(phrases, percent), ["lang", "phrase"], "left_anti")
    ranked = kept.withColumn("rank", F.expr("cast(row_number() over (partition by lang order by score desc, a desc, phrase) as bigint)")).where(F.col("rank") <= top)
    return ranked.join(words.groupBy("lang").agg(F.sum("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(string_split_regex(t, '[.,;:!?\x0A-\x0D]'), 1) AS k
  FROM (SELECT lang, row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
),
listed AS (SELECT lang, doc, k, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
places AS (SELECT lang, doc, k, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM listed),
runs AS (
  SELECT lang, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4 FROM places WINDOW p AS (PARTITION BY doc, k ORDER BY i)
),
grams AS (
  SELECT lang, 1 AS size, w AS phrase FROM runs UNION ALL SELECT lang, 2, w || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM runs WHERE w4 IS NOT NULL
),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 30),
cut AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS front, array_to_string(w[k + 1:], ' ') AS back FROM c, range(1, 4) g(k) WHERE k < size
),
cuts AS (
  SELECT cut.lang, cut.phrase, a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = front JOIN f r ON r.lang = cut.lang AND r.phrase = back
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT c.lang, array_to_string(w[i:i + size2 - 1], ' ') AS phrase, max(a) AS longest
  FROM c, range(2, 4) s(size2), range(1, 4) p(i) WHERE size2 < c.size AND i + size2 - 1 <= c.size GROUP BY ALL
),
kept AS (SELECT best.* FROM best LEFT JOIN parts USING (lang, phrase) WHERE NOT coalesce(100 * longest >= 80 * a, false))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""
