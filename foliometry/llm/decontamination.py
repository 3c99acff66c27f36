"""Benchmark decontamination by template windows: questions are found again with other numbers, names and units.

Words are runs of letters and digits. A word that begins with a digit is a number, one that begins with a capital is a name, one of UNITS is a
unit; in a window each of these counts only by its type, any other word as itself. Windows of WINDOW words that share their hash with a
benchmark window are joined, put in line by their distance, and the slots of each line are compared: a value of the item must always stand
for the same value in the document, and names must stay apart. A line is split where a slot disagrees with an earlier one. Windows of lower-cased words are joined as well, of any words; a line of these is
a verbatim copy and has no slots to compare. A third kind of windows counts a whole number (sign, separators, decimals) and a run of capitalised
words as one place, so that a slot may change its width. Items with too few windows are joined as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliometry.llm.tables import free_names, read, stored

WINDOW = 8
MIN_LITERALS = 4
MIN_WINDOWS = 3
MOST_KINDS = 10
BROADCAST_WINDOWS = 2_000_000
ANCHORS = 20_000
COMMON_WORDS = 250

NUMBER, NAME, UNIT = 1, 2, 3
#: How a text is read: lower-cased words as they are, words with slots, or tokens whose numbers and names are one place each.
EXACT, TYPED, PLACED = 0, 1, 2
CODES = ("exact", "typed", "placed")
TOKEN = r"[\p{Ll}\p{Lo}][\p{L}\p{N}]*|[\p{Lu}\p{Lt}][\p{L}\p{N}]*(?:[\s'\u2019-]+[\p{Lu}\p{Lt}][\p{L}\p{N}]*+)*+|(?:[+\-\u2212](?<![\p{L}\p{N}].))?[0-9]+(?:[.,][0-9]+)*+[\p{L}\p{N}]*|[\p{L}\p{N}]+"
#: Words that name a unit.
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "min", "h", "ms", "hz", "khz", "mb", "gb", "kb", "kwh", "w", "kw", "v",
    "meter", "meters", "metre", "metres", "kilometer", "kilometers", "mile", "miles", "foot", "feet", "inch", "inches", "yard", "yards",
    "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees",
)


def words_of(text: Column) -> Column:
    """Runs of letters and digits, as an array; a null or blank text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+"), "")


def tokens_of(text: Column) -> Column:
    """Words, but a whole number and a run of capitalised words are one each."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def slot_type(word: Column) -> Column:
    """NUMBER, NAME, UNIT or, for a literal word, 0."""
    return slots_or(word, F.lit(0))


def canonical(word: Column) -> Column:
    """The type of a slot, the hash of a literal."""
    return slots_or(word, F.xxhash64(word)).cast("bigint")


def slots_or(word: Column, other: Column) -> Column:
    """Most words begin with a plain small letter, which is told first; those are no numbers and no names."""
    first = F.substring(word, 1, 1)
    number = (word >= "0") & (word < ":") | first.isin("+", "-", "\u2212")
    small = (word >= "a") & (word < "{")
    return F.when(~small & number, NUMBER).when(~small & (first != F.lower(first)), NAME).when(word.isin(*UNITS), UNIT).otherwise(other)


def exact(word: Column) -> Column:
    """The hash of a word in lower case."""
    return F.xxhash64(F.lower(word))


def windows_of(codes: Column, reading: int, width: int = WINDOW) -> Column:
    """Hash of each window by its first position; an array shorter than the width has none. Readings share no hash."""
    starts = F.sequence(F.lit(0), F.size(codes) - width)
    return F.when(F.size(codes) >= width, F.transform(starts, lambda i: window_at(codes, i, reading, width))).otherwise(F.array().cast("array<bigint>"))


def window_at(codes: Column, start: Column, reading: int, width: int) -> Column:
    return F.xxhash64(F.slice(codes, start + 1, width), F.lit(reading))


def literals(codes: Column) -> Column:
    """How many of the codes are no slots."""
    return F.size(F.filter(codes, lambda c: (c < NUMBER) | (c > UNIT)))


def common_words(items: DataFrame) -> Column:
    """A map of the items' most common words to their numbers, by lower-case hash."""
    counts = items.select(F.explode(F.transform("item_words", exact)).alias("code")).groupBy("code").count().where("count > 1")
    rows = counts.orderBy(F.desc("count"), "code").limit(COMMON_WORDS).collect()
    return F.map_from_arrays(F.array(*[F.lit(r["code"]) for r in rows]).cast("array<bigint>"), F.array(*[F.lit(r["count"]) for r in rows]).cast("array<bigint>"))


def anchor_word(words: Column, reading: int, common: Column) -> Column:
    """The lower-case hash of the word that the fewest texts should hold: the least common among the items, of these the longest; among literals only
    where slots count by their type; null if there is none."""
    usable = words if reading == EXACT else F.filter(words, lambda w: slot_type(w) == 0)
    rank = lambda w: F.struct((-F.coalesce(F.try_element_at(common, exact(w)), F.lit(0))).alias("rare"), F.length(w).alias("size"), exact(w).alias("code"))
    return F.array_max(F.transform(usable, rank))["code"]


def cut_items(items: DataFrame, reading: int, common: Column, width: int = WINDOW) -> DataFrame:
    """(item_id, kind, reading, width, item_at, window, anchor, literals): all windows of the items' words or tokens."""
    words = F.col("item_tokens" if reading == PLACED else "item_words")
    codes = F.transform(words, exact if reading == EXACT else canonical)
    coded = items.select("item_id", "kind", words.alias("words"), codes.alias("codes"))
    cut = coded.select("*", F.posexplode(windows_of(F.col("codes"), reading, width)).alias("item_at", "window"))
    inside = lambda c: F.slice(c, F.col("item_at") + 1, width)
    figures = (anchor_word(inside("words"), reading, common).alias("anchor"), literals(inside("codes")).alias("literals"))
    return cut.select("item_id", "kind", F.lit(reading).alias("reading"), F.lit(width).alias("width"), "item_at", "window", *figures)


def short_items(items: DataFrame, reading: int, common: Column) -> DataFrame:
    """As cut_items: each item of fewer than WINDOW words or tokens is one window, whatever its width."""
    words = F.col("item_tokens" if reading == PLACED else "item_words")
    coded = items.where(F.size(words).between(1, WINDOW - 1)).withColumns({"words": words, "codes": F.transform(words, exact if reading == EXACT else canonical)})
    whole = (F.lit(reading).alias("reading"), F.size("codes").alias("width"), F.lit(0).alias("item_at"), window_at(F.col("codes"), F.lit(0), reading, F.size("codes")).alias("window"))
    return coded.select("item_id", "kind", *whole, anchor_word(F.col("words"), reading, common).alias("anchor"), literals(F.col("codes")).alias("literals"))


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, reading, width, item_at, window, anchor, least, whole): what is looked for, and how many windows of a line make a find.

    Lower-cased words: any windows, MIN_WINDOWS or all there are; items shorter than a window are one window. Words and tokens with slots: windows
    with MIN_LITERALS literals, MIN_WINDOWS of them. An item with fewer such windows of tokens, but MIN_LITERALS literals all in all, is found
    whole: all its windows with a literal must agree, and then every place. Windows in items of more than MOST_KINDS kinds, that is with
    different templates, are boilerplate and count for no part of an item; an item that has too few others is looked for with all its windows, and all must agree.
    """
    per_item = lambda cut: cut.join(cut.groupBy("item_id").agg(F.count("*").alias("n")), "item_id")
    common = common_words(items)
    verbatim = per_item(cut_items(items, EXACT, common)).withColumns({"least": F.least(F.col("n"), F.lit(MIN_WINDOWS)), "whole": F.lit(False)})
    typed = cut_items(items, TYPED, common).where(F.col("literals") >= MIN_LITERALS).withColumns({"least": F.lit(MIN_WINDOWS), "whole": F.lit(False)})
    tokens = stored(cut_items(items, PLACED, common).where("anchor is not null"))
    placed = tokens.where(F.col("literals") >= MIN_LITERALS).withColumns({"least": F.lit(MIN_WINDOWS), "whole": F.lit(False)})
    rich = placed.groupBy("item_id").count().where(F.col("count") >= MIN_WINDOWS)
    sparse = items.join(rich, "item_id", "left_anti").where(literals(F.transform("item_tokens", canonical)) >= MIN_LITERALS)
    few = per_item(tokens.join(sparse, "item_id", "left_semi")).withColumns({"least": F.col("n"), "whole": F.lit(True)})
    columns = ("item_id", "kind", "reading", "width", "item_at", "window", "anchor", "least", "whole")
    parts = [verbatim, typed, placed, few]
    parts.append(short_items(items, EXACT, common).withColumns({"least": F.lit(1), "whole": F.lit(False)}))
    parts.append(short_items(sparse, PLACED, common).withColumns({"least": F.lit(1), "whole": F.lit(True)}))
    every = stored(reduce(DataFrame.unionByName, [p.select(*columns) for p in parts]).distinct())
    boilerplate = every.where("not whole").groupBy("reading", "window").agg(F.count_distinct("kind").alias("kinds")).where(F.col("kinds") > MOST_KINDS)
    marked = every.join(boilerplate.select("reading", "window", F.lit(True).alias("common")), ["reading", "window"], "left")
    rare = F.col("whole") | F.col("common").isNull()
    reading = ["item_id", "kind", "reading", "width", "whole"]
    sizes = marked.groupBy(*reading).agg(F.count_distinct("item_at").alias("n"), F.count_distinct(F.when(rare, F.col("item_at"))).alias("n_rare"))
    all_of_it = ~F.col("whole") & (F.col("n_rare") < F.col("least")) & (F.col("n") >= F.col("least"))
    sought = marked.join(sizes, reading).where(rare | all_of_it).withColumn("least", F.when(all_of_it, F.col("n")).otherwise(F.col("least")))
    return stored(sought.select(*[c for c in columns if c != "kind"]).distinct())


def clashes(slots: Column) -> Column:
    """Of slots in line, (first, second): each place that contradicts an earlier one, with the last such. A line without any is consistent."""

    def against(p: Column, q: Column) -> Column:
        same_theirs, same_ours = p["theirs"] == q["theirs"], p["ours"] == q["ours"]
        return (q["at"] < p["at"]) & (q["kind"] == p["kind"]) & ((same_theirs & ~same_ours) | ((p["kind"] == NAME) & same_ours & ~same_theirs))

    last = F.transform(slots, lambda p: F.struct(F.array_max(F.transform(F.filter(slots, lambda q: against(p, q)), lambda q: q["at"])).alias("first"), p["at"].alias("second")))
    return F.filter(last, lambda c: c["first"].isNotNull())


def text_key(text: Column) -> list[Column]:
    """What equal texts share: two independent checksums."""
    return [F.xxhash64(text).alias("h1"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("h2")]


def anchored(codes: Column, anchors: list[int] | None) -> Column:
    """Places whose word is one of the anchors; all places where there are too many of these to be a literal."""
    if anchors is None:
        return F.transform(codes, lambda _, i: i)
    return F.filter(F.transform(codes, lambda c, i: F.when(c.isin(*anchors), i)), lambda i: i.isNotNull())


def holds_one_of(codes: Column, anchors: list[int] | None) -> Column:
    """Whether a text has a word that is one of the anchors, or any word where there are too many of these."""
    return F.size(codes) > 0 if anchors is None else F.exists(codes, lambda c: c.isin(*anchors))


def starts_around(places: Column, size: Column, width: int) -> Column:
    """Where windows begin that hold one of the ascending places: of each place those that hold no earlier one. Below MIN_LITERALS words only where that is the whole text."""
    none = F.array().cast("array<int>")

    def first_held(i: Column, n: Column) -> Column:
        start = F.greatest(i - (width - 1), F.coalesce(F.get(places, n - 1) + 1, F.lit(0)))
        return F.when(start <= size - width, F.sequence(start, F.least(i, size - width))).otherwise(none)

    enough = size == width if width < MIN_LITERALS else size >= width
    return F.when(enough & (F.size(places) > 0), F.flatten(F.transform(places, first_held))).otherwise(none)


def windows_around(codes: Column, starts: Column, reading: int, width: int) -> Column:
    """(at, window) of the windows that begin at starts."""
    return F.transform(starts, lambda i: F.struct(i.alias("at"), window_at(codes, i, reading, width).alias("window")))


def window_hits(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """(h1, h2, at) with the columns of windows: where texts hold them.

    Each window is known by an anchor, its rarest word as far as the items tell. Texts are split into words once; windows are hashed around anchors only, and tokens are found only
    in texts with an anchor of a window of tokens. One pass, whatever the widths.
    """
    kinds = sorted({(r["reading"], r["width"]) for r in windows.select("reading", "width").distinct().collect()})
    pick = lambda by_token: [r["anchor"] for r in windows.where((F.col("reading") == PLACED) == by_token).select("anchor").distinct().limit(ANCHORS + 1).collect()]
    word_anchors, token_anchors = (found if len(found) <= ANCHORS else None for found in (pick(False), pick(True)))
    bounded = F.broadcast(windows) if windows.count() <= BROADCAST_WINDOWS else windows

    words = texts.select(*text_key(F.col("text")), "text", words_of(F.col("text")).alias("words"))
    coded = words.withColumn("exact", F.transform("words", exact))
    placed = coded.select("h1", "h2", "words", "exact", anchored(F.col("exact"), word_anchors).alias("near"), F.when(holds_one_of(F.col("exact"), token_anchors), F.col("text")).alias("text"))
    typed = F.when(F.size("near") > 0, F.transform("words", canonical)).otherwise(F.array().cast("array<bigint>"))
    tokens = F.when(F.col("text").isNotNull(), tokens_of(F.col("text"))).otherwise(F.array().cast("array<string>"))
    ready = placed.select("h1", "h2", "exact", "near", typed.alias("typed"), tokens.alias("tokens"))
    ready = ready.withColumns({"placed": F.transform("tokens", canonical), "token_near": anchored(F.transform("tokens", exact), token_anchors)})
    by_token = {(r == PLACED, w): f"starts_{r == PLACED}_{w}" for r, w in kinds}
    ready = ready.select("*", *[starts_around(F.col("token_near" if t else "near"), F.size("tokens" if t else "exact"), w).alias(name) for (t, w), name in by_token.items()])
    around = [windows_around(F.col(CODES[r]), F.col(by_token[r == PLACED, w]), r, w) for r, w in kinds]
    none = F.array().cast("array<struct<at:int,window:bigint>>")
    scanned = ready.select("h1", "h2", F.explode(F.concat(none, *around)).alias("hit")).select("h1", "h2", "hit.at", "hit.window")
    return scanned.join(bounded, "window").distinct()


def leaking_texts(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of documents with a matching line, and (h1, h2, item_id, best): their texts' best consistent stretch of a line with each item."""
    text = F.col("text").cast("string")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), words_of(text).alias("item_words"), tokens_of(text).alias("item_tokens"))
    items = stored(items.where("item_id is not null").distinct().withColumn("kind", F.xxhash64(F.transform("item_tokens", canonical))))
    windows = item_windows(items)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = window_hits(texts, windows)
    line = ("h1", "h2", "item_id", "reading", "width", "least", "whole", (F.col("at") - F.col("item_at")).alias("shift"))
    lines = hits.groupBy(*line).agg(F.collect_set("at").alias("places"), F.min("at").alias("low"), (F.max("at") + F.max("width")).alias("end"))
    lines = stored(lines.where(F.size("places") >= F.col("least")))

    found = stored(lines.select("h1", "h2").distinct())
    few = F.broadcast(found) if found.count() <= BROADCAST_WINDOWS else found
    hit_rows = stored(texts.select("doc_id", "text", *text_key(F.col("text"))).join(few, ["h1", "h2"]))
    words = hit_rows.dropDuplicates(["h1", "h2"]).select("h1", "h2", words_of(F.col("text")).alias("doc_words"), tokens_of(F.col("text")).alias("doc_tokens"))
    paired = lines.join(items, "item_id").join(words, ["h1", "h2"])
    by_token = F.col("reading") == PLACED
    paired = paired.withColumns({"theirs": F.when(by_token, F.col("item_tokens")).otherwise(F.col("item_words")), "ours": F.when(by_token, F.col("doc_tokens")).otherwise(F.col("doc_words"))})
    pair = lambda i: F.struct(
        i.alias("at"), slot_type(F.element_at("theirs", i - F.col("shift") + 1)).alias("kind"), F.element_at("theirs", i - F.col("shift") + 1).alias("theirs"), F.element_at("ours", i + 1).alias("ours")
    )
    paired = paired.withColumns({"low": F.when(F.col("whole"), F.col("shift")).otherwise(F.col("low")), "end": F.when(F.col("whole"), F.col("shift") + F.size("theirs")).otherwise(F.col("end"))})
    paired = paired.where((F.col("low") >= 0) & (F.col("end") <= F.size("ours")))
    inside = F.transform(F.sequence(F.col("low"), F.col("end") - 1), lambda i: pair(i.cast("int")))
    agrees = lambda p: (p["kind"] == slot_type(p["ours"])) & ((p["kind"] > 0) | (p["theirs"] == p["ours"]))
    paired = paired.where(~F.col("whole") | F.forall(inside, agrees))
    slots = paired.withColumn("slots", F.filter(inside, lambda p: (p["kind"] > 0) & (p["kind"] == slot_type(p["ours"]))))
    changed = lambda p: F.when(F.col("reading") == EXACT, F.lower(p["theirs"]) != F.lower(p["ours"])).otherwise(p["theirs"] != p["ours"])
    slots = slots.withColumn("changes", F.transform(F.filter("slots", changed), lambda p: p["at"]))
    split = slots.withColumn("clashes", F.when(F.col("reading") == EXACT, F.expr("filter(array(named_struct('first', 0, 'second', 0)), c -> false)")).otherwise(clashes(F.col("slots"))))
    starts = F.array_distinct(F.concat(F.array("low"), F.transform("clashes", lambda c: c["first"] + 1)))
    runs = split.select("h1", "h2", "item_id", "reading", "ours", "width", "least", "whole", "low", "end", "places", "changes", "clashes", F.explode(starts).alias("start"))
    stop = F.least("end", F.array_min(F.transform(F.filter("clashes", lambda c: c["first"] >= F.col("start")), lambda c: c["second"])))
    runs = runs.withColumn("stop", stop).withColumn("run", F.filter("places", lambda at: (at >= F.col("start")) & (at + F.col("width") <= F.col("stop"))))
    runs = runs.where(F.size("run") >= F.col("least")).withColumn("low", F.when(F.col("whole"), F.col("low")).otherwise(F.array_min("run")))
    runs = runs.withColumn("end", F.when(F.col("whole"), F.col("end")).otherwise(F.array_max("run") + F.col("width")))
    same = ~F.exists("changes", lambda at: (at >= F.col("low")) & (at < F.col("end")))
    n_words = lambda start, size: F.when(by_token, F.size(words_of(F.array_join(F.slice("ours", start, size), " ")))).otherwise(size)
    early, n = -n_words(F.lit(1), F.col("low")), n_words(F.col("low") + 1, F.col("end") - F.col("low"))
    best = F.struct(F.size("run").cast("bigint").alias("n_windows"), early.alias("early"), n.alias("n_words"), same.alias("same_slots"))
    taken = runs.groupBy("h1", "h2", "item_id").agg(F.max(best).alias("best"))
    return hit_rows, stored(taken)


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, n_words, first_word, same_slots): one row per row of documents and benchmark item that it contains.

    A line is taken when at least MIN_WINDOWS template windows agree in a stretch of it whose slots are consistent, or as many windows of words agree when case is
    ignored; of several, the longest counts. Items with too few windows are found as a whole: those of fewer than WINDOW +
    MIN_WINDOWS - 1 words verbatim, those with MIN_LITERALS literals also by their template; one of fewer than MIN_LITERALS words only where it is
    all of a text. Windows in items of more than MOST_KINDS different templates are boilerplate: alone they make no find, but an item with fewer than
    MIN_WINDOWS other ones is found where all its windows lie in one line. same_slots tells that no slot was changed. Null or empty texts match nothing; repeated rows give repeated results, equal items
    one row each; empty tables give no rows; other columns are ignored. Work per text is linear in its words; equal texts are compared once.
    """
    hit_rows, taken = leaking_texts(documents, benchmark)
    rows = hit_rows.select("doc_id", "h1", "h2").join(taken, ["h1", "h2"])
    return rows.select("doc_id", "item_id", "best.n_windows", F.col("best.n_words").cast("bigint").alias("n_words"), (-F.col("best.early")).cast("bigint").alias("first_word"), "best.same_slots")


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents, with all their columns whatever their names, without the rows whose text contains a benchmark item; null texts stay, repeated rows share
    their fate, an empty table gives no rows and an empty benchmark takes none."""
    one, two = free_names(documents, "bad1", "bad2")
    bad = leaking_texts(documents, benchmark)[1].select(F.col("h1").alias(one), F.col("h2").alias(two)).distinct()
    h1, h2 = text_key(F.col("text").cast("string"))
    return documents.join(bad, (h1 == F.col(one)) & (h2 == F.col(two)), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
