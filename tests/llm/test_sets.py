import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliometry.llm import decontamination, jaccard_join, secrets, sharding
from foliometry.llm.components import components


def brute_components(texts, size, a, b):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and b * len(sets[i] & sets[j]) >= a * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in enumerate(sets)}


@pytest.mark.parametrize(("size", "a", "b"), [(3, 9, 10), (5, 8, 10)])
def test_components_equal_brute_force(documents, hard_texts, size, a, b):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(documents, size, (a, b)).collect()}
    assert got == brute_components(hard_texts, size, a, b)


def test_large_group_of_near_copies(spark):
    """Chains, copies and edits around one base without the base itself: the first round's centres do not reach all."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for _ in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2, 2, 3, 4])):
            words[rng.randrange(90)] = rng.choice(["x", "y", f"e{rng.random()}"])
        texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame).collect()}
    assert got == brute_components(texts, 3, 9, 10)


def test_join_edges(no_documents, spark):
    assert jaccard_join.jaccard_components(no_documents).count() == 0
    same = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "A B c d"), (7, None)], "doc_id bigint, text string")
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(same).collect()]
    assert Counter(rows) == Counter([(None, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7)])


def test_one_of_each(spark, documents, hard_texts, tmp_path):
    documents.write.parquet(str(tmp_path / "docs"))
    kept = jaccard_join.one_of_each(spark.read.parquet(str(tmp_path / "docs")), 5, (8, 10))
    assert kept.columns == documents.columns
    expected = brute_components(hard_texts, 5, 8, 10)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in expected.values()})


def test_connected_components_of_a_path(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_sharding_law(documents, no_documents, hard_texts):
    rows = sharding.shuffle_into_shards(documents, 8).collect()
    assert len(rows) == len(hard_texts)
    per = Counter(r["shard"] for r in rows)
    assert max(per.values()) - min(per[s] for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(per[s]))
    for r in rows:
        raw = (hard_texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    assert sharding.shuffle_into_shards(no_documents).count() == 0
    other = sharding.shuffle_into_shards(documents, 8, seed=1).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} != {(r["doc_id"], r["shard"], r["slot"]) for r in other}


def test_matrix_has_both_margins_and_the_law():
    import random as r

    blocks = {0: 5, 1: 9, 2: 3}
    sums = Counter()
    for seed in range(400):
        matrix = sharding.communication_matrix(blocks, 4, seed)
        assert Counter({b: n for b, n in blocks.items()}) == sum((Counter({b: e - f}) for b, _, f, e in matrix), Counter())
        per_shard = sum((Counter({s: e - f}) for _, s, f, e in matrix), Counter())
        assert sorted(per_shard.values()) == [4, 4, 4, 5]
        sums[sum(e - f for b, s, f, e in matrix if (b, s) == (1, 2))] += 1
    assert abs(sum(k * n for k, n in sums.items()) / 400 - 4 * 9 / 17) < 0.15
    assert sharding.hypergeometric(r.Random(1), 10**11, 9 * 10**11, 10**7) == pytest.approx(10**6, rel=0.01)


SECRETS = [
    "token = abcdef and token=short, TOKEN: 'a1b2c3d4'",
    'password="x" api_key: ABCDEFGH12 apikey=zzzzzz',
    "AKIA" + "A" * 16 + " AKIA" + "B" * 15 + " AKIAAKIA" + "C" * 20,
    "é漢 " + "0123456789abcdef" * 2 + " deadbeef secret=" + "0a" * 14,
    "token=token: abcdefghi",
    None,
    "",
    "nothing here",
    "token=token: abcdefghi",
]


def brute_spans(text):
    found = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(found)


def test_secret_spans_and_redaction(spark, tmp_path):
    frame = spark.createDataFrame([(k, t, "b", 3) for k, t in enumerate(SECRETS)], "doc_id bigint, text string, blob string, n_chars int")
    rows = secrets.scan(frame, str(tmp_path / "ledger")).collect()
    assert len(rows) == len(SECRETS)
    for r in rows:
        assert [tuple(s) for s in r["found"]] == brute_spans(SECRETS[r["doc_id"]])
    cleaned = secrets.redact(frame, str(tmp_path / "second"))
    assert cleaned.columns == frame.columns
    for r in cleaned.collect():
        text, expected, at = SECRETS[r["doc_id"]], "", 0
        spans = brute_spans(text)
        for start, _, _, end in spans:
            if start >= at:
                expected += text[at:start] + secrets.MARK
            at = max(at, end)
        assert r["text"] == (expected + text[at:] if spans else text)
        assert r["n_chars"] == (len(r["text"]) if spans else 3)
    assert secrets.scan(frame.where("doc_id < 0"), str(tmp_path / "third")).count() == 0


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    frame = spark.createDataFrame(list(enumerate(SECRETS)), "doc_id bigint, text string")
    secrets.scan(frame.where("doc_id < 3"), ledger)
    assert secrets.ledger_rows(spark, ledger).count() == 3 * 3
    secrets.scan(frame, ledger)
    entered = secrets.ledger_rows(spark, ledger)
    blobs = len({t or "" for t in SECRETS})
    assert entered.count() == entered.select("blob", "rule", "rule_version").distinct().count() == 3 * blobs
    newer = (*secrets.RULES[:2], secrets.Rule("hex", 2, "[0-9a-f]{30,}", 0, 30))
    rows = secrets.scan(frame, ledger, newer).collect()
    assert secrets.ledger_rows(spark, ledger).count() == 4 * blobs
    assert max(len([s for s in r["found"] if s["kind"] == "hex"]) for r in rows) == 1


ITEM = "If Alice buys 3 apples and 4 pears while Bob walks 12 km then how many apples does Alice carry home to Bob"


def test_templates_and_slots(spark):
    lead = "some words that come before the passage in question here "
    texts = {
        0: lead + ITEM + " and some that follow after it",
        1: lead + ITEM.replace("Alice", "Carol").replace("Bob", "Dave").replace("3", "17").replace("12 km", "9 miles"),
        2: lead + ITEM.replace("does Alice", "does Erin"),
        3: lead + ITEM.replace("home to Bob", "home to Alice").replace("while Bob", "while Alice"),
        4: lead * 3,
        5: None,
        6: "",
        7: lead + ITEM + " and some that follow after it",
        8: ITEM.lower(),
    }
    frame = spark.createDataFrame([(k, t, "c") for k, t in texts.items()], "doc_id bigint, text string, item_id string")
    benchmark = spark.createDataFrame([(10, ITEM), (11, ITEM), (12, None), (13, "too short"), (None, ITEM)], "item_id bigint, text string")
    rows = decontamination.leaks(frame, benchmark).collect()
    found = {(r["doc_id"], r["item_id"]): r["same_slots"] for r in rows}
    whole = {(k, i): k != 1 for k in (0, 1, 7, 8) for i in (10, 11)}
    # 2 keeps its first 18 words and 3 the 12 words between its changed names, so both are finds; their longest stretch has another name in it
    assert found == whole | {(k, i): False for k in (2, 3) for i in (10, 11)}
    assert {(r["doc_id"], r["first_word"], r["n_words"]) for r in rows if r["doc_id"] not in (2, 3)} == {(0, 10, 23), (1, 10, 23), (7, 10, 23), (8, 0, 23)}
    kept = decontamination.without_leaks(frame, benchmark)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6]
    assert decontamination.leaks(frame.where("doc_id < 0"), benchmark).count() == 0
    assert decontamination.leaks(frame, benchmark.where("item_id < 0")).count() == 0


def test_runs_of_capitals_and_numbers_do_not_recurse(spark):
    texts = ["Alpha " * 100_000, "1," * 100_000, "+-" * 50_000, f"{'Alpha ' * 50_000}{ITEM} end"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(10, ITEM)], "item_id bigint, text string")
    assert [(r["doc_id"], r["first_word"]) for r in decontamination.leaks(frame, benchmark).collect()] == [(3, 50_000)]


def test_a_sentence_of_many_items_proves_nothing(spark):
    lead = "read the following passage with care and choose the one answer that fits best of all"
    rng = random.Random(5)
    own = [" ".join(rng.choice(["copper", "river", "stone", "lantern", "paper", "garden", "window", "basket", "yellow"]) for _ in range(14)) for _ in range(30)]
    benchmark = spark.createDataFrame([(k, f"{lead}: {o}") for k, o in enumerate(own)], "item_id bigint, text string")
    frame = spark.createDataFrame([(0, f"the teacher said {lead} to us"), (1, f"and then {lead}: {own[7]} was asked"), (2, f"it read {own[8]} there")], "doc_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(frame, benchmark).collect()} == {(1, 7), (2, 8)}


def test_an_item_of_little_but_a_common_sentence_is_found_whole(spark):
    lead = "read the following passage with care and choose the one answer that fits best of all"
    own = "copper river stone lantern paper garden window basket yellow quartz walnut meadow candle thunder".split()
    benchmark = spark.createDataFrame([*((k, f"{lead}: {o}") for k, o in enumerate(own)), (20, lead)], "item_id bigint, text string")
    texts = [f"and then {lead.upper()}: {own[3]} was asked", f"and then {' '.join(lead.split()[4:])} {own[3]}", f"the teacher said {lead} to us", f"all but {lead.replace('care', 'haste')} {own[3]}"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(frame, benchmark).collect()} == {(0, 3), (0, 20), (2, 20)}


def test_short_items_of_every_width(spark):
    """Verbatim items of four to nine words inside a text, shorter ones only as a whole text."""
    words = "quartz lantern basket window garden paper river copper stone".split()
    items = [(k, " ".join(words[:k])) for k in range(1, 10)]
    texts = [(k, f"lead {w.upper()} tail") for k, w in items] + [(10 + k, w) for k, w in items]
    found = decontamination.leaks(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    expected = {(k, i) for k in range(1, 10) for i in range(4, k + 1)} | {(10 + k, i) for k in range(1, 10) for i in range(1, k + 1) if i >= 4 or i == k}
    assert got == expected


def brute_verbatim(text, item, window=8, least=3):
    """Whether `least` windows of lower-cased words agree in one line of text and item."""
    split = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t or "")]
    a, b = split(text), split(item)
    lines = Counter()
    for i in range(len(a) - window + 1):
        for j in range(len(b) - window + 1):
            if a[i : i + window] == b[j : j + window]:
                lines[i - j] += 1
    return any(n >= least for n in lines.values())


def brute_template(text, item, window=8, least=3, literal=4):
    """Whether `least` consecutive windows of words with slots agree in one line, at any places and without contradiction between their slots."""

    def split(t):
        words = re.findall(r"[^\W_]+", t or "")
        kinds = ["number" if w[0] in "0123456789" else "name" if w[0] != w[0].lower() else "unit" if w in decontamination.UNITS else "" for w in words]
        return words, [k or w for k, w in zip(kinds, words)], [bool(k) for k in kinds]

    (x, a, _), (y, b, slot) = split(text), split(item)
    span = window + least - 1
    for i in range(len(a) - span + 1):
        for j in range(len(b) - span + 1):
            if a[i : i + span] != b[j : j + span] or any(sum(not s for s in slot[j + k : j + k + window]) < literal for k in range(least)):
                continue
            pairs = [(b[j + k], y[j + k], x[i + k]) for k in range(span) if slot[j + k]]
            if not any(p[0] == q[0] and (p[1] == q[1]) != (p[2] == q[2]) and (p[1] == q[1] or p[0] == "name") for p in pairs for q in pairs):
                return True
    return False


def test_template_search_equals_brute_force(spark):
    """All pairs of windows, by a plain search: what it finds, verbatim or by template, is found; what neither it nor a change of slot widths explains is not."""
    rng = random.Random(23)
    plain = "copper river stone lantern paper garden window basket yellow quiet walks buys sells carries".split()

    def sentence(n):
        return " ".join(rng.choice([rng.choice(plain), rng.choice(plain), rng.choice(["Anna", "Bob", "Carl"]), str(rng.randrange(9)), rng.choice(["km", "apples"])]) for _ in range(n))

    def changed(t):
        names = dict(zip(["Anna", "Bob", "Carl"], rng.sample(["Dora", "Emil", "Fritz", "Gus"], 3)))
        return " ".join(names.get(w, str(int(w) + 20) if w.isdigit() else w) for w in t.split())

    items = [sentence(rng.randrange(18, 30)) for _ in range(8)]
    texts = [f"{sentence(9)} {t} {sentence(7)}" for item in items for t in (item, changed(item), item.upper(), changed(item)[: len(item) // 2], "")] + [sentence(60) for _ in range(20)]
    found = decontamination.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    brute = {(k, i) for k, t in enumerate(texts) for i, item in enumerate(items) if brute_verbatim(t, item) or brute_template(t, item)}
    assert len(brute) >= 24
    assert brute <= got
    assert all(k // 5 == i and k < 40 for k, i in got - brute)


def test_case_hides_no_copy(spark):
    """Verbatim passages in capitals, in lower case and dense in slots are found; the same words in another order are not."""
    dense = "Anna 3 Bob 4 Carl 5 Dora 6 Emil 7 Fritz 8"
    texts = {0: f"lead in {ITEM.upper()} tail", 1: f"lead in {ITEM.lower()} tail", 2: f"lead in {dense} tail", 3: " ".join(reversed(ITEM.upper().split()))}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(10, ITEM), (11, dense)], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): (r["first_word"], r["n_words"], r["same_slots"]) for r in decontamination.leaks(frame, benchmark).collect()}
    assert found == {(0, 10): (2, 23, True), (1, 10): (2, 23, True), (2, 11): (2, 12, True)}
    assert [r["doc_id"] for r in decontamination.without_leaks(frame, benchmark).collect()] == [3]


def test_one_slot_splits_a_line(spark):
    """A repeated name that is edited once leaves the unchanged part, also where all other slots are changed; one name for two is no copy."""
    other = ITEM.replace("Alice", "Carol").replace("Bob", "Dave").replace("3", "17").replace("12 km", "9 miles")
    mixed = "when Ann met Ann and Ann saw Ann then Ann told Ann about Ann near Ann while Ann slept"
    texts = {0: ITEM.replace("does Alice", "does Erin"), 1: other.replace("does Carol", "does Erin"), 2: "The" + ITEM[2:], 3: mixed}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    item = "when Ida met Eva and Ida saw Eva then Ida told Eva about Ida near Eva while Ida slept"
    benchmark = spark.createDataFrame([(10, ITEM), (11, item)], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(frame, benchmark).collect()} == {(0, 10), (1, 10), (2, 10)}
    assert [r["doc_id"] for r in decontamination.without_leaks(frame, benchmark).collect()] == [3]


FARM = "a small farm with seven hands ships 1,250 boxes of fruit on each working morning here"


def test_slots_of_other_width_and_short_items(spark):
    town = "trains that leave New York for the coast take less time than those from Rome do"
    short = "how far is it from 3 to 7"
    rows = "2 3 plus 4 5 gives 6 7 while 8 2 makes 9 1"
    texts = {
        0: FARM.replace("1,250", "80"),
        1: FARM.replace("1,250", "-2.5"),
        2: "lead " + town.replace("New York", "Paris"),
        3: "lead in " + short.replace("3", "1,000").replace("7", "9"),
        4: "lead in " + short.upper() + " tail",
        5: rows.replace("2", "20").replace("6", "0.5"),
        6: "Tiny item",
        7: "a tiny item among others",
        8: "how far is it from them to us",
        9: "lead in 20 3 plus 4 50 gives 6 7 while 8 21 makes 9 1",
    }
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, FARM), (2, town), (3, short), (4, rows), (5, "tiny item"), (6, "Oslo"), (7, "")], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): (r["first_word"], r["n_words"], r["same_slots"]) for r in decontamination.leaks(frame, benchmark).collect()}
    assert found == {
        (0, 1): (0, 16, False),
        (1, 1): (0, 17, False),
        (2, 2): (1, 15, False),
        (3, 3): (2, 9, False),
        (4, 3): (2, 8, True),
        (5, 4): (0, 15, False),
        (6, 5): (0, 2, True),
    }
    assert [r["doc_id"] for r in decontamination.without_leaks(frame, benchmark).collect()] == [7, 8, 9]


def test_one_of_each_when_files_are_split_otherwise_later(spark, documents, hard_texts, tmp_path):
    """Row numbers of a scan depend on how files are packed into tasks; another packing between the steps changes no result."""
    for k in range(3):
        documents.where(f"doc_id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    packing = {"spark.sql.files.openCostInBytes": ("0", "1g"), "spark.sql.files.minPartitionNum": ("1", "3")}
    try:
        for name, (early, _) in packing.items():
            spark.conf.set(name, early)
        kept = jaccard_join.one_of_each(spark.read.parquet(str(tmp_path / "docs")), 5, (8, 10))
        for name, (_, late) in packing.items():
            spark.conf.set(name, late)
        got = sorted(r["doc_id"] for r in kept.collect())
    finally:
        for name in packing:
            spark.conf.unset(name)
    assert got == sorted({c for _, c in brute_components(hard_texts, 5, 8, 10).values()})


def test_columns_keep_names_and_values(spark, tmp_path):
    """Columns named like those the stages make come through every filtering stage as they went in."""
    words = "quartz lantern basket window garden paper river copper stone yellow".split()
    texts = [" ".join(words), " ".join(words), f"password: hunter22x {' '.join(reversed(words))}", None, "", f"see {ITEM} here"]
    rows = [(k, t, f"b{k}", [k], k * 2, f"x{k}", f"y{k}", k + 0.5, f"r{k}", f"c{k}") for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, blob string, found array<int>, _row int, bad1 string, bad2 string, h1 double, row string, cuts string")
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    others = [c for c in frame.columns if c != "text"]
    before = {r["doc_id"]: tuple(r[c] for c in others) for r in frame.collect()}
    stages = {
        "redact": (secrets.redact(frame, str(tmp_path / "ledger")), set(range(6))),
        "near": (jaccard_join.one_of_each(frame), {0, 2, 3, 4, 5}),
        "leaks": (decontamination.without_leaks(frame, benchmark), set(range(5))),
    }
    for name, (result, kept) in stages.items():
        assert result.columns == frame.columns, name
        assert {r["doc_id"]: tuple(r[c] for c in others) for r in result.collect()} == {k: v for k, v in before.items() if k in kept}, name
        assert result.schema == frame.schema, name


def test_many_spans_in_one_text(spark, tmp_path):
    one = "é token=abcdefgh AKIA" + "Q" * 20 + " "
    frame = spark.createDataFrame([(1, one * 16_000), (2, one)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["found"] for r in secrets.scan(frame, str(tmp_path / "ledger")).collect()}
    assert len(found[1]) == 32_000
    assert [(s["start"], s["end"]) for s in found[1][-2:]] == [(s["start"] + 15_999 * len(one), s["end"] + 15_999 * len(one)) for s in found[2]]
    cleaned = {r["doc_id"]: r["text"] for r in secrets.redact(frame, str(tmp_path / "other")).collect()}
    assert cleaned == {1: "é [SECRET] [SECRET] " * 16_000, 2: "é [SECRET] [SECRET] "}


def test_anchors_are_rare_among_the_items(spark):
    own = [[chr(97 + k) + "x" + chr(97 + j) for j in range(10)] for k in range(12)]
    texts = [" ".join([*words[:5], "everywhere", *words[5:]]) for words in own]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    items = items.select("item_id", decontamination.words_of(F.col("text")).alias("item_words"), decontamination.tokens_of(F.col("text")).alias("item_tokens"))
    windows = decontamination.item_windows(items.withColumn("kind", F.col("item_id")))
    assert windows.count() == 12 * 4 * 3
    assert windows.where(F.col("anchor") == F.xxhash64(F.lit("everywhere"))).count() == 0
