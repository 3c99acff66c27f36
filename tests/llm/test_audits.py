import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from foliometry.llm import collocations, filter_audit, host_reputation
from foliometry.llm.text_trie import TextTrie

WORDS = "the of and to in alpha beta gamma delta copper river stone light paper seven garden window".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def fold(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


# --- filter audit


def brute_masks(rows):
    first = {}
    for k, t, _ in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    out = Counter()
    for k, t, lang in rows:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        mask = (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
        mask += 8 * bool(re.search(r"[#$%&*|]", text)) + 16 * (k is not None and k > first[text])
        out[k, lang, mask] += 1
    return out


def audit_rows(hard_texts):
    rng = random.Random(3)
    texts = [*hard_texts, *hard_texts[::2], "SHOUT " * 300, "a # b", "x" * 50, "x" * 51, *["same text in many rows"] * 40, *["p" * k for k in range(1, 60)]]
    rows = [(k, t, rng.choice(["en", "de", None, ""])) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(3, "twice", "en"), (3, "twice", "en"), (3, "twice", "de"), (2, "twice", "fr"), (None, "twice", "en"), (None, "same text in many rows", "en")]


@pytest.mark.parametrize("zone_bytes", [filter_audit.ZONE_BYTES, 200])
def test_masks_equal_brute_force(spark, hard_texts, zone_bytes):
    """With zones so small that prefixes are doubled many times too."""
    rows = audit_rows(hard_texts)
    frame = spark.createDataFrame([(*r, 1.0, "k", "z") for r in rows], "doc_id bigint, text string, lang string, mask double, key string, zone string").repartition(5)
    found = filter_audit.masks(frame, zone_bytes).groupBy("doc_id", "lang", "mask").sum("n").collect()
    assert {tuple(r)[:3]: r[3] for r in found} == brute_masks(rows)


def test_every_order_by_applying_the_filters(spark, hard_texts):
    rows = audit_rows(hard_texts)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 5 == 0)) for k in range(0, 90, 2)] + [(4, 0, 1), (4, 1, 0), (6, None, None)], "doc_id bigint, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(frame, labels).collect()}
    known = {}
    for r in labels.collect():
        good, toxic = known.get(r["doc_id"], (False, False))
        known[r["doc_id"]] = (good or r["quality"] == 1, toxic or r["toxic"] == 1)
    masks = brute_masks(rows)
    expected, shares = {}, Counter()
    for part in {lang or "" for _, lang, _ in masks}:
        mine = [(k, mask, n) for (k, lang, mask), n in masks.items() if (lang or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                gone = [x for x in left if x[1] & bit]
                left = [x for x in left if not x[1] & bit]
                size = lambda xs: sum(n for _, _, n in xs)
                shares[part, name] += size(gone)
                redundant = size([x for x in mine if x[1] & bit]) - size(gone)
                unique = size([x for x in mine if x[1] == bit])
                lost = [sum(n for k, _, n in gone if known.get(k, (False, False))[j]) for j in (0, 1)]
                expected[part, "".join(order), step] = [size(left), size(gone), redundant, unique, *lost, name]
    assert got == {key: (*v[:6], shares[key[0], v[6]]) for key, v in expected.items()}


def test_audit_of_nothing(no_documents, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(no_documents.withColumn("lang", no_documents["text"]), labels).count() == 0


def test_long_texts_and_chunks(monkeypatch):
    monkeypatch.setattr(filter_audit, "CHUNK_BYTES", 10)
    for text in (b"a bb a cc\tdd " * 50, b"w" * 100, b" " * 100, b"aaa aaa\x0bbbb\nccc" * 20):
        words = text.split()
        assert filter_audit.words_in(text) == (len(words), len(set(words)))


def test_trie_of_nested_and_long_texts():
    texts = [b"a" * k for k in range(0, 3000, 7)] + [b"a" * 1_000_000, b"a" * 999_999 + b"b", b"", b"a" * 1_000_000]
    trie = TextTrie()
    for k, text in enumerate(texts):
        node = trie.terminal(text)
        node.held = k if node.held is None else node.held
        assert node.text[: node.end] == text
    assert sum(1 for _ in trie.terminals()) == len(set(texts))


# --- collocations


def brute_collocations(rows, least, percent, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    dropped = set()
    for (lang, w), a in candidates.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                if 100 * a >= percent * counts[lang, w[i : i + size]]:
                    dropped.add((lang, w[i : i + size]))
    out = []
    for (lang, w), a in candidates.items():
        if (lang, w) not in dropped:
            cuts = [(2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return ranked


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(31)
    texts = [prose(rng, rng.randrange(5, 200)) for _ in range(60)]
    texts += ["Alpha beta gamma delta. Alpha BETA gamma delta", "x x x x x x", "river\tstone  river\x0bstone;river stone", None, "", ".,;:", "éa Éa éa éa", "w" * 5000 + " river stone"] * 4
    texts += ["a line that many rows share, with alpha beta"] * 60 + [" ".join(["river stone light"] * 400)]
    return [(t, rng.choice(["en", "de", None, "und"])) for t in texts]


@pytest.mark.parametrize(("least", "bucket_words", "top"), [(30, collocations.BUCKET_WORDS, 2000), (3, 60, 2000), (2, 20, 15)])
def test_collocations_equal_brute_force(spark, phrases, least, bucket_words, top):
    """Small buckets have heavy leading words, pairs and triples."""
    frame = spark.createDataFrame([(*r, 1, "q") for r in phrases], "text string, lang string, n int, phrase string").repartition(4)
    got = collocations.collocations(frame, least, 80, top, bucket_words)
    assert [c for c, _ in got.dtypes] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_collocations(phrases, least, 80, top))


def test_collocations_of_nothing(spark):
    frame = spark.createDataFrame([(None, None), ("", "en"), (" . ", "en")], "text string, lang string")
    assert collocations.collocations(frame).count() == 0
    assert collocations.collocations(frame.where("lang = 'xx'")).count() == 0


def test_chunks_part_no_words(monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, 300).encode(), b"w" * 500, b"", b"a.b,c " * 50, b" " * 90]
    whole = collocations.Words().codes(texts)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 17)
    assert collocations.Words().codes(texts).tolist() == whole.tolist()


def test_quicksort_finds_all_frequent_phrases():
    rng = np.random.default_rng(4)
    columns = rng.integers(0, 5, (4, 3000)).astype(np.int32)
    columns[0] += 1
    for d in range(1, 4):
        columns[d][columns[d - 1] == 0] = 0
    times = rng.integers(1, 4, 3000)
    counts = Counter()
    for p, n in zip(columns.T.tolist(), times.tolist(), strict=True):
        for size in range(1, 5):
            if p[size - 1]:
                counts[tuple(p[:size])] += n
    for small in (5, 100, 10_000):
        got = {}
        for size, pointers, totals in collocations.equal_partitions(columns, times, 30, small):
            for p, n in zip(columns[:size, pointers].T.tolist(), totals.tolist(), strict=True):
                assert tuple(p) not in got
                got[tuple(p)] = n
        assert got == {p: n for p, n in counts.items() if n >= 30}


# --- host reputation


def brute_cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return fold(host), re.match(r"[^?#]*", rest[len(host) :]).group()


def brute_rule(host, path):
    best = None
    for verdict, name, start in host_reputation.RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(start):
            best = max(best or (0, 0, "", ""), (len(name) + len(start), len(name), verdict, name + start))
    return best and (best[3], best[2])


URLS = [
    "http://a.example.com/en/1", "https://WWW.Example.com/en/x?q=/fr/", "https://deep.www.example.com/en/", "http://example.com/fr/2#top", "http://com/", "http://com", "http://notcom/",
    "https://b.net/es/3", "https://b.net/en/4", "http://b.net?/es/", "http://net/fr/", "ftp://x.org:8080/es/", "http://u:p@y.org/a", "no scheme /en/", "", None, "://", "http:///en/1", "a://b://c.net/es/",
    "http://evil-com/en/", "http://example.com.evil.org/en/7", "http://x.co.uk/1", "http://1.2.3.4/9", "HTTP://Z.ORG#/es/",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(k, u, "r", "p") for k, u in enumerate(URLS)] + [(None, URLS[0], "r", "p"), (0, URLS[0], "r", "p")], "page_id bigint, url string, rule string, path string")
    none = spark.createDataFrame([], "page_url string, n bigint, bad bigint")
    got = host_reputation.judge(pages, none).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = URLS[r["page_id"] or 0]
        host, path = brute_cut(url)
        rule = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *(rule or (None, "allow"))), url
    assert host_reputation.judge(pages.where("page_id < 0"), none).count() == 0


def test_names_of_hosts(spark):
    names = {"www.a.co.uk": ("a.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "b.example.org:80": ("example.org", "org"), "u@b.org.": ("b.org", "org"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "localhost": ("localhost", "localhost"), "": ("", "")}
    rows = host_reputation.named(spark.createDataFrame([(n,) for n in names], "host string")).collect()
    assert {r["host"]: (r["domain"], r["suffix"]) for r in rows} == names


def test_reputation_shrinks_and_blocks(spark):
    """Bad hosts with evidence are blocked, those with little only below a bad domain, and those without outcomes by their domain's prior."""
    rng = random.Random(6)
    shares = {f"h{k}.good{k % 4}.org": 0.05 for k in range(24)} | {f"h{k}.bad{k % 3}.org": 0.95 for k in range(18)}
    rows = [(f"x://{host}/", 60, sum(rng.random() < share for _ in range(60))) for host, share in shares.items()]
    rows += [("x://tiny.good1.org/", 1, 1), ("x://tiny.bad1.org/", 1, 1), ("x://odd.good2.org/", 200, 190)]
    hosts = [r[0][4:-1] for r in rows] + ["fresh.bad1.org", "fresh.good1.org", "fresh.new.org"]
    pages = spark.createDataFrame([(k, f"x://{h}/p") for k, h in enumerate(hosts)], "page_id bigint, url string")
    outcomes = spark.createDataFrame(rows, "page_url string, n bigint, bad bigint")
    got = {r["host"]: r["verdict"] for r in host_reputation.judge(pages, outcomes).collect()}
    assert {h for h, v in got.items() if v == "block"} == {h for h in hosts if ".bad" in h} | {"odd.good2.org"}
    means = {r["host"]: r["mean"] for r in host_reputation.reputations(outcomes.selectExpr("split(page_url, '/')[2] AS host", "n", "bad"), pages.selectExpr("split(url, '/')[2] AS host")).collect()}
    assert means["tiny.good1.org"] < means["tiny.bad1.org"]
    assert means["fresh.bad1.org"] > 0.8
    assert means["h1.good1.org"] < means["fresh.good1.org"] < means["fresh.new.org"] < means["fresh.bad1.org"]


def test_outcomes_from_labels(spark):
    pages = spark.createDataFrame([(0, "x://a.b/en/7"), (1, "x://A.b/en/7.html"), (2, "x://a.b/8/9"), (3, "x://c.d/70"), (4, None), (5, "x://c.d/abc7"), (6, f"x://c.d/{'9' * 30}")], "page_id bigint, url string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 1), (8, 1, 0), (70, 0, 0), (70, None, None), (9, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = {r["page_url"]: (r["n"], r["bad"]) for r in host_reputation.document_outcomes(pages, labels).collect()}
    assert got == {"://a.b": (3, 2), "://c.d": (1, 1)}


@pytest.mark.parametrize("limits", [(200_000, 1_000_000), (0, 5)])
def test_host_joins_alike(spark, monkeypatch, limits):
    monkeypatch.setattr(host_reputation, "BROADCAST_HOSTS", limits[0])
    monkeypatch.setattr(host_reputation, "HOT_PAGES", limits[1])
    pages = spark.createDataFrame([(k, f"x://h{0 if k % 3 else k}.b.org/1") for k in range(60)], "page_id bigint, url string")
    outcomes = spark.createDataFrame([("x://h0.b.org/", 50, 50), ("x://h3.b.org/", 50, 0)], "page_url string, n bigint, bad bigint")
    got = {r["page_id"]: r["verdict"] for r in host_reputation.judge(pages, outcomes).collect()}
    assert len(got) == 60
    assert all(got[k] == "block" for k in range(60) if k % 3)
    assert got[3] == "allow"
