import random

import numpy as np

from foliometry.llm import boosted_trees, quality_classifier, quality_rules


def labelled(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        kind = k % 4
        body = [rng.choice("river stone light paper garden window quiet lantern".split()) + str(rng.randint(0, 40)) for _ in range(40)]
        if kind == 0:
            body = [w + "%%%" for w in body]
        if kind == 1:
            body[rng.randint(0, 39)] = "nasty" + rng.choice(["est", "ly", ""])
        rows.append((k, " ".join(body), int(kind != 0), int(kind == 1), "z"))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, quality int, toxic int, score string")
    return table.select("doc_id", "text", "score"), table.select("doc_id", "quality", "toxic")


def test_ordinal_classifier_on_held_out_rows(spark):
    train, labels = labelled(spark, 800, 1)
    model = quality_classifier.fit_classifier(train, labels)
    assert model.thresholds[0] < model.thresholds[1]
    test, truth = labelled(spark, 400, 2)
    rows = quality_classifier.classify(test, model).join(truth, "doc_id").collect()
    right = sum(r["kept"] == bool(r["quality"] and not r["toxic"]) for r in rows)
    assert right >= 0.97 * len(rows)
    mean = lambda q, t: np.mean([r["expected_grade"] for r in rows if (r["quality"], r["toxic"]) == (q, t)])
    assert mean(0, 0) < mean(1, 1) < mean(1, 0)
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert {r["doc_id"] for r in quality_classifier.select_good(test, model).collect()} == kept


def test_classifier_is_fitted_in_a_task(spark, monkeypatch):
    train, labels = labelled(spark, 200, 3)
    expected = quality_classifier.fit_classifier(train, labels)
    monkeypatch.setattr(quality_classifier, "fit_ordinal", None)  # of the driver's process only
    found = quality_classifier.fit_classifier(train, labels)
    assert expected.weights.any()
    assert np.array_equal(found.weights, expected.weights) and np.array_equal(found.thresholds, expected.thresholds)


def test_classifier_edges(documents, no_documents, hard_texts, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality_classifier.quality_classifier(documents, none).collect()}
    assert len(rows) == len(hard_texts)
    assert all(rows[k]["kept"] == bool((t or "").strip()) for k, t in enumerate(hard_texts))
    only_bad = spark.createDataFrame([(0, 0, 0), (0, 0, 0), (None, 1, 0)], none.schema)
    assert not any(r["kept"] for r in quality_classifier.quality_classifier(documents, only_bad).collect())
    assert quality_classifier.quality_classifier(no_documents, none).count() == 0


def test_forest_learns_and_obeys_directions():
    rng = np.random.default_rng(5)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.3)).astype(float)
    forest = boosted_trees.fit(x, y, [-1, 1, 0])
    assert (((forest.margin(x) > 0) == (y > 0)).mean()) > 0.97
    grid = np.linspace(0, 1, 50)
    for _ in range(20):
        row = np.repeat(rng.random((1, 3)), 50, 0)
        row[:, 0] = grid
        assert (np.diff(forest.margin(row)) <= 1e-12).all()
        row = np.repeat(rng.random((1, 3)), 50, 0)
        row[:, 1] = grid
        assert (np.diff(forest.margin(row)) >= -1e-12).all()
    assert forest.margin(np.zeros((0, 3))).shape == (0,)
    assert boosted_trees.fit(np.zeros((0, 2)), np.zeros(0), [0, 0]).margin(np.zeros((1, 2)))[0] == 0


def test_rules_edges(documents, no_documents, hard_texts, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(documents, none).collect()}
    assert len(rows) == len(hard_texts)
    for k, text in enumerate(hard_texts):
        assert rows[k]["base_failed"] == (len((text or "").split()) < 10 or 100 * rows[k]["n_repeat_words"] > 20 * rows[k]["n_words"])
        assert rows[k]["kept"] == (not rows[k]["base_failed"])
    assert quality_rules.quality_rules(no_documents, none).count() == 0


def test_rules_on_held_out_rows(spark):
    train, labels = labelled(spark, 800, 3)
    forest = quality_rules.fit_rules(quality_rules.statistics(train), labels)
    test, truth = labelled(spark, 400, 4)
    rows = quality_rules.judge(quality_rules.statistics(test), forest).join(truth, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in rows]) > 0.98
