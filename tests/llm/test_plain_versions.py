"""Language network and quality model against plain versions written out step by step."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from liveset.llm import langid, quality


# --- 1 language ID ---------------------------------------------------------------------------
def plain_probabilities(network, window):
    """Every filter at every place of one window, one byte at a time."""
    hidden = []
    for w in langid.WIDTHS:
        for f in range(langid.FILTERS):
            hidden.append(max(sum(float(network.tables[w][j][window[i + j]][f]) for j in range(w)) for i in range(len(window) - w + 1)))
    active = [max(h + float(b), 0.0) for h, b in zip(hidden, network.bias)]
    logits = [sum(a * float(network.out[i][c]) for i, a in enumerate(active)) + float(network.out_bias[c]) for c in range(len(network.languages))]
    top = max(logits)
    total = sum(math.exp(v - top) for v in logits)
    return [math.exp(v - top) / total for v in logits]


def trained():
    rng = np.random.default_rng(4)
    windows = rng.integers(32, 127, (24, langid.WINDOW)).astype(np.uint8)
    return langid.Network(["aa", "bb", "cc"]).fit(windows, np.arange(24) % 3, epochs=2, batch=8), windows


def test_forward_pass_equals_a_plain_one():
    network, windows = trained()
    want = [plain_probabilities(network, w) for w in windows[:6]]
    assert np.allclose(network.probabilities(windows[:6]), want, atol=1e-4)


def test_first_step_follows_the_gradient():
    """Adam's first step moves a weight by the rate against the sign of its gradient, which
    differences of the plain loss give."""
    rng = np.random.default_rng(9)
    windows = rng.integers(97, 105, (4, langid.WINDOW)).astype(np.uint8)
    target = np.array([0, 1, 1, 0])
    before = langid.Network(["aa", "bb"])
    after = langid.Network(["aa", "bb"]).fit(windows, target, epochs=1, batch=4, rate=1e-3)

    def loss(part, place, by):
        kept = part[place]
        part[place] = kept + by
        value = -sum(math.log(plain_probabilities(before, w)[y]) for w, y in zip(windows, target))
        part[place] = kept
        return value

    checked = 0
    for name, places in (("out", [(0, 0), (17, 1), (40, 0)]), ("out_bias", [(0,), (1,)]), ("bias", [(3,), (20,)])):
        was, now = getattr(before, name), getattr(after, name)
        for place in places:
            slope = (loss(was, place, 1e-2) - loss(was, place, -1e-2)) / 2e-2
            if abs(slope) > 1e-3:
                assert np.sign(now[place] - was[place]) == -np.sign(slope)
                assert abs(now[place] - was[place]) == pytest.approx(1e-3, rel=0.05)
                checked += 1
    assert checked >= 4


def test_scores_of_texts_are_means_over_windows(spark):
    network, _ = trained()
    texts = ["a short text", "long words and more " * 40, "ä" * 300, "x" * langid.WINDOW]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in langid.identify(docs, network).collect()}
    for i, text in enumerate(texts):
        data, size = text.encode(), langid.WINDOW
        starts = [min(k * size, max(len(data) - size, 0)) for k in range(-(-len(data) // size))]
        p = np.mean([plain_probabilities(network, data[s:s + size].ljust(size, b"\0")) for s in starts], axis=0)
        assert got[i]["lang_pred"] == network.languages[int(p.argmax())]
        assert got[i]["lang_score"] == pytest.approx(p.max(), abs=1e-4)


def test_training_reads_whole_cuts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid.Network, "fit", lambda self, windows, target: seen.append(windows) or self)
    langid.train(spark.createDataFrame([("д" * 200 + "ж" * 56, "xx")], "text string, lang string"))
    # 512 bytes a cut: two windows, the second of which holds the last letters.
    assert seen[0].shape == (2 * langid.CUTS, langid.WINDOW)
    assert bytes(seen[0][1]).decode() == "д" * 72 + "ж" * 56


# --- 5 quality -------------------------------------------------------------------------------
def plain_statistics(text):
    """Those of the statistics that a few lines of Python define, on ASCII texts."""
    words, size = text.split(), max(len(text), 1)
    n = max(len(words), 1)
    lines = [tuple(line.split()) for line in text.split("\n") if line.split()]
    entropy = lambda c: -sum(v / sum(c.values()) * math.log2(v / sum(c.values())) for v in c.values())
    of = lambda test: sum(map(test, words)) / n
    pairs = list(zip(words, words[1:]))
    return {
        "log_bytes": math.log1p(len(text)), "log_words": math.log1p(len(words)), "log_lines": math.log1p(len(lines)),
        "word_length": of(len), "long_words": of(lambda w: len(w) > 12), "short_words": of(lambda w: len(w) < 4),
        "upper": sum("A" <= c <= "Z" for c in text) / size, "digit": sum("0" <= c <= "9" for c in text) / size,
        "space": sum(c in " \t" for c in text) / size, "newline_share": text.count("\n") / size,
        "distinct_words": len(set(words)) / n, "distinct_pairs": len(set(pairs)) / n,
        "top_word": max(Counter(words).values(), default=0) / n, "distinct_lines": len(set(lines)) / max(len(lines), 1),
        "word_entropy": entropy(Counter(words)), "byte_entropy": entropy(Counter(text)),
        "stop_ends": of(lambda w: w.endswith(".")), "line_words": len(words) / max(len(lines), 1),
    }


def test_statistics_equal_plain_ones(spark):
    texts = ["One two two. Three\nOne two two. Three\n\nextraordinarily 42 times", "word", "a b a b a b\na b", "UPPER lower 7\tTabs. End.",
             "same line\n" * 30, "No stop at all " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r["doc_id"]: dict(zip(quality.STATISTICS, r["stats"])) for r in quality.measured(docs).collect()}
    for i, text in enumerate(texts):
        for name, value in plain_statistics(text).items():
            assert got[i][name] == pytest.approx(value, abs=1e-9), (i, name)


def test_summed_equations_equal_ridge_on_all_rows(spark):
    rng = np.random.default_rng(6)
    stats = rng.normal(size=(300, len(quality.STATISTICS)))
    label = (stats[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    rows = [(s.tolist(), int(y)) for s, y in zip(stats, label)]
    model = quality.fit(spark.createDataFrame(rows, "stats array<double>, label int").repartition(5))
    assert np.allclose(model.mean, stats.mean(axis=0)) and np.allclose(model.spread, stats.std(axis=0))
    x = np.array([[math.sqrt(2 / quality.FEATURES) * math.cos(float(s @ model.frequency[:, f]) + model.phase[f]) for f in range(quality.FEATURES)] + [1.0]
                  for s in np.clip((stats - model.mean) / model.spread, -5, 5)])
    ridge = lambda a, y: np.linalg.solve(a.T @ a + quality.RIDGE * max(len(a), 1) * np.eye(a.shape[1]), a.T @ y)
    assert np.allclose(model.weights, ridge(x, label), atol=1e-8)
    fold = model.fold(stats)
    assert set(fold) == set(range(quality.FOLDS))
    for f in range(quality.FOLDS):
        assert np.allclose(model.fold_weights[f], ridge(x[fold != f], label[fold != f]), atol=1e-8)


def test_calibration_is_the_best_rising_step_function():
    rng = np.random.default_rng(3)
    for _ in range(20):
        score, count = np.arange(12.0), rng.integers(1, 6, 12).astype(float)
        positive = np.array([rng.integers(0, int(n) + 1) for n in count], float)
        model = quality.Model(np.zeros(2), np.ones(2))
        model.calibrate(score, count, positive)
        # The least-squares rising fit at i is the largest mean from any a <= i to the least of its ends b >= i.
        mean = lambda a, b: positive[a:b + 1].sum() / count[a:b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        first = np.unique(np.round(want, 12))
        assert np.allclose(model.levels, first)
        assert (np.diff(model.edges) > 0).all()


def test_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one good text.", 5.0), (1, "one good text.", 5.0), (2, None, 1.0)], "doc_id int, text string, stats double")
    rows = quality.measured(docs).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [1, 1, 2] and rows[0]["stats"] == rows[1]["stats"] and not any(rows[2]["stats"])
    model = quality.fit(quality.measured(docs.drop("stats")).select("stats", F.lit(1).alias("label")))
    assert len({r["quality_score"] for r in quality.scored(quality.measured(docs), model).filter("doc_id = 1").collect()}) == 1
    network, _ = trained()
    twice = langid.identify(docs, network).filter("doc_id = 1").collect()
    assert len(twice) == 2 and twice[0]["lang_score"] == twice[1]["lang_score"]
