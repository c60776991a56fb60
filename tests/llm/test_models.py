import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import quality_model, registry, toxicity

ODD = [None, "", " ", "\n\n\n", "x", "é" * 9, "good text here.\nand more of it.", "idiot " * 9, "a\n" * 3000, "The " * 9000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i or None, t, "clash") for i, t in enumerate(ODD)] + [(7, ODD[7], "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


@pytest.mark.parametrize("name, label", [("op1_quality", "quality"), ("op5_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    sf = "/root/testdata/sf0.01"
    out = registry.queries()[name](spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    d = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(d) > 80 and np.mean([r["predicted"] == r[label] for r in d]) > 0.93
    assert out.count() == 1000 and out.where("score is null or score < 0 or score > 1").count() == 0


@pytest.mark.parametrize("module, label", [(quality_model, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, sf, odd, module, label):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = module.train(docs, labels)
    got = module.score(odd, model).collect()
    assert len(got) == len(ODD) + 1 and got[7]["score"] == got[-1]["score"]
    assert got[0]["score"] == got[1]["score"]
    assert module.score(odd.limit(0), model).count() == 0
    again = module.train(docs.orderBy(F.desc("doc_id")), labels)
    assert [r["score"] for r in module.score(odd, again).collect()] == [r["score"] for r in got]
    # Without labels of both kinds nothing is rejected.
    none = module.train(docs, labels.where(F.lit(False)))
    want = 1 if label == "quality" else 0
    assert {round(r["score"]) for r in module.score(odd, none).collect()} == {want}


def test_toxicity_learns_from_2500_of_each_label(spark):
    labels = spark.range(6000).selectExpr("id as doc_id", "id % 2 as toxic")
    few = toxicity._labelled(labels, "toxic", F.lit(True), toxicity.PER_CLASS)
    assert {r["y"]: r["count"] for r in few.groupBy("y").count().collect()} == {0: 2500, 1: 2500}


def test_quality_learns_from_whole_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_model, "fit", lambda row, f, y: seen.append((np.bincount(row).tolist(), y.tolist())))
    docs = spark.createDataFrame([(d, "a good line.\n" * 300 + "#### |||\n" * (10 * d)) for d in range(1, 9)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) as quality")
    quality_model.train(docs, labels)
    assert seen[0][0] == [300 + 10 * d for d in range(1, 9)]
    # Past the bound on lines whole documents are left out, at the latest after the one that reaches it.
    monkeypatch.setattr(quality_model, "LINES", 700)
    quality_model.train(docs, labels)
    assert len(seen[1][0]) < 8 and set(seen[1][0]) <= set(seen[0][0])
    assert all(700 <= seen[1][1].count(k) < 700 + 380 for k in (0, 1))


def test_chain_marginals_equal_enumeration():
    r = np.random.default_rng(3)
    row = np.repeat([0, 1, 2], [1, 4, 6])
    u, stay, leave = r.normal(size=11), 0.7, -0.2
    fwd, bwd = quality_model.forward_backward(row, u, stay, leave)
    for k in range(3):
        v = u[row == k]
        n = len(v)
        good = np.zeros(n)
        total = 0.0
        for code in range(1 << n):
            y = np.array([code >> i & 1 for i in range(n)])
            p = np.exp((v * y).sum() + np.where(y[1:] == y[:-1], stay, leave).sum())
            total += p
            good += p * y
        np.testing.assert_allclose(1 / (1 + np.exp(-(fwd + u + bwd)[row == k])), good / total)


def _grams(text):
    """Character n-grams of a text, in plain Python."""
    t = " " + "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in (text or "").lower()) + " "
    return {t[i : i + n] for n in toxicity.GRAMS for i in range(len(t) - n + 1)}


def _bucket(gram):
    return int(dict(toxicity.gram_buckets(np.array([ord(c) for c in gram], np.uint32)))[len(gram)][0])


def test_grams_counts_ratios_and_scores_equal_plain_python(spark, monkeypatch):
    good, bad = "Some plain Words, ïn ordinary Äußerung", "you utter NITWIT go away"
    texts = [(f"d{i}", f"{bad if i % 3 == 0 else good} {i * 37 % 11} {'東京 ١٢' if i % 4 else ''}") for i in range(60)] + [("d1", "a repeated id"), ("n", None)]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", int(i % 3 == 0)) for i in range(60)], "doc_id string, toxic int")
    seen, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a: seen.append(a) or fit(*a))
    model = toxicity.train(docs, labels)
    buckets, counts, found, y, fold = seen[0]
    own = {"d1": min("a repeated id", texts[1][1])}
    sets = [{_bucket(g) for g in _grams(own.get(d, t))} for d, t in texts[:60]]
    label = [int(i % 3 == 0) for i in range(60)]
    for b, c in zip(buckets, counts.sum(1), strict=True):
        assert list(c) == [sum(b in s for s, k in zip(sets, label) if k == v) for v in (0, 1)]
    ratio, useful = toxicity.log_ratios(counts.sum(1), np.array([40, 20]))
    for c, r, u in zip(counts.sum(1), ratio, useful, strict=True):
        want = np.log((c[1] + 1) / 22) - np.log((c[0] + 1) / 42)
        assert np.isclose(r, want) and u == (abs(want) >= (2 + np.log(60) / 8) * np.sqrt(1 / (c[0] + 1) + 1 / (c[1] + 1)) and c.sum() >= 4)
    assert sorted(y.tolist()) == sorted(label)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    for r in toxicity.score(docs, model).collect():
        z = model.bias + sum(weight.get(b, 0) for b in {_bucket(g) for g in _grams(r["text"])})
        assert np.isclose(r["score"], 1 / (1 + np.exp(-z)), atol=1e-6)
    assert all((r["score"] >= 0.7) == (int(r["doc_id"][1:]) % 3 == 0) for r in toxicity.score(docs.where("doc_id not in ('n', 'd1')"), model).collect())


def test_folds_choose_the_threshold():
    z, y = np.array([5.0, 4, 3, 2, 1, 0, -1]), np.array([1, 1, 0, 1, 0, 0, 0])
    assert toxicity._threshold(z, y)[1] == 3.5 and np.isclose(toxicity._threshold(z, y)[0], 2 / 3)
    assert toxicity._threshold(np.array([1.0, 1, 0]), np.array([1, 1, 0]))[1] == 0.5


@pytest.mark.parametrize("module, label", [(quality_model, "quality"), (toxicity, "toxic")])
def test_any_type_of_id_and_repeated_ids(spark, sf, module, label):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = module.train(docs, labels)
    twice = docs.unionByName(docs).unionByName(docs.select("doc_id", F.lit("\U0010ffff another text").alias("text"), "lang", "source", "n_chars"))
    again = module.train(twice, labels)
    assert [r["score"] for r in module.score(docs, model).collect()] == [r["score"] for r in module.score(docs, again).collect()]
    named = [d.withColumn("doc_id", F.concat(F.lit("n"), "doc_id")) for d in (docs, labels)]
    out = module.score(named[0], module.train(*named)).select("doc_id", "score").collect()
    assert len(out) == docs.count() and out[0]["doc_id"].startswith("n")


def _lines(text):
    """(bytes of each line that has any, as text), in plain Python; one empty line without any."""
    return [x for x in (text or "").split("\n") if x] or [""]


def _features(text):
    """The features of each line, one at a time."""
    out, before = [], None
    for line in _lines(text):
        raw = line.encode()
        kinds = {"lower": 0, "upper": 0, "digit": 0, "mark": 0, "symbol": 0, "bar": 0, "shout": 0, "other": 0, "lead": 0}
        for b in raw:
            c = chr(b)
            if b >= 0xC0:
                kinds["lead"] += 1
            elif b >= 0x80 or c in " \t\x0b\x0c\r":
                pass
            elif "a" <= c <= "z":
                kinds["lower"] += 1
            elif "A" <= c <= "Z":
                kinds["upper"] += 1
            elif "0" <= c <= "9":
                kinds["digit"] += 1
            else:
                kinds["mark" if c in ".,;:?" else "symbol" if c in "#*$%&<>=~^_{}[]\\@/" else "bar" if c == "|" else "shout" if c == "!" else "other"] += 1
        chars, words = max(len(line), 1), re.findall(r"[^\x20\x09-\x0D]+", line)
        many, letters = max(len(words), 1), max(kinds["lower"] + kinds["upper"] + kinds["lead"], 1)
        repeats = sum(w in words[max(i - 2, 0) : i] for i, w in enumerate(words))
        out.append([
            np.log1p(len(raw)) / 8, np.log1p(len(words)) / 6, min(chars / many, 30) / 12, (kinds["symbol"] / chars) ** 0.5, (kinds["bar"] / chars) ** 0.5, kinds["upper"] / letters, (kinds["digit"] / chars) ** 0.5,
            min(kinds["shout"] / many, 2) ** 0.5, (kinds["mark"] / chars) ** 0.5, (repeats / many) ** 0.5, float(repeats > 0.3 * many), float(line[-1:] in (".", "!", "?") and line != ""), float(line == before and line != ""), kinds["other"] / chars,
        ])
        before = line
    return np.array(out)


def test_line_features_and_scores_equal_plain_python(spark):
    texts = [t for t in ODD if len(t or "") < 400] + ["One fine day. It was!\n\n### || 12 12 12\n### || 12 12 12\nübel über Straße, (x) y?\n\nEND END a", "a b a b\n" * 6]
    model = quality_model.Model(np.random.default_rng(1).normal(size=3 * quality_model.FEATURES + 3), 0.9, 0.0)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = quality_model.score(docs, model).collect()
    # A score does not depend on the rows beside it.
    for parts in (1, len(texts)):
        assert {r["doc_id"]: r["score"] for r in quality_model.score(docs.repartition(parts, "doc_id"), model).collect()} == {r["doc_id"]: r["score"] for r in got}
    for r in got:
        t = (r["text"] or "").encode()
        row, size, f = quality_model.line_features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        want = _features(r["text"])
        np.testing.assert_allclose(f, want, atol=1e-5)
        n = len(want)
        # Neighbouring lines' features, marks for the ends, and a constant; then all labellings of the lines.
        none = np.zeros(quality_model.FEATURES)
        x = np.array([[*want[i], *(want[i - 1] if i else none), *(want[i + 1] if i + 1 < n else none), i > 0, i + 1 < n, 1] for i in range(n)], float)
        u, good, total = x @ model.weights, np.zeros(n), 0.0
        for code in range(1 << n):
            y = np.array([code >> i & 1 for i in range(n)])
            p = np.exp((u * y).sum() + np.where(y[1:] == y[:-1], model.stay, model.leave).sum())
            good, total = good + p * y, total + p
        weight = np.array([max(len(x.encode()), 1) for x in _lines(r["text"])])
        assert np.isclose(r["score"], (good / total * weight).sum() / weight.sum(), atol=1e-4)


def test_training_climbs_the_likelihood():
    r = np.random.default_rng(2)
    row, f = np.repeat(np.arange(30), 4), r.normal(size=(120, quality_model.FEATURES))
    y = np.repeat((np.arange(30) % 2), 4)
    f[:, 3] += 2 * y
    model = quality_model.fit(row, f, y, rounds=150)

    def likelihood(w, stay):
        x, total = quality_model.with_neighbours(row, f).astype(float), 0.0
        for k in range(30):
            u = x[row == k] @ w
            score = lambda z: (u * z).sum() + stay * (z[1:] == z[:-1]).sum()
            every = [score(np.array([c >> i & 1 for i in range(4)])) for c in range(16)]
            total += (0.7 if y[4 * k] else 0.3) * (score(y[row == k]) - np.logaddexp.reduce(every)) / 4 / 15
        return total - 0.5e-4 * (w**2).sum() - 0.0015 * stay**2

    best = likelihood(model.weights, model.stay)
    assert best > likelihood(np.zeros_like(model.weights), 0.0) + 0.05
    # Steps along random directions, small enough for the optimiser's own precision to show, gain next to nothing.
    for _ in range(20):
        d = r.normal(size=len(model.weights) + 1) * 0.02
        assert likelihood(model.weights + d[:-1], model.stay + d[-1]) < best + 2e-3
