"""Operators 2 and 7: held-out accuracy, edge cases, and what scores may depend on."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tideline.llm import attention_mil, common, string_kernel
from tideline.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    r = QUERIES["op2_string_kernel_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = r.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("acc"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    assert len(r) == 2 and all(x.acc > 0.97 and x.lo >= 0 and x.hi <= 1 for x in r)


def test_quality_held_out(spark):
    r = QUERIES["op7_attention_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out")
    r = r.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("acc"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.acc > 0.95 and r.lo >= 0 and r.hi <= 1


def test_kernel_is_the_presence_kernel():
    texts = ["ab ba", "abc", "xyz", "ab ba"]
    x = string_kernel.presence(texts)
    grams = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    for a, s in enumerate(grams):
        assert x[a].sum() == len(s)
        for b, t in enumerate(grams):
            assert x[a] @ x[b] == len(s & t)
    model = string_kernel.KernelModel(["u"], x, np.ones((4, 1)))
    k = model.kernel(x, model.landmarks())
    assert np.allclose(np.diag(k), 1) and np.isclose(k[0, 3], 1)


def test_language_of_odd_rows(spark, odd, empty):
    model = string_kernel.train(odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "b").otherwise("a")))
    got = odd.select("doc_id", "text", string_kernel.language("text", model).alias("_l")).select("doc_id", "text", "_l.*").collect()
    for r in got:
        known = bool(r.text) and any(map(str.isalpha, r.text))
        assert (r.lang_pred in ("a", "b")) == known and (known or (r.lang_pred, r.score) == ("und", 0.0))
    assert {r.lang_pred for r in string_kernel.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert string_kernel.identify(empty).count() == 0


def test_language_ignores_everything_but_text(odd):
    model = string_kernel.train(odd)
    a = odd.select("text", string_kernel.language("text", model).alias("l"))
    b = odd.withColumns({"lang": F.lit("zz"), "source": F.lit("q"), "doc_id": F.lit(0)}).select("text", string_kernel.language("text", model).alias("l"))
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_attention_gradients_and_weights():
    g = np.random.default_rng(1)
    counts = np.array([1, 3, 5, 2] * 10)
    x = g.normal(size=(counts.sum(), 6))
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    bad = np.array([i % 2 for i in range(len(counts))])
    x[starts, 0] = np.where(bad, 4.0, 0.0)  # one telling passage in a bag
    model = attention_mil.fit(x, counts, 1.0 - bad)
    f = model.forward((x - model.mean) / model.spread, counts)
    assert ((f["p"] > 0.5) == (bad == 0)).mean() > 0.95
    assert np.allclose(np.add.reduceat(f["a"], starts), 1)


def test_quality_edge_cases(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (10, 1, 0), (12, 0, 0), (12, 0, 1), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = attention_mil.train(odd, labels)
    rows = odd.select("doc_id", attention_mil.quality("text", model).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in rows)
    one = attention_mil.train(odd, labels.filter("quality = 1"))
    assert {r.s for r in odd.select(attention_mil.quality("text", one).alias("s")).collect()} == {1.0}
    none = attention_mil.train(odd, labels.limit(0))
    assert {r.s for r in odd.select(attention_mil.quality("text", none).alias("s")).collect()} == {0.5}
    kept = attention_mil.accepted(odd, labels)
    assert kept.columns == odd.columns and attention_mil.accepted(empty, labels).count() == 0


def test_passages_cover_the_text():
    text = "Abc def! " * 300
    x, counts = attention_mil.features([text, "", "x"])
    assert list(counts) == [-(-len(text) // attention_mil.PASSAGE), 1, 1] and x.shape == (counts.sum(), attention_mil.N_FEATURES) and np.isfinite(x).all()
    again, _ = attention_mil.features([text])
    assert np.allclose(x[: counts[0]], again)


def test_gradients_by_finite_differences():
    """A fit's first step follows the loss' slope, taken numerically, and the forward pass is the formula bag by bag."""
    g = np.random.default_rng(3)
    counts = np.array([1, 3, 2, 4])
    x, y = g.normal(size=(10, attention_mil.N_FEATURES)), np.array([0.0, 1.0, 1.0, 0.0])
    sizes = {"E": (attention_mil.N_FEATURES, 4), "e": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "d": (1,)}
    w = {k: g.normal(0, 0.4, s) for k, s in sizes.items()}
    model = attention_mil.AttentionModel(w)
    at = np.concatenate([[0], np.cumsum(counts)])
    for bag, p in enumerate(model.forward(x, counts)["p"]):
        h = np.tanh(x[at[bag] : at[bag + 1]] @ w["E"] + w["e"])
        raw = [float((np.tanh(v @ w["V"]) / (1 + np.exp(-(v @ w["U"])))) @ w["w"]) for v in h]
        a = np.exp(raw) / np.exp(raw).sum()
        z = sum(x * v for x, v in zip(a, h, strict=True))
        assert abs(p - 1 / (1 + np.exp(-(z @ w["c"] + w["d"][0])))) < 1e-9
    loss = lambda: -np.mean(y * np.log(p := model.forward(x, counts)["p"]) + (1 - y) * np.log(1 - p))
    found = attention_mil.gradients(model, x, counts, y)
    for k, value in w.items():
        for i in list(np.ndindex(value.shape))[:: max(1, value.size // 7)]:
            before = value[i]
            value[i] = before + 1e-5
            up = loss()
            value[i] = before - 1e-5
            down = loss()
            value[i] = before
            assert abs((up - down) / 2e-5 - found[k][i]) < 1e-6, (k, i)


def test_ridge_scores_by_brute_force():
    """Nystroem features and one-versus-rest ridge, solved over again from the kernel's definition."""
    texts = [prose(s, 30) for s in range(8)] + [prose(s, 30).translate(str.maketrans("aeiou", "öäüßé")) for s in range(8)]
    y = np.repeat([0, 1], 8)
    model = string_kernel.fit(string_kernel.presence(texts), ["a", "b"], y, landmarks_per_class=3)
    slots = [set(np.flatnonzero(r)) for r in string_kernel.presence(texts)]
    k = lambda i, j: len(slots[i] & slots[j]) / (len(slots[i]) * len(slots[j])) ** 0.5
    marks = [0, 1, 2, 8, 9, 10]
    kmm, knm = (np.array([[k(i, j) for j in marks] for i in rows]) for rows in (marks, range(16)))
    values, vectors = np.linalg.eigh(kmm)
    phi = knm @ vectors / np.sqrt(values)
    target = np.where(y[:, None] == [0, 1], 1.0, -1.0)
    beta = np.linalg.solve(phi.T @ phi + string_kernel.RIDGE * 16 * np.eye(6) / 6, phi.T @ target)
    assert np.allclose(model.scores(texts, model.landmarks()), np.clip((phi @ beta + 1) / 2, 0, 1), atol=1e-3)


def test_quality_lets_the_store_of_the_operator_before_go():
    common.kept("of another operator", lambda: {"word": 1})
    [scores] = attention_mil.scored(iter([pd.Series(["Some text.", None])]), attention_mil.AttentionModel(None))
    assert list(scores) == [0.5, 0.5] and not common._store
