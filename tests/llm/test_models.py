"""Classifiers: held-out accuracy on made texts, and their edge cases."""

from __future__ import annotations

import random
import zlib

import numpy as np

from pyspark.sql import functions as F

from llm import cases
from turnwise.llm import quality, toxicity


def made(spark, n: int = 400):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        w = cases.words(rng, rng.randint(20, 150))
        toxic, bad = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), f"zorq{rng.choice('abcdef')}{rng.choice('abcdef')}")
        docs.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), labels


def check(scored, truth: dict, threshold: float) -> None:
    held = [r for r in scored.collect() if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in held)
    assert all(r["predicted"] == (r["score"] >= threshold) for r in held)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_toxicity_finds_unknown_stems(spark):
    docs, labels, rows = made(spark)
    model = toxicity.fit(docs, labels)
    assert any(t.startswith("zorq") for t in model.terms)
    check(toxicity.score_documents(docs, model), {r[0]: r[2] for r in rows}, 0.7)
    kept = toxicity.clean_documents(docs, model)
    assert kept.columns == docs.columns and 0.7 * 400 < kept.count() < 0.9 * 400


def test_quality(spark):
    docs, labels, rows = made(spark)
    check(quality.score_documents(docs, quality.fit(docs, labels)), {r[0]: r[1] for r in rows}, 0.5)


def test_edge_cases(spark):
    docs, labels, _ = made(spark, 60)
    odd = cases.frame(spark)
    none = labels.where("false")
    for module in (toxicity, quality):
        for model in (module.fit(docs, labels), module.fit(docs, none)):
            scored = module.score_documents(odd, model)
            assert scored.count() == odd.count()
            assert scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
            assert module.score_documents(cases.empty(spark), model).count() == 0
    assert toxicity.clean_documents(odd, toxicity.fit(docs, none)).columns == odd.columns


def test_lexicon_speaks_without_labels(spark):
    docs, labels, _ = made(spark, 10)
    model = toxicity.fit(docs, labels.where("false"))
    find = toxicity.Finder(model.terms)
    assert model.score(find("what an idiot you are")) >= 0.7 > model.score(find("what a day"))


def test_finder_reads_long_texts_once_and_short_words():
    find = toxicity.Finder(["zo", "zorq-", "quab-+"])
    several = find.several
    assert find("a zo b") == [0, several, several + 2]
    assert find("zoo quabx " + "w " * 200) == []
    assert find("quabx " * 3 + "w " * 200) == [2, several, several + 2]
    assert {several + 3, several + 4} <= set(find("you are a ZORQX"))
    import time

    began = time.time()
    assert 1 in find(" ".join(f"zorq{'abcdefghij'[i % 10]}" for i in range(300_000)))
    assert time.time() - began < 10


def voters(rng, y, accuracy: list[float]):
    """One voter for each accuracy: of toxic rows it names so many, of clean ones a tenth of the rest."""
    return np.stack([np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < (1 - a) / 10) for a in accuracy], 1)


def sparse(said):
    return toxicity.Sparse([np.flatnonzero(r).tolist() for r in said], said.shape[1])


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.3
    votes = sparse(voters(rng, y, [0.6, 0.6, 0.6])[:, [0, 0, 0, 1, 2]])
    model = toxicity.LabelModel(0.3, np.ones(5, bool)).fit(votes)
    assert model.weight[0] < 0.5 < model.weight[3]
    assert np.mean((model.posterior(votes) > 0.5) == y) > 0.85


def test_label_model_learns_rates_without_labels():
    rng = np.random.default_rng(2)
    y = rng.random(6000) < 0.3
    accuracy = [0.9, 0.7, 0.5, 0.8]
    model = toxicity.LabelModel(0.3, np.ones(4, bool)).fit(sparse(voters(rng, y, accuracy)))
    assert np.allclose(model.rates[:4, 1], accuracy, atol=0.08)
    assert np.allclose(model.rates[:4, 0], (1 - np.array(accuracy)) / 10, atol=0.03)


def test_sparse_logistic_equals_dense():
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(12) < 0.2).tolist() for _ in range(400)]
    y = rng.random(400)
    w = toxicity.fit_logistic(toxicity.Sparse(rows, 12), y)
    x = np.zeros((400, 13))
    for i, r in enumerate(rows):
        x[i, r] = 1
    x[:, -1] = 1
    gradient = x.T @ (y - 1 / (1 + np.exp(-x @ w))) - np.append(np.full(12, 0.1), 1e-6) * w
    assert np.abs(gradient).max() < 1e-5


def test_voters_outvote_wrong_labels(spark):
    """Labels of a third of the rows are wrong: the posteriors follow the voters, and rows held out are found as before."""
    docs, labels, rows = made(spark, 1500)
    wrong = labels.withColumn("toxic", F.when(F.pmod(F.hash("doc_id"), F.lit(3)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    told = {r.doc_id: r.toxic for r in wrong.collect()}
    assert 0.25 < np.mean([told[r[0]] != r[2] for r in rows]) < 0.4
    model = toxicity.fit(docs, wrong)
    check(toxicity.score_documents(docs, model), {r[0]: r[2] for r in rows}, 0.7)
    find = toxicity.Finder(model.terms)
    texts = {r.doc_id: r.text for r in docs.collect()}
    votes = toxicity.Sparse([find(texts[r[0]]) for r in rows], find.size)
    says = model.label_model.posterior(votes) > 0.5
    turned = [(said, r[2]) for said, r in zip(says, rows) if told[r[0]] != r[2]]
    assert np.mean([said == truth for said, truth in turned]) > 0.95


def test_toxic_documents_by_language(spark, sf_dir):
    """Held-out rows of the smallest tables that have enough of them."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    got = {r.lang: r for r in scored.groupBy("lang").agg(F.sum("toxic").alias("n"), F.sum(F.expr("toxic * predicted")).alias("hit"), F.sum(F.expr("(1 - toxic) * predicted")).alias("wrong"), F.count("*").alias("all")).collect()}
    assert len(got) == 4
    for r in got.values():
        assert r.hit >= 0.9 * r.n and r.wrong <= 0.01 * r["all"]


def test_text_ids_and_odd_column_names(spark):
    docs, labels, _ = made(spark, 200)
    named = lambda df: df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    odd = named(docs).withColumn("a.b", F.lit(1)).withColumn("doc", F.lit(2))
    for module in (toxicity, quality):
        scored = module.score_documents(named(docs), module.fit(named(docs), named(labels)))
        assert scored.schema["doc_id"].dataType.simpleString() == "string" and scored.count() == 200
    kept = toxicity.clean_documents(odd, toxicity.fit(odd, named(labels)))
    assert kept.columns == odd.columns and 0 < kept.count() < 200


def test_attention_gradient():
    rng = np.random.default_rng(0)
    x, start, y = rng.normal(size=(12, 5)), np.array([0, 3, 7]), np.array([1.0, 0, 1])
    model = quality.Attention.new(x, 4, 3)
    loss = lambda: -np.mean(y * np.log(p := model.forward(x, start)["y"]) + (1 - y) * np.log(1 - p))
    grad = model.gradient(model.forward(x, start), start, y)
    for k, w in model.p.items():
        at = tuple(0 for _ in w.shape)
        keep = w[at]
        w[at] = keep + 1e-6
        up = loss()
        w[at] = keep - 1e-6
        down = loss()
        w[at] = keep
        assert abs((up - down) / 2e-6 - grad[k][at]) < 1e-6
