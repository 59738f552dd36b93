"""Mixing, sharding, URL filter; and the pipeline against a brute-force version."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest

import oracle
from llm import cases
from turnwise.llm import byte_bpe, mixing, queries, sharding, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_mix(spark):
    rows = mixing.mix(cases.frame(spark)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in cases.rows())
    sizes = Counter({(r[0], len(WORD.findall(r[1] or ""))): 1 for r in cases.rows()})
    assert {(r["doc_id"], r["size"]) for r in rows} == set(sizes)
    per: dict = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        per[(r["source_size"], r["target"])] += r["taken"]
    for (size, target), taken in per.items():
        assert target <= 2 * size + 1e-6
        assert abs(taken - target) <= max(256, 0.02 * target)
    assert abs(sum(t for _, t in per) - 1.5 * sum(s for s, _ in per)) < 1e-3


def test_mix_reruns_agree(spark):
    a, b = (sorted(map(tuple, mixing.mix(cases.frame(spark)).collect()), key=str) for _ in range(2))
    assert a == b


def test_mix_empty(spark):
    assert mixing.mix(cases.empty(spark)).count() == 0
    assert mixing.repeat_documents(cases.empty(spark)).count() == 0


def test_shards(spark):
    rows = sharding.shard_by_bytes(cases.frame(spark)).collect()
    assert len(rows) == len(cases.rows())
    by: dict = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert set(by) <= set(range(16))
    biggest = max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in v) - sum(r["size"] for r in rows) / 16) <= biggest for v in by.values())
    assert sharding.shard_by_bytes(cases.empty(spark)).count() == 0


URLS = [None, "", "no scheme", "http://", "https://A.Example.COM/en/x?y=/fr/", "http://www.example.com/en/", "http://www.example.com/end", "ftp://x.net/es/a", "http://net/fr/", "http://xnet/fr/", "http://example.com#/en/", "http://example.com/en", "a://b://c.net/es/"]


@pytest.mark.parametrize("limit", [url_filter.MAX_TRIE_RULES, 0])
def test_url_rules(spark, limit):
    """The trie and, beyond its bound, the join give the same."""
    rules = spark.createDataFrame(list(queries.URL_RULES), "action string, host string, path string")
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    rows = url_filter.filter_urls(pages, rules, max_trie_rules=limit).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        fits = [(len(h + p), h + p, a) for a, h, p in queries.URL_RULES if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r["rule"], r["verdict"]) == best[1:]
    assert url_filter.filter_urls(pages.where("false"), rules, max_trie_rules=limit).count() == 0


def test_queries_against_sql(spark, sf_dir):
    con = oracle.connect(sf_dir)
    for name, sql in queries.oracle_sql().items():
        assert not oracle.differences(queries.queries()[name](spark, sf_dir), con, sql), name


def test_pipeline(spark, sf_dir):
    """Stage by stage against plain Python over the collected rows."""
    import corpus_pipeline
    from llm.test_near import brute
    from turnwise.llm import toxicity
    from turnwise.session import materialise

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    find = toxicity.Finder(model.terms)
    kept = [r for r in docs.collect() if model.score(find(r["text"] or "")) < toxicity.THRESHOLD]
    last = {}
    for r in sorted(kept, key=lambda r: r["doc_id"]):
        last[r["text"] or ""] = r
    kept = sorted(last.values())
    kept = {i for i, _, c in brute([(r["doc_id"], r["text"]) for r in kept]) if i == c}
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        frame = materialise(stage(spark, frame, sf_dir), f"test-{name}")
        assert frame.columns == docs.columns
    assert {r[0] for r in frame.select("doc_id").collect()} == kept
    taken = {r["doc_id"]: round(r["taken"] / r["size"]) if r["size"] else 0 for r in mixing.mix(frame).collect()}
    mixed = Counter(r[0] for r in corpus_pipeline.mix_sources(spark, frame, sf_dir).select("doc_id").collect())
    assert all(abs(mixed[i] - n) <= 1 for i, n in taken.items())
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in out) == mixed
    one = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert {tuple(r) for r in out} <= {tuple(r) for r in one}
