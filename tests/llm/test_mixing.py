import random
import re
from collections import defaultdict

import numpy as np
import pytest

from ionquarry.llm import mixing as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"


def wanted(words):
    """Targets of the sources (words: source to size), by sharing what is left over again and again."""
    order = sorted(words, key=lambda s: (s is None, s))
    weight = {s: X.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, full = X.SHARE * sum(words.values()), set()
    while True:
        rest = sum(weight[s] for s in order if s not in full)
        left = total - sum(2 * words[s] for s in full)
        target = {s: 2.0 * words[s] if s in full else left * weight[s] / rest for s in order}
        over = {s for s in order if s not in full and target[s] > 2 * words[s]}
        if not over:
            return target
        full |= over
        if len(full) == len(order):
            return {s: 2.0 * words[s] for s in order}


def sample(seed, n=1500):
    r = random.Random(seed)
    sources = ["b", "a", None, "Z", "é"]
    rows = [(i, " ".join(["w"] * r.choice([1, 5, 20, 100, 400])), r.choices(sources, [12, 4, 2, 1, 1])[0]) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", None), (n + 2, " \t\n", "b"), (None, "one word more", "a"), rows[0], rows[0]]


@pytest.mark.parametrize(("bucket", "fan"), [(X.BUCKET, X.FAN), (40, 3)])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sources_come_near_their_targets(spark, monkeypatch, seed, bucket, fan):
    rows = sample(seed)
    docs = spark.createDataFrame(rows, SCHEMA)
    found = X.mix(docs, bucket=bucket, fan=fan, seed=seed).collect()
    assert len(found) == len(rows)
    words = defaultdict(int)
    for _, text, source in rows:
        words[source] += len(WORD.findall(text or ""))
    target, taken = wanted(words), defaultdict(int)
    for x in found:
        assert x.size == len(WORD.findall(x.text or "")) and x.source_size == words[x.source]
        assert x.target == pytest.approx(target[x.source])
        assert x.copies in ((0,) if x.size == 0 else (int(x.target / x.source_size), -int(-x.target // x.source_size)))
        taken[x.source] += x.copies * x.size
    # within the size of one row that the tree's root draws
    assert all(abs(taken[s] - target[s]) <= max(30, 0.02 * target[s]) for s in target)


def test_report_reruns_agree_in_any_order(spark):
    rows = sample(5)
    once = sorted(map(tuple, X.mix_report(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    again = X.mix_report(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7))
    assert again.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, again.collect()), key=repr) == once
    assert all(t <= 2 * s for _, s, _, _, t in once)


@pytest.mark.parametrize("parts", [1, 7, 256])
def test_equal_rows_share_what_falls_to_them(spark, monkeypatch, parts):
    monkeypatch.setattr(X, "PARTS", parts)
    rows = [(1, "ten words " * 5, "a")] * 50 + [(i, " ".join(["w"] * 31), "b") for i in range(10)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = X.mix_report(docs).collect()
    assert len(found) == 60
    for source, size in ((500, 10), (310, 31)):
        own = [x for x in found if x.source_size == source]
        assert abs(sum(x.taken for x in own) - own[0].target) <= size and all(x.taken <= 2 * x.size for x in own)
    mixed = X.mix(docs).collect()
    assert sorted((x.size, x.copies * x.size) for x in mixed) == sorted((x["size"], x.taken) for x in found)
    assert sorted((x.doc_id, x.text, x.source) for x in mixed) == sorted(rows)


def test_rounding_keeps_words_and_expectation():
    r = np.random.default_rng(1)
    size, share = r.integers(1, 50, 200), r.random(200)
    sums = np.zeros(200)
    for _ in range(400):
        out = X.pivotal(size, share, r.random(200))
        assert (out * size).sum() == pytest.approx((share * size).sum(), abs=1e-3)
        assert ((out > 0) & (out < 1)).sum() <= 1
        sums += out
    assert np.abs(sums / 400 - share).mean() < 0.05


@pytest.mark.parametrize("sizes", [[1000, 5, 5, 5, 5, 5], [400, 300, 90, 60, 20, 7, 3, 1], [8] * 12])
def test_rounding_by_size_is_unbiased(sizes):
    r = np.random.default_rng(7)
    size, share = np.array(sizes), np.full(len(sizes), 0.25)
    sums, runs = np.zeros(len(sizes)), 4000
    for _ in range(runs):
        out = X.by_size(size, share, r.random(len(sizes)))
        assert (out * size).sum() == pytest.approx((share * size).sum(), abs=1e-3) and out.min() >= 0 and out.max() <= 1
        sums += out
    assert sums / runs == pytest.approx(share, abs=0.04)


def test_the_mix_is_unbiased(spark):
    rows = [(i, " ".join(["w"] * n), "a") for i, n in enumerate([300, 40, 40, 40, 7, 7, 7, 7])]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1).cache()
    taken, runs = defaultdict(int), 30
    for seed in range(runs):
        for x in X.mix(docs, share=0.3, seed=seed).collect():
            taken[x.doc_id] += x.copies
    # the smallest eight deviations of 30 draws at 0.3 lie within 0.3 of it but once in some thousands
    assert all(abs(taken[i] / runs - 0.3) < 0.3 for i in range(len(rows)))
    assert abs(sum(taken[i] * len(t.split()) for i, t, _ in rows) / runs - 0.3 * 448) < 45


def test_clashing_names_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 9, 9, 9, 9)], SCHEMA + ", Size int, digest int, mix_digest int, kept int")
    out = X.mix(docs)
    assert set(out.columns) == {"doc_id", "text", "source", "digest", "mix_digest", "kept", "size", "source_size", "target", "copies"}
    assert [(x.digest, x.kept, x.size) for x in out.collect()] == [(9, 9, 2)]
    none = spark.createDataFrame([], SCHEMA)
    assert X.mix(none).collect() == [] and X.mix_report(none).collect() == []
    wordless = spark.createDataFrame([(1, None, "a"), (2, " ", None)], SCHEMA)
    assert [x.taken for x in X.mix_report(wordless).collect()] == [0, 0]
