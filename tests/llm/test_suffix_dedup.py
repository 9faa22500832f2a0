import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionquarry.llm import suffix_dedup
from ionquarry.llm.suffix_array import suffix_array


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    held = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if held[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def cases():
    r = random.Random(5)
    prose = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared, common = prose(90), prose(70)
    texts = [None, "", "a" * 300, "ab" * 90, prose(39), prose(40)]
    texts += [prose(r.randrange(60)) + common + prose(r.randrange(60)) for _ in range(40)]
    texts += [prose(50) + shared[k : k + 60] + prose(20) + shared for k in (0, 10, 30)]
    twin = prose(200)
    return texts + [twin, twin, twin + "x", prose(39) * 2]


@pytest.mark.parametrize("shard_bytes", [50, 2000, 1 << 20])
def test_report_against_brute_force(spark, shard_bytes):
    texts = cases()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_report(docs, 40, gram=8, shard_bytes=shard_bytes).collect()}
    assert got == dict(enumerate(brute(texts, 40)))


@pytest.mark.parametrize("symbols", [1, 2, 5, 3000])
def test_suffix_array_against_sorting(symbols):
    r = random.Random(symbols)
    for size in (0, 1, 2, 3, 50, 3000):
        text = [r.randrange(1, symbols + 1) for _ in range(size)]
        text = text + text[: size // 2] + [0]
        assert suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_common_anchor_stays_in_its_tasks(spark):
    rows = [(i, 7) for i in range(800)] + [(i, 1000 + i // 2) for i in range(800, 1000)] + [(i, i + 5000) for i in range(50)]
    found = spark.createDataFrame(rows, "tid long, anchor long").repartition(8, "tid")
    got = suffix_dedup.standing_again(found, common=100)
    assert sorted((r.tid, r.anchor) for r in got.collect()) == sorted((t, a) for t, a in rows if a < 5000)
    held = Counter(r[0] for r in got.filter("anchor = 7").select(F.spark_partition_id()).collect())
    assert max(held.values()) < 200


def test_remove_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "x" * 50, 7), (2, "y", 8), (3, None, None)], "found int, text string, copies int")
    got = suffix_dedup.remove_repeats(docs, 40, gram=8)
    assert got.columns == docs.columns
    assert sorted(got.collect()) == [(2, "y", 8), (3, None, None)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.removal_report(docs).collect() == []
