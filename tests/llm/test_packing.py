import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionquarry.llm import packing

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def words():
    return packing.words_of(packing.default_tokenizer())


def encoded(words, texts, **_):
    data = [(t or "").encode() for t in texts]
    at = np.cumsum([0, *map(len, data)])
    return [np.frombuffer(x, "<u4").tolist() for x in words.ids(np.frombuffer(b"".join(data), np.uint8), at)]


def test_words_give_the_ids_of_whole_texts(words, monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choice("aeb'sStT ÀéİIiıßΣσςİ̸́<=>1２ \t\n  \x1c\x85ﬁ漢字😀.,%'Çç×÷ǅ") for _ in range(r.randrange(30))) for _ in range(3000)]
    texts += [" ".join(r.choice(["Hello,", "it's", "the", "(203)", "schön", "ÉTÉ!", "x" * 90, "don't"]) for _ in range(40)) for _ in range(50)]
    want = [x.ids for x in words.whole.encode_batch(texts, add_special_tokens=False)]
    assert encoded(words, texts) == want
    assert not any(len(w) > packing.LONGEST for w in words.known)
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    monkeypatch.setattr(packing, "BYTES", 50)
    assert encoded(words, texts) == want


def test_best_fit_fills_and_never_overfills():
    r = random.Random(3)
    for _ in range(50):
        sizes = [r.randrange(1, 100) for _ in range(r.randrange(0, 300))]
        bins, count = packing.best_fit(sizes, 100)
        fill = [0] * count
        for b, s in zip(bins, sizes, strict=True):
            fill[b] += s
        assert all(0 < f <= 100 for f in fill) and sum(f <= 50 for f in fill) <= 1
    assert packing.best_fit([60, 40, 50, 50, 99, 1], 100)[1] == 3


def checked(rows, capacity):
    """Sequences without gaps; returns their number."""
    held = {}
    for x in rows:
        held.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(held)


@pytest.mark.parametrize(("kind", "spare"), [("small", 1.01), ("mixed", 1.01), ("large", 1.4), ("one", 1.0)])
def test_rounds_pack_tightly(spark, kind, spare):
    r = random.Random(kind)
    size = {"small": lambda: r.randrange(1, 60), "mixed": lambda: r.choice([700, 1348, r.randrange(1, 2048), r.randrange(1, 300)]), "large": lambda: r.randrange(1100, 1900), "one": lambda: 2048}[kind]
    rows = [(i, r.randrange(2**31), size()) for i in range(6000)]
    table = spark.createDataFrame(rows, "key long, deal long, length long")
    got = table.join(packing.placed(table, bucket=500, fan=3, carried=20), "key").collect()
    assert len(got) == 6000
    used, least = checked(got, 2048), -(-sum(x[2] for x in rows) // 2048)
    if kind == "large":
        least = 6000 / 1.4  # no two fit together
    assert used <= least * spare + 1
    alone = packing.best_fit([x[2] for x in rows], 2048)[1]
    assert used <= alone * 1.01 + 2


def test_report_of_odd_rows(spark, words):
    r = random.Random(4)
    texts = ["".join(r.choice(["The ", "wordly ", "it's ", "x1 "]) for _ in range(r.choice([3, 40, 900]))) for _ in range(80)]
    rows = [(i, t, 5, 6) for i, t in enumerate([None, "", "   ", "a " * 10_000, "b" * 20_000, *texts])] + [(None, "no id", 5, 6), (6, texts[1], 5, 6), (6, texts[1], 5, 6)]
    got = packing.packing_report(spark.createDataFrame(rows, SCHEMA + ", key int, ids int").repartition(3)).collect()
    want = []
    for doc, text, *_ in rows:
        ids = np.array([*words.whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc, a // 2048, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for a in range(0, len(ids), 2048)]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got), key=key) == sorted(want, key=key)
    assert checked(got, 2048) == packing.best_fit([x[3] for x in want], 2048)[1]
    assert packing.packing_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sequences_hold_the_ids(spark, words):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 40)) for i in range(60)], SCHEMA)
    got = packing.sequences(docs, packing.default_tokenizer(), capacity=64).collect()
    seen = 0
    for x in got:
        ids = np.frombuffer(x.ids, "<u4").tolist()
        assert len(ids) == x.length <= 64
        for part in x.parts:
            own = [*words.whole.encode(f"text number {part.doc_id} " * (part.doc_id % 40), add_special_tokens=False).ids, 0]
            assert ids[part.offset : part.offset + part.length] == own[part.start : part.start + part.length]
            seen += part.length
    assert seen == sum(len(words.whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.select(F.col("text")).collect())
