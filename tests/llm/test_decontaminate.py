import hashlib
import random
import re

import pytest

from ionquarry.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def own_words(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute(docs, items, n):
    out = []
    for doc, text in docs:
        words, hit, found = own_words(text), set(), set()
        for item, held in items:
            wanted = own_words(held)
            size = min(n, len(wanted))
            for i in range(len(wanted) - size + 1 if size else 0):
                for j in range(len(words) - size + 1):
                    if words[j : j + size] == wanted[i : i + size]:
                        hit |= set(range(j, j + size))
                        found.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def sample():
    r = random.Random(11)
    words = ["ab", "Ab", "été", "x1", "日本", "q"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "\n", "--", "\x00"]) for _ in range(n))
    items = [(i, text(r.randrange(0, 9))) for i in range(12)] + [(3, "ab"), (12, None), (13, "!?"), (None, text(6))]
    docs = [(i, text(r.randrange(0, 40))) for i in range(60)] + [(60, None), (61, ""), (62, "..."), (None, text(30)), (7, text(30))]
    return docs + docs[:3], items


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 40])
def test_report_equals_brute_force(spark, monkeypatch, block_bytes):
    docs, items = sample()
    monkeypatch.setattr(D.find_leaks, "__defaults__", (*D.find_leaks.__defaults__[:-1], block_bytes))
    got = D.leak_report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), n=4)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(docs, items, 4)


def test_long_text_and_long_item(spark):
    r = random.Random(5)
    words = [f"w{r.randrange(500)}" for _ in range(60_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[30_000:30_012])), (3, " ".join(words[:9]))]
    items = [(1, " ".join(words[30_000:30_500]))]
    got = {x.doc_id: x.n_hit for x in D.leak_report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {1: 500, 2: 12, 3: 0}


def test_spans_and_documents_are_removed(spark):
    docs = spark.createDataFrame([(1, "Keep, one two THREE four; keep", 5), (2, "one two three four", 6), (3, "one two three", 7), (4, None, 8)], "doc_id long, text string, N_words int")
    items = spark.createDataFrame([(1, "one two three four")], ITEMS)
    spans = {x.doc_id: x.text for x in D.decontaminate(docs, items, n=4).collect()}
    assert spans == {1: "Keep, ; keep", 3: "one two three", 4: None}
    whole = D.decontaminate(docs, items, "documents", n=4)
    assert {x.doc_id for x in whole.collect()} == {3, 4}
    with pytest.raises(ValueError):
        D.decontaminate(docs, items, "words")


def test_empty_tables(spark):
    docs, items = sample()
    none = spark.createDataFrame([], ITEMS)
    assert D.leak_report(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).collect() == []
    assert not any(x.contaminated for x in D.leak_report(spark.createDataFrame(docs, DOCS), none).collect())
