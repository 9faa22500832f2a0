import hashlib
import random
import re

import pytest

from ionquarry.llm import fim

SCHEMA = "doc_id long, text string"


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("block", [1 << 20, 5, 1])
def test_transform_equals_brute_force(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    r = random.Random(block)
    for i in range(400):
        text = "".join(r.choice("abcZA  .<PSM>é漢\n😀1[`{@") for _ in range(r.randrange(0, 40)))
        assert fim.transform(text, fim.draws("1:", i)) == brute(i, text)


def test_odd_rows_and_clashing_names(spark):
    r = random.Random(2)
    texts = [None, "", "a", "<", "<<P", "x <S> y", "é" * 50, "long word " * 30_000, "Z" * 100_000, "< > " * 20]
    rows = [(i, t, 1, "z") for i, t in enumerate(texts * 12)] + [(None, "no id here", 1, "z"), (7, texts[7], 1, "z")]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA + ", N int, fim_text string")
    made = fim.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "fim_text", "n", "form", "prefix_chars", "middle_chars", "output"]
    for x in made.withColumn("again", fim.restored(made.output, made.form)).collect():
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == brute(x.doc_id, x.text)
        assert x.again == (x.text or "")
    assert fim.fim_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_settings(spark):
    docs = spark.createDataFrame([(i, "some words to cut at random places") for i in range(60)], SCHEMA)
    marks = ("[pre.]", "[suf|", "[mid\\")
    made = fim.fill_in_middle(docs, seed="other", sentinels=marks, plain=0, suffix_first=50)
    forms = {x.form for x in made.collect()}
    assert forms == {"psm", "spm"}
    assert {x.again for x in made.select(fim.restored(made.output, made.form, marks).alias("again")).collect()} == {"some words to cut at random places"}
