import random

import pytest

from ionquarry.llm import toxicity


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(7)
    rows, marks = [(900, None), (901, ""), (902, "1 2")], [(900, 1), (None, 1)]
    for i in range(600):
        words = [r.choice("abcdefgh") + r.choice("klmnop") for _ in range(r.randrange(5, 40))]
        if i % 5 == 0:
            words.insert(r.randrange(len(words)), r.choice(["Vile", "nasty"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_held_out_texts(docs):
    got = [x for x in toxicity.scores(*docs).collect()]
    assert len(got) == 603 and all(0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.held_out and x.doc_id < 900]
    assert sum(x.predicted == (x.doc_id % 5 == 0) for x in held) >= 0.95 * len(held)


def test_blocks_change_nothing(docs):
    texts, labels = docs
    one, many = (toxicity.train_classifier(texts, labels, block_rows=n) for n in (10**6, 20))
    assert len(one.model) == 1 and len(many.model) > 1
    first, second = ({x.doc_id: x.toxicity for x in toxicity.classify(texts, c).collect()} for c in (one, many))
    assert all(first[k] == pytest.approx(second[k], abs=1e-6) for k in first)
