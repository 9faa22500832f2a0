import random
import re

import pytest

from ionquarry.llm import minhash as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def shingle_set(text, n=5):
    words = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, percent):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted((d, len(s), least[top(i)], d == least[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def sample(seed):
    """Originals, exact copies, chains of edits of which only neighbours are alike, short, empty and null texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(4))
    texts = []
    for _ in range(25):
        text = [word() for _ in range(r.randrange(60, 220))]
        texts += [" ".join(text)] * r.randrange(1, 4)
        for _ in range(r.randrange(0, 6)):
            text = list(text)
            text[r.randrange(len(text))] = word().upper()
            texts.append("\n".join(text))
    texts += ["One two", "one TWO", "one two three four five", "", "", None, None, " \t", "solo"]
    r.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("seed", [1, 2])
def test_report_equals_brute_force(spark, seed, percent):
    rows = sample(seed)
    got = M.dedup_report(spark.createDataFrame(rows, SCHEMA), percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == brute(rows, percent)


def test_a_large_group_and_a_long_text(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    rows = [(i, " ".join(base)) for i in range(400)]
    for i in range(400, 700):
        text = list(base)
        text[r.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(text)))
    long = [f"v{r.randrange(10**6)}" for _ in range(80_000)]
    rows += [(700, " ".join(long)), (701, " ".join(long[:-1]))]
    got = {x.doc_id: x.component_id for x in M.dedup_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: 0 if i < 700 else 700 for i in range(702)}


def test_a_crowd_of_copies_at_the_threshold(spark):
    r = random.Random(4)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(150):
        text = list(base)
        for k in r.sample(range(150), r.randrange(1, 4)):
            text[k] = r.choice([f"x{i}", f"y{k}"])
        rows.append((i, " ".join(text)))
    assert sorted(map(tuple, M.dedup_report(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows, 85)


def test_one_document_of_each_group_stays_with_its_columns(spark):
    text = " ".join(f"w{i}" for i in range(80))
    names = "doc_id long, text string, tid string, root int, kept_tid int, kept_id int, text_key int, last int, Band int"
    rows = [(d, t, "t", 1, 2, 3, 4, 5, 6) for d, t in [(5, text), (3, text + " more"), (3, text + " more"), (9, None), (9, None), (8, ""), (None, text), (7, "other words altogether here now")]]
    docs = spark.createDataFrame(rows, names)
    got = M.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    # rows without words link with nothing, so all of them stay
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[1], rows[3], rows[4], rows[5], rows[7]], key=repr)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert M.dedup_report(none).collect() == [] and M.drop_near_duplicates(none).collect() == []
