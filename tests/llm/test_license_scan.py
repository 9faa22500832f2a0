import random
import re

from ionquarry.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
    base = sorted((i, x) for p, x in L.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    labels, score = {x for _, x in base}, 1.0 if base else 0.0
    for t, label, percent in L.TEMPLATES:
        own, size = set(t.split()), 2 * len(t.split())
        best = max((len(own & set(words[i : i + size])) for i in range(len(words))), default=0)
        if 100 * best >= percent * len(own):
            labels.add(label)
            score = max(score, best / len(own))
    return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score


def test_report_against_brute_force(spark):
    r = random.Random(1)
    texts = [None, "", "MIT Licénse", "the MIT\nLicense, the mit license", "license mit", "CC-BY cc by cc by 4", "GNU General Public License" * 2, "gnu general public apache license all rights were reserved", "Mozilla public LICENSE"]
    texts += [t for t, _, _ in L.TEMPLATES]
    for _ in range(60):
        words = r.choice(L.TEMPLATES)[0].split() + ["cc", "by", "mit", "license"] * r.randrange(3)
        words = [w for w in words if r.random() > 0.15] + ["other"] * r.randrange(8)
        r.shuffle(words) if r.random() < 0.4 else None
        texts.append(" ".join(["x"] * r.randrange(30) + words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x[0]: tuple(x[1:]) for x in L.license_report(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_empty_table(spark):
    assert L.license_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
