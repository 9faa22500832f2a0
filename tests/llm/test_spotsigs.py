import hashlib
import random

from pyspark.sql import functions as F

from ionquarry.llm import spotsigs as S


def test_report_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 8)
    r = random.Random(2)
    prose = lambda: " ".join(r.choice(["the", "of", "und", "le", "Wörd", "other", "mass", "scan", "ion", "😀"]) for _ in range(r.randrange(60)))
    texts = {i * 3: prose() for i in range(40)} | {1: None, 2: "", 500: "x", 501: "the"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ids = sorted(texts, reverse=True)
    got = {x.doc_id: x for x in S.fingerprint_report(docs).collect()}
    assert set(got) == set(texts)
    prints = {}
    for k, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, got[i].fingerprint) == got[i].fingerprint
        sets = [set(filter(None, x.split(","))) for x in (got[i].fingerprint, got[i].edited_fingerprint, got[ids[(k + 1) % len(ids)]].fingerprint)]
        like = [1.0 if not sets[0] | s else len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]]
        assert [got[i].near_edited, got[i].near_next] == like


def test_chains(spark):
    row = spark.range(1).select(S.signatures(F.lit("The red, big ion of the scan with mass.")).alias("s"), *[F.lower(F.hex(F.xxhash64(F.lit(c)))).alias(c) for c in ("red big", "scan mass")]).first()
    assert row.s == sorted([row["red big"], row["scan mass"]])


def test_similar_pairs_against_brute_force(spark):
    r = random.Random(4)
    base = [" the ".join(r.choice("abcdefgh") + r.choice("xyzuvw") + " w" + str(r.randrange(30)) for _ in range(25)) for _ in range(8)]
    texts = base + [" the ".join(p if r.random() > 0.06 else "new one" for p in b.split(" the ")) for b in base for _ in range(4)] + [None, ""]
    members, pairs = S.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    prints = sorted({x.fingerprint for x in members.collect()} - {""})
    sets = {p: set(p.split(",")) for p in prints}
    expected = {frozenset((a, b)) for a in prints for b in prints if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert expected and {frozenset((x.one, x.other)) for x in pairs.collect()} == expected


def test_a_long_run_of_common_words(spark):
    runs = ["the of and " * 30_000 + "red fox", "the red fox"]
    sets = [spark.createDataFrame([(x,)], "text string").select(S.signatures(F.col("text")).alias("s")).first().s for x in runs]
    assert sets[0] == sets[1] and len(sets[0]) == 1
