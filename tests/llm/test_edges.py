"""Empty tables, repeated rows, long texts, ties and clashing names, for the operators whose own tests leave them out."""

import random

import corpus_pipeline
from ionquarry.llm import language_id, license_scan, spotsigs, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8))) for _ in range(n))


def test_fingerprints_of_few_and_repeated_rows(spark):
    assert spotsigs.fingerprint_report(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = spotsigs.fingerprint_report(spark.createDataFrame([(5, "the red fox")], SCHEMA)).collect()
    assert [(x.doc_id, x.near_next) for x in alone] == [(5, 1.0)]
    rows = [(1, "the red fox"), (1, "the red fox"), (1, "the blue sky"), (None, None), (None, "")]
    got = spotsigs.fingerprint_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and len({x.fingerprint for x in got if x.doc_id == 1}) == 2
    members, pairs = spotsigs.similar_pairs(spark.createDataFrame([], SCHEMA))
    assert members.collect() == [] and pairs.collect() == []


def test_long_chains_are_filled_from_several_pieces(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(spotsigs.signatures(F.lit("the red of big and ion"), 3).alias("s"), F.lower(F.hex(F.xxhash64(F.lit("red big ion")))).alias("whole")).first()
    assert row.whole in row.s


def test_licenses_of_repeated_long_and_clashing_rows(spark):
    words = "the mit license " + "x " * 200_000 + "cc by"
    docs = spark.createDataFrame([(1, words, 7, 8), (1, words, 7, 8), (2, None, 9, 9)], SCHEMA + ", row int, kept int")
    rows, places = license_scan.scan_licenses(docs, license_scan.templates_table(spark))
    assert sorted((x.kept.doc_id, x.kept.row, x.kept.kept, x.n_words) for x in rows.collect()) == [(1, 7, 8, 200_005), (1, 7, 8, 200_005), (2, 9, 9, 0)]
    assert sorted((x.label, x.start) for x in places.collect()) == [("cc-by", 200_003)] * 2 + [("mit", 1)] * 2


def test_more_template_words_than_are_looked_up_in_place(spark, monkeypatch):
    r = random.Random(1)
    texts = [f"w{r.randrange(400)} " * 3 + "all rights reserved mit license" for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    few = sorted(map(tuple, license_scan.license_report(docs).collect()))
    monkeypatch.setattr(license_scan, "IN_PLACE", 3)
    assert sorted(map(tuple, license_scan.license_report(docs).collect())) == few
    many = spark.createDataFrame([([f"w{i}" for i in range(20_100)], "big", 100, False), (["mit", "license"], "mit", 100, True)], "words array<string>, label string, percent int, exact boolean")
    monkeypatch.setattr(license_scan, "IN_PLACE", 20_000)
    _, places = license_scan.scan_licenses(docs, many)
    assert {x.label for x in places.collect()} == {"mit"}


def test_blocks_of_license_templates(spark):
    docs = spark.createDataFrame([(1, "x x all y rights reserved z")], SCHEMA)
    _, places = license_scan.scan_licenses(docs, license_scan.templates_table(spark))
    assert {(x.label, x.first, x.last) for x in places.collect()} == {("all-rights-reserved", 2, 5)}


def test_toxicity_of_few_repeated_and_clashing_rows(spark):
    none, marks = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scores(none, marks).collect() == []
    rows = [(i, "vile a b" if i % 2 else "c d e") for i in range(60)] + [(7, "vile a b"), (99, None), (99, "q " * 100_000)]
    got = toxicity.scores(spark.createDataFrame(rows, SCHEMA), marks).collect()
    assert len(got) == 63 and {x.score for x in got} == {0.5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], SCHEMA + ", kn_words int, Toxicity int")
    classifier = toxicity.train_classifier(docs, labels)
    out = toxicity.classify(docs, classifier)
    assert out.columns == ["doc_id", "text", "kn_words", "toxicity"] and {x.kn_words for x in out.collect()} == {1} and out.count() == 63


def test_repeats_in_very_long_texts(spark):
    r = random.Random(3)
    passage, long = prose(r, 90), prose(r, 60_000)
    rows = [(1, long[:200_000] + passage + long[200_000:]), (2, passage), (3, prose(r, 100))]
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in suffix_dedup.removal_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (len(passage), 1), 2: (len(passage), 1), 3: (0, 0)}


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([("a b", str(i)) for i in range(3)], "text string, lang string")
    try:
        language_id.train(docs)
    except ValueError as e:
        assert "more than 2" in str(e)
    else:
        raise AssertionError


def test_stages_of_empty_and_odd_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    r = random.Random(9)
    text, long = prose(r, 80), prose(r, 30_000)
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text, None, None, None), (2, None, "en", None, None), (3, "", None, "b", 0), (4, long, "en", "b", 1)]
    odd = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], DOCUMENTS + ", found int, key_one int, Size int")
    for docs in (spark.createDataFrame([], DOCUMENTS), odd):
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, str(tmp_path))
            assert name == "mix_sources" or kept.columns == docs.columns
        found = sorted((x.doc_id, x.text) for x in kept.collect())
        assert found == ([] if docs is not odd else [x for x in [(1, text), (4, long)] if x in found]) and (docs is not odd or found)
