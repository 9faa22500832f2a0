import random

import corpus_pipeline


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8))) for _ in range(n))


def test_stages_on_planted_cases(spark, tmp_path):
    r = random.Random(3)
    clean = [words(r, 120) for _ in range(12)]
    passage, item = words(r, 70), words(r, 14)
    near = clean[0].split()
    near[60] = "changed"
    texts = [*clean, clean[1], " ".join(near), "123 456", None, words(r, 40) + "\n" + passage, passage + "\n" + words(r, 40), words(r, 50) + " " + item + " " + words(r, 50)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), None if name == "mix_sources" else schema)
        kept[name] = {x.doc_id: x for x in docs.collect()}
        assert name == "mix_sources" or docs.columns == columns
    assert set(kept["language_id"]) == set(range(19)) - {14, 15}
    assert set(kept["minhash_dedup"]) == {*range(12), 16, 17, 18}
    repeats = kept["suffix_array_dedup"]
    assert set(repeats) == {*range(12), 16, 17, 18} and passage not in repeats[16].text + repeats[17].text
    assert all(repeats[i].text == clean[i] for i in range(12))
    assert item not in kept["decontamination"][18].text and kept["decontamination"][3].text == clean[3]
    assert all(x.copies in (1, 2) for x in kept["mix_sources"].values())


def test_language_stage_lets_the_classifier_decide(spark):
    r = random.Random(5)
    spoken = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randrange(3, 8))) for _ in range(n))
    one, other, unlearnt = "abcdefghij", "klmnopqrst", "абвгдежзик"
    rows = [(i, spoken((one, other)[i % 2], 80), ("one", "other")[i % 2]) for i in range(40)]
    short, noisy = [(40, "ab. cde", None), (41, "q", None)], [(42, "1234 a@b.cd " * 3 + spoken(one, 30) + " id=99x", None)]
    foreign = [(50, spoken(unlearnt, 80), None), (51, spoken("uvwxyz", 80), None), (52, "12 34", None), (53, None, None)]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([*rows, *short, *noisy, *foreign], schema)
    got = corpus_pipeline.by_language(spark, docs, "")
    assert got.columns == docs.columns and {x.doc_id for x in got.collect()} == set(range(43))
    unlabelled = spark.createDataFrame([(i, t, None) for i, t, _ in [*rows, *short, *noisy, *foreign]], schema)
    assert {x.doc_id for x in corpus_pipeline.by_language(spark, unlabelled, "").collect()} == {*range(43), 50, 51}
