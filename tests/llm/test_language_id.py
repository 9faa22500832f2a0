import zlib

from pyspark.sql import functions as F

from ionquarry.llm import language_id as L

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.predictions(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    lang = {x.doc_id: x.lang for x in docs.select("doc_id", "lang").collect()}
    rows = got.collect()
    assert len(rows) == len(lang) and all(0 <= x.score <= 1 for x in rows)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in rows)
    judged = [x for x in rows if x.held_out and lang[x.doc_id] is not None and x.lang_pred != "und"]
    assert len(judged) > 100 and sum(x.lang_pred == lang[x.doc_id] for x in judged) >= 0.95 * len(judged)


def test_language_of_a_held_out_row_is_no_input(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    changed = docs.withColumns({"lang": F.when(L.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")), "source": F.lit(None).cast("string")})
    plain = lambda df: sorted(map(tuple, L.predictions(df).collect()))
    assert plain(docs) == plain(changed)


def test_edge_cases(spark):
    rows = [(0, "the cat and the dog", "en"), (1, "der Hund und die Katze", "de"), (2, "le chien et le chat", None), (3, None, "en"), (4, "12 34 !?", "en"), (5, "", None), (None, "und die der", None), (1, "der Hund und die Katze", "de")]
    docs = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], SCHEMA + ", Score int, any_letter int, LANG_PRED int")
    model = L.train(docs)
    assert model.langs == ["de", "en"]
    out = L.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "any_letter", "lang_pred", "score"]
    got = [(x.doc_id, x.lang_pred) for x in out.collect()]
    assert got == [(0, "en"), (1, "de"), (2, got[2][1]), (3, "und"), (4, "und"), (5, "und"), (None, "de"), (1, "de")]
    assert all((x.score == 0) == (x.lang_pred == "und") for x in out.collect())
    assert {x.any_letter for x in out.collect()} == {2}


def test_long_text_counts_whole(spark):
    text = "the cat and the dog " + "der Hund und die Katze " * 20_000
    docs = spark.createDataFrame([(0, "the cat and the dog", "en"), (1, "der Hund und die Katze", "de"), (2, text, None)], SCHEMA)
    assert {x.doc_id: x.lang_pred for x in L.identify(docs, L.train(docs)).collect()}[2] == "de"


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = L.train(none)
    assert model.langs == [] and L.predictions(none).collect() == []
    assert [x.lang_pred for x in L.identify(spark.createDataFrame([(1, "words", "en")], SCHEMA), model).collect()] == ["und"]
