"""License scans: an exact set-similarity join of text blocks and templates with prefix, length and positional filters.

A block is any run of ``window`` consecutive words of a text. It meets a template if it holds at least ``need`` of the
template's distinct words. The template's words are ordered by their frequency in the whole corpus, rarest first; a
block that meets it holds one of the first ``size - need + 1``, the prefix, so only blocks around prefix words are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionquarry.llm.common import ascii_lower, cut

#: phrase and label; a place of the phrase is a run of its words in order.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: text, label, percent of its distinct words that a block must hold.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", 80),
    ("licensed under the apache license version 2 you may not use this file except in compliance", "apache", 80),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 80),
    ("mozilla public license", "mpl", 100),
    ("all rights reserved", "all-rights-reserved", 100),
]
#: Distinct words of all templates up to which each text's words are looked up in place; with more, they are joined.
IN_PLACE = 20_000
#: Rows of the index of prefix words up to which it is broadcast.
BROADCAST_ROWS = 50_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates_table(spark: SparkSession) -> DataFrame:
    """words, label, percent, exact (whether the words must stand in order and side by side)."""
    rows = [(p.split(), x, 100, True) for p, x in PHRASES] + [(t.split(), x, k, False) for t, x, k in TEMPLATES]
    return spark.createDataFrame(rows, "words array<string>, label string, percent int, exact boolean")


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({_WORD})"), F.lit(1))


def _index(templates: DataFrame, words: DataFrame) -> DataFrame:
    """One row for each prefix word: template, its distinct words, need, window and the word's place in the order."""
    numbered = templates.filter("size(words) > 0").dropna().distinct().withColumn("template", F.xxhash64("words", "label", "percent", "exact"))
    held = words.groupBy("w").agg(F.count(F.lit(1)).alias("held"))
    each = numbered.select("template", F.explode(F.array_distinct("words")).alias("w")).join(held, "w", "left")
    order = each.groupBy("template").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "w"))).alias("order"))
    sized = numbered.join(order, "template").withColumns({"tokens": F.col("order.w"), "need": F.ceil(F.size("order") * F.col("percent") / 100).cast("int"), "window": F.when(F.col("exact"), F.size("words")).otherwise(2 * F.size("words"))})
    prefix = F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - F.col("need") + 1))
    return sized.select("template", "words", "label", "exact", "tokens", "need", "window", prefix.alias("w"))


def scan_licenses(docs: DataFrame, templates: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, places): ``docs`` without its text, as kept, with row and n_words; and row, label, exact, start, share, first, last.

    start is a place from 0: of an exact template, of each place of the phrase; of others, of each prefix word around which
    a block meets the template. share: the largest part of the template's distinct words that such a block holds; of
    others, first and last are the template's outermost words in the first block that holds so many.

    A null text is empty. Repeated texts and rows are each scanned. Templates without words or with a null are left out;
    repeated ones count once. Words of a text other than the templates' leave the scan at once, by a hash set in the
    scan itself or, for more than ``IN_PLACE`` of them, by a join; what remains of a text stays in its row, and around each
    prefix word at most two windows of it are looked at. Columns of ``docs`` of any name stay in kept. Without templates,
    or with an empty table, there are no places.
    """
    words = templates.select(F.explode("words").alias("w")).filter("w <> ''").distinct()
    known = [r.w for r in words.limit(IN_PLACE + 1).collect()]
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(1).alias("_")]
    listed = docs.select(F.struct(*others).alias("kept"), word_list(F.col(text_col)).alias("all")).withColumn("n_words", F.size("all").cast("long"))
    if len(known) <= IN_PLACE:
        placed = F.filter(F.transform("all", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x.w.isin(known))
        rows = cut(listed.select("kept", "n_words", placed.alias("found")).withColumn("row", F.monotonically_increasing_id()))
    else:
        whole = cut(listed.withColumn("row", F.monotonically_increasing_id()))
        each = whole.select("row", F.posexplode("all").alias("i", "w")).join(words, "w", "left_semi")
        found = each.groupBy(F.col("row").alias("of")).agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("found"))
        rows = cut(whole.join(found, F.col("row") == F.col("of"), "left").select("kept", "n_words", "found", "row"))
    index = cut(_index(templates, rows.select(F.explode("found.w").alias("w"))))
    reach = (index.agg(F.max("window")).first()[0] or 1) - 1
    around = F.expr(f"transform(sequence(0, size(found) - 1), k -> struct(found[k].i AS p, found[k].w AS w, slice(found, greatest(k - {reach}, 0) + 1, {2 * reach + 1}) AS near))")
    hits = rows.filter("size(found) > 0").select("row", F.explode(around).alias("h")).select("row", "h.p", "h.w", "h.near").join(F.broadcast(index) if index.count() <= BROADCAST_ROWS else index, "w")
    # only the template's words within a window of the prefix word
    close = F.filter("near", lambda x: (F.abs(x.i - F.col("p")) < F.col("window")) & F.array_contains("tokens", x.w))
    hits = hits.withColumn("near", close).filter("size(array_distinct(near.w)) >= need")
    block = "filter(near, x -> x.i >= s.i AND x.i < s.i + window)"
    best = F.expr(f"array_max(transform(near, s -> struct(size(array_distinct({block}.w)) AS n, -s.i AS before, element_at({block}, -1).i AS last)))")
    starts = F.expr("filter(near, s -> s.i <= p AND s.i + window > p AND filter(near, x -> x.i >= s.i AND x.i < s.i + window).w = words).i")
    exact = hits.filter("exact").select("row", "label", "exact", F.explode(starts.cast("array<long>")).alias("start"), F.lit(1.0).alias("share"), F.size("words").alias("_n")).distinct()
    exact = exact.select("row", "label", "exact", "start", "share", F.col("start").alias("first"), (F.col("start") + F.col("_n") - 1).alias("last"))
    blocks = hits.filter("NOT exact").withColumn("best", best).filter("best.n >= need").select("row", "label", "exact", F.col("p").cast("long").alias("start"), (F.col("best.n") / F.size("tokens")).alias("share"), (-F.col("best.before")).cast("long").alias("first"), F.col("best.last").cast("long").alias("last"))
    return rows.select("row", "kept", "n_words"), exact.unionByName(blocks)


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each document (columns doc_id, text).

    Each row, also a repeated one, is judged by itself; a null or empty text has no words, no labels and score 0; an empty
    table gives an empty one.
    """
    rows, places = scan_licenses(docs.select("doc_id", "text"), templates_table(docs.sparkSession))
    own = F.col("exact")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per = places.groupBy("row").agg(F.count_if(own).alias("n_base"), F.min(F.when(own, F.col("start"))).alias("first_word"), F.max(F.when(own, F.col("start"))).alias("last_word"), joined(F.when(own, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("share").alias("score"))
    out = rows.join(per, "row", "left")
    return out.select("kept.doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
