"""SpotSigs document fingerprints: chains of content words behind common words, compared by Jaccard similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionquarry.llm.common import ascii_lower, cut

#: Common words of four languages; a chain starts behind each run of them.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their they this to was were which with you "
    "au aux ce dans de des du elle en est et il la le les ne ou par pas pour que qui sur un une "
    "auf das dem den der des die ein eine einer es für ich ist mit nicht sich sie und von war zu "
    "con del el ella en es esta la las lo los no para por se su sus un una y"
).split()
#: Content words in a chain.
CHAIN = 2
#: Documents by id that one task orders.
BUCKET = 512
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted distinct chains, hashed; a text without any, but not empty, has itself as its only one."""
    words = F.concat(F.lit("  "), F.regexp_replace(ascii_lower(text), _OTHER, "  "), F.lit("  "))
    # a piece holds the content words between two runs of anchors; short ones are filled from the next ones. A repeated
    # group would make the matcher recurse along a run of anchors, so that each one parts, and blank pieces go
    behind = F.split(words, f" (?:{'|'.join(sorted(set(ANCHORS)))}) ")
    pieces = lambda b: F.filter(F.transform(F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))), lambda x: F.trim(x)), lambda x: x != "")
    head = lambda x: F.regexp_replace(F.substring_index(x, "  ", chain), " +", " ")
    filled = lambda p: F.transform(p, lambda x, i: F.trim(head(F.concat_ws("  ", F.slice(p, i + 1, chain)))))
    hashed = lambda c: F.array_sort(F.array_distinct(F.transform(F.filter(c, lambda x: x.contains(" ")), lambda x: F.lower(F.hex(F.xxhash64(x))))))
    alone = F.when(F.length(text) > 0, F.array(F.lower(F.hex(F.xxhash64(text))))).otherwise(F.array().cast("array<string>"))
    return once(once(once(once(behind, pieces), filled), hashed), lambda h: F.when(F.size(h) > 0, h).otherwise(alone))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def jaccard(one: Column, other: Column) -> Column:
    """Shared part of two signature sets; two empty ones are alike."""
    share = lambda both: F.when(F.size(one) + F.size(other) == 0, 1.0).otherwise(both / (F.size(one) + F.size(other) - both))
    return once(F.size(F.array_intersect(one, other)), share)


def similar_pairs(docs: DataFrame, threshold: float = 0.8, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): ``docs`` with fingerprint; and (one, other, similarity), fingerprints with Jaccard >= threshold.

    Only distinct fingerprints are compared; rows of one fingerprint are one class. Sets are partitioned by their length,
    so that a set meets its own partition and the next longer one; there, a pair must share one of the rarest signatures of
    both, and the lengths must allow the similarity, before the sets are compared in full. Null and empty texts have an
    empty fingerprint and no pairs; repeated rows are members of one fingerprint; an empty table has neither.
    """
    out = docs.drop(*[c for c in docs.columns if c.lower() == "fingerprint"])
    members = out.withColumn("fingerprint", F.array_join(signatures(F.coalesce(F.col(text_col), F.lit(""))), ","))
    sets = cut(members.filter("fingerprint <> ''").select("fingerprint").distinct().select(F.unhex(F.md5("fingerprint")).alias("id"), "fingerprint", F.split("fingerprint", ",").alias("sigs")))
    each = sets.select("id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    held = each.groupBy("sig").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    # signatures that one set alone holds come first in its prefix, but meet nothing
    alone = each.join(held, "sig", "left").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("held", F.lit(0)), "sig")))
    prefix = alone.filter((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1) & F.col("held").isNotNull())
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-1.0) / F.log(F.lit(threshold)))
    prefix = prefix.select("id", "n", "sig", part.alias("part"))
    a = prefix.withColumn("part", F.explode(F.array("part", F.col("part") + 1))).alias("a")
    b = prefix.alias("b")
    ordered = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id")))
    met = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.part") == F.col("b.part")) & ordered & (F.col("a.n") >= threshold * F.col("b.n"))).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct()
    own = sets.select(F.col("id").alias("x"), F.col("fingerprint").alias("one"), F.col("sigs").alias("s"))
    full = met.join(own, "x").join(own.select(F.col("x").alias("y"), F.col("one").alias("other"), F.col("s").alias("t")), "y")
    return members, full.select("one", "other", jaccard(F.col("s"), F.col("t")).alias("similarity")).filter(F.col("similarity") >= threshold)


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with next_text: that of the next document by descending id, null ids last, then the first again.

    Documents are ordered within buckets of ids; each bucket also gets the head of the next one as a further row, so that
    one table of bucket heads, ``BUCKET`` times smaller than the documents where ids are dense, is all that is ordered as a whole.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"tid": F.md5("text"), "bucket": F.coalesce(F.floor(F.col("doc_id") / BUCKET), F.lit(-(2**62)))})
    heads = cut(rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "tid")).alias("h")))
    turn = Window.orderBy(F.desc("bucket"))
    first = F.first("h").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = heads.select("bucket", F.coalesce(F.lead("h").over(turn), first).alias("h")).select(F.col("bucket").alias("of"), F.col("h.doc_id").alias("head"), F.col("h.tid").alias("head_tid"))
    guests = rows.join(after, F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tid") == F.col("head_tid"))).groupBy(F.col("of").alias("bucket")).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("tid").alias("tid"))
    both = rows.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("tid"))
    return both.withColumn("next_text", F.lead("text").over(order)).filter("guest = 0").select("doc_id", "text", "next_text")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (columns doc_id, text).

    Null texts are empty; equal ids are ordered by the texts' digests; repeated rows each have a row, and the last of all is
    followed by the first, a single one by itself; an empty table gives an empty one.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs).select("doc_id", "text", "next_text", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"))
    sets = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signatures(F.col("text")).alias("own"), signatures(F.col("edited")).alias("changed"), signatures(F.col("next_text")).alias("following"))
    return sets.select("doc_id", "n_chars", "edited_sha256", F.array_join("own", ",").alias("fingerprint"), F.array_join("changed", ",").alias("edited_fingerprint"), jaccard(F.col("own"), F.col("changed")).alias("near_edited"), jaccard(F.col("own"), F.col("following")).alias("near_next"))
