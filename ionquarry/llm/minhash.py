"""MinHash near-dedup: circulant MinHash signatures, banding, exact Jaccard verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionquarry.llm import bytesops as B
from ionquarry.llm.common import ASCII_LOWER, ASCII_UPPER, chosen_name, cut, text_halves
from ionquarry.llm.components import components

#: Words in a shingle; bands and rows of the signature. At a similarity of 0.8, all bands miss once in 300,000 pairs.
SHINGLE, BANDS, ROWS = 5, 32, 5
_SHIFT = np.uint32(0x9E3779B9)


def shingles(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles, with repeats, and the first of each text; a text of fewer words has one of all."""
    hashes, _, _, firsts = B.word_hashes(data, at, B.NONSPACE)
    count = np.diff(firsts)
    if len(hashes) and (short := np.flatnonzero((count > 0) & (count < n))).size:
        parts, bounds, grams = [], [0], B.gram_hash(hashes, n)
        few = set(short.tolist())
        for d in range(len(count)):
            a, b = firsts[d], firsts[d + 1]
            parts.append(B.gram_hash(hashes[a:b], b - a) if d in few else grams[a : max(a, b - n + 1)])
            bounds.append(bounds[-1] + len(parts[-1]))
        return np.concatenate(parts), np.array(bounds)
    grams = B.gram_hash(hashes, n)
    keep = np.flatnonzero(B.within(firsts, n, len(grams)))
    return grams[keep], np.searchsorted(keep, firsts)


def signatures(grams: np.ndarray, firsts: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: texts by ``size``; a text without shingles has the largest value everywhere.

    The upper half of the shingle hash is the first permutation's output. The second permutation, a bijection of the
    32-bit integers, is applied after k equal circular shifts for coordinate k.
    """
    out = np.full((len(firsts) - 1, size), np.iinfo(np.uint32).max, np.uint32)
    some = np.flatnonzero(np.diff(firsts))
    if not len(some):
        return out
    at = firsts[:-1][some]
    moved = (grams >> np.uint64(32)).astype(np.uint32)
    held, high = np.empty_like(moved), np.empty_like(moved)
    for k in range(size):
        moved += _SHIFT
        np.right_shift(moved, np.uint32(16), out=held)
        held ^= moved
        held *= np.uint32(0x85EBCA6B)
        np.right_shift(held, np.uint32(13), out=high)
        held ^= high
        held *= np.uint32(0xC2B2AE35)
        np.right_shift(held, np.uint32(16), out=high)
        held ^= high
        out[some, k] = np.minimum.reduceat(held, at)
    return out


_FEATURES = "t1 long, t2 long, n_shingles long, bands array<long>"
_SETS = "node long, shingles array<long>"


def _features(n: int, bands: int, rows: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in B.chunks(batch, "text"):
                grams, firsts = shingles(data, at, n)
                signed = signatures(grams, firsts, bands * rows).reshape(-1, bands, rows).astype(np.uint64)
                keys = np.zeros(signed.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    keys = B.mix(keys * np.uint64(31) + signed[:, :, r])
                sizes = [len(np.unique(grams[a:b])) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
                listed = [k if s else None for k, s in zip(keys.view(np.int64), sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("t1"), part.column("t2"), pa.array(sizes, pa.int64()), pa.array(listed, pa.list_(pa.int64()))], names=["t1", "t2", "n_shingles", "bands"])

    return step


def _sets(n: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in B.chunks(batch, "text"):
                grams, firsts = shingles(data, at, n)
                sets = [np.unique(grams[a:b]).view(np.int64) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return step


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """(t1, t2, text): the two halves of each text's digest; null counts as empty."""
    t1, t2 = text_halves(F.col(text_col))
    return docs.select(t1.alias("t1"), t2.alias("t2"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those ``pairs`` (u, v: nodes) whose whole sets link: 100 * intersection >= percent * union."""
    one, other = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "uv")
    both = F.size(F.array_intersect("of_u", "of_v"))
    counted = pairs.join(other, "v").join(one, "u").select("u", "v", both.cast("long").alias("both"), (F.size("of_u") + F.size("of_v")).alias("sizes"))
    return counted.filter(100 * F.col("both") >= percent * (F.col("sizes") - F.col("both"))).select("u", "v")


def ranked_shingles(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, n, shingle, place) of the shingles that several ``crowd`` nodes hold: n is the set's size, place the shingle's in order.

    The order goes by the number of crowd texts that hold a shingle, the rarest first, so those of no other text come before
    all that are listed here.
    """
    held = crowd.select("node").join(sets, "node").select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    many = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    by_node = Window.partitionBy("node")
    place = F.row_number().over(by_node.orderBy("texts", "shingle")) - 1 + F.col("n") - F.count(F.lit(1)).over(by_node)
    return held.join(many, "shingle").select("node", "n", "shingle", place.alias("place"))


def prefix_pairs(ranked: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of the ``ranked`` nodes with unlike roots that can link: an exact prefix join of their sets.

    Of two sets that link, each has a common shingle among its first ones, as many as it may lack; and after the first
    common one, enough must be left on both sides. So a text of which more is its own than a link allows has no pair at
    all, however crowded its bucket.
    """
    first = ranked.filter(100 * (F.col("n") - F.col("place")) >= percent * F.col("n")).join(roots, "node")
    x, y = first.alias("x"), first.alias("y")
    rest = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    may = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    may &= (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & ((100 + percent) * rest >= percent * (F.col("x.n") + F.col("y.n")))
    return x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & may).select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct()


def _pivots(rooted: DataFrame, order: Column) -> DataFrame:
    """Pairs (u, v): of each band's bucket the first node in ``order``, and every other one of unlike root."""
    first = rooted.groupBy("band").agg(F.min(order).alias("p")).select("band", F.col("p.node").alias("u"), F.col("p.root").alias("u_root"))
    return rooted.join(first, "band").filter("root <> u_root").select("u", F.col("node").alias("v")).distinct()


def links(docs: DataFrame, percent: int = 80, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the distinct texts, node, t1, t2, n_shingles; and (u, v), nodes whose sets link.

    Sets link if 100 * intersection >= percent * union, counted on the full sets. Candidates share a band. In each band's
    bucket, all are first compared with the bucket's smallest node. Texts of buckets that these links leave in several
    components are the crowd. There, all are compared with the bucket's most usual text, that with the fewest shingles of
    its own, and between the components left, ``prefix_pairs`` finds all pairs that can still link. Links between texts of
    one component are not all looked for, and a found component comes back as links to its smallest node; components lose
    none of the candidates. Null and empty texts have no shingles and no links; equal texts are one node; an empty table
    has neither nodes nor edges.
    """
    keyed = _keyed(docs, text_col)
    # equal texts meet as small rows, one for each task, before anything else
    once = keyed.mapInArrow(_features(n, bands, rows), _FEATURES).groupBy("t1", "t2").agg(F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    features = cut(once.withColumn("node", F.monotonically_increasing_id()), small=True)
    nodes = features.select("node", "t1", "t2", "n_shingles")
    entries = features.filter("bands IS NOT NULL").select("node", F.explode("bands").alias("band"))
    least = entries.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("held")).filter("held > 1").select("band", "first")
    members = cut(entries.join(least, "band").filter("node <> first"), small=True)
    star = members.select(F.col("first").alias("u"), F.col("node").alias("v")).distinct()
    wanted = members.select("node").union(members.select("first")).distinct().join(nodes, "node").select("node", "t1", "t2")
    texts = keyed.groupBy("t1", "t2").agg(F.first("text").alias("text"))
    sets = cut(texts.join(wanted, ["t1", "t2"]).select("node", "text").mapInArrow(_sets(n), _SETS), small=True)
    roots = components(linked(star, sets, percent))
    rooted = members.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    open_ = rooted.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("band")
    crowd = cut(rooted.join(open_, "band", "left_semi"), small=True)
    ranked = cut(ranked_shingles(crowd.select("node").distinct(), sets), small=True)
    own = ranked.groupBy("node").agg((F.max("place") + 1 - F.count(F.lit(1))).alias("own"))
    usual = crowd.join(own, "node")
    pivots = _pivots(usual, F.struct("own", "node", "root"))
    edges = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    roots = components(edges.union(linked(pivots, sets, percent)))
    edges = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    apart = crowd.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return nodes, edges.union(linked(prefix_pairs(ranked, apart, percent), sets, percent))


def classes(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Each row's id, t1, t2, n_shingles, root (the class, as a node) and component_id: the smallest id of the texts that links reach, itself included.

    Null and empty texts, and texts without words, have no shingles and link with nothing, not even with one another: each
    such row is a class of its own, by its id. Rows with equal texts are one class. A null id stays null and counts as
    larger than any other. Options: as of ``links``. An empty table gives an empty one.
    """
    nodes, edges = links(docs, **options)
    t1, t2 = text_halves(F.col(options.get("text_col", "text")))
    ids = docs.select(F.col(id_col).alias("id"), t1.alias("t1"), t2.alias("t2"))
    roots = nodes.join(components(edges), "node", "left").select("t1", "t2", "n_shingles", F.coalesce("root", "node").alias("root"))
    rows = ids.join(roots, ["t1", "t2"])
    least = rows.filter("n_shingles > 0").groupBy("root").agg(F.min("id").alias("least"))
    rows = rows.join(least, "root", "left")
    return rows.select("id", "t1", "t2", "n_shingles", "root", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each class: the smallest id, of several texts with it the smallest digest, of equal rows any.

    Rows without a shingle (null, empty, no words) are all kept; a null id counts as the largest. Other columns pass
    through, whatever their names. An empty table gives an empty one. Options: as of ``links``.
    """
    one, two, kept_one, kept_two, kept_id = (chosen_name(docs, x) for x in ("key_one", "key_two", "kept_one", "kept_two", "kept_id"))
    text = F.col(options.get("text_col", "text"))
    found = classes(docs, id_col, **options).filter("n_shingles > 0")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "t1", "t2")
    winner = found.groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.t1").alias(kept_one), F.col("best.t2").alias(kept_two), F.col("best.id").alias(kept_id))
    t1, t2 = text_halves(text)
    keyed = docs.withColumns({one: t1, two: t2})
    # the id stands outside the join's keys, so that the rows are dealt out once, by text, also for what follows
    same_id = F.array_contains(F.array(F.struct(F.col(kept_id).alias("id"))), F.struct(F.col(id_col).alias("id")))
    kept = keyed.join(winner, (F.col(one) == F.col(kept_one)) & (F.col(two) == F.col(kept_two)) & same_id, "left_semi")
    wordless = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return kept.dropDuplicates([one, two]).drop(one, two).unionByName(docs.filter(wordless))


def dedup_report(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row (columns doc_id, text); cases as in ``classes``."""
    found = classes(docs.select("doc_id", "text"), percent=percent)
    kept: Column = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


#: The report's rows by all pairs that share a shingle, and all texts that their links reach; for small tables.
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS size FROM s GROUP BY 1),
e AS (SELECT u, v FROM (SELECT a.rid AS u, b.rid AS v, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.rid <> b.rid GROUP BY 1, 2) JOIN n x ON x.rid = u JOIN n y ON y.rid = v WHERE 100 * shared >= 85 * (x.size + y.size - shared)),
r AS (SELECT rid, rid AS other FROM d UNION SELECT r.rid, e.v FROM r JOIN e ON e.u = r.other),
m AS (SELECT r.rid, min(o.doc_id) AS least FROM r JOIN d o ON o.rid = r.other GROUP BY 1)
SELECT doc_id, coalesce(size, 0) AS n_shingles, least AS component_id, doc_id = least AS kept FROM d JOIN m USING (rid) LEFT JOIN n USING (rid)"""
