"""Mixing sources to target weights by pivotal dependent rounding over a distributed reduction tree."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionquarry.llm.bytesops import mix as mixed
from ionquarry.llm.common import cut

#: Weights of the sources in order, repeating; share of all words to take; most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Documents that one task rounds together, and residuals that meet in one task of a further level.
BUCKET, FAN = 20_000, 2_000
#: Parts that equal rows are numbered in.
PARTS = 256
_WORD = r"[^\x20\x09-\x0D]+"


def targets(per: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``per`` (source, words, ...) with the words to take of each source, column target.

    The total is shared by weight; a source gets at most ``most`` times its words, and what it can't take is shared again
    by weight among the others until none is above. Only sums leave the table of sources; it is never collected.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    per = cut(per.withColumn("weight", weight))
    top = F.lit(float(most)) * F.col("words")
    total = share * (per.agg(F.sum("words")).first()[0] or 0)
    # a source is at its limit above the unit words * most / weight; the limit only ever takes in more sources
    unit, at_limit = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(unit) > top
        held, rest, count = per.agg(F.sum(F.when(over, top).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum(F.when(over, 1).otherwise(0))).first()
        if count is None or count == at_limit or not rest:
            return per.withColumn("target", F.when(over, top).otherwise(F.least(F.col("weight") * F.lit(unit), top))).drop("weight")
        unit, at_limit = (total - held) / rest, count


def pivotal(size: np.ndarray, share: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Moves words between fractional shares until at most one is fractional; sum(size * share) stays.

    Of the share carried so far and the next one, either the first rises and the second falls or the other way round, with
    the odds that leave both expectations as they are, until one of them is 0 or 1. draw: a uniform number for each row.
    """
    out = share.copy()
    carry = -1
    for i in np.flatnonzero((share > 0) & (share < 1)).tolist():
        if size[i] == 0:
            out[i] = 0.0
            continue
        if carry < 0:
            carry = i
            continue
        a, b, p, q = float(size[carry]), float(size[i]), float(out[carry]), float(out[i])
        up, down = min(a * (1 - p), b * q), min(a * p, b * (1 - q))
        if draw[i] * (up + down) < down:
            p, q = (1.0, q - a * (1 - p) / b) if a * (1 - p) <= b * q else (p + b * q / a, 0.0)
        else:
            p, q = (0.0, q + a * p / b) if a * p <= b * (1 - q) else (p - b * (1 - q) / a, 1.0)
        p, q = (min(1.0, max(0.0, round(x, 12))) for x in (p, q))
        out[carry], out[i] = p, q
        carry = i if 0 < q < 1 else carry if 0 < p < 1 else -1
    return out


def settle(size: float, share: float, sizes: np.ndarray, shares: np.ndarray, draws: np.random.Generator) -> tuple[float, np.ndarray]:
    """A pivotal step of one document against all ``sizes`` as one unit, again and again until its share is 0 or 1 or they have no room.

    The unit's shares move together, each by the smaller of its distances to 0 and 1, so that none leaves them; either
    the document's share rises and theirs fall or the other way round, with the odds that leave all expectations as they are.
    """
    shares = shares.copy()
    while 0 < share < 1:
        reach = np.minimum(shares, 1 - shares)
        room = float((sizes * reach).sum())
        if room < 1e-9:
            break
        up, down = min(size * (1 - share), room), min(size * share, room)
        rises = draws.random() * (up + down) < down
        moved = up if rises else -down
        share, shares = share + moved / size, shares - moved / room * reach
        share = min(1.0, max(0.0, round(share, 12)))
        shares = np.clip(np.round(shares, 12), 0, 1)
    return share, shares


def by_size(size: np.ndarray, share: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """``pivotal``, class by class of sizes in falling order; the share that a class leaves over is settled with all smaller documents.

    No document's expectation changes, and sum(size * share) stays. What no smaller document can settle stays fractional:
    one share of a class at most.
    """
    out = share.copy()
    classes = np.floor(np.log2(np.maximum(size, 1)) / 2).astype(int)
    bounds = [0, *(np.flatnonzero(np.diff(classes)) + 1).tolist(), len(size)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out[a:b] = pivotal(size[a:b], out[a:b], draw[a:b])
        for i in a + np.flatnonzero((out[a:b] > 0) & (out[a:b] < 1)):
            out[i], out[b:] = settle(float(size[i]), float(out[i]), size[b:], out[b:], np.random.Generator(np.random.PCG64(int(draw[i] * 2**53))))
    return out


_ROWS = "digest long, twin long, source string, size long, bucket long, share double"


def _round(seed: int, last: bool):
    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        # large documents first: what is left over at the end is the share of a small one
        pdf = pdf.sort_values(["size", "digest", "twin"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        key = pdf["digest"].to_numpy().astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
        draw = (mixed(key + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(11)) / float(1 << 53)
        share = by_size(pdf["size"].to_numpy(), pdf["share"].to_numpy(), draw)
        if last:
            left = (share > 0) & (share < 1)
            share[left] = draw[left] < share[left]
        return pdf.assign(share=share)

    return step


def _digests(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits, as two longs, of all of a row's columns that can be hashed."""
    own = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*own), F.xxhash64(F.lit("twin"), *own)


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0, bucket: int = BUCKET, fan: int = FAN, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each row of ``docs`` without its text: digest, twin, size, source_size, target, copies, and kept with its other columns. See ``mix``."""
    others = [c for c in docs.columns if c != text_col]
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("long")
    digest, twin = _digests(docs)
    rows = cut(docs.select(digest.alias("digest"), twin.alias("twin"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(1).alias("_")]).alias("kept"), F.monotonically_increasing_id().alias("place")))
    units = rows.groupBy("digest", "twin", "source").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("alike"))
    per = targets(rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")), weights, share, most)
    per = cut(per.withColumn("copies", F.when(F.col("words") > 0, F.least(F.col("target") / F.col("words"), F.lit(float(most)))).otherwise(0.0)))
    rate = per.select(F.col("source").alias("of"), "copies", "rows", F.col("words").alias("source_size"), "target")
    # of equal rows as many take one more as the whole part of their joint share says; the rest is one row's share
    share_of = F.round(F.col("alike") * (F.col("copies") - F.floor("copies")), 9)
    whole = units.join(rate, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("sure", F.floor(share_of))
    buckets = F.ceil(F.col("rows") / bucket)
    start = whole.select("digest", "twin", "source", "size", F.pmod(F.xxhash64(F.col("digest")), buckets).alias("bucket"), (share_of - F.col("sure")).alias("share"))
    most_buckets = per.agg(F.max(F.ceil(F.col("rows") / bucket))).first()[0] or 1
    fractional, parts = start.filter("size > 0 AND share > 0 AND share < 1"), []
    while True:
        level = cut(fractional.groupBy("source", "bucket").applyInPandas(_round(seed, most_buckets == 1), _ROWS))
        parts.append(level.filter("share IN (0, 1)"))
        if most_buckets == 1:
            break
        most_buckets = -(-most_buckets // fan)
        fractional = level.filter("share NOT IN (0, 1)").withColumn("bucket", F.floor(F.col("bucket") / fan) if most_buckets > 1 else F.lit(0).cast("long"))
    extra = reduce(DataFrame.unionByName, parts).select(F.col("digest").alias("own"), F.col("twin").alias("own_twin"), F.col("source").alias("of_own"), F.col("share").cast("long").alias("extra"))
    decided = whole.join(extra, (F.col("digest") == F.col("own")) & (F.col("twin") == F.col("own_twin")) & F.col("source").eqNullSafe(F.col("of_own")), "left")
    once, more = F.floor("copies").cast("long"), F.col("sure") + F.coalesce("extra", F.lit(0))
    chosen = decided.select("digest", "twin", F.coalesce("source", F.lit("")).alias("of"), F.col("source").isNull().alias("of_none"), "source_size", "target", once.alias("once"), more.alias("more"))
    return _numbered(rows, chosen)


def _numbered(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows`` with what is ``chosen`` for them: of equal ones the first ``more`` are taken once more than the others.

    Equal rows are counted within ``PARTS`` parts of their places, then over the parts, so that no task has more than one
    part of them; which of them come first makes no difference.
    """
    unit = ["digest", "twin", "of", "of_none"]
    held = rows.withColumns({"of": F.coalesce("source", F.lit("")), "of_none": F.col("source").isNull(), "part": F.pmod("place", F.lit(PARTS))})
    counts = held.groupBy(*unit, "part").agg(F.count(F.lit(1)).alias("before"))
    earlier = F.coalesce(F.sum("before").over(Window.partitionBy(*unit).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.withColumn("before", earlier).join(chosen, unit)
    own = held.withColumn("number", F.row_number().over(Window.partitionBy(*unit, "part").orderBy("place")))
    copies = F.when(F.col("size") > 0, F.col("once") + (F.col("before") + F.col("number") <= F.col("more")).cast("long")).otherwise(F.lit(0)).cast("long")
    return own.join(parts, [*unit, "part"]).select("digest", "twin", "kept", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with size, source_size, target and copies (times that the mix takes the document).

    The copies of a document are the whole part of target / source_size and, by pivotal rounding of the rest, one more or
    not; its expectation is that rest. Rounding moves words, not documents, and large documents are settled before small
    ones; what is left over at the tree's root is drawn. Documents are dealt to buckets by a hash, rounded bucket by
    bucket, and what is left fractional, at most one row of each size class (sizes within a factor of four) and bucket,
    meets by ``fan`` until one bucket is left. No group has more than about ``bucket`` rows or a few times ``fan``, however
    large a source. The same rows give the same result.

    A null text has no words; documents without words are never taken (copies 0). A null source is a source, the last.
    Of rows that are equal in every column as many are taken once more as their joint share says, give or take one. An empty
    table gives an empty one. Columns of ``docs`` with an added name are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("size", "source_size", "target", "copies")])
    rows = plan_mix(docs, text_col=text_col, **options)
    # a text for each digest; equal rows have one
    digest, twin = _digests(docs)
    texts = docs.select(digest.alias("digest"), twin.alias("twin"), F.col(text_col).alias("body")).groupBy("digest", "twin").agg(F.first("body").alias("body"))
    held = rows.join(texts, ["digest", "twin"])
    own = [F.col("body").alias(text_col) if c == text_col else F.col(f"kept.`{c}`").alias(c) for c in docs.columns]
    return held.select(*own, "size", "source_size", "target", "copies")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row (columns doc_id, text, source).

    Null texts have size 0, null sources are one, the last; equal rows share what falls to them, give or take one row; an
    empty table gives an empty one.
    """
    rows = plan_mix(docs.select("doc_id", "text", "source"))
    return rows.select("kept.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
