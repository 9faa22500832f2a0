"""Suffix-array dedup: byte strings that start more than once are found by suffix arrays over shards of aligned windows.

Every window of ``length`` bytes has one anchor: its ``GRAM`` bytes with the smallest hash (its upper bits), the leftmost of
equal ones. So equal windows have equal anchors at equal offsets. The windows of a text that share an anchor are one
stretch; stretches are dealt by the anchor's hash, so that all windows that could be equal meet in one shard, each of them
once. There, a suffix array by induced sorting and its capped common prefixes tell which windows start elsewhere too.

An anchor with more bytes of stretches than a shard holds is split: windows that start at similar distances before their
anchor have bytes around it in common, more of them the closer the distances, and equal windows start at equal ones. So
each of its stretches is parted by distance into two, and dealt by the hash of those bytes; and so on until the groups fit.
When all distances of a stretch are one, it is one window, and equal ones have met already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionquarry.llm import bytesops as B
from ionquarry.llm.common import chosen_name, cut, text_id, unique_texts
from ionquarry.llm.suffix_array import capped_prefixes, suffix_array

LENGTH, GRAM = 400, 64
#: Bytes of stretches in a shard, and shards of a task.
SHARD_BYTES, TASK_SHARDS = 1 << 20, 4
#: Stretches from which on an anchor is a common one.
COMMON = 10_000
#: Windows of a long text that are worked on at a time, and the bits that number their bytes.
WINDOWS, _PLACE_BITS = 1 << 17, np.uint64(18)

_ANCHORS = "tid binary, anchor long, place int, first int, last int"
_STRETCHES = "tid binary, anchor long, place int, first int, digest binary, bytes binary"
_RUNS = "tid binary, first int, last int"


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, the anchor's place, first, last start of the windows) of every stretch, counted from the text's first byte.

    A long text is worked off in blocks of windows, which bounds the memory; a stretch that spans two of them stays whole.
    """
    parts = []
    for d in np.flatnonzero(np.diff(at) >= length):
        own, windows = data[at[d] : at[d + 1]], int(at[d + 1] - at[d]) - length + 1
        blocks = [_block_anchors(own[a : a + WINDOWS + length - 1], a, length, gram) for a in range(0, windows, WINDOWS)]
        first, place, value = (np.concatenate(x) for x in zip(*blocks, strict=True))
        fresh = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        first = first[fresh]
        parts.append((np.full(len(first), d), value[fresh].view(np.int64), place[fresh], first, np.r_[first[1:] - 1, windows - 1]))
    if not parts:
        return (np.zeros(0, np.int64),) * 5
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _block_anchors(own: np.ndarray, begin: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, place and hash of the anchor) of the block's stretches; ``own`` starts at byte ``begin``."""
    width = length - gram + 1
    starts = np.arange(len(own) - gram + 1)
    value = B.span_hash(B.prefix_hash(own, lower=False), starts, starts + gram)
    # the place stands in the lowest bits, so that the smallest of a window is the leftmost of its smallest hash
    low = value >> _PLACE_BITS << _PLACE_BITS | starts.astype(np.uint64)
    # by doubling
    least, reach = low, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        shift = width - reach
        least = np.minimum(least[:-shift], least[shift:])
    place = (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    fresh = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return fresh + begin, place[fresh] + begin, value[place[fresh]]


def _find_anchors(length: int, gram: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in B.chunks(batch, "text"):
                text, *found = anchors(data, at, length, gram)
                yield pa.RecordBatch.from_arrays([part.column("tid").take(pa.array(text)), pa.array(found[0]), *(pa.array(x, pa.int32()) for x in found[1:])], names=["tid", "anchor", "place", "first", "last"])

    return step


def _cut_stretches(length: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in B.chunks(batch, "text"):
                rows = []
                for d, found in enumerate(part.column("found").to_pylist()):
                    own = data[at[d] : at[d + 1]].tobytes()
                    tid = part.column("tid")[d].as_py()
                    for x in found:
                        held = own[x["first"] : x["last"] + length]
                        rows.append((tid, x["anchor"], x["place"], x["first"], hashlib.md5(held).digest(), held))
                        if len(rows) >= 2000:
                            yield _batch(rows, _STRETCHES)
                            rows = []
                if rows:
                    yield _batch(rows, _STRETCHES)

    return step


_KINDS = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def repeated(stretches: list[bytes], length: int) -> list[np.ndarray]:
    """Of each stretch, which of its windows start elsewhere in the stretches too."""
    if not stretches:
        return []
    # symbols: 0 ends the text, 1 parts stretches, bytes follow; a window never holds a parting symbol
    parts = [np.r_[np.frombuffer(x, np.uint8).astype(np.uint16) + 2, 1] for x in stretches]
    text = np.concatenate([*parts, [0]]).astype(np.uint16)
    order = suffix_array(text)
    size = np.array([len(x) + 1 for x in stretches])
    begin = np.r_[0, np.cumsum(size)[:-1]]
    # up to the parting symbol, which would otherwise equal another stretch's
    room = np.repeat(begin + size - 1, size) - np.arange(len(text) - 1)
    prefix = np.minimum(capped_prefixes(text, order, length), np.r_[room, 0])
    twin = np.zeros(len(text), bool)
    long = np.flatnonzero(prefix[order] >= length)
    twin[order[long]] = True
    twin[order[long - 1]] = True
    twin &= np.r_[room, 0] >= length
    return [twin[b : b + s - length] for b, s in zip(begin, size, strict=True)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _shard(length: int):
    def step(group: pa.Table) -> pa.Table:
        flags = repeated([x.as_py() for x in group.column("bytes")], length)
        rows = []
        for tid, first, held, own in zip(group.column("tid").to_pylist(), group.column("first").to_pylist(), group.column("held").to_pylist(), flags, strict=True):
            if held == 1:
                rows += [(tid, first + a, first + b) for a, b in _runs(own)]
        return pa.Table.from_batches([_batch(rows, _RUNS)])

    return step


def _parted(length: int, gram: int, width: int):
    """Stretches parted where the windows' distance to the anchor passes a multiple of ``width``, each with its new key."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tid, anchor, place, first, held in zip(*(batch.column(c).to_pylist() for c in ("tid", "anchor", "place", "first", "bytes")), strict=True):
                low, high = place - (first + len(held) - length), place - first
                for part in range(low // width, high // width + 1):
                    near, far = max(low, part * width), min(high, (part + 1) * width - 1)
                    # the bytes that all windows at distances of this part hold, whether they are here or not
                    reach = min((part + 1) * width - 1, length - gram)
                    common = held[place - part * width - first : place - reach + length - first]
                    key = int.from_bytes(hashlib.md5(b"%d %d %d " % (anchor, width, part) + common).digest()[:8], "little", signed=True)
                    own = held[place - far - first : place - near + length - first]
                    rows.append((tid, key, place, place - far, hashlib.md5(own).digest(), own))
                if len(rows) >= 2000:
                    yield _batch(rows, _STRETCHES)
                    rows = []
            if rows:
                yield _batch(rows, _STRETCHES)

    return step


def _distinct(stretches: DataFrame) -> DataFrame:
    """One row for each anchor and content; equal stretches meet map-side, and ``held`` counts them."""
    own = stretches.groupBy("anchor", "digest").agg(F.sum("held").alias("held"), F.first("bytes").alias("bytes"), F.min(F.struct("tid", "first", "place")).alias("at"))
    return own.select("anchor", "digest", "held", "bytes", "at.tid", "at.first", "at.place")


def standing_again(found: DataFrame, common: int = COMMON) -> DataFrame:
    """The rows of ``found`` whose anchor stands in others too; those of an anchor with ``common`` rows or more stay in their tasks."""
    again = cut(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), small=True)
    # one for each ``common`` rows at most
    often = F.broadcast(again.filter(F.col("n") >= common).select("anchor"))
    others = again.filter(F.col("n") < common).select("anchor")
    return found.join(often, "anchor", "left_semi").unionByName(found.join(often, "anchor", "left_anti").join(others, "anchor", "left_semi"))


def repeated_windows(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(tid, first, last): ranges of starts of the windows that start elsewhere in the distinct ``texts`` (tid, text) too."""
    found = cut(texts.filter(F.octet_length("text") >= length).mapInArrow(_find_anchors(length, gram), _ANCHORS))
    listed = standing_again(found).groupBy("tid").agg(F.collect_list(F.struct("anchor", "place", "first", "last")).alias("found"))
    stretches = cut(texts.join(listed, "tid").select("tid", "text", "found").mapInArrow(_cut_stretches(length), _STRETCHES))
    runs, width = None, length - gram + 1
    while True:
        distinct = cut(_distinct(stretches.withColumn("held", F.lit(1).cast("long"))), small=True)
        # all windows of a stretch that stands twice are repeated, and one of its places stands for all of them
        multiple = distinct.filter("held > 1").select("anchor", "digest", (F.octet_length("bytes") - length).alias("more"))
        whole = stretches.join(multiple, ["anchor", "digest"]).select("tid", "first", (F.col("first") + F.col("more")).alias("last"))
        load = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("bytes")).alias("size")).filter("n > 1")
        load = cut(load, small=True)
        large = F.col("size") > shard_bytes // 2  # so that a shard that hash deals little too much stays small
        fit, left = load.agg(F.sum(F.when(~large, F.col("size"))), F.count_if(large)).first()
        shards = max(1, (fit or 0) // shard_bytes)
        several = distinct.join(load.filter(~large).select("anchor"), "anchor", "left_semi")
        dealt = several.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).select("shard", "tid", "first", "held", "bytes")
        # tasks by the load, so that none grows with the input
        dealt = dealt.repartition(-(-shards // TASK_SHARDS), "shard")
        sorted_ = dealt.groupBy("shard").applyInArrow(_shard(length), _RUNS)
        found = whole.unionByName(sorted_)
        runs = found if runs is None else runs.unionByName(found)
        if not left or width == 1:
            return runs
        width = (width + 1) // 2
        # a stretch that stands twice goes on for the others' sake; its own windows are known
        crowd = distinct.join(load.filter(large).select("anchor"), "anchor", "left_semi").select("tid", "anchor", "place", "first", "bytes")
        stretches = cut(crowd.mapInArrow(_parted(length, gram, width), _STRETCHES), small=True)


def _spans(found: list[dict] | None, copies: int, size: int, length: int) -> list[tuple[int, int]]:
    """The maximal byte runs covered by repeated windows."""
    if size < length:
        return []
    if copies > 1:
        return [(0, size)]
    out: list[list[int]] = []
    for first, last in sorted((x["first"], x["last"]) for x in found or ()):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, length: int = LENGTH, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with found and copies, from which ``_spans`` tells the bytes covered by repeated windows.

    Null texts are empty; rows of equal text are copies of one another; a column of ``docs`` named found or copies must be
    renamed first (``remove_repeats`` does so). An empty table gives an empty one.
    """
    texts = cut(unique_texts(docs, text_col))
    runs = repeated_windows(texts.filter("length(text) > 0").select("tid", "text"), length, **options)
    found = runs.groupBy("tid").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    marked = texts.select("tid", "copies").join(found, "tid", "left").filter("copies > 1 OR found IS NOT NULL")
    # where all of a text goes, copies say so; its windows' ranges are not needed
    marked = marked.select(F.col("tid").alias("marked"), F.when(F.col("copies") == 1, F.col("found")).alias("found"), "copies")
    key = chosen_name(docs, "text_key")
    keyed = docs.withColumn(key, text_id(F.col(text_col)))
    return keyed.join(marked, F.col(key) == F.col("marked"), "left").drop(key, "marked").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the bytes covered by a string of ``length`` bytes that starts anywhere else too.

    All copies of a repeated string go, the first one as well; a document of which nothing is left is dropped, one that was
    empty before stays. Where a cut parts a character, its remaining bytes go as well. A null text stays null. Other
    columns pass through, also those named found or copies. An empty table gives an empty one.
    """
    names = docs.columns
    plain_names = [f"c{i}" for i in range(len(names))]
    plain = docs.toDF(*plain_names)
    k = names.index(text_col)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in B.chunks(batch, f"c{k}"):
                texts, keep = part.column(k).to_pylist(), []
                for row, (found, copies) in enumerate(zip(part.column("found").to_pylist(), part.column("copies").to_pylist(), strict=True)):
                    own = data[at[row] : at[row + 1]]
                    spans = _spans(found, copies, len(own), length)
                    if spans:
                        texts[row] = _kept(own.tobytes(), spans).decode(errors="ignore")
                    if texts[row] or not spans:
                        keep.append(row)
                columns = list(part.columns[: len(names)])
                columns[k] = pa.array(texts, columns[k].type)
                yield pa.RecordBatch.from_arrays(columns, names=plain_names).take(pa.array(keep, pa.int64()))

    return repeated_spans(plain, length, f"c{k}", **options).mapInArrow(step, plain.schema).toDF(*names)


_REPORT = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())])


def _digest(length: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in B.chunks(batch, "text"):
                rows = []
                for row, (found, copies) in enumerate(zip(part.column("found").to_pylist(), part.column("copies").to_pylist(), strict=True)):
                    own = data[at[row] : at[row + 1]].tobytes()
                    spans = _spans(found, copies, len(own), length)
                    rows.append((len(own), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(own, spans)).hexdigest()))
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=_REPORT.names)

    return step


def removal_report(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document (columns doc_id, text).

    Null texts have no bytes; each of several equal rows is repeated whole, if it has ``length`` bytes; other columns don't
    count; an empty table gives an empty one.
    """
    return repeated_spans(docs.select("doc_id", "text"), length, **options).mapInArrow(_digest(length), _REPORT)


#: The report's rows by the digests of all windows; for small tables.
ORACLE_SQL = f"""
WITH d AS (SELECT *, octet_length(b) AS n FROM (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents)),
w AS (SELECT rid, i, md5(array_slice(b, i, i + {LENGTH - 1})) AS h FROM (SELECT rid, b, unnest(range(1, n - {LENGTH} + 2)) AS i FROM d WHERE n >= {LENGTH})),
t AS (SELECT rid, i FROM w JOIN (SELECT h FROM w GROUP BY 1 HAVING count(*) > 1) USING (h)),
g AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) > {LENGTH} THEN 1 ELSE 0 END AS fresh FROM t)),
r AS (SELECT rid, min(i) AS a, max(i) + {LENGTH} AS z FROM g GROUP BY rid, k),
p AS (SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 1) AS x, a - 1 AS y FROM r UNION ALL SELECT r.rid, max(z), any_value(n) FROM r JOIN d ON d.rid = r.rid GROUP BY 1),
k AS (SELECT rid, string_agg(hex(array_slice(b, x, y)), '' ORDER BY x) AS kept FROM p JOIN d USING (rid) WHERE y >= x GROUP BY 1),
c AS (SELECT rid, CAST(sum(z - a) AS BIGINT) AS removed, count(*) AS spans FROM r GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, CASE WHEN spans IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(kept, ''))) END AS kept_sha256
FROM d LEFT JOIN c USING (rid) LEFT JOIN k USING (rid)"""
