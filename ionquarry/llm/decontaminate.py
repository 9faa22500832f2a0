"""Benchmark decontamination: a broadcast hash set of normalised word n-grams, verified hits, spans or documents removed."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionquarry.llm import bytesops as B
from ionquarry.llm.common import ASCII_LOWER, ASCII_UPPER, cut

#: Bytes of item text in one broadcast set. More items are searched for in further sets, one scan step each.
BLOCK_BYTES = 4 << 20
_FILTER_BITS = 20

ADDED = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", T.ArrayType(T.LongType())),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
])


class Grams:
    """The windows of some items: sorted hashes, a bit filter in front, and the words behind each hash."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        windows: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            data = np.frombuffer(text.encode(), np.uint8)
            starts, ends, _ = B.words(data, np.array([0, len(data)]), B.ALNUM)
            low = B.LOWER[data].tobytes()
            own = [low[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            size = min(n, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                windows[size][b" ".join(own[i : i + size])].add(item)
        self.by_size = {}
        for size, found in windows.items():
            behind: dict[int, list[tuple[bytes, list[str]]]] = defaultdict(list)
            for window, ids in found.items():
                data = np.frombuffer(window, np.uint8)
                hashes, *_ = B.word_hashes(data, np.array([0, len(data)]), B.ALNUM)
                behind[int(B.gram_hash(hashes, size)[0])].append((window, sorted(ids)))
            keys = np.sort(np.fromiter(behind, np.uint64, len(behind)))
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[keys >> np.uint64(64 - _FILTER_BITS)] = True
            self.by_size[size] = (keys, bits, dict(behind))

    def hits(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
        """Of each text: the number of words, the indices of the words hit, the items found."""
        hashes, starts, ends, firsts = B.word_hashes(data, at, B.ALNUM)
        marks = np.zeros(len(starts) + 1, np.int32)
        items: dict[int, set[str]] = defaultdict(set)
        for size, (keys, bits, behind) in self.by_size.items():
            grams = B.gram_hash(hashes, size)
            maybe = np.flatnonzero(bits[grams >> np.uint64(64 - _FILTER_BITS)])
            maybe = maybe[B.within(firsts, size, len(grams))[maybe]]
            there = np.minimum(np.searchsorted(keys, grams[maybe]), len(keys) - 1)
            maybe = maybe[keys[there] == grams[maybe]]
            docs = np.searchsorted(firsts, maybe, "right") - 1
            for i, doc in zip(maybe.tolist(), docs.tolist(), strict=True):
                window = b" ".join(B.LOWER[data[s:e]].tobytes() for s, e in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist(), strict=True))
                for held, ids in behind[int(grams[i])]:
                    if held == window:
                        marks[i] += 1
                        marks[i + size] -= 1
                        items[doc].update(ids)
        hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        bounds = np.searchsorted(hit, firsts)
        return np.diff(firsts), [hit[a:b] - f for a, b, f in zip(bounds[:-1], bounds[1:], firsts[:-1], strict=True)], [sorted(items.get(d, ())) for d in range(len(at) - 1)]


def _scan(grams: Grams, text_col: str, first: bool):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in B.chunks(batch, text_col):
                n, words, items = grams.hits(data, at)
                kept = part.columns if first else part.columns[: -len(ADDED)]
                if not first:
                    words = [np.union1d(w, o) if o else w for w, o in zip(words, part.column("hit_words").to_pylist(), strict=True)]
                    items = [sorted({*i, *o}) for i, o in zip(items, part.column("hit_items").to_pylist(), strict=True)]
                added = [pa.array(n, pa.int64()), pa.array([w.astype(np.int64) for w in words], pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*kept, *added], names=[*part.schema.names[: len(kept)], *ADDED.names])

    return step


def find_leaks(docs: DataFrame, items: DataFrame, n: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_words (indices of the words inside a window's occurrence) and hit_items (sorted ids as text).

    A window is n consecutive words of an item, or all the words of an item that has fewer. Each hash hit is verified
    against the words. The windows are broadcast in blocks of at most about ``block_bytes`` of item text (one longer item
    makes a block of its own); with more blocks, the scan has more steps, each written before the next, and still no shuffle.

    A null text has no words; an item with null or wordless text gives no window; a null item id counts as the empty id;
    repeated items count once for each id; repeated documents are judged alike. Columns of ``docs`` named like an added
    one are replaced.
    """
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("words")).filter(F.col("words").isNotNull())
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = docs.drop(*[c for c in docs.columns if c.lower() in ADDED.names])
    base = out.schema
    schema = T.StructType([*base.fields, *ADDED.fields])

    def block(df: DataFrame, k: int) -> DataFrame:
        held = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k)
        grams = Grams([(r.item, r.words) for r in held.toLocalIterator()], n)
        found = df.mapInArrow(_scan(grams, text_col, k == 0), schema)
        return found if blocks == 1 else cut(found)  # written before the next block is read, so the driver holds one

    return reduce(block, range(blocks), out)


def _without(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, at in B.chunks(batch, text_col):
            k = part.schema.get_field_index(text_col)
            texts = part.column(k).to_pylist()
            for row, hit in enumerate(part.column("hit_words").to_pylist()):
                if hit:
                    own = data[at[row] : at[row + 1]]
                    starts, ends, _ = B.words(own, np.array([0, len(own)]), B.ALNUM)
                    hit = np.array(hit)
                    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
                    edges = [0, *(int(x) for r in runs for x in (starts[r[0]], ends[r[-1]])), len(own)]
                    texts[row] = b"".join(own[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
            columns = list(part.columns)
            columns[k] = pa.array(texts, part.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "spans", n: int = 10, text_col: str = "text", **names) -> DataFrame:
    """``docs`` without what they share with the items: ``remove`` is "spans" or "documents".

    "spans" cuts each run of hit words out of its text, from the first word's first byte to the last one's last, and
    drops a document of which no word is left; untouched texts stay as they are. "documents" drops each document with a
    hit. Edge cases are as in ``find_leaks``.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove: {remove!r}")
    found = find_leaks(docs, items, n, text_col, **names)
    if remove == "documents":
        return found.filter(F.size("hit_words") == 0).drop(*ADDED.names)
    found = found.filter((F.size("hit_words") == 0) | (F.size("hit_words") < F.col("n_words")))
    return found.mapInArrow(lambda b: _without(b, text_col), found.schema).drop(*ADDED.names)


def leak_report(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The digest of ``find_leaks`` for each document (columns doc_id, text)."""
    found = find_leaks(docs.select("doc_id", "text"), items, n)
    n_hit = F.size("hit_words").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_LISTED = rf"regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The report's rows: windows of items joined with windows of the same number of words of documents.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LISTED} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_LISTED} AS w FROM benchmark),
g AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
h AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM g) ON len(w) >= n)),
f AS (SELECT rid, i, h.n, item FROM h JOIN g ON h.n = g.n AND h.gram = g.gram),
c AS (SELECT rid, count(DISTINCT place) AS hit FROM (SELECT rid, unnest(range(i, i + n)) AS place FROM f) GROUP BY 1),
t AS (SELECT rid, count(*) AS items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, item FROM f) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)"""
