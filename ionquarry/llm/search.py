"""Ranked lexical search: shards of compressed postings sorted by document, merged document at a time.

``build_index`` writes one row for each shard and term (its postings) and one for each shard (its documents). A shard is what
one task read of the table, up to a fixed size, so building it moves no text. ``search`` ranks items in blocks: each pair of a
shard and a block is one group, which merges the postings of each item by a heap of cursors, keeps the best in a bounded
heap, and sends on no more than those.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionquarry.llm.bytesops import ALNUM, CHUNK, LOWER, chunks, word_hashes
from ionquarry.llm.common import ascii_lower, cut

#: The terms of a text; as bytes, they are the runs of ``ALNUM``.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text and documents at which a shard is full; the last chunk of texts may go beyond.
SHARD_BYTES, SHARD_DOCS = 1 << 24, 100_000
#: Items that are ranked together; items and terms that are broadcast at most.
BLOCK, BROADCAST_ROWS = 500, 1_000_000
#: Documents returned for each item.
K = 10
_INDEX = "shard long, term string, df long, postings binary, ids array<long>, lengths array<long>"
_FIELDS = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("postings", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low ones first, of numbers from 0; and where each number starts (n + 1)."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        if not (longer := values >> bits > 0).any():
            break
        size += longer
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        out[at[own] + k] = (values[own] >> 7 * k & 127) | (size[own] > k + 1) << 7
    return out, at


def decode(data: np.ndarray) -> np.ndarray:
    """The numbers of ``encode``."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)[: len(ends)]
    out = (data[starts] & 127).astype(np.int64)
    for k in range(1, int((ends - starts).max(initial=0)) + 1):
        own = np.flatnonzero(ends - starts >= k)
        out[own] |= (data[starts[own] + k] & 127).astype(np.int64) << 7 * k
    return out


class _Shard:
    """Documents with at least one term, gathered from chunks of a task's input."""

    def __init__(self) -> None:
        self.bytes, self.ids, self.lengths, self.hashes, self.names = 0, [], [], [], {}

    def add(self, ids: np.ndarray, data: np.ndarray, at: np.ndarray) -> None:
        hashes, starts, ends, firsts = word_hashes(data, at, ALNUM)
        held = np.flatnonzero(np.diff(firsts))
        self.ids += ids[held].tolist()
        self.lengths += np.diff(firsts)[held].tolist()
        self.hashes.append(hashes)
        self.bytes += len(data)
        found, first = np.unique(hashes, return_index=True)
        for h, i in zip(found.tolist(), first.tolist(), strict=True):
            if h not in self.names:
                self.names[h] = LOWER[data[starts[i] : ends[i]]].tobytes().decode("utf-8", "replace")

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0, i))
        ordinal = np.empty(len(order), np.int64)
        ordinal[order] = np.arange(len(order))
        doc = np.repeat(ordinal, self.lengths)
        found, of = np.unique(np.concatenate(self.hashes), return_inverse=True)
        names = [self.names[h] for h in found.tolist()]
        by_name = sorted(range(len(names)), key=names.__getitem__)
        place = np.empty(len(names), np.int64)
        place[by_name] = np.arange(len(names))
        pairs, tf = np.unique(place[of] * len(order) + doc, return_counts=True)
        term, doc = pairs // len(order), pairs % len(order)
        first = np.flatnonzero(np.diff(term, prepend=-1))
        step = np.diff(doc, prepend=0)
        step[first] = doc[first]
        data, at = encode(np.stack([step, tf], 1).ravel())
        bounds = np.append(at[2 * first], len(data)).astype(np.int32)
        df = np.diff(np.append(first, len(term)))
        postings = pa.Array.from_buffers(pa.binary(), len(df), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        none = pa.nulls(len(df), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(df), shard)), pa.array([names[i] for i in by_name]), pa.array(df), postings, none, none], schema=_FIELDS)
        own = [[shard], [None], [len(order)], [None], [[self.ids[i] for i in order]], [[self.lengths[i] for i in order]]]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(own, _FIELDS, strict=True)], schema=_FIELDS)


def _indexed(shard_bytes: int, shard_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            for part, data, at in chunks(batch, "text", min(CHUNK, shard_bytes)):
                shard.add(np.array(part.column(0).to_pylist(), object), data, at)
                if shard.bytes >= shard_bytes or len(shard.ids) >= shard_docs:
                    if shard.ids:
                        yield from shard.rows(number)
                    number, shard = number + 1, _Shard()
        if shard.ids:
            yield from shard.rows(number)

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The written index of ``docs`` (integer ids): shard, term, df, postings, ids, lengths.

    A row with a term holds its postings in the shard: for each document that has it, by rising id, the step from the one
    before and the term's occurrences, as numbers of seven bits a byte. A row without a term describes the shard's documents:
    their ids in order, null last, and numbers of terms; df is their count. Terms are told apart by 64-bit hashes within a
    shard, and stored as text. Documents without a term (null, empty) are left out; rows that repeat are documents of their
    own; an empty table gives an empty index. Other columns are not read.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return cut(read.mapInArrow(_indexed(shard_bytes, shard_docs), _INDEX))


def merge(lists: list[tuple[list[int], list[int], int]], k: int, least: int = 0) -> list[tuple[int, int]]:
    """The k best (score, document) with a score above ``least``, best first, equal scores by rising document.

    lists: for each term its documents, rising, their scores for it, and the largest of those. A heap of the lists' heads
    yields one document after another. Once k documents are held, lists whose largest scores together don't exceed the
    worst of them are not merged any more but looked up, and only for documents that can still get above it; a later
    document with the same score never displaces an earlier one, so nothing is lost.
    """
    lists = sorted((x for x in lists if x[0]), key=lambda x: x[2])
    n = len(lists)
    docs, scores, bound = [x[0] for x in lists], [x[1] for x in lists], np.cumsum([0, *(x[2] for x in lists)]).tolist()
    at, first, held = [0] * n, 0, []
    while first < n and bound[first + 1] <= least:
        first += 1
    heads = [docs[i][0] * n + i for i in range(first, n)]
    heapify(heads)
    while heads:
        doc, score = heads[0] // n, 0
        end = doc * n + n
        while heads and heads[0] < end:
            i = heads[0] % n
            p = at[i]
            score += scores[i][p]
            at[i] = p = p + 1
            if p < len(docs[i]):
                heapreplace(heads, docs[i][p] * n + i)
            else:
                heappop(heads)
        for i in range(first - 1, -1, -1):
            if score + bound[i + 1] <= least:
                break
            p = at[i] = bisect_left(docs[i], doc, at[i])
            if p < len(docs[i]) and docs[i][p] == doc:
                score += scores[i][p]
        if score <= least:
            continue
        heappush(held, (score, -doc)) if len(held) < k else heapreplace(held, (score, -doc))
        if len(held) == k and held[0][0] > least:
            least, before = held[0][0], first
            while first < n and bound[first + 1] <= least:
                first += 1
            if first > before:
                heads = [x for x in heads if x % n >= first]
                heapify(heads)
    return [(score, -doc) for score, doc in sorted(held, reverse=True)]


def _ranked(documents: int, words: int, k: int):
    def run(hits: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int | None]] = []
        if len(hits):
            ids, m = own["ids"].iloc[0], 10 + 90 * np.asarray(own["lengths"].iloc[0], np.int64) * documents // words
            of: dict[int, list] = {}
            for weight, items, postings in zip(hits["weight"], hits["items"], hits["postings"], strict=True):
                numbers = decode(np.frombuffer(postings, np.uint8))
                doc, tf = np.cumsum(numbers[::2]), numbers[1::2]
                score = weight * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                # the k-th best score for one term is one that the k-th best document reaches
                sure = int(np.partition(score, -k)[-k]) - 1 if len(score) >= k else 0
                entry = (doc.tolist(), score.tolist(), int(score.max()), sure)
                for q in items:
                    of.setdefault(int(q), []).append(entry)
            for q, lists in of.items():
                best = merge([x[:3] for x in lists], k, max(0, *(x[3] for x in lists)))
                out += [(q, score, ids[doc]) for score, doc in best]
        found = pd.DataFrame(out, columns=["q", "score", "doc_id"])
        return found.assign(doc_id=found["doc_id"].astype("Int64"))

    return run


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)))


def search(index: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k best documents of ``index`` for each item: the item's id (as in ``items``), rank (from 1), doc_id, score.

    A term weighs floor(1000 ln((2N + 2) / (2 df + 1))); a document's score for it is that times
    10^9 tf div (1000 tf + 8 m), with m = 10 + 90 n N div L; only scores above 0 count, equal ones go by rising doc_id (null
    last). Items without terms (null, empty) have no rows; items equal in id and text are one, those equal in id alone are
    ranked each on its own; an empty table of items or an empty index gives no rows. Other columns are not read.
    """
    session = index.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    asked = cut(asked.withColumn("q", F.monotonically_increasing_id()), small=True)
    shards = index.filter("term IS NULL")
    documents, words = shards.agg(F.sum("df"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    blocks = max(1, -(-asked.count() // block))
    wanted = asked.select("q", F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block"), F.explode(terms(F.col("text"))).alias("term"))
    wanted = cut(wanted.groupBy("term", "block").agg(F.collect_list("q").alias("items")), small=True)
    number, held = wanted.agg(F.count(F.lit(1)), F.sum(F.size("items"))).first()
    few = (lambda df: F.broadcast(df)) if number + (held or 0) <= BROADCAST_ROWS else (lambda df: df)
    postings = index.filter("term IS NOT NULL")
    df = postings.select("term", "df").join(few(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * F.lit(documents or 0) + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighed = cut(wanted.join(df, "term").select("term", "block", "items", weight.alias("weight")).filter("weight > 0"), small=True)
    hits = postings.select("shard", "term", "postings").join(few(weighed), "term").select("shard", "block", "weight", "items", "postings")
    own = shards.select(F.col("shard").alias("of"), "ids", "lengths", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("asked"))
    best = hits.groupBy("shard", "block").cogroup(own.groupBy("of", "asked")).applyInPandas(_ranked(documents or 0, words or 1, k), "q long, score long, doc_id long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)  # each task sends on k rows of an item at most
    names = asked.select("q", "item_id")
    return top.join(few(names), "q").select(F.col("item_id").alias(item_col), "rank", "doc_id", "score")


def search_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the 10 best documents for each item; see ``build_index`` and ``search``."""
    return search(build_index(docs), items)


#: ``N``, ``L`` and the divisions as in the docstring of ``search``.
ORACLE_SQL = rf"""
WITH words AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS w FROM documents),
docs AS (SELECT doc, doc_id, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nl FROM docs),
items AS (SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT DISTINCT q, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM items),
tf AS (SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, nd),
scored AS (SELECT q, doc, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nl))))::BIGINT AS score FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN docs USING (doc), total GROUP BY q, doc),
ranked AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored JOIN docs USING (doc) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN items USING (q) WHERE rank <= {K}
"""
