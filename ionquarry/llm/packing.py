"""Best-fit packing of tokenised documents into sequences: local rounds, and a tree of further ones over what stays underfull."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionquarry.llm.bytesops import LOWER, NONSPACE, _parts, chunks
from ionquarry.llm.bytesops import mix as mixed
from ionquarry.llm.common import cut

#: Tokens of a sequence; the id that ends a document.
CAPACITY, END = 2048, 0
#: Pieces that one task packs, groups that meet in one task of a further round, underfull sequences that each sends on.
BUCKET, FAN, CARRIED = 20_000, 16, 64
#: A sequence with less room than this share of it is nearly full.
NEARLY = 1 / 64
#: Words whose ids a worker remembers, their longest, and bytes of a text that are split into words at a time.
REMEMBERED, LONGEST, BYTES = 600_000, 64, 1 << 20
#: Lower-case ASCII and Latin-1 letters, which no normalisation changes; ASCII letters; other ASCII characters that end a run
#: of letters (an apostrophe may not); second bytes of Latin-1 capitals in UTF-8, 32 below their small forms.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_LETTER, _SIGN, _UPPER = (np.zeros(256, bool) for _ in range(3))
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN[33:39] = _SIGN[40:65] = _SIGN[91:97] = _SIGN[123:127] = True
_UPPER[0x80:0x97] = _UPPER[0x98:0x9F] = True
#: U+0307.
_DOT = b"\xcc\x87"
_PIECES = "key long, deal long, doc_id {}, piece int, start long, length long, ids_crc32 long, ids binary"


def default_tokenizer() -> str:
    """The vocabulary file of the production query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """A tokenizer's ids of whole texts, word by word.

    The tokenizer must lower-case, drop white space, and part runs of letters from other characters before its merges, so
    that a text's ids are those of its words one after another. Each word is encoded once and remembered. Words of
    letters that stay as they are when normalised go through the merges together, without the rest of the tokenizer.
    """

    def __init__(self, path: str) -> None:
        import os

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.whole, self.known = Tokenizer.from_file(path), {}
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _learn(self, new: list[bytes]) -> None:
        plain = [w for w in new if _PLAIN.fullmatch(w)]
        ids = np.array(self.bare.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids if plain else [], "<u4")
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) == len(plain):  # one end of a word for each
            held = ids.tobytes()
            self.known |= {w: held[a:b] for w, a, b in zip(plain, [0, *ends][:-1], ends, strict=True)}
        other = [w for w in new if w not in self.known]
        for w, x in zip(other, self.whole.encode_batch_fast([w.decode("utf-8", "replace") for w in other], add_special_tokens=False), strict=True):
            self.known[w] = np.array(x.ids, "<u4").tobytes()

    def ids(self, data: np.ndarray, at: np.ndarray) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text between the offsets, without special tokens; long texts by blocks."""
        if len(data) > 2 * BYTES:
            for a, b in zip(at[:-1], at[1:], strict=True):
                bounds = _parts(data[a:b], NONSPACE, BYTES) if b - a > 2 * BYTES else [0, b - a]
                yield b"".join(x for c, d in zip(bounds[:-1], bounds[1:], strict=True) for x in self._ids(data[a + c : a + d], np.array([0, d - c])))
        else:
            yield from self._ids(data, at)

    def _ids(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        if _DOT not in data.tobytes():  # which makes another letter of a capital I than of a small one
            data = LOWER[data]
            data[np.flatnonzero((data[:-1] == 0xC3) & _UPPER[data[1:]]) + 1] += 32
        letter, sign = _LETTER[data], _SIGN[data]
        parts = np.flatnonzero((letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])) + 1
        whole = np.insert(data, parts, 32).tobytes()
        at = (at + np.searchsorted(parts, at)).tolist()
        words = [whole[a:b].split() for a, b in zip(at[:-1], at[1:], strict=True)]
        own = {w: self.known.get(w) for w in set().union(*words)}  # a small table, which stays in the processor's cache
        if new := [w for w, ids in own.items() if ids is None]:
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
            self._learn(new)
            own |= {w: self.known[w] for w in new}
        out = [b"".join(map(own.__getitem__, x)) for x in words]
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        return out


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    """One for each worker, kept between tasks."""
    return Words(path)


def _tokenised(path: str, capacity: int, end: int, with_ids: bool, doc_type: pa.DataType):
    fields = pa.schema([("key", pa.int64()), ("deal", pa.int64()), ("doc_id", doc_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, last = words_of(path), np.array([end], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, data, at in chunks(batch, "text"):
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, found in enumerate(words.ids(data, at)):
                    own = memoryview(found + last)
                    for a in range(0, len(own), 4 * capacity):
                        held = own[a : a + 4 * capacity]
                        rows.append(i)
                        piece.append(a // (4 * capacity))
                        start.append(a // 4)
                        length.append(len(held) // 4)
                        crc.append(zlib.crc32(held))
                        ids.append(bytes(held) if with_ids else None)
                keys = np.arange(number, number + len(rows))
                number += len(rows)
                deal = (mixed(keys.astype(np.uint64)) >> np.uint64(33)).astype(np.int64)
                doc = part.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(deal), doc, *[pa.array(x, f.type) for x, f in zip((piece, start, length, crc, ids), list(fields)[3:], strict=True)]], schema=fields)

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The written pieces of the documents: key (unique), deal (random), doc_id, piece, start, length, ids_crc32, and ids if asked.

    A document's ids end with ``end``; a longer one than ``capacity`` is cut into pieces of that, the last may be shorter.
    For the tokenizer see ``Words``. A null or empty text is the end alone; rows that repeat are
    documents of their own; ids may be null; an empty table gives no pieces. Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = read.schema["doc_id"].dataType
    return cut(read.mapInArrow(_tokenised(tokenizer, capacity, end, with_ids, to_arrow_type(kind)), _PIECES.format(kind.simpleString())))


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """The bin of each item, and the number of bins: large items first, each where it leaves the least room.

    Bins are kept by the room they have; a number with one bit for each room that some bin has finds the least that fits.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins, out = 0, 0, [0] * len(sizes)
    for i in np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist():
        size = sizes[i]
        if fits := rooms >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room, bins = bins, capacity, bins + 1
        out[i] = b
        if left := room - size:
            by_room[left].append(b)
            rooms |= 1 << left
    return out, bins


_PLACED = "key long, bucket long, bin long, at long, length long, open boolean"


def _round(capacity: int, carried: int, nearly: float, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bin", "at"], ignore_index=True)
        items, of = np.unique(pdf["bin"].to_numpy(), return_inverse=True)
        sizes = np.bincount(of, pdf["length"].to_numpy()).astype(np.int64)
        bins, count = best_fit(sizes.tolist(), capacity)
        bins = np.asarray(bins, np.int64)
        order = np.lexsort((np.arange(len(items)), -sizes, bins))
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))  # of each bin, in order
        ends = np.cumsum(sizes[order])
        base = np.empty(len(items), np.int64)
        base[order] = ends - sizes[order] - np.repeat((ends - sizes[order])[first], np.diff(np.append(first, len(items))))
        room = capacity - np.bincount(bins, sizes, count).astype(np.int64)
        emptiest = np.argsort(-room, kind="stable")[:carried]
        stays = np.zeros(count, bool)
        if not last:
            stays[emptiest] = room[emptiest] > capacity * nearly
        return pdf.assign(bin=items[order][first][bins][of], at=pdf["at"].to_numpy() + base[of], open=stays[bins][of])

    return run


def placed(pieces: DataFrame, capacity: int = CAPACITY, bucket: int = BUCKET, fan: int = FAN, carried: int = CARRIED, nearly: float = NEARLY) -> DataFrame:
    """key, sequence_id (the key of one of its pieces), offset of each row of ``pieces`` (key, deal, length).

    Whole sequences are left out of the packing. The other pieces are dealt at random to buckets of about ``bucket``; each
    is packed by itself, and its sequences with the most room, ``carried`` at most, meet those of ``fan`` - 1 other groups as
    items of the next round, until one group is left; all others are settled. After a round at most one sequence of a group
    is less than half full, and only those can still be put into another's room; so what a group holds back loses at most
    a few sequences of the whole, while no group grows with the table. Ties go by the order of keys.
    """
    whole = pieces.filter(F.col("length") >= capacity).select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity).select("key", "deal", "length")
    buckets = max(1, -(-rest.count() // bucket))
    todo = rest.select("key", F.shiftright(F.col("deal") * F.lit(buckets), 31).alias("bucket"), F.col("key").alias("bin"), F.lit(0).cast("long").alias("at"), "length", F.lit(True).alias("open"))
    done = [whole]
    while True:
        level = cut(todo.groupBy("bucket").applyInPandas(_round(capacity, carried, nearly, buckets == 1), _PLACED), small=True)
        done.append(level.filter("NOT open").select("key", F.col("bin").alias("sequence_id"), F.col("at").alias("offset")))
        if buckets == 1:
            return reduce(DataFrame.unionByName, done)
        buckets = -(-buckets // fan)
        todo = level.filter("open").withColumn("bucket", F.floor(F.col("bucket") / fan))


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """sequence_id, length, parts (offset, doc_id, piece, start, length; by offset) and ids (32-bit, little-endian) of each sequence."""
    held = pieces(docs, tokenizer, capacity, end, id_col, text_col, with_ids=True)
    rows = held.join(placed(held, capacity, **options), "key")
    by_offset = F.array_sort(F.collect_list(F.struct("offset", "piece", "start", "length", "key", "doc_id", "ids")))  # a sequence at most
    return rows.groupBy("sequence_id").agg(F.sum("length").alias("length"), by_offset.alias("parts")).select(
        "sequence_id", "length", F.transform("parts", lambda x: F.struct(x.offset, x.doc_id, x.piece, x.start, x.length)).alias("parts"), F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x.ids)).alias("ids")
    )


def packing_report(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of the documents; see ``pieces`` and ``placed``."""
    held = pieces(docs, default_tokenizer())
    return held.join(placed(held), "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
