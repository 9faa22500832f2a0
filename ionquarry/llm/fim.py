"""Fill-in-middle: texts cut at two random unit bounds and put together again with the middle last."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField

from ionquarry.llm.bytesops import chunks
from ionquarry.llm.common import chosen_name

#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Percent of the other texts that stay plain, and of the rest that go suffix first; start of the drawn text.
PLAIN, SUFFIX_FIRST, SEED = 10, 20, "1:"
#: Code points that are held as numbers at a time.
BLOCK = 1 << 20


def unit_starts(codes: np.ndarray, inside: bool = False) -> np.ndarray:
    """Where units begin: runs of A-Z and a-z, and every other code point. inside: a letter stands before the first one."""
    letter = (codes | 32) - np.uint32(97) < 26
    before = np.concatenate([[inside], letter[:-1]])
    return np.flatnonzero(~(letter & before))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Units:
    """The units of a text, found block by block; no more than one block's bounds are held."""

    def __init__(self, text: str, block: int = 0) -> None:
        self.text, self.block = text, block or BLOCK
        self.counts = np.cumsum([0, *(len(self._starts(a)) for a in range(0, len(text), self.block))])
        self.n = int(self.counts[-1])

    def _starts(self, a: int) -> np.ndarray:
        before = _codes(self.text[max(0, a - 1) : a + self.block])
        starts = unit_starts(before) if a == 0 else unit_starts(before)[unit_starts(before) > 0] - 1
        return starts + a

    def end(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        if rank >= self.n:
            return len(self.text)
        k = int(np.searchsorted(self.counts, rank, "right")) - 1
        return int(self._starts(k * self.block)[rank - self.counts[k]])


def draws(seed: str, key: object) -> tuple[int, ...]:
    """Four numbers below 2^32 from the sha256 of the seed followed by the key; a null key is empty."""
    digest = hashlib.sha256(f"{seed}{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def transform(text: str, drawn: tuple[int, ...], sentinels: tuple[str, str, str] = SENTINELS, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), output."""
    units = Units(text)
    if not text or any(s in text for s in sentinels) or drawn[2] % 100 >= 100 - plain:
        return units.n, "plain", None, None, text
    first, second = sorted(d % (units.n + 1) for d in drawn[:2])
    a, b = units.end(first), units.end(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = sentinels
    if drawn[3] % 100 < suffix_first:
        return units.n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return units.n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, sentinels: tuple[str, str, str] = SENTINELS, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output, the text to train on.

    A unit is a run of A-Z and a-z or any other code point. Both cuts fall on unit bounds drawn from the row's id, so equal
    ids with equal texts give equal outputs, in any order and on every run; parts may be empty. A null text counts as empty
    and its output is empty; empty texts and those that hold a sentinel stay plain, so each output can be undone
    (``restored``). Texts are cut whole, a block of code points at a time. A null id draws as the empty text. An empty table
    gives an empty one. Columns of ``docs`` with an added name are replaced.
    """
    added = [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]
    names = {f.name for f in added}
    # read under names of their own: the id and the text may themselves bear an added name
    key, body = chosen_name(docs, "fim_key"), chosen_name(docs, "fim_text")
    own = [c for c in docs.columns if c.lower() not in names]
    read = docs.select(*[F.col(f"`{c}`") for c in own], F.col(id_col).cast("string").alias(key), F.col(text_col).alias(body))
    schema = read.select(*[f"`{c}`" for c in own]).schema
    for field in added:
        schema = schema.add(field)
    fields = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in chunks(batch, body):
                keys, texts = (part.column(part.schema.get_field_index(c)).to_pylist() for c in (key, body))
                done = [transform(t or "", draws(seed, k), sentinels, plain, suffix_first) for k, t in zip(keys, texts, strict=True)]
                new = [pa.array(x, kind) for x, kind in zip(zip(*done, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *new], names=[*own, *(f.name for f in added)])

    return read.mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made of; null gives null."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def fim_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the sha256 of the output and of the text restored from it; see ``fill_in_middle``."""
    made = fill_in_middle(docs.select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
numbers AS (SELECT *, len(u)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM drawn),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts),
made AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END AS output FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM made
"""
