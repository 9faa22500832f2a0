"""Toxicity: class-conditional Kneser-Ney word models with shared backoff counts, compared by length-normalised likelihood."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionquarry.llm import bytesops as B
from ionquarry.llm.common import chosen_name, cut, held_out

#: Taken off every count and given to the shared counts: what a class has seen up to so many times says nothing by itself.
DISCOUNT = 4.0
#: log2 of the classes that preceding words fall into by hash; their totals are held in every task.
CONTEXT_BITS = 18
#: Bigrams in one broadcast block; a larger model is scored in further blocks, one scan step each.
BLOCK_ROWS = 2_000_000
#: Labelled texts on which the final weights of the likelihoods are fitted.
FIT_ROWS = 20_000
#: Labels up to so many rows (about 16 bytes each) are broadcast, more are joined by a shuffle.
BROADCAST_LABELS = 4_000_000
CLEAN, TOXIC = 0, 1
_COUNTS = "word long, context int, clean long, toxic long"
_PARTS = T.StructType([T.StructField("kn_words", T.LongType()), T.StructField("kn_sum", T.DoubleType()), T.StructField("kn_max", T.DoubleType())])


def bigrams(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word (A-Z lowered): its hash, its context (the class of the word before; 0 at a text's start) and its text."""
    words, _, _, firsts = B.word_hashes(data, at, B.ALNUM)
    context = np.zeros(len(words), np.int64)
    context[1:] = 1 + (B.mix(words[:-1].copy()) >> np.uint64(64 - bits)).astype(np.int64)
    context[firsts[:-1][firsts[:-1] < len(words)]] = 0
    return words, context, np.repeat(np.arange(len(at) - 1), np.diff(firsts))


def _count(bits: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in B.chunks(batch, "text"):
                words, context, owner = bigrams(data, at, bits)
                # what one text says again and again counts once
                order = np.lexsort((owner, context, words))
                words, context, owner = words[order], context[order], owner[order]
                once = np.r_[len(words) > 0, (words[1:] != words[:-1]) | (context[1:] != context[:-1]) | (owner[1:] != owner[:-1])][: len(words)]
                words, context, toxic = words[once], context[once], part.column("toxic").to_numpy()[owner[once]].astype(np.int64)
                start = np.flatnonzero(np.r_[len(words) > 0, (words[1:] != words[:-1]) | (context[1:] != context[:-1])][: len(words)])
                size = np.diff(np.r_[start, len(words)])
                bad = np.add.reduceat(toxic, start) if len(start) else toxic
                columns = [pa.array(words[start].view(np.int64)), pa.array(context[start].astype(np.int32)), pa.array(size - bad), pa.array(bad)]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "context", "clean", "toxic"])

    return step


class Block:
    """The bigrams of some of the words that the discount leaves, those words' continuation counts, and all contexts' totals."""

    def __init__(self, bigrams: pa.Table, follows: pa.Table, contexts: np.ndarray, types: np.ndarray, spare: np.ndarray, k: int, blocks: int, bits: int):
        self.keys, self.counts = self.table(bigrams, self.key(bigrams.column("word").to_numpy().view(np.uint64), bigrams.column("context").to_numpy().astype(np.int64)))
        self.words, self.follows = self.table(follows, follows.column("word").to_numpy().view(np.uint64))
        self.contexts, self.types, self.spare, self.k, self.blocks, self.bits = contexts, types, spare, k, blocks, bits

    @staticmethod
    def table(rows: pa.Table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        return keys[order], np.stack([rows.column(c).to_numpy() for c in ("clean", "toxic")], 1).astype(np.float32)[order]

    @staticmethod
    def key(word: np.ndarray, context: np.ndarray) -> np.ndarray:
        return B.mix(word * np.uint64(31) + context.astype(np.uint64))

    def ratios(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log p(word | toxic) - log p(word | clean) of the block's words, and the text of each."""
        word, context, owner = bigrams(data, at, self.bits)
        mine = word % np.uint64(self.blocks) == self.k
        word, context, owner = word[mine], context[mine], owner[mine]
        held = _looked_up(self.keys, self.counts, self.key(word, context))
        follows = _looked_up(self.words, self.follows, word)
        shared = (follows.sum(1) + 0.5) / (self.types.sum() + 1.0)
        log = []
        for c in (CLEAN, TOXIC):
            total, spare = self.contexts[context, 2 * c], self.contexts[context, 2 * c + 1]
            kinds = max(self.types[c], 1)
            lower = np.maximum(follows[:, c] - DISCOUNT, 0) / kinds + max(self.spare[c], 1) / kinds * shared
            upper = (np.maximum(held[:, c] - DISCOUNT, 0) + spare * lower) / np.maximum(total, 1)
            log.append(np.log(np.where(total > 0, upper, lower)))
        return log[TOXIC] - log[CLEAN], owner


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros((len(wanted), 2))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], 0).astype(np.float64)


def train(labelled: DataFrame, bits: int = CONTEXT_BITS, block_rows: int = BLOCK_ROWS) -> list:
    """Functions that load the model's blocks, from ``labelled`` (text, toxic 0 or 1); nulls are left out.

    All bigrams of all rows count, in a written table that grows with the input. Each block is read when it is scored.
    """
    rows = labelled.filter("text IS NOT NULL AND toxic IS NOT NULL").select("text", "toxic")
    counts = cut(rows.mapInArrow(_count(bits), _COUNTS).groupBy("word", "context").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    both = ("clean", "toxic")
    per = counts.groupBy("context").agg(*[f for c in both for f in (F.sum(c).alias(c), F.sum(F.least(F.col(c), F.lit(DISCOUNT))).alias(f"{c}_spare"))]).toArrow()
    contexts = np.zeros(((1 << bits) + 1, 4), np.float32)
    contexts[per.column("context").to_numpy()] = np.stack([per.column(c).to_numpy() for c in ("clean", "clean_spare", "toxic", "toxic_spare")], 1)
    follows = cut(counts.groupBy("word").agg(*[F.count_if(F.col(c) > 0).alias(c) for c in both]))
    sums = follows.agg(*[F.sum(c) for c in both], *[F.sum(F.least(F.col(c), F.lit(DISCOUNT))) for c in both]).first()
    types, spare = np.array([float(x or 0) for x in sums]).reshape(2, 2)
    # the discount leaves nothing of rarer bigrams but what the contexts' totals hold
    strong = cut(counts.filter(F.greatest(*both) > DISCOUNT))
    blocks = max(1, -(-(strong.count() + follows.count()) // block_rows))
    part = F.pmod(F.conv(F.hex("word"), 16, 10).cast("decimal(20,0)"), F.lit(blocks))

    def load(k: int):
        own = [t if blocks == 1 else t.filter(part == k) for t in (strong, follows)]
        return Block(*[t.toArrow() for t in own], contexts, types, spare, k, blocks, bits)

    return [lambda k=k: load(k) for k in range(blocks)]


def _score(block: Block, text_col: str, first: bool):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in B.chunks(batch, text_col):
                ratio, owner = block.ratios(data, at)
                n = part.num_rows
                added = [np.bincount(owner, minlength=n), np.bincount(owner, ratio, n), np.full(n, -np.inf)]
                np.maximum.at(added[2], owner, ratio)
                kept = part.columns if first else part.columns[:-3]
                if not first:
                    before = [c.to_numpy() for c in part.columns[-3:]]
                    added = [added[0] + before[0], added[1] + before[1], np.maximum(added[2], before[2])]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(x.astype(t)) for x, t in zip(added, (np.int64, float, float), strict=True)]], names=[*part.schema.names[: len(kept)], *_PARTS.names])

    return step


def likelihoods(docs: DataFrame, model: list, text_col: str = "text") -> DataFrame:
    """``docs`` with kn_words, and the sum and the largest of the words' log-likelihood ratios (toxic to ordinary).

    Each scan adds one block's words; its result is written before the next block is loaded, so the driver holds one block.
    Null and wordless texts have 0 words, the sum 0 and no largest ratio (-infinity); an empty table gives an empty one.
    """
    out = docs.drop(*[c for c in docs.columns if c.lower() in _PARTS.names])
    schema = T.StructType([*out.schema.fields, *_PARTS.fields])
    for k, load in enumerate(model):
        out = out.mapInArrow(_score(load(), text_col, k == 0), schema)
        out = cut(out) if k < len(model) - 1 else out
    return out


def evidence(n: np.ndarray, total: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Per text: 1, the ratio for each word, the ratio over the root of the length, the strongest word's ratio, the length's log."""
    size = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), total / size, np.clip(total / np.sqrt(size), -20, 20), np.where(n > 0, np.clip(most, -10, 10), 0.0), np.log(size)], 1)


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps with a small penalty."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = 0.0 if not len(y) else 6.0 * (2 * y[0] - 1)
        return w
    penalty = np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step / max(1.0, np.abs(step).max() / 4)
    return w


class Classifier:
    def __init__(self, model: list, weights: np.ndarray):
        self.model, self.weights = model, weights


def train_classifier(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **options) -> Classifier:
    """A classifier of ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic).

    Five sixths of the labelled documents, by a hash of the id, give the two models. Of the rest, at most about
    ``fit_rows``, by the hash's order, give the weights of the likelihoods: of texts that the models don't know by heart.
    Several labels of a document count as toxic if one does; null ids, texts and labels are left out.
    """
    marks = cut(labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_LABELS else marks
    turn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(6000))
    labelled = cut(docs.filter("text IS NOT NULL").select("doc_id", "text").join(marks, "doc_id").select("text", "toxic", turn.alias("turn")))
    model = train(labelled.filter("turn >= 1000"), **options)
    rest = labelled.filter("turn < 1000")
    share = min(1.0, fit_rows / max(1, rest.count()))
    found = likelihoods(rest.filter(F.col("turn") < int(np.ceil(1000 * share))), model).select("toxic", *_PARTS.names).toArrow()
    n, total, most = (found.column(c).to_numpy() for c in _PARTS.names)
    return Classifier(model, fit(evidence(n, total, most), found.column("toxic").to_numpy().astype(float)))


def classify(docs: DataFrame, classifier: Classifier, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with the score (0 to 1, higher: likelier toxic) of each whole text, in ``score_col``.

    Null texts, empty ones and those without a word have no evidence and get the score of none. Equal texts get equal
    scores. A column of ``docs`` named like the score is replaced.
    """
    names = [c for c in docs.columns if c.lower() != score_col.lower()]
    if clash := [c for c in names if c.lower() in _PARTS.names]:
        free = {c: chosen_name(docs, f"own_{c}") for c in clash}
        return classify(docs.withColumnsRenamed(free), classifier, text_col, score_col).withColumnsRenamed({v: k for k, v in free.items()})
    size, w = F.greatest("kn_words", F.lit(1)), [float(x) for x in classifier.weights]
    clip = lambda c, m: F.greatest(F.lit(-m), F.least(F.lit(m), c))
    top = F.when(F.col("kn_words") > 0, clip(F.col("kn_max"), 10.0)).otherwise(0.0)
    odds = w[0] + w[1] * F.col("kn_sum") / size + w[2] * clip(F.col("kn_sum") / F.sqrt(size), 20.0) + w[3] * top + w[4] * F.log(size)
    found = likelihoods(docs.select(*names), classifier.model, text_col)
    return found.select(*names, (1 / (1 + F.exp(-clip(odds, 30.0)))).alias(score_col))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from the labels of the rows that aren't held out.

    Null, empty and wordless texts get the score of no evidence; repeated rows get equal scores; without usable labels all
    scores are 0.5; an empty table gives an empty one.
    """
    out = held_out(F.col("doc_id"))
    classifier = train_classifier(docs.filter(~out), labels)
    found = classify(docs.select("doc_id", out.alias("held_out"), "text"), classifier, score_col="score")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
