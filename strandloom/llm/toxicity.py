"""Toxicity: averaged subword-bag embeddings under a linear softmax.

A word is a bag of its character n-grams (with a mark at both word ends) and of
itself, hashed into :data:`BUCKETS` buckets; so an unseen misspelling shares
most of its vectors with the word it comes from. A passage, any
:data:`PASSAGE` consecutive words, is the average of its bags' vectors, a linear
softmax turns it into two class probabilities, and a document is as toxic as its
most toxic passage, so a single insult counts the same in a short and in a very
long text.

Vectors and softmax are trained jointly in numpy by stochastic gradient descent
on a bounded sample of labelled rows (:data:`SAMPLE` of each class, the first
in the order of a digest of the id, as long as their texts have
:data:`SAMPLE_BYTES` bytes at most). The driver makes the features of the sample
from whole texts, one at a time. Scoring is one pass with Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import materialise, no_null, table
from strandloom.llm.textbytes import BLOCK_BYTES, blocks, lowered, word_hashes

BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
PASSAGE = 4
DIMENSIONS = 8
#: Epochs on whole documents, then on most toxic passages; step; first scale of the softmax.
WARM_AND_FINE = (4, 8)
RATE = 0.3
#: A bucket that a smaller share of the sampled documents has keeps a zero vector.
LEAST_SHARE = 1 / 300
GAIN = 8.0
#: Largest number of labelled rows of each class that the model is fitted on, and
#: largest number of bytes of their texts (the driver holds some 12 times as much).
SAMPLE = 1200
SAMPLE_BYTES = 6 << 20
#: Texts of more than this share of the bytes come last in the sample, so a class gets
#: that many other texts at least, if it has them.
LONG_SHARE = 32
THRESHOLD = 0.7

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_STEP = np.uint32(0x01000193)


@dataclass
class Model:
    """Effective weight of each bucket (its vector times the softmax), and bias."""

    weight: np.ndarray
    bias: float


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word) of every feature, and the first word of each row with one entry more for the end.

    Features come ordered by n-gram length, not by place. A word is hashed whole,
    whatever its length.
    """
    rows = len(offsets) - 1
    data = lowered(data)
    # A separator before and after every row keeps rows apart.
    place = np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(offsets)) + 1
    b = np.full(len(data) + rows + 1, 32, np.uint8)
    b[place] = data
    word = _WORD[b]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    begin = offsets + np.arange(rows + 1)  # separator before the row
    first_word = np.searchsorted(starts, begin)
    number = np.cumsum(first, dtype=np.int64) - 1  # word that a byte of a word belongs to

    b32 = np.where(word, b, 32).astype(np.uint32)
    found, where = [], []
    for n in GRAMS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        inside = np.ones(m, bool)
        for j in range(1, n - 1):
            inside &= word[j : j + m]
        at = np.flatnonzero(inside)
        h = np.full(len(at), 0x811C9DC5 + n, np.uint32)
        for j in range(n):
            h = (h ^ b32[at + j]) * _STEP
        h ^= h >> np.uint32(15)
        found.append((h & np.uint32(BUCKETS - 1)).astype(np.uint32))
        where.append(number[at + 1])
    found.append((word_hashes(b, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.uint32))
    where.append(np.arange(len(starts)))
    return np.concatenate(found), np.concatenate(where), first_word


def passages(totals: np.ndarray, first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``totals`` (one entry a word) over every passage, and the first passage of each row.

    A passage starts at every word that has :data:`PASSAGE` words from there on;
    a row of fewer words is one passage, and so is a row without words.
    """
    words = np.diff(first_word)
    number = np.maximum(1, words - PASSAGE + 1)
    first = np.concatenate([[0], np.cumsum(number)])
    start = np.arange(first[-1]) + np.repeat(first_word[:-1] - first[:-1], number)
    end = np.repeat(first_word[1:], number)
    padded = np.concatenate([totals, np.zeros(PASSAGE)])
    out = np.zeros(len(start))
    for j in range(PASSAGE):
        out += np.where(start + j < end, padded[start + j], 0.0)
    return out, first


def score_block(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of the toxic class for each row."""
    bucket, word, first_word = features(data, offsets)
    total, first = passages(np.bincount(word, model.weight[bucket], minlength=first_word[-1]), first_word)
    number, _ = passages(np.bincount(word, minlength=first_word[-1]), first_word)
    logit = total / np.maximum(number, 1) + model.bias
    return 1.0 / (1.0 + np.exp(-np.maximum.reduceat(logit, first[:-1])))


def sample_of(data: np.ndarray, limit: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text's features, ordered by word, and the place where each word begins.

    A text of more than ``limit`` bytes goes in pieces cut between words, so the
    work space doesn't grow with it (unless one word is longer than that).
    """
    buckets, firsts, total, lo = [], [], 0, 0
    while lo < len(data):
        hi = min(lo + limit, len(data))
        if hi < len(data):
            gaps = np.flatnonzero(~_WORD[data[lo:hi]])
            if not len(gaps):
                gaps = hi - lo + np.flatnonzero(~_WORD[data[hi:]])[:1]
            hi = lo + int(gaps[-1]) + 1 if len(gaps) else len(data)
        bucket, word, first_word = features(data[lo:hi], np.array([0, hi - lo]))
        buckets.append(bucket[np.argsort(word, kind="stable")])
        begin = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=first_word[-1]))])
        firsts.append((total + begin[:-1]).astype(np.uint32))
        total += len(bucket)
        lo = hi
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    return np.concatenate(buckets), np.concatenate(firsts)


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: tuple[int, int] = WARM_AND_FINE, seed: int = 7) -> Model:
    """Fit vectors and softmax jointly, by AdaGrad on batches of 32 documents.

    ``samples``: for each document the buckets of its features, ordered by
    word, and the place where each word begins. In the first epochs a
    document is the average of all its features; in the later ones it is the
    average of its most toxic passage, as in scoring. Vectors are read by
    distinct bucket and weighed with its count, so a document never brings more
    vectors than there are; the samples themselves, and one number for each
    feature of a document in the later epochs, do grow with it. With only one class
    present, or none, the model scores every text alike. A bucket that fewer
    than :data:`LEAST_SHARE` of the documents have keeps a zero vector.
    """
    positive = int(labels.sum())
    if not 0 < positive < len(labels):
        rate = (positive + 0.5) / (len(labels) + 5.0)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(seed)
    common = np.zeros(BUCKETS, np.int32)
    wholes = []
    for bucket, _ in samples:
        whole, count = np.unique(bucket, return_counts=True)
        common[whole] += 1
        wholes.append((whole, count.astype(np.float32)))
    learns = common >= max(1, round(LEAST_SHARE * len(labels)))
    vectors = rng.normal(0, 0.01, (BUCKETS, DIMENSIONS)) * learns[:, None]
    softmax = rng.normal(0, 1.0, (DIMENSIONS, 2)) * GAIN
    bias = np.zeros(2)
    seen, seen_softmax, seen_bias = np.full(BUCKETS, 1e-6), np.full(softmax.shape, 1e-2), np.full(2, 1e-2)
    slope, used = np.zeros((BUCKETS, DIMENSIONS)), np.zeros(BUCKETS, bool)
    warm, fine = epochs
    for epoch in range(warm + fine):
        rate = 1 - epoch / (warm + fine)
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), 32):
            batch = [i for i in order[lo : lo + 32] if len(samples[i][0])]
            if not batch:
                continue
            effective = vectors @ (softmax[:, 1] - softmax[:, 0])
            chosen = []
            for i in batch:
                if epoch < warm:
                    chosen.append(wholes[i])
                    continue
                bucket, firsts = samples[i]
                bounds = np.append(firsts, len(bucket))
                sums, _ = passages(np.add.reduceat(effective[bucket], firsts), np.array([0, len(firsts)]))
                best = int(np.argmax(sums / (bounds[np.minimum(np.arange(len(sums)) + PASSAGE, len(firsts))] - bounds[: len(sums)])))
                chosen.append(np.unique(bucket[bounds[best] : bounds[min(best + PASSAGE, len(firsts))]], return_counts=True))
            sizes = np.array([count.sum(dtype=np.float64) for _, count in chosen])
            mean = np.stack([count @ vectors[bucket] for bucket, count in chosen]) / sizes[:, None]
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = labels[batch].astype(int)
            error = p / len(y)
            error[np.arange(len(y)), y] -= 1 / len(y)
            back = error @ softmax.T / sizes[:, None]
            grad_softmax, grad_bias = mean.T @ error, error.sum(0)
            for (bucket, count), step in zip(chosen, back):
                slope[bucket] += count[:, None] * step
                used[bucket] = True
            unique = np.flatnonzero(used)
            grad = slope[unique] * learns[unique][:, None]
            slope[unique], used[unique] = 0.0, False
            seen[unique] += (grad**2).mean(1)
            vectors[unique] -= RATE * rate * grad / np.sqrt(seen[unique])[:, None]
            seen_softmax += grad_softmax**2
            softmax -= RATE * rate * grad_softmax / np.sqrt(seen_softmax)
            seen_bias += grad_bias**2
            bias -= RATE * rate * grad_bias / np.sqrt(seen_bias)
    return Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on at most ``sample`` rows and ``sample_bytes`` bytes of each class of ``labels``.

    Only ids whose crc32 leaves 0 or 2 modulo 3 are used; null ids and labels
    are skipped, and an id that either table repeats counts once: toxic if any of
    its labels says so, with the first of its texts in the order of a digest.

    Rows count in the order of a digest of their id, but texts of more than one
    :data:`LONG_SHARE`-th of ``sample_bytes`` come after all others, so a long text
    never takes the place of those behind it. A text beyond ``sample_bytes`` isn't
    fitted on; a class that has no other text is missing from the model, which then
    scores every text alike. Lengths are summed up first; texts are
    fetched for the chosen rows only.
    """
    usable = (
        labels.select("doc_id", "toxic")
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    order = [F.md5(F.col("doc_id").cast("string")), "doc_id"]
    chosen = [usable.where(F.col("toxic") == c).orderBy(*order).limit(sample) for c in (0, 1)]
    picked = F.broadcast(materialise(chosen[0].unionAll(chosen[1]), "picked"))  # 2 * sample rows of two numbers at most
    texts = docs.select("doc_id", no_null("text").alias("text")).withColumn("digest", F.xxhash64("text"))
    sizes = texts.withColumn("size", F.octet_length("text")).join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("digest", "size")).alias("x")).select("doc_id", "toxic", "x.*")
    # One task sums up 2 * sample numbers at most.
    turn = Window.partitionBy("toxic").orderBy(F.col("size") > sample_bytes // LONG_SHARE, *order).rowsBetween(Window.unboundedPreceding, 0)
    fitting = sizes.where(F.col("size") <= sample_bytes).withColumn("upto", F.sum("size").over(turn)).where(F.col("upto") <= sample_bytes)
    fitting = F.broadcast(materialise(fitting.select("doc_id", "digest", "toxic"), "sample"))
    rows = texts.join(fitting, ["doc_id", "digest"]).groupBy("doc_id", "toxic").agg(F.first("text").alias("text")).select("doc_id", "text", "toxic")

    got, samples = rows.toArrow(), []
    for batch in got.to_batches():
        for i in range(batch.num_rows):
            samples += [sample_of(data) for _, _, data, _ in blocks(batch.column(1)[i : i + 1])]
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    return train([samples[i] for i in order], got.column("toxic").to_numpy()[order])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, score) of every row; null and empty texts have the score of the bias alone.

    Whole texts count, whatever their length. Repeated rows come out repeated;
    other columns are ignored.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [score_block(model, data, offsets) for _, _, data, offsets in blocks(batch.column(1))]
            values = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scored, "doc_id long, score double")


def not_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, columns unchanged."""
    schema, at = docs.schema, docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Block by block, so that never a second copy of a whole batch is held.
            for lo, hi, data, offsets in blocks(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(score_block(model, data, offsets) < threshold))

    return docs.mapInArrow(kept, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
