"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams and of
itself; a text's is the mean of its words'; a linear softmax reads it.  Vectors
and softmax are trained together in numpy on a sample of labelled documents
that ``SAMPLE`` bounds, on the driver.  Misspelt words share most n-grams with
the word that they stand for, and so its vector.

Because everything after the look-up is linear, a bucket's vector enters a
score only through its product with the softmax weights: scoring carries one
number a bucket (1 MB in the task's closure) and costs one pass over the text.

Defined results: null, blank and unlabelled texts are scored like any other (a
text without words gets the score of the bias alone); texts of any length are
scored whole; repeated rows get equal scores; ids only choose the rows to learn
from; without labels of both kinds the score is the share of toxic labels (0.5
without any); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import kernels as K
from terrane.llm.subwords import lexemes, segment_sums, subword_buckets
from terrane.llm.text import hashed_span, held_out
from terrane.workspace import bounded_batches

#: Bounds of the training sample: documents of each label, and characters of one.
SAMPLE, SAMPLE_CHARS = 1200, 8_000
BUCKETS = 1 << 17
SIZES = (3, 4, 5)
DIMENSIONS = 4
#: The mean of a long text is small; this keeps the gradients in range.
GAIN = 20.0
RATE = 0.05
PATIENCE = 8
LEAST_DOCUMENTS = 3


@dataclass
class Model:
    """Log-odds of each bucket, and bias, on the scale of the calibrated score."""

    weight: np.ndarray
    bias: float


def _adam(params: list[np.ndarray], grads: list[np.ndarray], state: list, step: int, rate: float) -> None:
    for p, g, (m, v) in zip(params, grads, state, strict=True):
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def _first_vectors(seen: np.ndarray, toxic: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Start for the first dimension: the log-odds ratio of finding the n-gram
    in a toxic text, in standard errors, shrunk by two of them.  What a few
    texts share by chance starts at 0."""
    a, c = toxic + 0.5, seen - toxic + 0.5
    ratio = np.log(a / (labels.sum() + 1)) - np.log(c / (len(labels) - labels.sum() + 1))
    z = ratio / np.sqrt(1 / a + 1 / c)
    return np.sign(z) * np.maximum(np.abs(z) - 2, 0)


def train(texts: list[str], labels: np.ndarray, prior: float, steps: int = 50, seed: int = 5) -> Model:
    """prior: share of toxic documents among all labelled ones, to which the
    balanced sample's odds are moved back.

    Training stops after ``PATIENCE`` rounds without a lower loss on the fifth of
    the sample that is held back, and the round of the least loss is taken; so
    samples of any size are trained alike, and a small one is not memorised.
    """
    labels = np.asarray(labels, np.int64)
    if not len(labels) or labels.min() == labels.max():
        p = min(max(prior, 1e-3), 1 - 1e-3) if len(labels) else 0.5
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    buf, offs = K.text_bytes(pa.array(texts, pa.large_string()))
    lex = lexemes(buf, offs)
    bucket, owner = subword_buckets(lex, SIZES, BUCKETS)
    grams = np.maximum(1, np.bincount(owner, minlength=len(lex.codes))).astype(np.float32)
    # Documents as (document, word, share) with the shares of a document's words summing to 1.
    doc = lex.words.row
    pair = np.unique(doc * len(lex.codes) + lex.index, return_counts=True)
    doc_of, word_of = pair[0] // len(lex.codes), pair[0] % len(lex.codes)
    share = (pair[1] / np.maximum(1, np.diff(lex.words.first))[doc_of]).astype(np.float32)
    by_word = np.argsort(word_of, kind="stable")
    # Documents, and toxic ones, that hold each bucket; only buckets of several documents are trained.
    begin, count = np.searchsorted(owner, word_of), np.bincount(owner, minlength=len(lex.codes))[word_of]
    seen, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for d in range(0, len(labels), 64):
        a, b = np.searchsorted(doc_of, (d, d + 64))
        held = np.unique(np.repeat(doc_of[a:b], count[a:b]) * BUCKETS + bucket[K.ranges(begin[a:b], count[a:b])])
        seen += np.bincount(held % BUCKETS, minlength=BUCKETS)
        toxic += np.bincount((held % BUCKETS)[labels[held // BUCKETS] == 1], minlength=BUCKETS)
    often = seen[bucket] >= LEAST_DOCUMENTS
    bucket, owner = bucket[often], owner[often].astype(np.int32)
    used, local = np.unique(bucket, return_inverse=True)
    local = local.astype(np.int32)
    by_gram = np.argsort(local, kind="stable").astype(np.int32)
    del bucket, often, begin, count

    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.02, (len(used), DIMENSIONS)).astype(np.float32)
    w = rng.normal(0, 0.2, DIMENSIONS).astype(np.float32)
    e[:, 0] = _first_vectors(seen[used], toxic[used], labels)
    w[0] = 1.0
    b = np.zeros(1, np.float32)
    fit = rng.random(len(labels)) < 0.8
    rate = labels[fit].mean()
    weight = np.where(labels == 1, 0.5 / max(rate, 1e-6), 0.5 / max(1 - rate, 1e-6)) * fit / max(1, fit.sum())
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (e, w, b)]

    def forward() -> tuple[np.ndarray, np.ndarray]:
        words = segment_sums(e[local], owner, len(grams)) / grams[:, None]
        docs = segment_sums(words[word_of] * share[:, None], doc_of, len(labels)) * GAIN
        return docs, docs @ w + b

    # Both labels weigh the same in the loss of the documents held back.
    back = ~fit
    share_back = labels[back].mean() if back.any() else 0.0
    back_weight = np.where(labels == 1, 0.5 / max(share_back, 1e-6), 0.5 / max(1 - share_back, 1e-6)) * back / max(1, back.sum())
    least, kept, since = np.inf, None, 0
    for step in range(1, steps + 1):
        docs, logit = forward()
        loss = float((back_weight * np.logaddexp(0, np.where(labels == 1, -logit, logit))).sum())
        if not 0 < share_back < 1 or loss < least:
            least, kept, since = loss, [p.copy() for p in (e, w, b)], 0
        elif (since := since + 1) >= PATIENCE:
            break
        error = (weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels)).astype(np.float32)
        to_docs = error[:, None] * w * GAIN
        to_words = segment_sums((to_docs[doc_of] * share[:, None])[by_word], word_of[by_word], len(grams)) / grams[:, None]
        to_grams = segment_sums(to_words[owner][by_gram], local[by_gram], len(used))
        _adam([e, w, b], [to_grams, docs.T @ error, error.sum(keepdims=True)], state, step, RATE)
    if kept is not None:
        e, w, b = kept
    _, logit = forward()

    # Calibration on the documents left out: slope and offset by Newton's method, then back to the true prior.
    x, y = (logit[~fit], labels[~fit]) if 0 < labels[~fit].sum() < (~fit).sum() else (logit, labels)
    centre, scale = float(x.mean()), float(x.std()) or 1.0
    design = np.stack([(x - centre) / scale, np.ones_like(x)], axis=1).astype(np.float64)
    coef = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ coef, -30, 30)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([0.05, 1e-3])
        coef -= np.linalg.solve(hess, design.T @ (p - y) + np.array([0.05 * (coef[0] - 1), 1e-3 * coef[1]]))
    slope = max(coef[0], 0.05) / scale
    odds = lambda p: float(np.log(p / (1 - p)))
    shift = odds(min(max(prior, 1e-3), 1 - 1e-3)) - odds(min(max(float(y.mean()), 1e-3), 1 - 1e-3))
    full = np.zeros(BUCKETS, np.float32)
    full[used] = (e @ w) * GAIN * slope
    return Model(full, float(slope * (float(b[0]) - centre) + coef[1] + shift))


def score_texts(model: Model, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    lex = lexemes(buf, offs)
    bucket, owner = subword_buckets(lex, SIZES, BUCKETS)
    n = len(lex.codes)
    word = np.bincount(owner, model.weight[bucket], minlength=n) / np.maximum(1, np.bincount(owner, minlength=n))
    rows = len(offs) - 1
    total = np.bincount(lex.words.row, word[lex.index], minlength=rows)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(1, np.diff(lex.words.first)) + model.bias, -30, 30)))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, chars: int) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of a bounded, hashed sample of the rows one may learn
    from, and the share of 1 among all of those labels.  A text gives at most
    ``chars`` characters, from a hashed place; rows that repeat an id are one."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("y"))
    counts = dict(known.groupBy("y").count().collect())
    total = sum(counts.values())
    place = F.pmod(F.xxhash64(F.lit(label), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.lit(False)
    for y, n in counts.items():
        wanted = wanted | ((F.col("y") == y) & (place < per_class / n))
    ids = known.filter(wanted).orderBy(place, "doc_id", "y").limit(3 * per_class)
    texts = docs.filter("text is not null").select("doc_id", hashed_span(F.col("text"), F.col("doc_id"), chars).alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = found.orderBy("doc_id", "y").collect()
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], np.int64), (counts.get(1, 0) / total if total else 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = K.text_bytes(batch.column(1))
            scores = [score_texts(model, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in K.slices(offs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "score"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op1(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    model = train(*training_sample(docs, labels, "toxic", SAMPLE, SAMPLE_CHARS))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
