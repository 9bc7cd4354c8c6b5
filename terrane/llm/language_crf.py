"""Language of words and texts by a linear-chain conditional random field.

Every word is labelled with a language.  Its potentials come from hashed
features (the word itself as a lexicon entry, its prefixes and suffixes, its
character n-grams); a transition matrix couples neighbours, so that runs of one
language and switches between languages are both learned.  Training sequences
are spans of different documents put one after the other, which is what
code-switched text looks like; gradients come from forward-backward over all
sequences at once.

Prediction runs forward-backward over whole texts of any length: blocks of
``BLOCK`` words are multiplied into one transfer matrix each, the blocks of a
text are chained, and a second pass inside the blocks gives every word's
marginals.  A text's language is the one with the largest sum of marginals,
its score that sum's share.

Defined results: null texts and texts without a letter are ``und`` with score
0; without any labelled row all texts are; ties go to the label that comes first
in order; empty tables give empty results; repeated rows get equal results; ids only choose the rows to learn
from; lang and source are never read for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm import kernels as K
from terrane.llm.subwords import Lexemes, lexemes, segment_sums, subword_buckets
from terrane.llm.text import hashed_span, held_out
from terrane.workspace import bounded_batches

#: Bounds of the training sample: documents of a label, characters of one; sequences (at least, and of each label) and their words.
SAMPLE, SAMPLE_CHARS = 150, 6_000
SEQUENCES, LABEL_SEQUENCES, LENGTH = 1500, 25, 32
#: Numbers in one array of forward-backward: batches of sequences and of texts are cut to it.
NUMBERS = 4_000_000
#: From so many labels on, a word by word recursion takes the place of transfer matrices of labels x labels.
MANY_LABELS = 32
BUCKETS = 1 << 15
SIZES, AFFIXES = (2, 3), (1, 2, 3)
BLOCK = 32
GAIN = 6.0


@dataclass
class Crf:
    labels: list[str]
    theta: np.ndarray  # bucket x label
    transition: np.ndarray  # from x to, in logs
    start: np.ndarray


def emissions(crf_theta: np.ndarray, lex: Lexemes) -> np.ndarray:
    bucket, owner = subword_buckets(lex, SIZES, BUCKETS, AFFIXES)
    n = len(lex.codes)
    return segment_sums(crf_theta[bucket], owner, n) * (GAIN / np.maximum(1, np.bincount(owner, minlength=n)))[:, None]


def marginals(e: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (sequences, words, labels) and summed pair marginals of a batch."""
    s, t, n = e.shape
    p = np.exp(e - e.max(axis=2, keepdims=True))
    a = np.exp(transition)
    alpha, beta, scale = np.empty_like(p), np.ones_like(p), np.empty((s, t, 1))
    now = np.exp(start) * p[:, 0]
    for i in range(t):
        if i:
            now = (alpha[:, i - 1] @ a) * p[:, i]
        scale[:, i] = now.sum(axis=1, keepdims=True)
        alpha[:, i] = now / scale[:, i]
    for i in range(t - 2, -1, -1):
        beta[:, i] = ((beta[:, i + 1] * p[:, i + 1]) @ a.T) / scale[:, i + 1]
    pairs = np.einsum("stl,stm->lm", alpha[:, :-1], beta[:, 1:] * p[:, 1:] / scale[:, 1:]) * a
    return alpha * beta, pairs


def train(texts: list[str], langs: list[str], steps: int = 30, seed: int = 3) -> Crf | None:
    names = sorted(set(langs))
    if not names:
        return None
    n = len(names)
    label = np.array([names.index(x) for x in langs])
    buf, offs = K.text_bytes(pa.array(texts, pa.large_string()))
    lex = lexemes(buf, offs)
    count = np.diff(lex.words.first)
    usable = np.flatnonzero(count > 0)
    if not len(usable):
        return None
    rng = np.random.default_rng(seed)
    # Each sequence is made of spans of 2 to LENGTH words from random documents of random labels.
    by_label = [usable[label[usable] == k] for k in range(n)]
    sequences = max(SEQUENCES, LABEL_SEQUENCES * n)
    present = [k for k in range(n) if len(by_label[k])]
    word, truth = np.empty((sequences, LENGTH), np.int64), np.empty((sequences, LENGTH), np.int64)
    for s in range(sequences):
        at = 0
        while at < LENGTH:
            k = present[rng.integers(len(present))]
            doc = by_label[k][rng.integers(len(by_label[k]))]
            size = min(int(rng.integers(2, LENGTH + 1)), LENGTH - at, int(count[doc]))
            first = lex.words.first[doc] + int(rng.integers(0, count[doc] - size + 1))
            word[s, at : at + size], truth[s, at : at + size] = lex.index[first : first + size], k
            at += size
    bucket, owner = subword_buckets(lex, SIZES, BUCKETS, AFFIXES)
    used_words, word = np.unique(word, return_inverse=True)
    word = word.reshape(sequences, LENGTH)
    inside = np.isin(owner, used_words)
    bucket, owner = bucket[inside], np.searchsorted(used_words, owner[inside])
    feats = np.maximum(1, np.bincount(owner, minlength=len(used_words)))
    by_bucket = np.argsort(bucket, kind="stable")
    theta, transition, start = np.zeros((BUCKETS, n)), np.zeros((n, n)), np.zeros(n)
    gold_pairs = np.zeros((n, n))
    np.add.at(gold_pairs, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1.0)
    chunk = max(1, NUMBERS // (LENGTH * n))
    by_words = [np.argsort(word[c : c + chunk].reshape(-1), kind="stable") for c in range(0, sequences, chunk)]
    params = [theta, transition, start]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        e = segment_sums(theta[bucket], owner, len(used_words)) * (GAIN / feats)[:, None]
        to_words, pairs, opening = np.zeros((len(used_words), n)), np.zeros((n, n)), np.zeros(n)
        for c, by_word in zip(range(0, sequences, chunk), by_words, strict=True):
            error, own = marginals(e[word[c : c + chunk]], transition, start)
            error = error.reshape(-1, n)
            error[np.arange(len(error)), truth[c : c + chunk].reshape(-1)] -= 1
            error /= sequences
            to_words += segment_sums(error[by_word], word[c : c + chunk].reshape(-1)[by_word], len(used_words))
            pairs += own
            opening += error[::LENGTH].sum(axis=0)
        to_words *= (GAIN / feats)[:, None]
        grads = [segment_sums(to_words[owner][by_bucket], bucket[by_bucket], BUCKETS) + 1e-6 * theta, (pairs - gold_pairs) / sequences, opening]
        for p, g, (m, v) in zip(params, grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(names, theta.astype(np.float32), transition, start)


def stepped_marginals(crf: Crf, e: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``word_marginals`` word by word: labels^2 a word and no transfer matrices."""
    out, p = np.zeros_like(e), np.exp(e - e.max(axis=1, keepdims=True))
    a, opening = np.exp(crf.transition), np.exp(crf.start)
    count = np.diff(first)
    # Longest texts first: those that have a word i are the first few.
    order = np.argsort(-count, kind="stable")
    begin, size = first[:-1][order], count[order]
    live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
    for i, k in enumerate(live):
        at = begin[:k] + i
        now = (out[at - 1] @ a if i else opening) * p[at]
        out[at] = now / now.sum(axis=1, keepdims=True)
    beta = np.ones((len(size), e.shape[1]))
    for i in range(len(live) - 1, -1, -1):
        k = live[i]
        at = begin[:k] + i
        now = out[at] * beta[:k]
        out[at] = now / now.sum(axis=1, keepdims=True)
        back = (beta[:k] * p[at]) @ a.T
        beta[:k] = back / back.sum(axis=1, keepdims=True)
    return out


def word_marginals(crf: Crf, e: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marginals of every word of texts whose words start at ``first``."""
    n = e.shape[1]
    if n >= MANY_LABELS:
        return stepped_marginals(crf, e, first)
    out = np.zeros_like(e)
    count = np.diff(first)
    blocks = -(-count // BLOCK)
    total = int(blocks.sum())
    if not total:
        return out
    text = np.repeat(np.arange(len(count)), blocks)
    rank = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[text] + rank * BLOCK
    size = np.minimum(BLOCK, first[text + 1] - begin)
    a = np.exp(crf.transition)
    p = np.exp(e - e.max(axis=1, keepdims=True))
    # The first word of a text is entered with start, as if from a state whose row of the transition is start.
    opening = np.exp(crf.start)

    product = np.broadcast_to(np.eye(n), (total, n, n)).copy()
    for i in range(BLOCK):
        on = np.flatnonzero(size > i)
        factor = p[begin[on] + i]
        step = product[on] @ a if i else np.where((rank[on] == 0)[:, None, None], np.eye(n) * opening, a)
        step = step * factor[:, None, :]
        product[on] = step / step.sum(axis=(1, 2), keepdims=True)
    # Chain the blocks of each text: what enters a block from the left, and from the right.
    left, right = np.full((total, n), 1.0 / n), np.full((total, n), 1.0 / n)
    head = np.cumsum(blocks) - blocks
    for r in range(1, int(blocks.max())):
        on = head[blocks > r] + r
        now = np.einsum("bl,blm->bm", left[on - 1], product[on - 1])
        left[on] = now / now.sum(axis=1, keepdims=True)
        back = (head + blocks - 1)[blocks > r] - r
        now = np.einsum("blm,bm->bl", product[back + 1], right[back + 1])
        right[back] = now / now.sum(axis=1, keepdims=True)
    alpha = left
    for i in range(BLOCK):
        on = np.flatnonzero(size > i)
        now = alpha[on] @ a if i else np.where((rank[on] == 0)[:, None], opening, alpha[on] @ a)
        now = now * p[begin[on] + i]
        alpha[on] = now / now.sum(axis=1, keepdims=True)
        out[begin[on] + i] = alpha[on]
    beta = right
    for i in range(BLOCK - 1, -1, -1):
        on = np.flatnonzero(size > i)
        at = begin[on] + i
        now = out[at] * beta[on]
        out[at] = now / now.sum(axis=1, keepdims=True)
        if i:
            back = (beta[on] * p[at]) @ a.T
            beta[on] = back / back.sum(axis=1, keepdims=True)
    return out


def label_words(crf: Crf, buf: np.ndarray, offs: np.ndarray) -> tuple[Lexemes, np.ndarray]:
    """Words of the texts and the marginals of their labels."""
    lex = lexemes(buf, offs)
    if not len(lex.codes):
        return lex, np.zeros((0, len(crf.labels)))
    return lex, word_marginals(crf, emissions(crf.theta, lex)[lex.index].astype(np.float64), lex.words.first)


def identify(docs: DataFrame, crf: Crf | None) -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if crf is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    # A word has two bytes at least, and so many numbers as there are labels.
    limit = min(K.SLICE_BYTES, max(1, 2 * NUMBERS // len(crf.labels))) if len(crf.labels) >= MANY_LABELS else K.SLICE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*crf.labels, "und"])
        for batch in batches:
            buf, offs = K.text_bytes(batch.column(1))
            letter = batch.column(2).to_numpy(zero_copy_only=False)
            best, share = np.full(batch.num_rows, len(crf.labels)), np.zeros(batch.num_rows)
            for a, b in K.slices(offs, limit):
                lex, m = label_words(crf, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                sums = segment_sums(m, lex.words.row, b - a)
                total = sums.sum(axis=1)
                good = (total > 0) & letter[a:b]
                best[a:b][good] = sums[good].argmax(axis=1)
                share[a:b][good] = sums[good].max(axis=1) / total[good]
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(best)), pa.array(np.minimum(1.0, share))], names=["doc_id", "lang_pred", "score"])

    bounded_batches(docs.sparkSession)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return rows.select("doc_id", "text", letter.alias("letter")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def training_sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """A hashed sample of the rows one may learn from, bounded for each label:
    of all labels, and of every text that has a letter.  A text gives at most
    ``SAMPLE_CHARS`` characters, from a hashed place."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    share = docs.sparkSession.createDataFrame([(k, SAMPLE / n) for k, n in counts.items()], "lang string, share double")
    place = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    span = hashed_span(F.col("text"), F.col("doc_id"), SAMPLE_CHARS)
    lettered = hashed_span(F.regexp_replace("text", r"[^\p{L}]+", " "), F.col("doc_id"), SAMPLE_CHARS)
    text = F.when(span.rlike(r"\p{L}"), span).otherwise(F.trim(lettered)).alias("text")
    first = Window.partitionBy("lang").orderBy("place", "doc_id")
    rows = known.withColumn("place", place).join(F.broadcast(share), "lang").filter("place < share").select("doc_id", text, "lang", "place")
    rows = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= 2 * SAMPLE).drop("n", "place").orderBy("doc_id").collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def op5(docs: DataFrame) -> DataFrame:
    found = identify(docs, train(*training_sample(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
