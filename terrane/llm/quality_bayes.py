"""Quality by hierarchical empirical Bayes over hosts and paths.

A logistic classifier turns each text's measures into evidence that it is
good.  All documents' evidence is summed by host and by path (a host's section)
in one combining aggregate.  A host's rate is shrunk to the global rate, a
path's to its host's, by prior strengths that the data give (method of moments
on the spread of sites' rates, again from aggregates), so that a site of a few
documents hardly moves a decision and a large one does.  A document's posterior
odds are its evidence's odds times its path's odds over the global odds, where
the path's sums leave out the document itself.

Sites are keys of ordinary aggregates and joins: the sums are combined before
the shuffle, and the site table is joined back by a join that adaptive
execution splits when a site holds a large share of all rows.

Defined results: null and blank texts have the evidence of an empty text; null
hosts or paths are sites of their own; repeated rows count each time; without
labels of both kinds the evidence is the share of good labels (1 without any,
so that nothing is rejected); empty tables give empty results; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm import kernels as K
from terrane.llm.toxicity import training_sample
from terrane.workspace import Workspace, bounded_batches

#: Bounds of the training sample: documents of each label, and characters of one.
SAMPLE, SAMPLE_CHARS = 2000, 12_500
#: A document whose posterior is below this is rejected.
THRESHOLD = 0.5
#: Weight of a site's odds in a decision, and bounds of the prior strengths (in documents).
SITE_WEIGHT, STRENGTHS = 0.5, (20.0, 10_000.0)

#: Byte classes that are measured as shares of a text's bytes.
CLASSES = (b"#*$%&<>", b"|", b"!", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"\n")


def measures(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of numbers per text."""
    rows = len(offs) - 1
    words = K.find_words(buf, offs)
    n = np.diff(words.first)
    length = words.end - words.start
    row = words.row
    size = np.maximum(1, np.diff(offs))
    out = [np.log1p(n)]
    kind = np.zeros(256, np.int64)
    for i, chars in enumerate(CLASSES):
        kind[list(chars)] = i + 1
    of_byte = kind[buf]
    marked = np.flatnonzero(of_byte)
    counts = np.bincount((np.searchsorted(offs, marked, "right") - 1) * (len(CLASSES) + 1) + of_byte[marked], minlength=rows * (len(CLASSES) + 1)).reshape(rows, len(CLASSES) + 1)[:, 1:]
    out += list(np.sqrt(counts / size[:, None]).T)
    out.append(np.bincount(row, length, minlength=rows) / np.maximum(1, n))
    out.append(np.bincount(row, length <= 3, minlength=rows) / np.maximum(1, n))
    # Shares of words and of lines that repeat an earlier one of the text.
    codes = K.word_codes(buf, words)
    out.append(_repeats(row, codes, rows) / np.maximum(1, n))
    separator = np.zeros(256, bool)
    separator[10] = True
    lines = K.find_words(buf, offs, separator)
    out.append(_repeats(lines.row, K.word_codes(buf, lines), rows) / np.maximum(1, np.diff(lines.first)))
    # Repeated runs of four words: loops and boilerplate.
    runs = K.grams(codes, 4)
    inside = K.ranges(words.first[:-1], np.maximum(0, n - 3))
    out.append(_repeats(np.repeat(np.arange(rows), np.maximum(0, n - 3)), runs[inside], rows) / np.maximum(1, n))
    return np.stack(out, axis=1)


def _repeats(row: np.ndarray, codes: np.ndarray, rows: int) -> np.ndarray:
    order = np.lexsort((codes, row))
    same = (row[order[1:]] == row[order[:-1]]) & (codes[order[1:]] == codes[order[:-1]])
    return np.bincount(row[order[1:]][same], minlength=rows)


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = expanded((x - self.mean) / self.scale) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def expanded(x: np.ndarray) -> np.ndarray:
    """Linear and squared terms: junk lies at both ends of several measures."""
    x = np.clip(x, -6, 6)
    return np.concatenate([x, x * x], axis=1)


def train(texts: list[str], labels: np.ndarray, prior: float) -> Logistic:
    """Penalised logistic regression by Newton's method."""
    buf, offs = K.text_bytes(pa.array(texts, pa.large_string()))
    width = measures(np.zeros(0, np.uint8), np.zeros(1, np.int64)).shape[1]
    if len(labels) == 0 or labels.min() == labels.max():
        p = min(max(prior if len(labels) else 1.0, 1e-3), 1 - 1e-3)
        return Logistic(np.zeros(width), np.ones(width), np.zeros(2 * width), float(np.log(p / (1 - p))))
    x = np.concatenate([measures(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in K.slices(offs)])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.concatenate([expanded((x - mean) / scale), np.ones((len(x), 1))], axis=1)
    # Each label's sample is weighted back to its share among all labelled rows.
    share = labels.mean()
    weight = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))
    penalty = np.full(z.shape[1], 0.5)
    penalty[-1] = 1e-6
    coef = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ coef, -30, 30)))
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hess, z.T @ (weight * (p - labels)) + penalty * coef)
        coef -= step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, coef[:-1], float(coef[-1]))


def evidence(docs: DataFrame, model: Logistic) -> DataFrame:
    """doc_id, host, path, p for docs(doc_id, text, host, path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = K.text_bytes(batch.column(1))
            p = [model.probability(measures(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])) for a, b in K.slices(offs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.concatenate(p) if p else np.zeros(0))], names=["doc_id", "host", "path", "p"])

    return docs.mapInArrow(run, "doc_id long, host string, path string, p double")


def _strength(within: Column) -> Column:
    """Prior strength by moments: how much more the sites' rates spread around
    their parent than sampling alone would make them."""
    spread = F.sum(F.col("n") * (F.col("s") / F.col("n") - within) ** 2)
    sampling = F.sum(within * (1 - within))
    excess = (spread - sampling) / F.sum("n")
    strength = F.sum(F.col("n") * within * (1 - within)) / F.sum("n") / F.greatest(excess, F.lit(1e-9))
    return F.coalesce(F.least(F.greatest(strength, F.lit(STRENGTHS[0])), F.lit(STRENGTHS[1])), F.lit(STRENGTHS[1]))


def posteriors(scored: DataFrame) -> DataFrame:
    """doc_id, host, path, p (kept from before), host_rate, path_rate, posterior."""
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = lambda c: F.log(clip(c) / (1 - clip(c)))
    # Keys that are never null and tell null from the empty name.
    key = lambda c: F.concat(F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce(c, F.lit("")))
    rows = scored.withColumns({"hk": key("host"), "pk": F.concat(key("host"), F.lit("\n"), key("path"))})
    paths = rows.groupBy("hk", "pk").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("hk").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    overall = hosts.agg(F.sum("n").alias("all_n"), clip(F.sum("s") / F.sum("n")).alias("rate"))
    host_strength = hosts.join(F.broadcast(overall)).agg(_strength(F.col("rate")).alias("host_strength"), F.first("rate").alias("rate"))
    shrunk = hosts.join(F.broadcast(host_strength)).select("hk", "rate", "host_strength", F.col("n").alias("host_n"), F.col("s").alias("host_s"), clip((F.col("s") + F.col("host_strength") * F.col("rate")) / (F.col("n") + F.col("host_strength"))).alias("host_rate"))
    sites = paths.join(shrunk, "hk")
    path_strength = sites.agg(_strength(F.col("host_rate")).alias("path_strength"))
    sites = sites.join(F.broadcast(path_strength)).select("pk", "n", "s", "rate", "host_strength", "host_n", "host_s", "host_rate", "path_strength")
    joined = rows.join(sites, "pk")
    # The document's own evidence is left out of its sites' sums.
    own_host = (F.col("host_s") - F.col("p") + F.col("host_strength") * F.col("rate")) / (F.col("host_n") - 1 + F.col("host_strength"))
    own_path = (F.col("s") - F.col("p") + F.col("path_strength") * own_host) / (F.col("n") - 1 + F.col("path_strength"))
    z = odds(F.col("p")) + SITE_WEIGHT * (odds(own_path) - odds(F.col("rate")))
    return joined.select("doc_id", "host", "path", "p", "host_rate", own_path.alias("path_rate"), (1 / (1 + F.exp(-z))).alias("posterior"))


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document with its evidence, its sites' rates, and the verdict."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ws = Workspace(spark, "quality")
    model = train(*training_sample(docs, labels, "quality", SAMPLE, SAMPLE_CHARS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", host.cast("string").alias("host"), path.cast("string").alias("path"))
    scored = ws.keep(evidence(rows, model), "evidence")
    return posteriors(scored).withColumn("kept", F.col("posterior") >= threshold)


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents have a source for a host; its sections are its languages."""
    return judge(docs, labels, F.col("source"), F.col("lang")).select(
        "doc_id", F.col("host").alias("source"), F.col("path").alias("section"), F.round("p", 9).alias("evidence"), F.round("host_rate", 9).alias("host_rate"), F.round("path_rate", 9).alias("path_rate"), F.round("posterior", 9).alias("posterior"), "kept"
    )
