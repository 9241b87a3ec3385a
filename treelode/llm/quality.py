"""Document quality by hierarchical empirical Bayes.

A linear classifier gives each document its own evidence, once for good quality and once for
toxic content.  Hosts, and paths inside hosts, have rates of their own: a host's expected counts
over all its documents are shrunk toward the global rate, a path's toward its host's, by as many
pseudo-documents as the strength says.  A document's log odds move by what its path's rate says
beyond the global one.

The classifier is fitted on a bounded sample of labelled rows; all rates are over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelode.llm.common import bytes_of, give_back, mix64, Scratch, text_slices
from treelode.llm.jaccard import LOWER, SPACES
from treelode.llm.suffixdedup import powers

#: Labelled rows that the classifier sees at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 8000
BUCKETS, GRAM = 1 << 18, 5
#: Grams a head may use: those whose presence differs most between its classes.
CHOSEN, STEPS, RATE, DECAY = 2048, 300, 0.1, 1e-5
STRENGTH = 50.0
SALTS = 32
#: A document is toxic from this probability on.
TOXIC_FROM = 0.35
SHAPES = 8
HEADS = ("quality", "toxic")
#: Log odds of a head without any labelled row.
UNLABELLED = {"quality": 4.0, "toxic": -4.0}


def features(data: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct gram buckets of each text, and its shape: shares of capitals, digits, signs,
    other bytes and line ends, of words equal to the one before, of distinct words, and size."""
    n, rows = len(data), len(starts) - 1
    grams, shape = [np.zeros(0, np.int64)] * rows, np.zeros((rows, SHAPES))
    if not n:
        return grams, shape
    up, down = powers(n)
    letters = LOWER[data]
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    hashed = mix64((prefix[GRAM:] - prefix[:-GRAM]) * down[: max(0, n - GRAM + 1)]) if n >= GRAM else np.zeros(0, np.uint64)
    bucket = (hashed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    space = SPACES[data]
    signs = (data < 128) & ~space & ~((letters >= 97) & (letters <= 122)) & ~((data >= 48) & (data <= 57)) & ~np.isin(data, [44, 46])
    counts = [(data >= 65) & (data <= 90), (data >= 48) & (data <= 57), signs, data >= 128, data == 10]
    totals = [np.concatenate([[0], np.cumsum(c)]) for c in counts]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    begin = np.flatnonzero(~space & (edge[:n] | np.concatenate([[True], space[:-1]])))
    end = np.flatnonzero(~space & (edge[1:] | np.concatenate([space[1:], [True]]))) + 1
    word = (prefix[end] - prefix[begin]) * down[begin]
    first = np.searchsorted(begin, starts)
    again = np.concatenate([[0], np.cumsum(np.concatenate([[False], word[1:] == word[:-1]]))]) if len(word) else np.zeros(1, np.int64)
    for i in range(rows):
        a, b = starts[i], starts[i + 1]
        if a == b:
            continue
        if b - a >= GRAM:
            grams[i] = np.unique(bucket[a : b - GRAM + 1])
        shape[i, : len(totals)] = [(t[b] - t[a]) / (b - a) for t in totals]
        words = first[i + 1] - first[i]
        if words:
            shape[i, 5] = (again[first[i + 1]] - again[min(first[i] + 1, first[i + 1])]) / words
            shape[i, 6] = len(np.unique(word[first[i] : first[i + 1]])) / words
        shape[i, 7] = np.log1p(words) / 10
    return grams, shape


def feature_rows(labelled: DataFrame) -> DataFrame:
    """grams (int32 bytes), shape and the two labels of few rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 19):
                grams, shape = features(*bytes_of(part.column("text")))
                columns = [pa.array([g.astype("<i4").tobytes() for g in grams]), pa.array(shape.tolist(), pa.list_(pa.float64())), part.column("quality"), part.column("toxic")]
                yield pa.RecordBatch.from_arrays(columns, ["grams", "shape", *HEADS])

    return labelled.select("text", *HEADS).mapInArrow(task, "grams binary, shape array<double>, quality double, toxic double")


def fit_head(grams: list[np.ndarray], shape: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of all buckets, of the shape, and the bias, by logistic regression; a head whose
    labels are all alike keeps zero weights and a bias toward that label."""
    weights, rate = np.zeros(BUCKETS, np.float32), (truth.sum() + 0.5) / (len(truth) + 1)
    if truth.min() == truth.max():
        return weights, np.zeros(SHAPES), float(np.log(rate / (1 - rate)))
    yes, every = np.full(BUCKETS, 0.5), np.ones(BUCKETS)
    for g, t in zip(grams, truth):
        every[g] += 1
        yes[g] += t
    n_yes, n = truth.sum(), len(truth)
    p, q = yes / (n_yes + 1), (every - yes) / (n - n_yes + 1)
    z = np.abs(p - q) / np.sqrt(every / n * (1 - every / (n + 2)) * (1 / n_yes + 1 / (n - n_yes)) + 1e-12)
    z[every < 4] = 0
    chosen = np.sort(np.argsort(-z, kind="stable")[:CHOSEN])
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    held = [place[g] for g in grams]
    held = [p[p >= 0] for p in held]
    col, row = np.concatenate(held), np.repeat(np.arange(n), [len(p) for p in held])
    dense = np.hstack([shape, np.ones((n, 1))])
    w, v = np.zeros(len(chosen)), np.zeros(SHAPES + 1)
    v[-1] = np.log(rate / (1 - rate))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]
    for step in range(1, STEPS + 1):
        error = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], n) + dense @ v, -30, 30))) - truth
        for k, (x, gradient) in enumerate(((w, np.bincount(col, error[row], len(w)) / n + DECAY * w), (v, dense.T @ error / n))):
            m1, m2 = moments[2 * k], moments[2 * k + 1]
            m1 += 0.1 * (gradient - m1)
            m2 += 0.01 * (gradient**2 - m2)
            x -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    weights[chosen] = w
    return weights, v[:-1], float(v[-1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, tuple]:
    """Both heads from a sample of labelled rows; its size is bounded, so it may be broadcast
    to the documents and its features may reach the driver."""
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id")
    known = known.agg(*(F.max(F.col(h).cast("double")).alias(h) for h in HEADS))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # An id may stand on many rows: the bound holds for the rows, by id and text.
    labelled = docs.withColumn("twin", F.xxhash64("text")).join(F.broadcast(sample), "doc_id")
    chosen = labelled.select("doc_id", "twin").distinct().orderBy(F.xxhash64("doc_id", "twin"), "doc_id", "twin").limit(rows)
    found = labelled.join(F.broadcast(chosen), ["doc_id", "twin"]).dropDuplicates(["doc_id", "twin"])
    try:
        return fit_heads(feature_rows(found.drop("twin")).toArrow())
    finally:
        give_back()


def fit_heads(found: pa.Table) -> dict[str, tuple]:
    """Both heads from the gathered features; nothing of them is held afterwards."""
    grams = [np.frombuffer(g.as_buffer(), "<i4") for g in found["grams"]]
    shape = np.array(found["shape"].to_pylist()).reshape(len(grams), SHAPES)
    out = {}
    for head in HEADS:
        truth = found[head].to_numpy(zero_copy_only=False).astype(float)
        use = np.flatnonzero(~np.isnan(truth))
        if len(use):
            out[head] = fit_head([grams[i] for i in use], shape[use], truth[use])
        else:  # nothing is known against any document
            out[head] = (np.zeros(BUCKETS, np.float32), np.zeros(SHAPES), UNLABELLED[head])
    return out


def evidence(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """The given columns and ``e_quality``, ``e_toxic``: log odds from the text alone."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 19):
                grams, shape = features(*bytes_of(part.column("text")))
                odds = []
                for weights, shape_weights, bias in (model.value[h] for h in HEADS):
                    odds.append(pa.array([float(weights[g].sum(dtype=np.float64)) for g in grams] + shape @ shape_weights + bias))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *odds], [*keep, "e_quality", "e_toxic"])

    return docs.select(*keep, "text").mapInArrow(task, f"{kinds}, e_quality double, e_toxic double")


def rate(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def assess(
    docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, strength: float = STRENGTH,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: doc_id, host, path, ``p_quality``, ``p_toxic``, the path's two
    rates, and ``keep``: quality at least one half, toxic below TOXIC_FROM.

    ``host`` defaults to the source, ``path`` to the language inside it; nulls form a host or
    path of their own.  A null or empty text has the evidence of an empty text.  Labels with a
    null id are ignored, repeated ones count by their largest value; without labels everything
    is kept.  Repeated rows are kept; columns in ``carry`` come along; an empty table gives no rows.
    """
    spark = docs.sparkSession
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = spark.sparkContext.broadcast(fit(docs.select("doc_id", "text"), labels))  # BUCKETS weights
    placed = docs.select(
        "doc_id", F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), "text", *carry
    )
    scored = Scratch(spark, "quality").save(evidence(placed, model, ["doc_id", "host", "path", *carry]), "evidence")
    own = [rate(F.col(f"e_{h}")) for h in HEADS]
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *(F.sum(p).alias(f"s_{h}") for p, h in zip(own, HEADS)))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *(F.sum(f"s_{h}").alias(f"host_s_{h}") for h in HEADS))
    world = hosts.agg(F.sum("host_n"), *(F.sum(f"host_s_{h}") for h in HEADS)).first()
    prior = {h: (world[i + 1] + 0.5) / (world[0] + 1) if world[0] else 0.5 for i, h in enumerate(HEADS)}
    sites = paths.join(hosts, "host")
    for h in HEADS:
        of_host = (F.lit(strength * prior[h]) + F.col(f"host_s_{h}")) / (strength + F.col("host_n"))
        sites = sites.withColumn(f"path_{h}", (strength * of_host + F.col(f"s_{h}")) / (strength + F.col("n")))
    # A path may hold a third of all documents: each site row goes to every salt.
    salted = sites.select("host", "path", *(f"path_{h}" for h in HEADS), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    scored = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "e_quality"), F.lit(SALTS)).cast("int"))
    moved = scored.join(salted, ["host", "path", "salt"])
    odds = {h: F.col(f"e_{h}") + F.log(F.col(f"path_{h}") / (1 - F.col(f"path_{h}"))) - float(np.log(prior[h] / (1 - prior[h]))) for h in HEADS}
    return moved.select(
        "doc_id", "host", "path", *(rate(odds[h]).alias(f"p_{h}") for h in HEADS), *(f"path_{h}" for h in HEADS),
        ((odds["quality"] >= 0) & (rate(odds["toxic"]) < TOXIC_FROM)).alias("keep"), *carry,
    )
