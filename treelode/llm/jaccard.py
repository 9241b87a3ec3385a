"""Exact join of documents by Jaccard similarity of their word shingles, in metric regions.

The distance 1 - J is a metric.  Documents with equal sets are one node from the start.

* Landmarks are single shingles.  Under one global order, rare first, two sets within distance
  t share a shingle among the first floor(t * n) + 1 of each, so a node is replicated to the
  regions of those shingles only.  In each region the node of least priority is the pivot, and
  nodes move on to the regions of their pivots: every close pair meets at a common pivot.
* A region is joined by its pivot.  Nodes within t of it are its ball, linked to it and so to
  each other.  A node y at distance d > t can only be close to ball members x with
  d(x, pivot) >= d - t, and to none if d > 2 t: these windows of the triangle inequality are
  all that is compared.  The ball then leaves, and the rest is joined recursively around its
  next pivot.
* Regions too large for a task lose their balls in distributed steps first.  What is still too
  large is dealt into blocks, and each pair of blocks is joined as a region of its own.

The order is by a sketch of fixed size that counts shingles over all documents; any order gives
the same links, a good one gives small regions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelode.llm.common import Scratch, bytes_of, mix64, one_each, text_slices
from treelode.llm.suffixdedup import powers

WORDS, PERCENT = 5, 75
#: One landmark more for each SPARE shingles, and so one more that close sets must share.
SPARE = 20
BUCKETS = 1 << 18
#: Nodes of a region that one task joins; larger regions take distributed steps, up to ROUNDS.
REGION_NODES, ROUNDS = 4000, 8
#: Region rows that a task holds at once.
HELD_NODES = 2000
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, starts: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes (uint64)."""
    n = len(data)
    out = [np.zeros(0, np.uint64)] * (len(starts) - 1)
    if not n:
        return out
    up, down = powers(n)
    letters = LOWER[data]
    filled = ~SPACES[letters]
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    # A word starts after a space or at a text's start, and ends likewise.
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    begin = np.flatnonzero(filled & (edge[:n] | np.concatenate([[True], ~filled[:-1]])))
    end = np.flatnonzero(filled & (edge[1:] | np.concatenate([~filled[1:], [True]]))) + 1
    word = mix64((prefix[end] - prefix[begin]) * down[begin])
    first = np.searchsorted(begin, starts)
    joined = word[: max(0, len(word) - words + 1)]
    for k in range(1, words):
        joined = mix64(joined + np.uint64(k)) ^ (word[k : len(word) - words + 1 + k] * np.uint64(0xD6E8FEB86659FD93))
    joined = mix64(joined)
    for i in range(len(starts) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            out[i] = np.unique(joined[a : b - words + 1])
        elif b > a:  # the whole sequence; its length keeps it apart from longer ones
            short = np.array([b - a], np.uint64)
            for w in word[a:b]:
                short = mix64(mix64(short) ^ w)
            out[i] = short
    return out


def bucket_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def prefix_length(n: int, percent: int) -> int:
    """Landmarks of a set of n: two sets within t share at least ``1 + m // SPARE`` of them, m
    being the size of the smaller, since so many of their common shingles come that early."""
    return n - (percent * n + 99) // 100 + 1 + n // SPARE if n else 0


def set_id(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def frequency_sketch(texts: DataFrame, words: int) -> np.ndarray:
    """How many (document, shingle) pairs fall into each bucket; BUCKETS numbers for any input."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 19):
                for s in shingle_sets(*bytes_of(part.column("text")), words):
                    if len(s):
                        np.add.at(counts, bucket_of(s), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(task, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def prefixes(texts: DataFrame, order, words: int, percent: int) -> DataFrame:
    """doc, key, n, sid (null for an empty set) and the landmarks of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 19):
                sizes, sids, marks = [], [], []
                for s in shingle_sets(*bytes_of(part.column("text")), words):
                    sizes.append(len(s))
                    sids.append(set_id(s) if len(s) else None)
                    take = prefix_length(len(s), percent)
                    marks.append(s[np.lexsort((s, order.value[bucket_of(s)]))[:take]].view(np.int64) if len(s) else s.view(np.int64))
                flat = np.concatenate(marks)
                offsets = np.concatenate([[0], np.cumsum([len(m) for m in marks])]).astype(np.int32)
                columns = [part.column("doc"), part.column("key"), pa.array(sizes, pa.int32()), pa.array(sids, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "key", "n", "sid", "marks"])

    return texts.select("doc", "key", "text").mapInArrow(task, "doc bigint, key bigint, n int, sid binary, marks array<bigint>")


def common_counts(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of one sorted set with each of others."""
    flat = np.concatenate(many)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    ends = np.cumsum([len(m) for m in many])
    hits = np.concatenate([[0], np.cumsum(one[at] == flat)])
    return np.diff(hits[np.concatenate([[0], ends])])


def distances(one: np.ndarray, many: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard distances, and whether each pair links (decided in whole numbers)."""
    sizes = np.array([len(m) for m in many], np.int64)
    inter = common_counts(one, many)
    union = len(one) + sizes - inter
    return 1 - inter / union, 100 * inter >= percent * union


def join_region(nodes: list[int], sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links that connect all close pairs of a region, by balls around one pivot after another."""
    t, slack = 1 - percent / 100, 1e-9
    sizes = np.array([len(s) for s in sets], np.int64)
    pool = np.argsort(mix64(np.array(nodes, np.int64).view(np.uint64)), kind="stable")
    while len(pool) > 1:
        pivot, rest = pool[0], pool[1:]
        d = np.ones(len(rest))
        link = np.zeros(len(rest), bool)
        # Sets of which one is too small to be within 2 t are far, whatever they hold.
        near = np.flatnonzero(np.minimum(sizes[rest], sizes[pivot]) >= (1 - 2 * t - slack) * np.maximum(sizes[rest], sizes[pivot]))
        if len(near):
            d[near], link[near] = distances(sets[pivot], [sets[i] for i in rest[near]], percent)
        ball, d_ball = rest[link], d[link]
        for x in ball:
            yield nodes[pivot], nodes[x]
        if len(ball):
            for y, d_y in zip(rest[~link], d[~link]):
                if d_y > 2 * t + slack:
                    continue
                window = ball[d_ball >= d_y - t - slack]
                if len(window):
                    _, close = distances(sets[y], [sets[i] for i in window], percent)
                    if close.any():
                        yield nodes[y], nodes[window[close.argmax()]]
        pool = rest[~link]


def regions_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Nodes and sets of one region after another; the input is sorted by region."""
    now, nodes, sets = None, {}, None
    for batch in batches:
        for region, node, content in zip(batch.column("region").to_pylist(), batch.column("node").to_pylist(), batch.column("shingles")):
            if region != now:
                if len(nodes) > 1:
                    yield list(nodes), list(nodes.values())
                now, nodes = region, {}
            nodes.setdefault(node, np.frombuffer(content.as_buffer(), np.uint64))
    if len(nodes) > 1:
        yield list(nodes), list(nodes.values())


def drop_balls(rows: DataFrame, scratch: Scratch, percent: int, number: int) -> tuple[DataFrame, DataFrame]:
    """One distributed step for large regions: links found, and the rows that remain.

    Every row is compared with its region's pivot; the join is one that Spark may split.
    """
    t, slack = 1 - percent / 100, 1e-9
    pivots = rows.groupBy("region").agg(F.min_by(F.struct("node", "shingles"), F.struct(F.xxhash64("node"), "node")).alias("p"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                distances(np.frombuffer(p.as_buffer(), np.uint64), [np.frombuffer(s.as_buffer(), np.uint64)], percent)
                for p, s in zip(batch.column("pivot_set"), batch.column("shingles"))
            ]
            columns = [batch.column(c) for c in ("region", "node", "shingles", "pivot")]
            columns += [pa.array([float(d[0]) for d, _ in found], pa.float64()), pa.array([bool(x[0]) for _, x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["region", "node", "shingles", "pivot", "d", "linked"])

    joined = rows.join(pivots.select("region", F.col("p.node").alias("pivot"), F.col("p.shingles").alias("pivot_set")), "region").where("node <> pivot")
    measured = scratch.save(
        joined.mapInArrow(task, "region bigint, node bigint, shingles binary, pivot bigint, d double, linked boolean"), f"balls-{number}"
    )
    links = measured.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    # Ball members stay only inside the window of the nearest outer node.
    outer = measured.where("not linked").groupBy("region").agg(F.min("d").alias("least"))
    stay = measured.join(outer, "region").where(f"not linked or (least <= {2 * t + slack} and d >= least - {t + slack})")
    return links, stay.select("region", "node", "shingles")


def with_company(cells: DataFrame, percent: int) -> DataFrame:
    """Rows of cells whose next smaller or larger set there may be within t by its size."""
    by_size = Window.partitionBy("cell").orderBy("n", "node")
    beside = cells.withColumn("smaller", F.lag("n").over(by_size)).withColumn("larger", F.lead("n").over(by_size))
    return beside.where(f"100 * smaller >= {percent} * n or 100 * n >= {percent} * larger").select("cell", "node", "n")


def memberships(nodes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """region, node: every node in the regions of its pivots, and each pivot in its own.

    ``nodes`` has node, n and marks, one row per distinct set.  A node with fewer cells that
    hold company than close sets share has no close set; taking such nodes out takes company
    from others, so that is done twice.  A node leaves regions that hold few of its cells.
    """
    # A node has one row in a cell, so even a landmark of all nodes has no more rows than nodes.
    cells = scratch.save(with_company(nodes.select("node", "n", F.explode("marks").alias("cell")).repartition("cell"), percent), "cells-0")
    for number in (1, 2):
        enough = cells.groupBy("node", "n").agg(F.count(F.lit(1)).alias("held"))
        enough = enough.where(f"held >= 1 + floor(floor({percent} * n / 100) / {SPARE})").select("node")
        cells = scratch.save(with_company(cells.join(enough, "node").repartition("cell"), percent), f"cells-{number}")
        scratch.drop(f"cells-{number - 1}")
    pivots = cells.groupBy("cell").agg(F.min(F.struct(F.xxhash64("node"), "node")).alias("pivot"))
    placed = cells.join(pivots.select("cell", F.col("pivot.node").alias("region")), "cell")
    placed = placed.groupBy("region", "node", "n").agg(F.count(F.lit(1)).alias("held"))
    # Two close sets share at least as many cells as each of them must.  If each leaves regions
    # with less than half of that in all, one shared cell's region still holds both.
    least_first = Window.partitionBy("node").orderBy("held", "region").rowsBetween(Window.unboundedPreceding, 0)
    left = placed.withColumn("left", F.sum("held").over(least_first))
    kept = left.where(f"2 * left >= 1 + floor(floor({percent} * n / 100) / {SPARE})").select("region", "node")
    kept = scratch.save(kept, "kept")
    shared = kept.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("region")
    return kept.join(shared, "region")


def region_rows(texts: DataFrame, nodes: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """region, node, shingles of the given memberships, each set made from its text.

    ``nodes`` has node, doc, key and sid.
    """
    wanted = members.groupBy("node").agg(F.collect_list("region").alias("regions")).join(nodes, "node")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 19):
                regions, owners, contents = [], [], []
                rows = zip(shingle_sets(*bytes_of(part.column("text")), words), part.column("sid").to_pylist(), part.column("node").to_pylist(), part.column("regions").to_pylist())
                for s, sid, node, own in rows:
                    if set_id(s) == sid:  # else another text under the same id and key
                        regions += own
                        owners += [node] * len(own)
                        contents += [s.tobytes()] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(regions, pa.int64()), pa.array(owners, pa.int64()), pa.array(contents, pa.binary())], ["region", "node", "shingles"])

    joined = texts.join(wanted, ["doc", "key"]).select("text", "sid", "node", "regions")
    return joined.mapInArrow(task, "region bigint, node bigint, shingles binary")


def block_pairs(rows: DataFrame, region_nodes: int) -> DataFrame:
    """The rows of regions, those of regions above ``region_nodes`` once for each pair of blocks
    that holds theirs: two nodes of a region share a pair, and a pair about ``region_nodes`` rows."""
    sizes = rows.groupBy("region").agg(F.ceil(2 * F.count(F.lit(1)) / F.lit(region_nodes)).cast("int").alias("blocks")).where("blocks > 2")
    placed = rows.join(sizes, "region", "left")
    own = F.pmod(F.xxhash64("node", "region"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = placed.withColumn("own", own).withColumn("other", F.explode(others))
    pair = F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other"))
    # With itself alone a block is part of its pairs with the others.
    return paired.where("blocks is null or own <> other").select(F.when(F.col("blocks").isNull(), F.col("region")).otherwise(pair).alias("region"), "node", "shingles")


def links_of(texts: DataFrame, nodes: DataFrame, members: DataFrame, scratch: Scratch, words: int, percent: int, region_nodes: int) -> DataFrame:
    """a, b: links that connect exactly the nodes connected by close pairs."""
    size = F.count(F.lit(1)).alias("size")
    large = members.groupBy("region").agg(size).where(F.col("size") > region_nodes).select("region")
    found: list[DataFrame] = []
    if large.isEmpty():
        rows = region_rows(texts, nodes, members, words)
    else:
        rows = region_rows(texts, nodes, members.join(large, "region", "left_anti"), words)
        waiting = region_rows(texts, nodes, members.join(large, "region", "left_semi"), words).dropDuplicates(["region", "node"])
        waiting = scratch.save(waiting, "waiting-0")
        for number in range(1, ROUNDS + 1):
            links, waiting = drop_balls(waiting, scratch, percent, number)
            found.append(links)
            waiting = scratch.save(waiting, f"waiting-{number}")
            scratch.drop(f"waiting-{number - 1}")
            if waiting.groupBy("region").agg(size).where(F.col("size") > region_nodes).isEmpty():
                break
        rows = rows.unionByName(block_pairs(waiting, region_nodes))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, sets in regions_of(batches):
            pairs = list(join_region(own, sets, percent))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    out = rows.repartition("region").sortWithinPartitions("region").mapInArrow(task, "a bigint, b bigint")
    for links in found:
        out = out.unionByName(links)
    return out


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label: the smallest node reachable, by taking neighbours' labels and then the
    label's own label, until nothing changes."""
    links = scratch.save(links.distinct(), "links")
    both = links.unionAll(links.select("b", "a")).toDF("node", "other")
    labels = scratch.save(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels-0")
    number = 0
    while True:
        number += 1
        offered = both.join(labels.toDF("other", "label"), "other").select("node", "label").unionAll(labels)
        best = offered.groupBy("node").agg(F.min("label").alias("label"))
        jumped = best.join(labels.toDF("label", "further"), "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"))
        new = scratch.save(jumped, f"labels-{number}")
        changed = not new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty()
        scratch.drop(f"labels-{number - 1}") if number > 1 else None
        labels = new
        if not changed:
            return labels


def grouped(
    docs: DataFrame, key: Column, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, percent: int = PERCENT, region_nodes: int = REGION_NODES,
) -> DataFrame:
    """The rows of ``join`` with ``key``, a bigint that tells rows of one id and different texts
    apart, and ``component``: a number for the component, null for rows without shingles."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    no_id = -(1 << 63)
    texts = docs.where(F.octet_length(text_column) > 0).select(F.coalesce(F.col(id_column).cast("long"), F.lit(no_id)).alias("doc"), key.alias("key"), F.col(text_column).alias("text"))
    order = docs.sparkSession.sparkContext.broadcast(frequency_sketch(texts, words))  # BUCKETS numbers
    rows = prefixes(texts, order, words, percent).withColumn("node", F.monotonically_increasing_id())
    rows = scratch.save(rows, "sets")
    slim = scratch.save(rows.drop("marks"), "slim")
    filled = slim.where("sid is not null")
    known = F.when(F.col("doc") != no_id, F.col("doc"))
    heads = scratch.save(filled.groupBy("sid").agg(F.min("node").alias("node"), F.min(known).alias("least")), "heads")
    nodes = filled.join(heads.select("node"), "node", "left_semi").select("node", "doc", "key", "sid")
    members = scratch.save(memberships(rows.join(heads.select("node"), "node", "left_semi"), scratch, percent), "members")
    scratch.drop("sets")
    labels = components(links_of(one_each(texts, "doc", "key"), nodes, members, scratch, words, percent, region_nodes), scratch)
    labelled = heads.join(labels, "node")
    groups = labelled.groupBy("label").agg(F.min("least").alias("component"))
    linked = labelled.join(groups, "label").select("sid", "component", "label")
    classes = heads.join(linked, "sid", "left").select("sid", F.coalesce("component", "least").alias("component"), F.coalesce("label", "node").alias("label"))
    whole = filled.select("doc", "key", "n", "sid").join(classes, "sid").select("doc", "key", "n", "component", "label")
    none = slim.where("sid is null").select("doc", "key", "n", known.alias("component"), F.lit(None).cast("long").alias("label"))
    blank = docs.where(F.coalesce(F.octet_length(text_column), F.lit(0)) == 0).select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(no_id)).alias("doc"), key.alias("key"), F.lit(0).alias("n"), F.col(id_column).cast("long").alias("component"),
        F.lit(None).cast("long").alias("label"),
    )
    out = whole.unionAll(none).unionAll(blank)
    return out.select(known.alias(id_column), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), "key", F.col("label").alias("component"))


def join(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, percent: int = PERCENT, region_nodes: int = REGION_NODES,
) -> DataFrame:
    """One row per input row: id, ``n_shingles`` and ``component_id``, the smallest id reachable
    by links (100 * intersection >= percent * union), itself included.

    Texts with fewer words than a shingle are one shingle; a null text, or one without words,
    has none and is linked with nothing.  Null ids come last: a component's id is null only if
    all of its ids are.  Repeated rows and rows that share an id are nodes by their text.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = grouped(docs, F.xxhash64(text_column), id_column, text_column, words, percent, region_nodes)
    return rows.select(id_column, "n_shingles", "component_id")
