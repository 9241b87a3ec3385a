"""Removal of repeated byte strings by a column-wise suffix order over many documents.

A byte goes when it lies in a string of ``length`` bytes that also starts earlier: in a document
with a smaller id, or before it in its own.  Documents that share an id, or have none, are told
apart and ordered by a hash of their text, their ``twin``.

* Every window of ``length`` bytes has an anchor: the position of the least hash among its short
  grams, the first if there are several.  Equal windows have equal anchors at the same place, so
  all windows that may be equal meet under their anchor's gram.  A run of windows with one anchor
  travels once, as its bytes: a short document of its own.
* Runs are dealt out to as many buckets as keep one small, in compressed blocks.
* A task takes the runs of its grams as a collection, aligned at the anchor, and builds their
  suffix order column by column: each round inserts one symbol per run, the one before its
  suffix.  The column of symbols in the present order is the collection's Burrows-Wheeler
  transform; sorting it stably gives the next order, and the common prefixes of neighbours grow
  by one or fall to zero.  The columns wait in an external file that is read front to back.
* Once suffixes are ``length`` long, neighbours with that common prefix are equal windows; all
  but the earliest are marked.

Grams that hold more than a small share of all runs (found by a sketch of fixed size over all
texts) are keyed by nearly the whole window instead, and salted: each salt keeps the earliest of
equal windows, and what survives meets in a second, small round.  The number of salts follows
the sketch.  Where a part of the data holds many runs under one gram (padding, one repeated byte),
equal ones are folded first: the earliest travels, the ranges of the others are marked there.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelode.llm.common import Scratch, bytes_of, mix64, one_each, per_process, text_slices

LENGTH, GRAM = 100, 16
#: Buckets of the sketch, and the runs a bucket may hold: a share of all, and a number.
BUCKETS, HOT_SHARE, HOT_RUNS = 1 << 18, 4096, 200_000
#: Windows that a hot run keeps together, least salts, and hot runs for each salt.
HOT_WINDOWS, SALTS, SALT_RUNS = 8, 16, 25_000
#: Runs of a part under one gram from which equal ones are folded, and bytes gathered at once.
FOLD_RUNS, GATHER_BYTES = 16, 4 << 20
#: Runs of a bucket, which are ordered together, and bytes of text hashed together.
BLOCK_RUNS, PART_BYTES = 25_000, 1 << 19
#: Run bytes that a task deals out to the buckets at once.
DEAL_BYTES = 16 << 20
BASE = 0x9E3779B97F4A7C15
NO_ID = -(1 << 63)
ROW = "key bigint, salt int, hot boolean, doc bigint, twin bigint, pos bigint, lead int, seg binary"
RUN = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("hot", pa.bool_()), ("doc", pa.int64()), ("twin", pa.int64()), ("pos", pa.int64()), ("lead", pa.int32()), ("seg", pa.binary())])
DOC = RUN.get_field_index("doc")
FOUND = f"start bigint, stop bigint, {ROW}"


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i up to n."""
    held = per_process(("powers",), dict)
    if "up" not in held or len(held["up"]) <= n:
        size = max(n + 1, PART_BYTES + 4096)
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            held[name] = np.multiply.accumulate(out)
    return held["up"], held["down"]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


class Runs:
    """Runs of windows with one anchor in one part of the data: arrays ``doc`` (row in the
    part), ``first`` and ``last`` window start, ``anchor``, ``key``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> None:
        n = len(data)
        self.starts = starts
        self.prefix = np.zeros(0, np.uint64)
        self.first = self.last = self.anchor = self.doc = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.int64)
        if n < length:
            return
        up, down = powers(n)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.prefix[1:])
        hashes = mix64((self.prefix[gram:] - self.prefix[:-gram]) * down[: n - gram + 1])
        place = np.arange(len(hashes), dtype=np.uint64)
        least = sliding_min((hashes & ~np.uint64(0xFFFFFF)) | place, length - gram + 1) & np.uint64(0xFFFFFF)
        inside = np.zeros(n - length + 2, np.int32)
        long = np.flatnonzero(np.diff(starts) >= length)
        np.add.at(inside, starts[long], 1)
        np.add.at(inside, starts[long + 1] - length + 1, -1)
        at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        if not len(at):
            return
        anchor = least[at].astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        self.anchor, self.first = anchor[begins], at[begins]
        self.last = at[np.concatenate([begins[1:], [len(at)]]) - 1]
        self.doc = np.searchsorted(starts, self.first, side="right") - 1
        self.key = mix64(hashes[self.anchor]).view(np.int64)

    def hash_of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges, equal for equal bytes wherever they stand."""
        _, down = powers(len(self.prefix))
        return mix64((self.prefix[stop] - self.prefix[start]) * down[start])


def bucket_of(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def parts_of(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, row starts, document ids, twins and offsets inside the documents; a very long text comes
    in pieces that overlap by ``length - 1`` bytes, so each window is in exactly one."""
    for part in text_slices(batch, "text", PART_BYTES, rows=20_000):
        data, starts = bytes_of(part.column("text"))
        ids, twins = part.column("doc").to_numpy(), part.column("twin").to_numpy()
        if part.num_rows == 1 and len(data) > PART_BYTES:
            for at in range(0, len(data) - length + 1, PART_BYTES):
                piece = data[at : at + PART_BYTES + length - 1]
                yield piece, np.array([0, len(piece)]), ids, twins, np.array([at])
        else:
            yield data, starts, ids, twins, np.zeros(len(ids), np.int64)


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary array of the given ranges of ``data``."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(offsets[-1], np.uint8)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + GATHER_BYTES, side="right")) - 1)
        index = np.repeat(start[a:b] - offsets[a:b], size[a:b]) + np.arange(offsets[a], offsets[b])
        out[offsets[a] : offsets[b]] = data[index]
        a = b
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def fold(runs: Runs, data: np.ndarray, columns: list[np.ndarray], age: tuple[np.ndarray, ...], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pieces of runs travel, and which of the others are later than the equal piece that
    does.  ``columns`` has key, document, first, last and lead of each piece, ``age`` what
    orders them, the most important last."""
    key, _, first, last, lead = columns
    n = len(key)
    travels, later = np.ones(n, bool), np.zeros(n, bool)
    within = bucket_of(key)
    some = np.flatnonzero(np.bincount(within, minlength=BUCKETS)[within] > FOLD_RUNS) if n else np.zeros(0, np.int64)
    if not len(some):
        return travels, later
    size = last - first + length
    content = runs.hash_of(first[some], first[some] + size[some])
    order = some[np.lexsort((*(a[some] for a in age), content, size[some], lead[some], key[some]))]
    content = runs.hash_of(first[order], first[order] + size[order])
    new = np.ones(len(order), bool)
    new[1:] = content[1:] != content[:-1]
    for c in (key, size, lead):
        new[1:] |= c[order][1:] != c[order][:-1]
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    copies, heads = order[~new], head[~new]
    same = np.ones(len(copies), bool)
    for j in range(int(size[copies].max()) if len(copies) else 0):
        inside = j < size[copies]
        at, other = np.where(inside, first[copies] + j, 0), np.where(inside, first[heads] + j, 0)
        same &= data[at] == data[other]
    copies, heads = copies[same], heads[same]
    travels[copies] = False
    later[copies] = np.logical_or.reduce([a[copies] != a[heads] for a in age])
    return travels, later


def run_rows(runs: Runs, data: np.ndarray, ids: np.ndarray, twins: np.ndarray, base: np.ndarray, length: int, salts: np.ndarray, before: int) -> pa.RecordBatch:
    """Rows of all runs; those under a hot gram are split at fixed distances from the anchor
    and keyed by the bytes that all windows of such a split share.  ``salts`` has their number
    for each bucket, 0 if cold.  Ranges that are marked here have a negative lead and their end
    as key."""
    lead = before - (runs.anchor - runs.first)
    is_hot = salts[bucket_of(runs.key)] > 0 if len(runs.key) else np.zeros(0, bool)
    cold = ~is_hot
    pieces = [(runs.key[cold], np.zeros(cold.sum(), np.int32), runs.doc[cold], runs.first[cold], runs.last[cold], lead[cold], False)]
    if is_hot.any():
        key, doc, first, last, lead_h = runs.key[is_hot], runs.doc[is_hot], runs.first[is_hot], runs.last[is_hot], lead[is_hot]
        split = lead_h // HOT_WINDOWS
        count = (lead_h + last - first) // HOT_WINDOWS - split + 1
        row = np.repeat(np.arange(len(key)), count)
        split = split[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        zero = first[row] - lead_h[row]  # the place of column 0
        low = np.maximum(first[row], zero + split * HOT_WINDOWS)
        high = np.minimum(last[row], zero + split * HOT_WINDOWS + HOT_WINDOWS - 1)
        common = runs.hash_of(zero + split * HOT_WINDOWS + HOT_WINDOWS - 1, zero + split * HOT_WINDOWS + length)
        own = mix64(common ^ key[row].view(np.uint64) + (split.astype(np.uint64) << np.uint64(40))).view(np.int64)
        place = (base[doc[row]] + low - runs.starts[doc[row]]).astype(np.uint64)
        dealt_by = mix64(mix64(ids[doc[row]].view(np.uint64)) + twins[doc[row]].view(np.uint64)) + place * np.uint64(BASE)
        salt = (mix64(dealt_by) % salts[bucket_of(key)][row].astype(np.uint64)).astype(np.int32)
        pieces.append((own, salt, doc[row], low, high, low - zero, True))
    key, salt, doc, first, last, lead = (np.concatenate([p[i] for p in pieces]) for i in range(6))
    flag = np.concatenate([np.full(len(p[0]), p[6]) for p in pieces])
    pos = base[doc] + first - runs.starts[doc]
    travels, later = fold(runs, data, [key, doc, first, last, lead], (pos, twins[doc], ids[doc]), length)
    # Marked runs that touch make one range.
    gone = np.flatnonzero(later)
    gone = gone[np.lexsort((first[gone], doc[gone]))]
    d, a, b = doc[gone], pos[gone], pos[gone] + last[gone] - first[gone] + length
    begins = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] > b[:-1])])) if len(gone) else gone
    ends = np.maximum.reduceat(b, begins) if len(gone) else b
    key, salt, flag, doc, pos, lead, first, last = (c[travels] for c in (key, salt, flag, doc, pos, lead, first, last))
    seg = gather(data, np.append(first, np.zeros(len(begins), np.int64)), np.append(last - first + length, np.zeros(len(begins), np.int64)))
    doc = np.append(doc, d[begins])
    columns = [
        pa.array(np.append(key, ends)), pa.array(np.append(salt, np.zeros(len(begins))).astype(np.int32)), pa.array(np.append(flag, np.zeros(len(begins), bool))),
        pa.array(ids[doc]), pa.array(twins[doc]), pa.array(np.append(pos, a[begins])), pa.array(np.append(lead, np.full(len(begins), -1)).astype(np.int32)), seg,
    ]
    return pa.RecordBatch.from_arrays(columns, RUN.names)


def mark_equal(group: np.ndarray, age: np.ndarray, lead: np.ndarray, aligned: np.ndarray, length: int, before: int) -> np.ndarray:
    """For each run and each column where a window may start: whether an equal window of the
    same group is older.  ``aligned`` holds byte + 1 by column, 0 where a run has no byte."""
    m, width = aligned.shape
    marked = np.zeros((m, before + 1), bool)
    order = np.argsort(group, kind="stable")
    common = np.zeros(m, np.int32)
    with tempfile.TemporaryFile() as columns:
        for c in range(width - 1, -1, -1):
            columns.write(aligned[:, c].tobytes())
        columns.seek(0)
        for c in range(width - 1, -1, -1):
            column = np.frombuffer(columns.read(2 * m), np.uint16)
            transform = column[order]
            rank = group[order] * 257 + transform
            if len(rank) > 1 and (rank[1:] < rank[:-1]).any():
                moved = np.argsort(rank, kind="stable")
                rank, transform = rank[moved], transform[moved]
            else:
                moved = np.arange(len(rank))
            grown = np.zeros(len(rank), np.int32)
            same = np.flatnonzero((rank[1:] == rank[:-1]) & (transform[1:] > 0)) + 1
            p, q = moved[same - 1], moved[same]
            near = q == p + 1
            grown[same[near]] = common[q[near]] + 1
            if not near.all():
                far = ~near
                bounds = np.empty(2 * int(far.sum()), np.int64)
                bounds[0::2], bounds[1::2] = p[far] + 1, q[far] + 1
                grown[same[far]] = np.minimum.reduceat(np.append(common, 0), bounds)[::2] + 1
            order, common = order[moved], grown
            if c <= before:
                equal = common >= length
                if equal.any():
                    begins = np.flatnonzero(~equal)
                    oldest = np.minimum.reduceat(age[order], begins)
                    run = np.cumsum(~equal) - 1
                    later = age[order] > oldest[run]
                    marked[order[later], c] = True
            if c % 8 == 0 and len(order) > 1:
                # A run stays while its best common prefix may still reach the full length.
                best = np.maximum(common, np.append(common[1:], 0))
                stays = np.flatnonzero(best + (c - lead[order]) >= length)
                if not len(stays):
                    break
                if len(stays) < len(order):
                    common = np.minimum.reduceat(common[: stays[-1] + 1], np.concatenate([[0], stays[:-1] + 1]))
                    order = order[stays]
    return marked


def resolve(key: np.ndarray, salt: np.ndarray, doc: np.ndarray, twin: np.ndarray, pos: np.ndarray, lead: np.ndarray, seg: pa.Array, length: int, before: int) -> np.ndarray:
    """``marked`` for the runs of whole groups (key, salt)."""
    m = len(key)
    marked = np.zeros((m, before + 1), bool)
    order = np.lexsort((salt, key))
    new = np.ones(m, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (salt[order][1:] != salt[order][:-1])
    group = np.empty(m, np.int64)
    group[order] = np.cumsum(new) - 1
    live = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(live):
        return marked
    data, starts = bytes_of(seg)
    size = np.diff(starts)[live]
    group, lead_l = group[live], lead[live].astype(np.int64)
    width = before + length
    aligned = np.zeros((len(live), -(-width // 4) * 4), np.uint16)
    into = np.repeat(np.arange(len(live)) * aligned.shape[1] + lead_l - (np.cumsum(size) - size), size) + np.arange(size.sum())
    source = np.repeat(starts[live] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    aligned.ravel()[into] = data[source].astype(np.uint16) + 1
    # Equal ages are one place of one document in repeated rows.
    by_age = np.lexsort((pos[live], twin[live], doc[live]))
    d, t, p = doc[live][by_age], twin[live][by_age], pos[live][by_age]
    age = np.empty(len(live), np.int64)
    age[by_age] = np.cumsum(np.concatenate([[0], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1])]))
    # Equal runs: only the oldest of them goes into the order.
    words = aligned.view(np.uint64)
    factor = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, words.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    content = mix64((mix64(words * factor + factor)).sum(1, dtype=np.uint64))
    order = np.lexsort((age, content, group))
    new = np.ones(len(order), bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (content[order][1:] != content[order][:-1])
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    same = np.empty(len(order), np.int64)
    same[order] = head
    differs = (aligned != aligned[same]).any(1)
    same[differs] = np.flatnonzero(differs)
    heads = np.flatnonzero(same == np.arange(len(same)))
    several = np.bincount(group[heads], minlength=group.max() + 1)[group[heads]] > 1
    heads = heads[several]
    out = np.zeros((len(live), before + 1), bool)
    if len(heads):
        out[heads] = mark_equal(group[heads], age[heads], lead_l[heads], aligned[heads][:, :width], length, before)
    copies = np.flatnonzero(same != np.arange(len(same)))
    out[copies] = out[same[copies]]
    later = copies[age[copies] > age[same[copies]]]
    column = np.arange(before + 1)
    out[later] = (column >= lead_l[later, None]) & (column <= (lead_l + size - length)[later, None])
    marked[live] = out
    return marked


def found_rows(block: pa.RecordBatch, length: int, before: int) -> Iterator[pa.RecordBatch]:
    """Marked byte ranges of a block of whole groups, and the hot runs that survive it."""
    marked_before = pc.less(block.column("lead"), 0)
    if pc.any(marked_before).as_py():
        known, block = block.filter(marked_before), block.filter(pc.invert(marked_before))
        blank = [pa.nulls(known.num_rows, kind) for kind in (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary())]
        yield pa.RecordBatch.from_arrays([known.column("pos"), known.column("key"), *blank[:3], known.column("doc"), known.column("twin"), *blank[3:]], FOUND_NAMES)
        if not block.num_rows:
            return
    key, salt, doc, twin, pos, lead = (block.column(c).to_numpy() for c in ("key", "salt", "doc", "twin", "pos", "lead"))
    hot = block.column("hot").to_numpy(zero_copy_only=False)
    seg = block.column("seg")
    marked = resolve(key, salt, doc, twin, pos, lead, seg, length, before)
    padded = np.zeros((len(key), before + 3), np.int8)
    padded[:, 1:-1] = marked
    step = np.diff(padded, axis=1)
    row, low = np.nonzero(step == 1)
    high = np.nonzero(step == -1)[1] - 1
    if len(row):
        start = pos[row] + low - lead[row]
        blank = [pa.nulls(len(row), kind) for kind in (pa.int64(), pa.int32(), pa.bool_())]
        columns = [pa.array(start), pa.array(start + (high - low) + length), *blank, pa.array(doc[row]), pa.array(twin[row]), pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.int32()), pa.nulls(len(row), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, FOUND_NAMES)
    sizes = np.diff(bytes_of(seg)[1])
    column = np.arange(before + 1)
    hot_rows = np.flatnonzero(hot)
    if len(hot_rows):
        own = (column >= lead[hot_rows, None]) & (column <= (lead + sizes - length)[hot_rows, None])
        left = own & ~marked[hot_rows]
        some = left.any(1)
        rows, left = hot_rows[some], left[some]
        if len(rows):
            low, high = left.argmax(1), before - left[:, ::-1].argmax(1)
            data, starts = bytes_of(seg)
            cut = gather(data, starts[rows] + low - lead[rows], high - low + length)
            columns = [
                pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array(key[rows]), pa.array(np.zeros(len(rows), np.int32)), pa.array(np.zeros(len(rows), bool)),
                pa.array(doc[rows]), pa.array(twin[rows]), pa.array(pos[rows] + low - lead[rows]), pa.array(low.astype(np.int32)), cut,
            ]
            yield pa.RecordBatch.from_arrays(columns, FOUND_NAMES)


FOUND_NAMES = [part.split()[0] for part in FOUND.split(", ")]


def dealt(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Runs as compressed blocks, one for each bucket that a share of them falls into; document
    ids are stored as steps."""
    import zstandard

    writer = zstandard.ZstdCompressor(level=6)

    def packed(share: pa.RecordBatch) -> bytes:
        steps = np.diff(share.column("doc").to_numpy(), prepend=0)
        return writer.compress(pa.concat_batches([share.set_column(DOC, "doc", pa.array(steps))]).serialize())

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        own = mix64(block.column("key").to_numpy().view(np.uint64) + block.column("salt").to_numpy().astype(np.uint64) * np.uint64(BASE)) % np.uint64(buckets)
        order = np.argsort(own, kind="stable")
        block, own = block.take(pa.array(order)), own[order]
        edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        blobs = [packed(block.slice(a, b - a)) for a, b in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(own[edges[:-1]].astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "runs"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= DEAL_BYTES:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of one bucket after the other; the input is sorted by bucket."""
    import zstandard

    reader = zstandard.ZstdDecompressor()
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("runs")):
            if bucket != now and held:
                yield pa.concat_batches(held)
                held = []
            now = bucket
            share = pa.ipc.read_record_batch(pa.py_buffer(reader.decompress(memoryview(blob.as_buffer()))), RUN)
            held.append(share.set_column(DOC, "doc", pa.array(np.cumsum(share.column("doc").to_numpy()))))
    if held:
        yield pa.concat_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of about ``rows`` rows that never split a group; the input is sorted by group."""
    held: list[pa.RecordBatch] = []
    count = 0

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=None)[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        if count >= rows:
            key, salt = batch.column("key").to_numpy(), batch.column("salt").to_numpy()
            last_key, last_salt = held[-1].column("key")[-1].as_py(), held[-1].column("salt")[-1].as_py()
            other = np.flatnonzero((key != last_key) | (salt != last_salt))
            if len(other):
                if other[0]:
                    held.append(batch.slice(0, int(other[0])))
                yield joined(held)
                held, count = [], 0
                batch = batch.slice(int(other[0]))
        held.append(batch)
        count += batch.num_rows
    if held:
        yield joined(held)


def marked_ranges(docs: DataFrame, length: int, gram: int, scratch: Scratch, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc, twin, start, stop of byte ranges to remove (they may overlap); ``docs`` has doc, twin and text."""
    before = length - gram

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for data, starts, *_ in parts_of(batch, length):
                counts += np.bincount(bucket_of(Runs(data, starts, length, gram).key), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["bucket", "n"])

    counts = docs.mapInArrow(sketch, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    n = table["n"].to_numpy()
    salts = np.zeros(BUCKETS, np.int32)
    hot = n > max(64, min(hot_runs, int(n.sum()) // HOT_SHARE))
    salts[table["bucket"].to_numpy()[hot]] = np.maximum(SALTS, n[hot] // SALT_RUNS)
    shared = docs.sparkSession.sparkContext.broadcast(salts)  # BUCKETS numbers, whatever the input

    buckets = 1 + int(n.sum()) // BLOCK_RUNS

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data, starts, ids, twins, base in parts_of(batch, length):
                    runs = Runs(data, starts, length, gram)
                    if len(runs.key):
                        yield run_rows(runs, data, ids, twins, base, length, shared.value, before)

        return dealt(rows(), buckets)

    def solve_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches):
            yield from found_rows(block, length, before)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches, BLOCK_RUNS):
            yield from found_rows(block, length, before)

    order = ["key", "salt"]
    rows = docs.mapInArrow(emit, "bucket bigint, runs binary").repartition("bucket").sortWithinPartitions("bucket")
    first = scratch.save(rows.mapInArrow(solve_dealt, FOUND), "first")
    again = first.where("start is null").select(*RUN.names)
    second = again.repartition(*order).sortWithinPartitions(*order).mapInArrow(solve, FOUND)
    columns = ["doc", "twin", "start", "stop"]
    return first.where("start is not null").select(*columns).unionByName(second.select(*columns))


def twin_of(docs: DataFrame, id_column: str, text_column: str) -> Column:
    """What tells the documents of one id apart: a hash of the text, or 0 for every row with an
    id where no id has two texts, since a hash for each run takes space."""
    doc, text = F.col(id_column).cast("long"), F.xxhash64(F.col(text_column))
    several = docs.where(doc.isNotNull()).groupBy(doc.alias("doc")).agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b")
    return F.when(doc.isNull(), text).otherwise(F.lit(0).cast("long")) if several.isEmpty() else text


def cut(texts: DataFrame, ranges: DataFrame, twin: Column, id_column: str, text_column: str, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """id, carried columns, ``kept``, ``n_bytes`` and ``spans``: the marked ranges joined to
    their documents.  ``kept`` is bytes, or a text without what is left of characters cut in two."""
    lists = ranges.groupBy("doc", "twin").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    plain = texts.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), twin.alias("twin"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)))
    held = ["id", *(f"carry_{i}" for i in range(len(carry)))]
    kinds = ", ".join(f"{c} {plain.schema[c].dataType.simpleString()}" for c in held)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                data, starts = bytes_of(part.column("text"))
                lists = part.column("ranges")
                out: list[tuple] = []
                for i in range(part.num_rows):
                    own = data[starts[i] : starts[i + 1]]
                    gone = np.zeros(len(own) + 1, np.int32)
                    if lists[i].is_valid:
                        fields = lists[i].values
                        np.add.at(gone, fields.field("start").to_numpy(), 1)
                        np.add.at(gone, fields.field("stop").to_numpy(), -1)
                    gone = np.cumsum(gone) > 0
                    edges = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
                    spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
                    kept = own[~gone[:-1]].tobytes()
                    out.append((kept.decode("utf-8", "ignore") if as_text else kept, len(own), [{"start": a, "stop": b} for a, b in spans]))
                columns = [*(part.column(c) for c in held), pa.array([o[0] for o in out], pa.string() if as_text else pa.binary()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], span)]
                yield pa.RecordBatch.from_arrays(columns, [*held, "kept", "n_bytes", "spans"])

    plain = plain.withColumn("doc", F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)))
    joined = plain.join(lists, ["doc", "twin"], "left").select(*held, "text", "ranges")
    out = joined.mapInArrow(task, f"{kinds}, kept {'string' if as_text else 'binary'}, n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>")
    return out.toDF(id_column, *carry, "kept", "n_bytes", "spans")


def deduplicate(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM, hot_runs: int = HOT_RUNS,
    carry: tuple[str, ...] = (), as_text: bool = False,
) -> DataFrame:
    """One row per input row: id, ``kept`` (remaining bytes), ``n_bytes``, ``spans`` removed.

    A null text is empty.  A null id counts as smaller than any other.  Repeated rows with one
    id and text are one document, each row getting its result; rows with one id, or none, and
    different texts are documents of their own.  Texts shorter than ``length`` only keep.  Columns in ``carry`` come along, others are ignored; an empty table gives no
    rows.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    twin = twin_of(docs, id_column, text_column)
    plain = docs.where(F.octet_length(text_column) >= length).select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc"), twin.alias("twin"), F.col(text_column).alias("text")
    )
    return cut(docs, marked_ranges(one_each(plain, "doc", "twin"), length, gram, scratch, hot_runs), twin, id_column, text_column, carry, as_text)


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """The documents with their remaining text and its length; all columns stay."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    texts = deduplicate(docs, carry=others, as_text=True).withColumnRenamed("kept", "text")
    if "n_chars" in docs.columns:
        texts = texts.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return texts.select(*docs.columns)
