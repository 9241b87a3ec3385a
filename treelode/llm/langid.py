"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, fixed by its code point.  A letter trigram is
bound as the product of its letters' vectors, each rotated by its place; a text is the bundle
(sum) of its trigrams, and a language the bundle of its training texts.  A text gets the
language with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelode.llm.common import per_process, text_slices

DIMENSIONS = 1024
UNKNOWN = "und"
#: Trigrams whose vectors are expanded at once.
BLOCK = 4096


def letter_table() -> np.ndarray:
    """For each code point of the basic plane: whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def letter_vectors(letters: np.ndarray, dimensions: int) -> np.ndarray:
    """A row of +1 and -1 for each code point."""
    known = per_process(("letters", dimensions), dict)
    for c in letters.tolist():
        if c not in known:
            bits = np.random.Generator(np.random.PCG64(c)).integers(0, 2, dimensions)
            known[c] = (bits * 2 - 1).astype(np.float32)
    return np.stack([known[c] for c in letters.tolist()]) if len(letters) else np.zeros((0, dimensions), np.float32)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, trigram number and count of each distinct pair, and the trigrams' three letters.

    Letters are lower-cased; anything else is one space between words and at both ends.
    """
    joined = "\0".join(t.replace("\0", " ") for t in texts).lower()
    points = np.frombuffer(f"\0{joined}\0".encode("utf-32-le"), np.uint32)
    is_letter = per_process(("is letter",), letter_table)[np.minimum(points, 0xFFFF)]
    for at in np.flatnonzero(points > 0xFFFF):
        is_letter[at] = chr(points[at]).isalpha()
    row = np.cumsum(points == 0) - 1
    points = np.where(is_letter, points, 32)
    keep = np.ones(len(points), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]  # the first of each run of others stands for the run
    ends = np.flatnonzero(row[1:] != row[:-1]) + 1
    keep[ends] = True  # a space of the next text's own
    points, row = points[keep].astype(np.int64), row[keep]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros((0, 3), np.int64)
    code = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    # A trigram belongs to one text, or ends with the space that opens the next.
    same = (row[:-2] == row[1:-1]) & (points[1:-1] != 32)
    code, owner = code[same], row[:-2][same]
    distinct, number = np.unique(code, return_inverse=True)
    cell, count = np.unique(owner * max(1, len(distinct)) + number, return_counts=True)
    letters = np.stack([distinct >> 42, (distinct >> 21) & 0x1FFFFF, distinct & 0x1FFFFF], 1)
    return cell // max(1, len(distinct)), cell % max(1, len(distinct)), count.astype(np.float32), letters


def bundles(n_rows: int, grams: tuple, dimensions: int) -> np.ndarray:
    """One vector per text: the sum of its trigrams' bound vectors."""
    row, number, count, letters = grams
    out = np.zeros((n_rows, dimensions), np.float32)
    alphabet, place = np.unique(letters, return_inverse=True)
    place = place.reshape(letters.shape)
    base = letter_vectors(alphabet, dimensions)
    turned = [np.roll(base, 2, 1), np.roll(base, 1, 1), base]
    for start in range(0, len(letters), BLOCK):
        block = place[start : start + BLOCK]
        bound = turned[0][block[:, 0]] * turned[1][block[:, 1]] * turned[2][block[:, 2]]
        of_block = (number >= start) & (number < start + BLOCK)
        counts = np.zeros((n_rows, len(block)), np.float32)
        counts[row[of_block], number[of_block] - start] = count[of_block]
        out += counts @ bound
    return out


def profiles(docs: DataFrame, text_column: str, lang_column: str, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The bundle of each language over all given rows.

    Tasks bundle their own rows; the sums meet in one aggregation, and as many vectors as
    there are languages reach the driver.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts, langs = part.column("text").to_pylist(), part.column("lang").to_pylist()
                names = sorted(set(langs))
                row, number, count, letters = trigrams(texts)
                group = np.array([names.index(x) for x in langs])[row] if len(row) else row
                cell, at = np.unique(group * max(1, len(letters)) + number, return_inverse=True)
                total = np.bincount(at, count).astype(np.float32) if len(cell) else np.zeros(0, np.float32)
                width = max(1, len(letters))
                vectors = bundles(len(names), (cell // width, cell % width, total, letters), dimensions)
                for name, vector in zip(names, vectors):
                    sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        for name, vector in sums.items():
            columns = [pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(vector)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "place", "weight"])

    rows = (
        docs.select(F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))
        .where("text is not null and lang is not null")
        .mapInArrow(task, "lang string, place int, weight double")
        .groupBy("lang", "place").agg(F.sum("weight").alias("weight"))
        .collect()
    )
    out: dict[str, np.ndarray] = {}
    for lang, place, weight in rows:
        out.setdefault(lang, np.zeros(dimensions))[place] = weight
    return {lang: out[lang] for lang in sorted(out) if out[lang].any()}


def predict(
    docs: DataFrame, learned: dict[str, np.ndarray], id_column: str = "doc_id", text_column: str = "text",
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """One row per input row: id, ``lang_pred`` and ``score``, its cosine cut to [0, 1].

    A null text, a text without letters, or no learned language gives ``und`` with score 0.
    Equal cosines go to the first name.  Repeated rows are kept; other columns are ignored.
    """
    names = list(learned)
    units = np.stack([v / np.linalg.norm(v) for v in learned.values()], 1).astype(np.float32) if names else np.zeros((dimensions, 0), np.float32)
    kind = docs.schema[id_column].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                vectors = bundles(len(texts), trigrams(texts), dimensions)
                size = np.linalg.norm(vectors, axis=1)
                lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool)
                best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                if names:
                    cosines = (vectors @ units) / np.maximum(size, 1e-9)[:, None]
                    best = cosines.argmax(1)
                    score = np.where(lettered, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0).astype(np.float64)
                pred = [names[b] if names and ok else UNKNOWN for b, ok in zip(best, lettered)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(pred, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    out = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        task, f"id {kind}, lang_pred string, score double"
    )
    return out.withColumnRenamed("id", id_column)


def held_out(id_column: str = "doc_id"):
    """Rows that are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Learn from the rows that are not held out, predict for all: doc_id, held_out, lang_pred, score."""
    learned = profiles(docs.where(~held_out()), "text", "lang", dimensions)
    out = predict(docs, learned, dimensions=dimensions)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
