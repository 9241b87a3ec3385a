"""Benchmark decontamination: test passages found in documents within an edit budget.

Texts are compared in lower case with runs of white space as one space.  A test item is covered
by overlapping passages; a passage of m characters may differ by m // RATE edits.  By the pigeonhole
principle, of budget + 1 pieces of a passage one occurs unchanged, so one automaton over all
pieces finds every place to look at.  Such a place must hold enough of the passage's 4-grams
(an edit destroys four at most), and is then measured by Myers' bit-parallel distance.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelode.llm.common import per_process, text_slices

#: Characters per allowed edit, and the usual length of a passage.
RATE, PASSAGE = 14, 120
#: Passages of an item under twice PASSAGE are half of it, and this long at least.
SHORTEST = 40
#: Passages start this share of their length apart.
STEPS = 8
#: Items below this length have no passages: they are found unedited, as whole words.
LEAST = 24
#: Characters of test items that travel with one pass over the documents.
BLOCK_CHARS = 4 << 20
GRAM = 4


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def passages_of(text: str) -> list[str]:
    """Overlapping passages of a normalised item, of PASSAGE characters or half the item: each
    unedited quote of length + length // STEPS - 1 characters holds one, wherever it starts."""
    n = len(text)
    if n < LEAST:
        return []
    size = min(n, PASSAGE, max(SHORTEST, n // 2))
    step = size // STEPS
    return [text[a : a + size] for a in [*range(0, n - size, step), n - size]]


def pieces_of(passage: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces with their offsets."""
    m = len(passage)
    edges = [m * i // (budget + 1) for i in range(budget + 2)]
    return [(a, passage[a:b]) for a, b in zip(edges, edges[1:])]


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and the first end of such a
    part (Myers' algorithm: one machine word of any length holds a whole column)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text):
        equal = masks.get(c, 0)
        vertical = equal | minus
        diagonal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, at + 1
    return best, end


class Finder:
    """Passages of a block of items, and the automaton over their pieces."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        import ahocorasick

        # Item, number, of how many, text, budget; items without an id are told apart by their place.
        self.passages: list[tuple[int | tuple, int, int, str, int]] = []
        where: dict[str, list[tuple[int, int]]] = {}
        for place, (item, text) in enumerate(items):
            parts = passages_of(text) or [text] * bool(text)
            for number, part in enumerate(parts):
                budget = len(part) // RATE if len(text) >= LEAST else 0
                for offset, piece in pieces_of(part, budget):
                    where.setdefault(piece, []).append((len(self.passages), offset))
                self.passages.append(((None, place) if item is None else item, number, len(parts), part, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Passage -> (distance, start, stop) of its best place in a normalised text."""
        if self.empty:
            return {}
        places: dict[int, set[int]] = {}
        for end, (size, found) in self.automaton.iter(text):
            for p, offset in found:
                places.setdefault(p, set()).add(end + 1 - size - offset)
        out: dict[int, tuple[int, int, int]] = {}
        for p, unordered in places.items():
            part, budget = self.passages[p][3:]
            m, diagonals = len(part), sorted(unordered)
            if m < LEAST:
                at = next((a for a in diagonals if whole_words(text, a, a + m)), None)
                if at is not None:
                    out[p] = (0, at, at + m)
                continue
            at = 0
            while at < len(diagonals):
                start = last = diagonals[at]
                at += 1
                # Places whose windows overlap are measured together.
                while at < len(diagonals) and diagonals[at] <= last + budget:
                    last = diagonals[at]
                    at += 1
                low = max(0, start - budget)
                window = text[low : last + m + budget]
                if part in window:
                    found_at = low + window.index(part)
                    best = (0, found_at, found_at + m)
                else:
                    if not shares_grams(part, window, GRAM * budget):
                        continue
                    distance, stop = best_match(part, window)
                    if distance > budget:
                        continue
                    _, back = best_match(part[::-1], window[:stop][::-1])
                    best = (distance, low + stop - back, low + stop)
                if p not in out or best < out[p]:
                    out[p] = best
        return out


def whole_words(text: str, start: int, stop: int) -> bool:
    """Whether a place begins and ends where words of the text do."""
    return not (
        (start and text[start - 1].isalnum() and text[start].isalnum())
        or (stop < len(text) and text[stop].isalnum() and text[stop - 1].isalnum())
    )


def shares_grams(part: str, window: str, missing: int) -> bool:
    """Whether at most ``missing`` grams of a passage are absent from a window."""
    for i in range(len(part) - GRAM + 1):
        if part[i : i + GRAM] not in window:
            missing -= 1
            if missing < 0:
                return False
    return True


SCHEMA = "item_id bigint, passages int, passages_hit int, distance int, start bigint, stop bigint"


def blocks_of(items: DataFrame, item_column: str, item_text: str) -> Iterator[list[tuple[int | None, str]]]:
    """Normalised items in blocks of bounded size."""
    block: list[tuple[int | None, str]] = []
    size = 0
    for item, text in items.select(F.col(item_column).cast("long"), F.col(item_text).cast("string")).toLocalIterator():
        block.append((item, normal(text)))
        size += len(block[-1][1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    yield block


def finder_of(docs: DataFrame, block: list[tuple[int | None, str]]):
    """A function that gives each worker process its automaton over the block."""
    shared = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK_CHARS and one item at most
    name = ("finder", uuid.uuid4().hex)
    return lambda: per_process(name, lambda: Finder(shared.value))


def contaminated(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per (document row, item) with a passage within its budget: id, item_id,
    ``passages`` of the item, ``passages_hit``, and of the closest one ``distance``, ``start``
    and ``stop`` in the normalised text.

    Items go through in blocks of BLOCK_CHARS characters, one pass over the documents each, so
    a test set of any size is used whole.  Null texts are empty.  An item of fewer than LEAST
    normalised characters is one passage, found unedited as whole words; items with a null id
    each give rows with a null item_id.  Repeated items count as one, repeated documents each
    give their rows; a null document id stays null; other columns are ignored.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.where(F.octet_length(text_column) > 0).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    names = ["id", *(c.split()[0] for c in SCHEMA.split(", "))]

    def scan(block: list[tuple[int | None, str]]) -> DataFrame:
        finder_here = finder_of(docs, block)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = finder_here()
            for batch in batches:
                for part in text_slices(batch, "text"):
                    rows: list[tuple] = []
                    for i, text in enumerate(part.column("text").to_pylist()):
                        by_item: dict[int | tuple, list] = {}
                        for p, best in finder.find(normal(text)).items():
                            by_item.setdefault(finder.passages[p][0], []).append((best, finder.passages[p][2]))
                        for item, hits in by_item.items():
                            distance, start, stop = min(h[0] for h in hits)
                            rows.append((i, None if isinstance(item, tuple) else item, hits[0][1], len(hits), distance, start, stop))
                    if rows:
                        ids = part.column("id").take(pa.array([r[0] for r in rows]))
                        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[i + 1] for r in rows], k) for i, k in enumerate(kinds))], names)

        return plain.mapInArrow(task, f"id {kind}, {SCHEMA}")

    found = [scan(block) for block in blocks_of(items.dropDuplicates([item_column, item_text]), item_column, item_text)]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.withColumnRenamed("id", id_column)


def clean_documents(docs: DataFrame, items: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without those that hold a passage; a narrow plan, all columns stay."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def without(rows: DataFrame, block: list[tuple[int | None, str]]) -> DataFrame:
        finder_here = finder_of(docs, block)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = finder_here()
            for batch in batches:
                yield batch.filter(pa.array([not finder.find(normal(t)) for t in batch.column(text_column).to_pylist()], pa.bool_()))

        return rows.mapInArrow(task, kinds)

    for block in blocks_of(items, item_column, item_text):
        docs = without(docs, block)
    return docs
