"""Token counts by a compiled finite-state transducer.

A piece vocabulary with merge scores is compiled into a deterministic transducer that reads
characters and writes no tokens, only how many: every transition carries the change in the
number of tokens of the text read so far.  Two facts make that finite.

* A sequence of pieces is the tokenization of its text exactly when every adjacent pair is
  the tokenization of the pair's text, because merges inside a pair happen in the same order
  with or without neighbours.  So the last token of each prefix is unique: the piece t ending
  the prefix whose pair with the last token before it is valid.
* Only cuts after which a piece may still be growing matter later.  A state is the list of
  such cuts: the characters since the cut, the token before it, and its count relative to now.

States and transitions are compiled when first met and kept by the worker process.  A piece
never holds a space mark after another character, so a space mark after a word puts every
state into the same one: such a place is a synchronising point.

Texts are cut into chunks of fixed length.  The map of a chunk from entry state to (exit
state, count) is constant from its first synchronising point on; before it, it is kept as the
characters still to be read.  Such maps compose associatively, and are composed as a tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelode.llm.common import forget, offsets_of, per_process

SPACE = "▁"
CHUNK_CHARS = 65_536
#: Compiled states a process keeps; beyond it, it starts over, which costs time and not results.
MAX_STATES = 300_000


class State(dict):
    """One state: a table from character to (next state, change in tokens), filled on demand."""

    __slots__ = ("cuts", "machine")

    def __init__(self, machine: Transducer, cuts: tuple) -> None:
        super().__init__()
        self.machine, self.cuts = machine, cuts

    def __missing__(self, char: str) -> tuple[State, int]:
        move = self[char] = self.machine.compile(self.cuts, char)
        return move


class Transducer:
    """``pieces`` maps each mergeable piece to its score; a higher score merges first."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.score = pieces
        self.tokens = {p for p in pieces if len(p) == 1 or self.merge(p) == [p]}
        self.growing = {p[:n] for p in self.tokens for n in range(1, len(p))}
        self.synchronises = not any(SPACE in p.lstrip(SPACE) for p in self.tokens)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.states: dict[tuple, State] = {}
        self.start = self.state((("", "", 0),))

    def state(self, cuts: tuple) -> State:
        found = self.states.get(cuts)
        if found is None:
            found = self.states[cuts] = State(self, cuts)
        return found

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by definition: merge the best-scored pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b) for a, b in zip(parts, parts[1:])]
            best = max((s for s in scores if s is not None), default=None)
            if best is None:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: str, right: str) -> bool:
        """Whether the two pieces stand side by side in the tokenization of their text."""
        if not left:
            return True
        known = self.pairs.get((left, right))
        if known is None:
            known = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return known

    def compile(self, cuts: tuple, char: str) -> tuple[State, int]:
        if char not in self.score:  # written as its bytes, which never merge
            return self.start, len(char.encode())
        if char == SPACE and self.synchronises and len(cuts) > 1 and not cuts[0][0].endswith(SPACE):
            return self.start[char]
        if char == SPACE and self.synchronises and len(cuts) == 1 and cuts[0][1] and not cuts[0][1].endswith(SPACE):
            return self.start[char]
        token, gained = next(
            (grown + char, count + 1)
            for grown, last, count in cuts
            if grown + char in self.tokens and self.follows(last, grown + char)
        )
        after = [(grown + char, last, count - gained) for grown, last, count in cuts if grown + char in self.growing]
        return self.state((*after, ("", token, 0))), gained

    def run(self, state: State, text: str) -> tuple[State, int]:
        count = 0
        for char in text:
            state, gained = state[char]
            count += gained
        return state, count


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to any entry state: ``head`` is read from that state; then, if the
    chunk holds a synchronising point, ``count`` more tokens follow and the exit is ``state``."""

    head: str
    state: State | None = None
    count: int = 0


def chunk_map(machine: Transducer, text: str) -> ChunkMap:
    """The map of one chunk; its first synchronising point is the first space mark after a
    character that is none."""
    word = next((i for i, c in enumerate(text) if c != SPACE), len(text))
    at = text.find(SPACE, word) if machine.synchronises else -1
    if at < 0:
        return ChunkMap(text)
    return ChunkMap(text[:at], *machine.run(machine.start, text[at:]))


def compose(machine: Transducer, first: ChunkMap, second: ChunkMap) -> ChunkMap:
    """The map of two neighbouring chunks; associative."""
    if first.state is None:
        return ChunkMap(first.head + second.head, second.state, second.count)
    state, count = machine.run(first.state, second.head)
    if second.state is not None:
        state = second.state
    return ChunkMap(first.head, state, first.count + count + second.count)


def count_text(machine: Transducer, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
    """Tokens of a whole text: the chunk maps behind the fixed start, composed as a tree."""
    if not text:
        return 0
    marked = SPACE + text.replace(" ", SPACE)
    maps = [ChunkMap("", machine.start)]
    maps += [chunk_map(machine, marked[i : i + chunk_chars]) for i in range(0, len(marked), chunk_chars)]
    while len(maps) > 1:
        paired = [compose(machine, a, b) for a, b in zip(maps[::2], maps[1::2])]
        maps = paired + maps[len(paired) * 2 :]
    return maps[0].count


def load(model_path: str) -> Transducer:
    """Compile the vocabulary of a piece model that falls back to bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    if not any(model.is_byte(i) for i in ids):
        raise ValueError("the piece model has no byte fallback")
    plain = (i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
    return Transducer({model.id_to_piece(i): model.get_score(i) for i in plain})


def count_tokens(
    docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text",
    limit: int = 4096, chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """One row per input row: its id, ``n_bytes``, ``n_tokens``, ``over_limit``; a narrow plan.

    A null text counts as empty (no tokens); a null id stays null; repeated rows are counted
    one by one; other columns are ignored, whatever their names; an empty table gives none.
    ``model_path`` must be readable on every executor.
    """
    key = ("transducer", model_path)
    kind = docs.schema[id_column].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for value in batch.column(1):
                machine = per_process(key, lambda: load(model_path))
                counts.append(count_text(machine, value.as_py() or "", chunk_chars))
                if len(machine.states) > MAX_STATES:
                    forget(key)
            n = np.array(counts, np.int64)
            size = np.diff(offsets_of(batch.column(1)))
            columns = [batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens", "over_limit"])

    out = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        task, f"id {kind.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
    return out.withColumnRenamed("id", id_column)
