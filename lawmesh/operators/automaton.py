"""Many terms searched for in many texts at once: an Aho-Corasick automaton in flat arrays, run over all places of a batch together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A byte that no UTF-8 text has: it parts the texts of a batch, and no term goes on over it.
BETWEEN = 255


class Automaton:
    """goto as one array of (state, class of byte), failures already followed; the terms that end in a state are chained by `link`.

    Bytes that occur in no term share a class. Levels of the tree are made one
    after the other, all states of a level in whole arrays.
    """

    def __init__(self, terms: list[bytes]):
        self.terms, lengths = terms, np.array([len(t) for t in terms])
        self.longest = int(lengths.max())
        flat, starts = np.frombuffer(b"".join(terms), np.uint8), np.cumsum(lengths) - lengths
        self.classes = np.zeros(256, np.int64)
        used = np.unique(flat)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        most = int(lengths.sum()) + 1
        goto, fail, link = np.zeros((most, self.width), np.int32), np.zeros(most, np.int32), np.zeros(most, np.int32)
        self.term = np.full(most, -1, np.int32)
        at, made = np.zeros(len(terms), np.int64), 1
        for depth in range(self.longest):
            going = np.flatnonzero(lengths > depth)
            edge, which = np.unique(at[going] * 256 + flat[starts[going] + depth], return_inverse=True)
            parent, by = edge >> 8, self.classes[edge & 255]
            child = np.arange(made, made + len(edge))
            back = goto[fail[parent], by] if depth else np.zeros(len(edge), np.int32)
            goto[parent, by] = child
            at[going] = child[which]
            ended = going[lengths[going] == depth + 1]
            self.term[at[ended]] = ended
            fail[child], made = back, made + len(edge)
            goto[child] = goto[back]
            link[child] = np.where(self.term[back] >= 0, back, link[back])
        self.goto, self.link, self.term = goto[:made].ravel(), link[:made], self.term[:made]
        self.ends = (self.term >= 0) | (self.link > 0)

    def found(self, texts: list[bytes], stretch: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(text, term): the numbers of the texts and of the terms that they hold, each pair once.

        The texts stand behind each other and are cut into stretches that
        overlap by the longest term; all stretches take a step at a time.
        """
        stretch = max(stretch, 8 * self.longest)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        n = max(1, -(-int(begins[-1]) // stretch))
        data = np.full(n * stretch + self.longest, BETWEEN, np.uint8)
        data[: begins[-1]] = np.frombuffer(bytes([BETWEEN]).join([*texts, b""]), np.uint8)
        classes = self.classes[data].astype(np.uint8)
        state, met = np.zeros(n, np.int64), []
        seen, pending = np.empty(0, np.int64), 0
        first = np.arange(n) * stretch
        for step in range(stretch + self.longest - 1):
            state = self.goto[state * self.width + classes[first + step]].astype(np.int64)
            hit = np.flatnonzero(self.ends[state])
            if len(hit):
                met.append((np.searchsorted(begins, first[hit] + step, "right") - 1) * len(self.ends) + state[hit])
                pending += len(hit)
                if pending > 1 << 20:
                    seen, met, pending = np.unique(np.concatenate([seen, *met])), [], 0
        text, state = np.divmod(np.unique(np.concatenate([seen, *met])), len(self.ends))
        out = []
        while len(text):
            own = self.term[state] >= 0
            out.append(text[own] * len(self.terms) + self.term[state[own]])
            state = self.link[state].astype(np.int64)
            text, state = text[state > 0], state[state > 0]
        return np.divmod(np.unique(np.concatenate(out)) if out else np.empty(0, np.int64), len(self.terms))


def shards(terms: list[bytes], most: int) -> list[list[bytes]]:
    """The terms by length in parts whose arrays take at most about `most` bytes; a longer term has its own."""
    out, size = [[]], 0
    for t in sorted(terms, key=len):
        if out[-1] and (size + len(t)) * 4 * 128 > most:
            out, size = [*out, []], 0
        out[-1].append(t)
        size += len(t)
    return [s for s in out if s]


def search(terms: list[bytes], texts: DataFrame, most: int = 48 << 20, together: int = 8 << 20) -> DataFrame:
    """(term, text_id): which of the terms are in which of the texts, both in the columns' own case; columns text_id, text.

    The automaton of each shard of terms goes to the tasks, at most about
    `most` bytes of it, and the texts are read once for each shard. The
    arrays are made in the tasks from the terms, once in a worker.
    """
    spark, out = texts.sparkSession, None
    schema = pa.schema([("term", pa.binary()), ("text_id", pa.string())])
    texts = texts.select(F.col("text_id").cast("string").alias("text_id"), F.col("text").cast("binary").alias("text"))
    for part in shards(terms, most):
        shared = spark.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            automaton = None
            for batch in batches:
                for some in parts(batch, together):
                    automaton = automaton or Automaton(shared.value)
                    text, term = automaton.found(some.column("text").to_pylist())
                    if len(text):
                        names = pa.array(automaton.terms, pa.binary())
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(term)), pc.take(some.column("text_id"), pa.array(text)).cast(pa.string())], schema=schema)

        one = texts.where("text is not null").mapInArrow(run, "term binary, text_id string")
        out = one if out is None else out.unionByName(one)
    return out.select(F.col("term").cast("string").alias("term"), "text_id")


def parts(batch: pa.RecordBatch, most: int):
    """The batch in slices of at most `most` bytes, but for a single longer row."""
    waiting = [batch]
    while waiting:
        some = waiting.pop()
        if some.num_rows > 1 and some.nbytes > most:
            half = some.num_rows // 2
            waiting += [some.slice(half), some.slice(0, half)]
        elif some.num_rows:
            yield some
