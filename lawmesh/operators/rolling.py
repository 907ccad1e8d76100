"""Any number of longer terms searched for in texts: rolling hashes of all places, kept by bitmaps of the terms' hashes, then compared whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawmesh.operators.automaton import BETWEEN, parts

#: Bytes of a term's beginning that are looked for first; shorter terms are not searched for here.
WINDOW = 24
#: Places of each bitmap, as a power of two (16 MB, whatever the data), and of the slices in which they are made.
PLACES, SLICE = 27, 20
#: What a byte counts in a hash, its base, that base's inverse, and two multipliers.
BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
MULTIPLIERS = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_powers: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64, kept in the worker."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            every = np.full(n, base, np.uint64)
            every[0] = 1
            _powers[k] = np.multiply.accumulate(every)
    return _powers


def sums(data: np.ndarray) -> np.ndarray:
    """Of bytes: the sums before each place and at the end, of which two tell the hash of what lies between."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * powers(len(data) + 1)[0][: len(data)])])


def hashes(total: np.ndarray, at: np.ndarray, length) -> np.ndarray:
    return (total[at + length] - total[at]) * powers(len(total))[1][at] + np.asarray(length).astype(np.uint64) * MULTIPLIERS[1]


def places(hashed: np.ndarray) -> list[np.ndarray]:
    """Two places of the bitmap for each hash."""
    hashed = hashed ^ (hashed >> np.uint64(32))
    return [((hashed * m) >> np.uint64(64 - PLACES)).astype(np.int64) for m in MULTIPLIERS]


def has(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    a, b = places(hashed)
    out = (bits[a >> 3] >> (a & 7).astype(np.uint8)) & 1
    return (out & (bits[b >> 3] >> (b & 7).astype(np.uint8))).astype(bool)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts behind each other, each followed by BETWEEN, and where each begins."""
    return np.frombuffer(bytes([BETWEEN]).join([*texts, b""]), np.uint8), np.cumsum([0, *(len(t) + 1 for t in texts)])


def bitmaps(terms: DataFrame) -> list[np.ndarray]:
    """Of the terms' first WINDOW bytes and of whole terms: made by slices in the tasks; what the driver gets has a fixed size."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parts(batch, 1 << 20):
                data, begins = joined(some.column("term").to_pylist())
                total, at = sums(data), begins[:-1]
                for kind, length in enumerate((WINDOW, np.diff(begins) - 1)):
                    where = np.unique(np.concatenate(places(hashes(total, at, length))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), kind, np.int32)), pa.array((where >> SLICE).astype(np.int32)), pa.array((where & ((1 << SLICE) - 1)).astype(np.int32))], names=["kind", "slice", "place"])

    def made(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << SLICE, np.uint8)
        for batch in batches:
            bits[batch.column("place").to_numpy()] = 1
        one = [pa.array([k.as_py()], pa.int32()) for k in key]
        yield pa.RecordBatch.from_arrays([*one, pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["kind", "slice", "bits"])

    out = [np.zeros(1 << (PLACES - 3), np.uint8) for _ in range(2)]
    found = terms.mapInArrow(told, "kind int, slice int, place int").distinct().groupBy("kind", "slice").applyInArrow(made, "kind int, slice int, bits binary")
    for r in found.toLocalIterator():
        out[r["kind"]][r["slice"] << (SLICE - 3) : (r["slice"] + 1) << (SLICE - 3)] = np.frombuffer(r["bits"], np.uint8)
    return out


def search(terms: DataFrame, texts: DataFrame, together: int = 1 << 20) -> DataFrame:
    """(term, text_id): which terms of WINDOW bytes or more are in which texts; columns term (binary, distinct) and text_id, text.

    Each text is read once, whatever the number of terms. Where the hash of
    the next WINDOW bytes is in the one bitmap, the hash of as many bytes as a
    term has is held against the other for each length that terms have; what
    passes is a row with these bytes, and only rows that are terms stay.
    """
    spark = texts.sparkSession
    lengths = sorted(r[0] for r in terms.select(F.octet_length("term").alias("n")).distinct().toLocalIterator())
    shared = spark.sparkContext.broadcast((bitmaps(terms), np.array(lengths, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (begin, whole), lengths = shared.value
            for some in parts(batch, together):
                data, begins = joined(some.column("text").to_pylist())
                total = sums(data)
                at = np.arange(max(0, len(data) - WINDOW))
                at = at[has(begin, hashes(total, at, WINDOW))]
                text = np.searchsorted(begins, at, "right") - 1
                met = set()
                for k in range(0, len(at), 4096):
                    place, length = np.repeat(at[k : k + 4096], len(lengths)), np.tile(lengths, len(at[k : k + 4096]))
                    of = np.repeat(text[k : k + 4096], len(lengths))
                    fits = place + length < begins[of + 1]
                    place, length, of = place[fits], length[fits], of[fits]
                    fits = has(whole, hashes(total, place, length))
                    met.update((o, data[p : p + n].tobytes()) for o, p, n in zip(of[fits].tolist(), place[fits].tolist(), length[fits].tolist(), strict=True))
                if met:
                    of, term = zip(*met, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(term, pa.binary()), some.column("text_id").take(pa.array(of)).cast(pa.string())], names=["term", "text_id"])

    texts = texts.where(F.octet_length("text") >= WINDOW).select(F.col("text_id").cast("string").alias("text_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "term binary, text_id string")
