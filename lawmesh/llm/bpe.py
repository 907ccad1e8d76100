"""Byte-level BPE: encoding by monoid tree reduction, decoding by concatenation up the tree."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame

from lawmesh.llm.common import broadcast_value, kept, map_arrow

CACHE_LIMIT = 500_000


class TreeBpe:
    """The monoid of valid encodings under join, over one table of ranks.

    An encoding is the one that rank-ordered merging gives exactly when it is
    so for each two neighbouring tokens by themselves: `stable(a, b)` says
    whether merging their joined bytes gives them back. A join therefore only
    re-encodes a window at the boundary and widens it until the tokens on both
    sides of it are stable against it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.encoded: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Rank-ordered merging, for single tokens and small windows."""
        ranks = self.ranks
        if data in ranks:
            return (ranks[data],)
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def stable(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > CACHE_LIMIT:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
        return got

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        of = self.bytes_of
        i, j = len(left) - 1, 1
        while True:
            window = self.merge(b"".join([*(of[t] for t in left[i:]), *(of[t] for t in right[:j])]))
            left_ok = i == 0 or self.stable(left[i - 1], window[0])
            right_ok = j == len(right) or self.stable(window[-1], right[j])
            if left_ok and right_ok:
                return left[:i] + window + right[j:]
            if not left_ok:
                i = max(0, i - max(1, len(left) - i))
            if not right_ok:
                j = min(len(right), j * 2)

    def encode(self, data: bytes) -> tuple[int, ...]:
        """Halves recursively, remembering what it has met."""
        got = self.encoded.get(data)
        if got is None:
            if len(data) < 2:
                got = self.merge(data) if data else ()
            else:
                middle = len(data) // 2
                got = self.join(self.encode(data[:middle]), self.encode(data[middle:]))
            if len(data) <= 64:
                if len(self.encoded) > CACHE_LIMIT:
                    self.encoded.clear()
                self.encoded[data] = got
        return got

    def decode(self, ids) -> bytes:
        """Concatenates up the tree; joining all leaves at once gives the same bytes."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Pieces(dict):
    """Text piece -> its ids as little-endian bytes, made when first met."""

    def __init__(self, bpe: TreeBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if len(self) > CACHE_LIMIT:
            self.clear()
        got = np.array(self.bpe.encode(piece.encode("utf-8")), dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = got
        return got


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def codec(key: str, data: bytes, pattern: str):
    """One per Python worker and vocabulary; workers are reused between tasks."""
    import regex

    def make():
        bpe = TreeBpe(read_ranks(data))
        return bpe, Pieces(bpe), regex.compile(pattern).findall

    return kept(key, make)


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id", with_ids: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (with_ids: also ids) of every whole text.

    Each match of `pattern` is encoded by itself. One pass, no shuffle: the
    vocabulary (its file is read once, here) is the only thing broadcast. Null
    text counts as empty: no ids and the digests of nothing. Null ids,
    repeated rows and further columns pass or are ignored row by row. Texts of
    any length are cut into the pattern's matches; a long match is a deeper tree.
    """
    with open(ranks_path, "rb") as f:
        data = f.read()
    name, shipped = hashlib.md5(data + pattern.encode()).hexdigest(), broadcast_value(docs, data)

    def make():
        bpe, pieces, findall = codec(name, shipped.value, pattern)

        def step(batch):
            ids_of, n, ids_sha, back_sha, lists = batch.column(0), [], [], [], []
            for value in batch.column(1).to_pylist():
                packed = b"".join(map(pieces.__getitem__, findall(value))) if value else b""
                ids = np.frombuffer(packed, dtype="<u4")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                back_sha.append(hashlib.sha256(bpe.decode(ids.tolist())).hexdigest())
                if with_ids:
                    lists.append(ids.astype("int32"))
            out = {key: ids_of, "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": back_sha}
            return out | {"ids": lists} if with_ids else out

        return step

    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(docs.select(key, text), make, schema + (", ids array<int>" if with_ids else ""))
