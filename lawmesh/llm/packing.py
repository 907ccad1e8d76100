"""Packing token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lawmesh.llm.common import broadcast_value, kept, map_arrow

#: Bytes of the pieces of words that a Python worker keeps between batches.
PIECES_BYTES = 128 << 20
#: Bytes of an entry of a dict besides its key's and value's characters, about.
ENTRY = 190
#: Splitting at white space also parts at these, the tokenizer does not.
ODD_SPACE = "[\x1c\x1d\x1e\x1f]"
#: Words whose normal form is themselves in lower case, letter by letter (the dotted capital I becomes two).
LATIN = "[\x21-\x7e\xa1-\u012f\u0131-\u024f]+"
#: Patterns that words are parted by -> what is left of them besides runs of letters, which stay when all else is parted from them.
BESIDE_LETTERS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{N}]|[^\s\p{L}\p{N}]+"}


def difference(sizes: list[int], n_windows: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of sizes, dealt to n_windows windows of near-equal sums.

    Each size starts as a partial partition with one filled window. The two
    partial partitions with the largest spread are merged again and again, the
    fullest window of one with the emptiest of the other. Partial partitions
    keep only their non-empty windows, so small ones are cheap to merge.
    """
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]  # spread, order, windows by sum downwards
    heapq.heapify(heap)
    made: list[tuple[int, int]] = []  # node -> its two children; leaves are the indices
    n = len(sizes)
    order = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        fit = n_windows - len(a)
        merged = a + b[:fit] if fit > 0 else list(a)
        rest = b[max(0, fit) :]  # these must share windows; the smallest of a come last
        lo = len(a) - 1
        for s, node in rest:
            s2, node2 = a[lo]
            made.append((node, node2))
            merged[lo] = (s + s2, n + len(made) - 1)
            lo -= 1
        merged.sort(key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == n_windows else 0
        heapq.heappush(heap, (least - merged[0][0], order, merged))
        order += 1
    windows = []
    for _, node in heap[0][2] if heap else []:
        stack, leaves = [node], []
        while stack:
            x = stack.pop()
            if x < n:
                leaves.append(x)
            else:
                stack.extend(made[x - n])
        windows.append(sorted(leaves))
    return windows


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows that differencing keeps within capacity, counting up from the total."""
    n_windows = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = difference(sizes, n_windows)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return windows
        n_windows += 1


class Recent:
    """What was met lately, in at most about `most` bytes: of two generations the older one goes when the younger one is full."""

    def __init__(self, most: int):
        self.young, self.old, self.size, self.half = {}, {}, 0, most // 2

    def turn(self) -> None:
        if self.size > self.half:
            self.old, self.young, self.size = self.young, {}, 0

    def put(self, key: str, value: bytes) -> None:
        self.young[key] = value
        self.size += ENTRY + len(key) + len(value)

    def missing(self, keys) -> list[str]:
        """Those of the keys that must be made; the others are in the younger generation from now on."""
        out, young, old, size = [], self.young, self.old, 0
        for k in keys:
            if k not in young:
                got = old.get(k)
                if got is None:
                    out.append(k)
                else:
                    young[k] = got
                    size += ENTRY + len(k) + len(got)
        self.size += size
        return out


def gathered(flat: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat's parts with these numbers one after another, and where each begins and ends."""
    first, n = bounds[:-1][at], np.diff(bounds)[at]
    ends = np.concatenate(([0], np.cumsum(n)))
    # places step by one within a part and jump from a part's last to the next one's first
    some = np.flatnonzero(n)
    if not len(some):
        return flat[:0], ends
    step = np.ones(ends[-1], dtype="int32" if len(flat) < 1 << 31 else "int64")
    begin, last = first[some], first[some] + n[some] - 1
    step[ends[:-1][some]] = begin - np.concatenate(([0], last[:-1]))
    return flat[np.cumsum(step, out=step)], ends


class Words:
    """Pieces of words -> their ids as little-endian bytes; the tokenizer fills it by batches.

    If its file says that it lower-cases and then parts a text by a pattern,
    words are parted so first: such pieces repeat far more often than words
    with their capitals and punctuation do, and only pieces not met before go
    to the tokenizer. Words with characters beyond Latin letters go to it
    whole, as their normal forms are its own business.
    """

    def __init__(self, tokenizer, spec: str):
        said = json.loads(spec)
        # what added tokens begin with, up to a letter: texts that have it go to the tokenizer whole, which knows where it is one ("": all texts)
        self.added = re.split(r"[^\W\d_]", os.path.commonprefix([t["content"] for t in said.get("added_tokens", [])]), maxsplit=1)[0]
        self.adds = bool(said.get("added_tokens"))
        steps = [n["type"] for n in (said.get("normalizer") or {}).get("normalizers", [])]
        parting = ((said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        pattern = parting.get("pattern", {}).get("Regex") if parting.get("behavior") == "Removed" and parting.get("invert") else None
        self.tokenizer, self.bare = tokenizer, tokenizer
        self.pieces, self.latin = Recent(PIECES_BYTES), re.compile(LATIN).fullmatch
        self.pattern = pattern if steps == ["NFC", "Replace", "Lowercase"] else None
        if self.pattern:  # the same model without the steps that its pieces have behind them
            from tokenizers import Tokenizer

            rest = {"type": "Sequence", "pretokenizers": said["pre_tokenizer"]["pretokenizers"][1:]}
            empty = {"version": said.get("version", "1.0"), "added_tokens": [], "model": said["model"] | {"vocab": {}, "merges": []}, "pre_tokenizer": rest}
            empty |= dict.fromkeys(("truncation", "padding", "normalizer", "post_processor", "decoder"))
            self.bare = Tokenizer(tokenizer.model)
            self.bare.pre_tokenizer = Tokenizer.from_str(json.dumps(empty)).pre_tokenizer

    def parted(self, words: pa.Array) -> pa.ListArray:
        """Each word's pieces, and empty ones; Arrow parts all words at once."""
        spaced = pc.binary_join_element_wise("", words, " ")
        if self.pattern:
            latin = pc.match_substring_regex(words, f"^{LATIN}$")
            lower = pc.utf8_lower(pc.if_else(latin, words, ""))
            spaced = pc.if_else(latin, pc.replace_substring_regex(lower, BESIDE_LETTERS.get(self.pattern, self.pattern), r" \0 "), spaced)
        return pc.split_pattern(spaced, " ")

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each of a batch's distinct pieces."""
        self.pieces.turn()
        latin, bare, whole = self.latin, [], []
        for p in self.pieces.missing(pieces):
            (bare if self.pattern and latin(p) else whole).append(p)
        for new, tokenizer in ((bare, self.bare), (whole, self.tokenizer)):
            for at in range(0, len(new), 4096):
                some = new[at : at + 4096]
                for p, e in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                    self.pieces.put(p, array("I", e.ids).tobytes())
        return self.pieces.young

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text's begin and end; null texts have none.

        Words never share a token: the tokenizer's pieces hold no white space.
        Splitting and finding the distinct words and their distinct pieces is
        Arrow's work; Python sees only these, and ids are gathered by their
        numbers.
        """
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        if self.adds:
            odd = pc.or_(odd, pc.match_substring(texts, self.added))
        split = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        coded = split.flatten().dictionary_encode()
        parted = self.parted(coded.dictionary)
        pieces = parted.flatten().dictionary_encode()
        known = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids_of = self.learn(known)
        made = [ids_of[p] for p in known]
        n_of = np.fromiter(map(len, made), "int64", len(made)) // 4
        flat, ends = gathered(np.frombuffer(b"".join(made), dtype="<u4"), np.concatenate(([0], np.cumsum(n_of))), pieces.indices.to_numpy())
        ids, ends = gathered(flat, ends[parted.offsets.to_numpy()], coded.indices.to_numpy())
        bounds = ends[split.offsets.to_numpy()]
        if pc.any(odd).as_py():  # few: such texts go to the tokenizer whole
            parts = [ids[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
            for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                parts[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, dtype="<u4")
            ids, bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, bounds


def words_of(key: str, spec: str) -> Words:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    def make():
        tokenizer = Tokenizer.from_str(spec)
        return Words(tokenizer, spec)

    return kept(key, make)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    capacity: int = 2048,
    longest_piece: int = 512,
    block_tokens: int = 1 << 19,
    rows: int = 1024,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    Every document's ids, end_id last, are cut into pieces of at most
    longest_piece. The pieces of each task gather in blocks of about
    block_tokens ids (and what a document has over), and differencing deals a
    block to ceil(ids / capacity) windows, one more whenever one would exceed
    capacity. Windows are padded to capacity; what is lost is the part of a
    window by which each block's total rounds up. There is no shuffle, and a
    task holds one block; `rows` documents are encoded at a time. sequence_id has the partition, block and window, so
    a task that runs again gives the same ids.

    Null or empty text: one piece with end_id alone. Null or repeated doc_id:
    each row is packed by itself. Empty input: no rows. Ties between sizes go
    by input order. Further columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    name, shipped = hashlib.md5(spec.encode()).hexdigest(), broadcast_value(docs, spec)
    end = np.array([end_id], dtype="<u4").tobytes()
    fields = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    class Step:
        def __init__(self):
            self.words = words_of(name, shipped.value)
            self.partition = TaskContext.get().partitionId()
            self.block, self.rows, self.total = 0, [], 0

        def __call__(self, batch):
            out = []
            ids, bounds = self.words.encode(batch.column(1))
            bounds = bounds.tolist()
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                packed = memoryview(ids[bounds[k] : bounds[k + 1]].tobytes() + end)
                n = len(packed) // 4
                for start in range(0, n, longest_piece):
                    length = min(longest_piece, n - start)
                    crc = zlib.crc32(packed[4 * start : 4 * (start + length)])
                    self.rows.append((doc_id, start, length, crc, n))
                self.total += n
                if self.total >= block_tokens:
                    out.append(self.finish())
            return out

        def finish(self):
            made = []
            if self.rows:
                for k, window in enumerate(windows_of([r[2] for r in self.rows], capacity)):
                    offset, sequence = 0, (self.partition << 40) | (self.block << 20) | k
                    for i in window:
                        made.append((*self.rows[i], sequence, offset))
                        offset += self.rows[i][2]
            self.block, self.rows, self.total = self.block + 1, [], 0
            return dict(zip(fields, map(list, zip(*made, strict=True)), strict=True)) if made else dict.fromkeys(fields, [])

    return map_arrow(
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"),
        Step,
        ", ".join(f"{f} long" for f in fields),
        rows,
    )
