"""Byte-level BPE by a segment tree.

A piece's byte positions are the leaves of a tree whose nodes hold the least pair rank below them and, of equal
ranks, the leftmost position. Each merge reads the root and updates the two or three live neighbours it touches, each
in a logarithmic number of steps, so a long piece costs n log n. The trees of short pieces are rows of one
matrix, so that numpy works on thousands of them at once. Ranks come from a file of the tiktoken kind.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm.common import key_texts, map_batches

#: Bounds of a task's cache of encoded pieces: entries, and characters of a piece.
CACHE_PIECES, CACHE_CHARS = 80_000, 64
#: Characters encoded together, and pieces whose trees are rows of one matrix.
CHUNK, ROWS = 500_000, 8_192
_NONE = sys.maxsize


#: A text all of whose code points are below this one gets a pattern with small classes, which is several times faster.
SMALL = 0x100
#: The code points below SMALL with the property White_Space.
WHITE_SPACE = r"\x09-\x0d\x20\x85\xa0"


def _small_class(kind: str) -> str:
    """The inside of a class with every code point below SMALL whose general category starts with kind."""
    return "".join(f"\\x{c:02x}" for c in range(SMALL) if unicodedata.category(chr(c))[0] == kind)


@functools.cache
def _splitters(pattern: str) -> tuple[re.Pattern, regex.Pattern]:
    r"""The pattern for texts below SMALL, with \p{L}, \p{N} and \s spelled out, and the one for all texts."""
    out, in_class, i = [], False, 0
    inside = {r"\p{L}": _small_class("L"), r"\p{N}": _small_class("N"), r"\s": WHITE_SPACE}
    while i < len(pattern):
        token = pattern[i : i + 5] if pattern[i : i + 3] == r"\p{" else pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(token)
        if token == r"\S":
            out.append(f"[^{WHITE_SPACE}]")
        elif token in inside:
            out.append(inside[token] if in_class else f"[{inside[token]}]")
        else:
            in_class = token == "[" or in_class and token != "]"
            out.append(token)
    return re.compile("".join(out)), regex.compile(pattern)


def split(text: str, pattern: str) -> list[str]:
    """Each match of the pattern."""
    small, every = _splitters(pattern)
    return (small if text.isascii() or max(text) < chr(SMALL) else every).findall(text)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: again and again the pair of least rank, the leftmost of equals, becomes one token."""
    if piece in ranks:
        return [ranks[piece]]
    n, rank = len(piece), ranks.get
    size = 1 << (n - 2).bit_length()
    # a leaf is rank * n + position of a pair, so that the least is leftmost too; leaf i is the pair that starts at byte i
    best = [_NONE] * (2 * size)
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            best[size + i] = r * n + i
    for node in range(size - 1, 0, -1):
        x, y = best[2 * node], best[2 * node + 1]
        best[node] = x if x < y else y
    after, before = list(range(1, n + 2)), list(range(-1, n))
    while (low := best[1]) != _NONE:
        i = low % n
        j = after[i]
        k = after[i] = after[j]
        before[k] = i
        changed = [(j, _NONE)] if j < n - 1 else []
        r = rank(piece[i : after[k]]) if k < n else None
        changed.append((i, _NONE if r is None else r * n + i))
        if i:
            h = before[i]
            r = rank(piece[h:k])
            changed.append((h, _NONE if r is None else r * n + h))
        after[j] = 0
        for leaf, x in changed:
            node = size + leaf
            best[node] = x
            while node > 1:
                y = best[node ^ 1]
                node >>= 1
                if y < x:
                    x = y
                if best[node] == x:
                    break
                best[node] = x
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Forest:
    """The trees of many short pieces at once, a row each; a step merges one pair of every piece that has one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)

    def keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """What a leaf holds: rank * size + position, or _NONE where the pair (either may be -1) has no rank."""
        pair = left << 32 | right
        found = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[found] == pair) & (left >= 0) & (right >= 0), self.made[found] * size + at, _NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p in self.ranks:
                out[i] = struct.pack("<I", self.ranks[p])
            elif len(p) > CACHE_CHARS:
                out[i] = struct.pack(f"<{len(ids)}I", *ids) if (ids := merge(p, self.ranks)) else b""
            else:
                classes.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for size, which in classes.items():
            for at in range(0, len(which), ROWS):
                some = which[at : at + ROWS]
                for i, packed in zip(some, self._rows([pieces[i] for i in some], size), strict=True):
                    out[i] = packed
        return out

    def _rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        m, n = len(pieces), np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
        place = np.arange(size)
        alive = place < n[:, None]
        token = np.full((m, size + 1), -1, np.int64)
        token[:, :size] = np.where(alive, self.byte[raw], -1)
        after, before = np.tile(np.arange(1, size + 2), (m, 1)), np.tile(np.arange(-1, size + 1), (m, 1))
        best = np.full((m, 2 * size), _NONE, np.int64)
        best[:, size:] = self.keys(token[:, :-1], token[:, 1:], place, size)
        for node in range(size - 1, 0, -1):
            best[:, node] = np.minimum(best[:, 2 * node], best[:, 2 * node + 1])
        row = np.flatnonzero(best[:, 1] != _NONE)
        while len(row):
            made, i = np.divmod(best[row, 1], size)
            j = after[row, i]
            k = after[row, j]
            h = before[row, i]
            after[row, i], before[row, k], token[row, i], alive[row, j] = k, i, made, False
            h = np.where(h < 0, i, h)
            changed = [(j, np.full(len(row), _NONE)), (h, self.keys(token[row, h], made, h, size)), (i, self.keys(made, token[row, k], i, size))]
            for leaf, value in changed:  # where nothing stands before i, the third entry overwrites the second
                node = size + leaf
                best[row, node] = value
                while node[0] > 1:
                    node = node >> 1
                    best[row, node] = np.minimum(best[row, 2 * node], best[row, 2 * node + 1])
            row = row[best[row, 1] != _NONE]
        ids = token[:, :size][alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(axis=1)) * 4
        return [ids[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Codec:
    """Encode and decode whole texts. Pieces that weren't met for a while leave the cache."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.forest = pattern, Forest(ranks)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The packed ids (little-endian unsigned 32-bit integers) of each text."""
        split_up = [split(t, self.pattern) if t else [] for t in texts]
        missing = {p for pieces in split_up for p in pieces if p not in self.cache}
        if len(self.cache) + len(missing) > CACHE_PIECES and self.cache:
            self.older, self.cache = self.cache, {}
            missing = {p for pieces in split_up for p in pieces}
        found = {p: x for p in missing if (x := self.older.get(p)) is not None}
        new = [p for p in missing if p not in found]
        found.update(zip(new, self.forest.merge([p.encode("utf-8", "surrogatepass") for p in new]), strict=True))
        self.cache.update(found)
        out = [b"".join(map(self.cache.__getitem__, pieces)) for pieces in split_up]
        for p in new:
            if len(p) > CACHE_CHARS:
                del self.cache[p]
        return out

    def forget(self) -> None:
        """Empty the caches."""
        self.cache, self.older = {}, {}

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def chunks(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column, null as empty, some CHUNK characters at a time."""
    out, size = [], 0
    for scalar in column:
        out.append(scalar.as_py() or "")
        size += len(out[-1])
        if size >= CHUNK:
            yield out
            out, size = [], 0
    if out:
        yield out


#: One codec for each worker process: the ranks of a 50,000-entry file take some tens of MB.
@functools.lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> Codec:
    return Codec(load_ranks(path), pattern)


def bpe_encode(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for each row of docs (doc_id, text).

    path is a rank file that every executor has; pattern splits a text into pieces. No special tokens. A null text
    counts as empty: no ids, and the hash of nothing. Repeated rows give repeated results, no rows none.
    """

    def make():
        own = codec(path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, id_hash, text_hash, all_ids = [], [], [], []
            for texts in chunks(batch.column(1)):
                for packed in own.encode_all(texts):
                    counts.append(len(packed) // 4)
                    id_hash.append(hashlib.sha256(packed).hexdigest())
                    text_hash.append(hashlib.sha256(own.decode(packed)).hexdigest())
                    if ids:
                        all_ids.append(np.frombuffer(packed, "<u4").astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
            if ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            return pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

        return step

    return map_batches(key_texts(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids, lambda: codec(path, pattern).forget())


def bpe_decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text, bytes that aren't UTF-8 the replacement character."""

    def make():
        own = codec(path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [None if x is None else own.decode(np.array(x, "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            return pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

        return step

    return map_batches(tokens.select("doc_id", "ids"), make, "doc_id long, text string")
