r"""Byte-level BPE: encoding and decoding.

Pre-tokenisation works on arrays of code-point classes. Each class is a transition function on a small set of states; the
functions are composed block by block (an associative scan), which gives the state before every character and so every
boundary, without a regular expression. The slices between boundaries feed pair merging, cached by slice; their offsets
are kept, so ids can be mapped back to the text.

Classes: letter, number, other, an apostrophe that opens a contraction of one or of two letters, white space that other
white space or the end follows, a space before a non-space, and other white space before a non-space. The states say what
stands before a character: nothing that binds it, a space that joins it, a run of letters, numbers, others or white space,
or the one or two letters that a contraction still takes.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessergraph.llm.common import bounded_batches, plain_id, restored, table

FREE, JOIN, LETTERS, NUMBERS, OTHERS, TAKE1, TAKE2, SPACES = range(8)
LETTER, NUMBER, OTHER, SHORT, LONG, INNER_SPACE, LAST_BLANK, LAST_SPACE = range(8)
#: A class with this added is the first of a text: the state before it does not matter.
FIRST = 8
#: Code points in a scan, and in one block of it.
SCAN_CHARS, BLOCK = 1 << 18, 256
#: Slices kept by the cache of a worker before it starts anew.
CACHE_SLICES = 200_000


@lru_cache(1)
def _classes() -> np.ndarray:
    """Letter, number, other or white space of each code point; white space is INNER_SPACE here."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for at in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(at))[0]
        if kind == "L":
            out[at] = LETTER
        elif kind == "N":
            out[at] = NUMBER
    for low, high in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[low : high + 1] = INNER_SPACE
    return out


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, is a boundary) for class * 8 + state."""
    step, cut = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    run_of = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, SHORT: OTHERS, LONG: OTHERS, INNER_SPACE: SPACES, LAST_BLANK: JOIN, LAST_SPACE: FREE}
    for kind in range(8):
        for state in range(8):
            to = run_of[kind]
            if kind in (LAST_BLANK, LAST_SPACE):
                starts = True
            elif kind == INNER_SPACE:
                starts = state != SPACES
            else:
                starts = state not in (JOIN, to)
            if kind == LETTER and state in (TAKE1, TAKE2):
                starts, to = False, FREE if state == TAKE1 else TAKE1
            elif kind in (SHORT, LONG) and starts:
                to = TAKE1 if kind == SHORT else TAKE2
            step[kind, state], cut[kind, state] = to, starts
        step[kind + FIRST], cut[kind + FIRST] = step[kind, FREE], True
    return step.ravel(), cut.ravel()


def class_array(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Classes of joined texts; firsts: where each non-empty text begins."""
    n = len(points)
    kinds = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    first[n] = True
    space = kinds == INNER_SPACE
    last = space.copy()  # white space that a non-space of the same text follows
    last[:-1] &= ~space[1:]
    last &= ~first[1:]
    kinds[last] = LAST_SPACE
    kinds[last & (points == 0x20)] = LAST_BLANK
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        ends = np.append(firsts, n)
        room = ends[np.searchsorted(ends, quotes, "right")] - quotes  # characters to the end of the text
        one = points[np.minimum(quotes + 1, n - 1)]
        two = points[np.minimum(quotes + 2, n - 1)]
        short = (room > 1) & np.isin(one, [ord(c) for c in "stmd"])
        pairs = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kinds[quotes[short]] = SHORT
        kinds[quotes[(room > 2) & pairs]] = LONG
    kinds[firsts] += FIRST
    return kinds


def boundaries(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where slices begin in joined texts, by a blocked scan over the classes' transition functions."""
    step, cut = _tables()
    kinds = class_array(points, firsts)
    n = len(kinds)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, LETTER, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T) << 3
    # Compose each block's functions: the image of each of the eight states.
    image = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in grid:
        image = step.take(column[:, None] | image)
    # Scan the blocks' functions, by doubling.
    prefix, span = image, 1
    while span < rows:
        later = np.take_along_axis(prefix[span:], prefix[:-span], 1)  # first the earlier block, then the later
        prefix = np.concatenate([prefix[:span], later])
        span *= 2
    state = np.concatenate([np.zeros(1, np.uint8), prefix[:-1, FREE]])
    marks = np.empty((BLOCK, rows), bool)
    for at, column in enumerate(grid):
        both = column | state
        marks[at] = cut.take(both)
        state = step.take(both)
    return np.flatnonzero(marks.T.ravel()[:n])


def slices(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """For each text its slices and their offsets (code points)."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SCAN_CHARS):
            size += len(texts[end])
            end += 1
        group = texts[at:end]
        lengths = np.array([len(t) for t in group])
        tops = np.cumsum(lengths)
        if size:
            points = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32)
            starts = boundaries(points, (tops - lengths)[lengths > 0])
        else:
            starts = np.empty(0, np.int64)
        split = np.searchsorted(starts, np.concatenate([tops - lengths, tops[-1:]]))
        for k, text in enumerate(group):
            own = starts[split[k] : split[k + 1]] - (tops[k] - lengths[k])
            edges = own.tolist()
            edges.append(len(text))
            yield [text[a:b] for a, b in zip(edges, edges[1:])], own
        at = end


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Joins the adjacent pair of the lowest rank, the first of equals, until no pair has one."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(parts[i] + parts[i + 1], _NONE) for i in range(len(parts) - 1)]
    while pairs:
        low = min(pairs)
        if low == _NONE:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
    return [ranks[p] for p in parts]


_NONE = 1 << 60
#: Longer pieces are merged with a heap instead of a scan of all pairs.
HEAP_BYTES = 200


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """merge() in n log n steps: a heap of pairs over a linked list of parts."""
    import heapq

    n = len(piece)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\1" * n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j] = 0
        end[i], right[i] = stop, right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(piece[i : end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]]))
        if (k := left[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Vocabulary(dict):
    """Maps a slice to its ids, as a tuple; what it has merged stays, up to CACHE_SLICES."""

    def __init__(self, path: str):
        super().__init__()
        self.ranks = read_ranks(path)
        self.bytes_of = {i: b for b, i in self.ranks.items()}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        ids = tuple(merge(raw, self.ranks) if len(raw) <= HEAP_BYTES else merge_long(raw, self.ranks))
        if len(self) >= CACHE_SLICES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(texts: list[str], path: str) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """For each text its ids, the offsets of its slices, and how many ids each slice has."""
    known = vocabulary(path)
    for pieces, offsets in slices(texts):
        found = [known[p] for p in pieces]
        yield [i for ids in found for i in ids], offsets, np.fromiter(map(len, found), np.int32, len(found))


def decode(ids: list[int], path: str) -> bytes:
    return b"".join(map(vocabulary(path).bytes_of.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, offsets array<int>, counts array<int>): offsets of the slices and ids in each."""

    bounded_batches(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = list(encode(batch["text"].fillna("").tolist(), path))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [r[0] for r in rows], "offsets": [r[1] for r in rows], "counts": [r[2] for r in rows]})

    picked = docs.select(plain_id(docs[id_col]).alias("doc_id"), docs[text_col].alias("text"))
    return restored(picked.mapInPandas(run, "doc_id long, ids array<int>, offsets array<int>, counts array<int>"))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text and gives digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text is empty and has no tokens. Repeated rows give repeated rows. No other column is read.
    """

    bounded_batches(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary(path)
        named: dict[int, str] = {i: str(i) for i in known.bytes_of}
        for batch in batches:
            rows = []
            for ids, _, _ in encode(batch["text"].fillna("").tolist(), path):
                text = ",".join(map(named.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(decode(ids, path)).hexdigest()))
            counts, ids_hash, text_hash = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": np.array(counts, np.int64), "ids_sha256": ids_hash, "decoded_sha256": text_hash})

    picked = docs.select(plain_id(docs[id_col]).alias("doc_id"), docs[text_col].alias("text"))
    return restored(picked.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
