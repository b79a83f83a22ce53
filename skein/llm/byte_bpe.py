"""Byte-level BPE: pre-tokenisation by an associative scan, cached pair merging, decoding.

Every code point has a symbol (its class, with one place of look-ahead folded in). A symbol is a function from the
states of a small automaton to its states; functions compose associatively, so blocks of text are composed side by
side, the blocks' functions scanned, and all places' states filled in at once. A slice starts where the automaton says
so. The slices partition the text; each distinct one is merged once per worker.

Defined results: a null text is empty and has no ids; rows with the same doc_id or text are encoded each, alike; a very
long text is a block by itself; of merges with one rank the first in the slice comes first; bytes that are no UTF-8
count as U+FFFD; an empty table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import row_blocks, spans, strings, text_buffers, valid_text

# White space as Unicode's White_Space lists it.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LETTER, NUMBER, OTHER, WHITE = range(4)
# States: what the current slice is.
FRESH, WORD, DIGITS, SIGNS, QUOTE, BLANKS, SPACE, SUFFIX = range(8)
# Symbols.
LET, LET_END, LET_TWO, NUM, APOSTROPHE, SIGN, MORE_WHITE, LAST_SPACE, LAST_WHITE = range(9)
SYMBOLS = 9
BLOCK = 256
MOST_CACHED = 300_000
LONG_SLICE = 256


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next_state[symbol, state] and starts[symbol, state]; symbols from SYMBOLS on are the same at a text's first place."""
    goes, starts = np.zeros((2 * SYMBOLS, 8), np.uint8), np.ones((2 * SYMBOLS, 8), np.uint8)
    for letter in (LET, LET_END, LET_TWO):
        goes[letter], starts[letter, [WORD, SPACE]] = WORD, 0
        goes[letter, SUFFIX], starts[letter, SUFFIX] = FRESH, 0
    goes[LET_END, QUOTE], starts[LET_END, QUOTE] = FRESH, 0
    goes[LET_TWO, QUOTE], starts[LET_TWO, QUOTE] = SUFFIX, 0
    goes[NUM], starts[NUM, [DIGITS, SPACE]] = DIGITS, 0
    for sign, alone in ((APOSTROPHE, QUOTE), (SIGN, SIGNS)):
        goes[sign] = alone
        goes[sign, [SIGNS, QUOTE, SPACE]], starts[sign, [SIGNS, QUOTE, SPACE]] = SIGNS, 0
    goes[MORE_WHITE], starts[MORE_WHITE, BLANKS] = BLANKS, 0
    goes[LAST_SPACE], goes[LAST_WHITE] = SPACE, FRESH
    for symbol in range(SYMBOLS):
        goes[SYMBOLS + symbol] = goes[symbol, FRESH]
    return goes, starts


GOES, STARTS = _automaton()
_classes: list[np.ndarray] = []


def code_point_classes() -> np.ndarray:
    if not _classes:
        table = np.full(0x110000, OTHER, np.uint8)
        for code in range(0x110000):
            kind = unicodedata.category(chr(code))[0]
            if kind == "L":
                table[code] = LETTER
            elif kind == "N":
                table[code] = NUMBER
        table[list(WHITE_SPACE)] = WHITE
        _classes.append(table)
    return _classes[0]


def symbols(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The symbol of each code point; firsts: the places where texts begin."""
    kind = code_point_classes()[codes]
    first = np.zeros(len(codes) + 1, bool)
    first[firsts] = True
    first[-1] = True
    next_kind = np.where(first[1:], 255, np.append(kind[1:], 255))
    next_code = np.where(first[1:], 0, np.append(codes[1:], 0))
    out = np.array([LET, NUM, SIGN, MORE_WHITE], np.uint8)[kind]
    out[codes == ord("'")] = APOSTROPHE
    for letter in "stmd":
        out[codes == ord(letter)] = LET_END
    for letter, then in ("re", "ve", "ll"):
        out[(codes == ord(letter)) & (next_code == ord(then))] = LET_TWO
    last = (kind == WHITE) & (next_kind != WHITE) & (next_kind != 255)
    out[last] = np.where(codes[last] == 0x20, LAST_SPACE, LAST_WHITE)
    out[first[:-1]] += SYMBOLS
    return out


def scan(symbol: np.ndarray) -> np.ndarray:
    """The automaton's state before each place, by composing the symbols' functions."""
    n = len(symbol)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:n] = symbol
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T).astype(np.uint8) << np.uint8(3)
    flat = GOES.ravel()
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for column in columns:
        whole = flat[column[:, None] | whole]
    step = 1
    while step < blocks:  # inclusive scan of the blocks' functions
        later = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), 1)
        whole = np.concatenate([whole[:step], later])
        step *= 2
    state = np.concatenate([[FRESH], whole[:-1, FRESH]]).astype(np.uint8)
    out = np.empty((BLOCK, blocks), np.uint8)
    for i, column in enumerate(columns):
        out[i] = state
        state = flat[column | state]
    return out.T.ravel()[:n]


def slice_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which slices start, over the texts data[offsets[i]:offsets[i+1]] one after the other."""
    if not len(data):
        return np.zeros(0, np.int64)
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    places = np.flatnonzero((data & 0xC0) != 0x80)
    firsts = np.searchsorted(places, offsets[:-1][np.diff(offsets) > 0])
    symbol = symbols(codes, firsts)
    return places[STARTS[symbol, scan(symbol)].astype(bool)]


class Merger:
    """Ids of slices by merging the neighbours whose join has the lowest rank, leftmost first."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes_ = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.pairs = pairs
        self.token_array = pa.array(self.tokens, pa.large_binary())
        self.decimals = pa.array([f"{i} " for i in range(len(self.tokens))], pa.large_string())
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], 1 << 30)

    def _merge_block(self, words: list[bytes]) -> list[np.ndarray]:
        """Merges many short slices in lockstep, one merge of each at a time."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        width = int(lengths.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        inside = np.arange(width) < lengths[:, None]
        ids = np.where(inside, self.bytes_[raw], 1 << 19)
        rank = np.full((len(words), width), 1 << 30, np.int64)
        if width > 1:
            rank[:, :-1] = np.where(inside[:, 1:], self._rank(ids[:, :-1], ids[:, 1:]), 1 << 30)
        left = lengths.copy()
        live = np.arange(len(words))
        columns = np.arange(width)
        while len(live):
            r = rank[live]
            place = r.argmin(1)
            best = r[np.arange(len(live)), place]
            go = best < 1 << 30
            live, place, best = live[go], place[go], best[go]
            if not len(live):
                break
            i, r = ids[live], rank[live]
            rows = np.arange(len(live))
            source = np.minimum(columns + (columns > place[:, None]), width - 1)
            i, r = np.take_along_axis(i, source, 1), np.take_along_axis(r, source, 1)
            i[rows, place] = best
            left[live] -= 1
            n = left[live]
            r[:, -1] = 1 << 30
            has_next, has_before = place + 1 < n, place > 0
            r[rows, place] = np.where(has_next, self._rank(best, i[rows, np.minimum(place + 1, width - 1)]), 1 << 30)
            before = np.maximum(place - 1, 0)
            r[rows, before] = np.where(has_before, self._rank(i[rows, before], best), r[rows, before])
            ids[live], rank[live] = i, r
        return [ids[k, : left[k]] for k in range(len(words))]

    def _merge_long(self, word: bytes) -> list[int]:
        """The same for one long slice, with a heap over a linked list."""
        ids = self.bytes_[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.pairs.get(rank << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (p := before[i]) >= 0 and (r := self.pairs.get(ids[p] << 20 | rank)) is not None:
                heapq.heappush(heap, (r, p, ids[p], rank))
        return [x for x in ids if x >= 0]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 48), (48, 96), (96, LONG_SLICE)):
            chosen = np.flatnonzero((lengths > low) & (lengths <= high))
            for at in range(0, len(chosen), 20_000):
                some = chosen[at : at + 20_000].tolist()
                for k, ids in zip(some, self._merge_block([words[k] for k in some])):
                    out[k] = ids
        for k in np.flatnonzero(lengths > LONG_SLICE).tolist():
            out[k] = np.array(self._merge_long(words[k]), np.int64)
        return out

    def places(self, slices: list[bytes]) -> np.ndarray:
        """Cache places of distinct slices."""
        new = [s for s in slices if s not in self.known]
        if len(self.known) + len(new) > MOST_CACHED and self.known:
            self.clear()
            new = slices
        if new:
            found = self.merge(new)
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new))))
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
            self.ids = np.concatenate([self.ids, np.concatenate(found).astype(np.int32)])
        return np.fromiter(map(self.known.__getitem__, slices), np.int64, len(slices))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts, each text's offsets into them, and the byte offset at which each slice starts."""
        starts = slice_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), starts
        slices = strings(data, np.append(starts, len(data))).view(pa.large_binary()).dictionary_encode()
        places = self.places(slices.dictionary.to_pylist())[slices.indices.to_numpy()]
        begin, lengths = self.starts[places], self.starts[places + 1] - self.starts[places]
        at = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[spans(begin, lengths)], at[np.searchsorted(starts, offsets)], starts

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids and each id's offsets into them."""
        return text_buffers(self.token_array.take(pa.array(ids)))


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode_decode(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes decoded from them."""
    ranks = ranks or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, "text", 1 << 21):
            data, offsets = text_buffers(batch.column("text"))
            ids, at, _ = merger(ranks).encode(data, offsets)
            decoded, decoded_at = merger(ranks).decode(ids)
            decimals, decimals_at = text_buffers(merger(ranks).decimals.take(pa.array(ids)))
            out = []
            for values, bounds, cut in ((decimals, decimals_at[at], 1), (decoded, decoded_at[at], 0)):
                view = memoryview(values)
                out.append(pa.array([hashlib.sha256(view[a : max(a, b - cut)]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), *out], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text().alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, ids, and the byte offset in the text at which each id's bytes start."""
    ranks = ranks or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, "text", 1 << 21):
            data, offsets = text_buffers(batch.column("text"))
            ids, at, _ = merger(ranks).encode(data, offsets)
            _, starts = merger(ranks).decode(ids)
            inside = starts[:-1] - np.repeat(offsets[:-1], np.diff(at))
            bounds = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(bounds, pa.array(ids)), pa.ListArray.from_arrays(bounds, pa.array(inside.astype(np.int64)))], ["doc_id", "ids", "starts"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text().alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids array<int>, starts array<long>")
