"""Encoding with a tokenizers file whose pre-tokenizer never joins text across white space.

Each batch is cut into pieces at places that the pre-tokenizer never joins across, and every distinct piece is encoded
once per worker, so the library sees distinct pieces only. Strings of the file's added tokens are cut out before, as
the library does: each is its own id, and the texts beside it are encoded apart.
"""

from __future__ import annotations

import os
import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa

from skein.llm.common import LOWER_TABLE, spans, strings, text_buffers

MOST_CACHED = 300_000
#: The library's results take far more memory than their ids.
AT_ONCE = 16_384

BLANK, LETTER, DIGIT, SIGN, QUOTE, ELSE = range(6)


def _cuts() -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte, and for each pair of classes whether a piece may end between them."""
    kinds = np.full(256, ELSE, np.uint8)
    kinds[33:127] = SIGN
    kinds[list(b" \t\n\v\f\r")] = BLANK
    kinds[[*range(65, 91), *range(97, 123)]] = LETTER
    kinds[48:58] = DIGIT
    kinds[ord("'")] = QUOTE
    between = np.zeros((6, 6), bool)
    between[LETTER, [DIGIT, SIGN, QUOTE]] = True
    between[DIGIT, [LETTER, DIGIT, SIGN, QUOTE]] = True
    between[SIGN, [LETTER, DIGIT]] = True
    between[BLANK, [LETTER, DIGIT, SIGN, QUOTE, ELSE]] = True
    return kinds, between.ravel()


KINDS, BETWEEN = _cuts()


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Texts cut at white space and where an ASCII or Latin-1 letter or digit meets another kind; white space is dropped.

    Gives the pieces, A-Z lower-cased, and each text's offsets into them. A pre-tokenizer that takes runs of letters,
    single digits and runs of signs never joins across these cuts.
    """
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
    kind = KINDS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # not the signs for times and divided by
    kind[lead] = kind[lead + 1] = LETTER
    first = np.zeros(len(data), bool)
    first[1:] = BETWEEN[kind[:-1] * 6 + kind[1:]]
    solid = kind != BLANK
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] = solid[begins]
    starts = np.flatnonzero(first)
    kept = data[solid].tobytes().translate(LOWER_TABLE)
    bounds = np.append(np.flatnonzero(first[solid]), len(kept))
    return strings(kept, bounds).view(pa.large_binary()), np.searchsorted(starts, offsets)


_encoders: dict[str, WordEncoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """ids of texts as the library's encode() gives them with add_special_tokens=False."""

    def __init__(self, path: str):
        self.most_cached = 0
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in tokens.values()):
            raise ValueError(f"{path} has added tokens that are more than their strings")
        self.added = {t.content.encode(): i for i, t in tokens.items()}
        self.any_added = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.tokenizer.encode_special_tokens = True  # for the pieces, which are lower-cased: added tokens are gone by then
        for text in ("ab cd", "a\tb\n\nc", " x,y  z ", "don't é.5x 12's $$a"):
            data = np.frombuffer(text.encode(), np.uint8)
            alone = [p.decode() for p in pieces(data, np.array([0, len(data)]))[0].to_pylist()]
            if self.tokenizer.encode(text, add_special_tokens=False).ids != [i for p in alone for i in self.tokenizer.encode(p, add_special_tokens=False).ids]:
                raise ValueError(f"{path} joins text across the cuts of pieces()")
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _shrink(self) -> None:
        """Keeps the half that was met first: mostly the frequent pieces."""
        half = len(self.known) // 2
        self.known = dict(islice(self.known.items(), half))
        self.starts = self.starts[: half + 1].copy()
        self.ids = self.ids[: self.starts[-1]].copy()

    def _numbers(self, found: list[bytes]) -> np.ndarray:
        """The cache places of distinct pieces."""
        new = [p for p in found if p not in self.known]
        if len(self.known) + len(new) > self.most_cached:
            self._shrink()
            new = [p for p in found if p not in self.known]
        if new:
            first, parts = len(self.known), [self.ids]
            self.known.update(zip(new, range(first, first + len(new))))
            lengths = []
            for at in range(0, len(new), AT_ONCE):
                ids = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in new[at : at + AT_ONCE]], add_special_tokens=False)]
                lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
                parts.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths[-1].sum())))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(lengths))])
            self.ids = np.concatenate(parts)
        return np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))

    def _cut_added(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and ids of the added tokens' strings in the texts."""
        raw, found = data.tobytes(), []
        if self.any_added and self.any_added.search(raw):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                found += [(*m.span(), self.added[m.group()]) for m in self.any_added.finditer(raw, a, b)]
        return tuple(np.array(found, np.int64).reshape(-1, 3).T)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a string column, and each row's offsets into them."""
        data, offsets = text_buffers(column)
        cut, end, token = self._cut_added(data, offsets)
        if not len(cut):
            return self._encode(data, offsets)
        data = data.copy()
        data[spans(cut, end - cut)] = ord(" ")
        # the texts before, between and behind added tokens are rows of their own
        parts = np.sort(np.concatenate([offsets, cut, end]), kind="stable")
        ids, at = self._encode(data, parts)
        before = np.searchsorted(cut, offsets, "left")
        return np.insert(ids, at[np.searchsorted(parts, cut)], token.astype(np.uint32)), at[np.searchsorted(parts, offsets)] + before

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, bounds = pieces(data, offsets)
        coded = found.dictionary_encode()
        places = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        starts = self.starts[places]
        lengths = self.starts[places + 1] - starts
        at = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[spans(starts, lengths)], at[bounds]


def encoder(path: str, most_cached: int = MOST_CACHED) -> WordEncoder:
    """One per worker process and file; it caches the largest number of pieces that was asked for."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _encoders[path].most_cached = max(_encoders[path].most_cached, most_cached)
    return _encoders[path]
