"""Token ids of whole texts by a public tokenizer, a batch of texts at a time.

The tokenizer's library works a text at a time and meets the same words again and again. Its
normalizer and splitter never join characters across ASCII white space, so a text's ids are
those of its words in turn. Each Python worker keeps the ids of words it has met in a bounded
table and asks the library for new words only.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters that lower-casing and composition treat one by one, then ASCII symbols.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\[-`{-~]*)")
MAX_WORDS = 600_000
SLICE_BYTES = 4 << 20


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where printable, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def stretches(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch, one stretch after another."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids of texts; ``path`` names a tokenizers file whose model marks word ends."""

    def __init__(self, path: str, max_words: int = MAX_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer(self.whole.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size = self.whole.get_vocab_size()
        self.ends = np.array([(self.whole.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.letters = byte_letters()
        self.max_words = max_words
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.length, self.met = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0

    def _make_room(self) -> None:
        """Forget the words met in one slice only; if that frees too little, all."""
        kept = [w for w, i in self.index.items() if self.met[i] > 1]
        if len(kept) > self.max_words // 2:
            self._reset()
            return
        old = np.array([self.index[w] for w in kept], np.int64)
        start, length, flat = self.start[old], self.length[old], self.flat
        self._reset()
        self._add(kept, flat, start, length)

    def _add(self, words: list[str], source: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Enter words whose ids are ``length`` entries of ``source`` from ``start``; two stretches a word may be given."""
        n, size = len(self.index), len(words)
        each = length.reshape(size, -1).sum(axis=1)
        ids = source[stretches(start, length)]
        while n + size > len(self.start):
            self.start, self.length, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.met))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + size] = self.used + np.cumsum(each) - each
        self.length[n : n + size] = each
        self.used += len(ids)
        self.index.update(zip(words, range(n, n + size), strict=True))

    def _plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, end of each piece's) of letters-only or symbols-only pieces, by the model itself."""
        mapped = " ".join([p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in pieces])
        ids = np.array(self.words.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(pieces):
            raise ValueError("the tokenizer's model doesn't mark word ends")
        return ids, ends

    def _learn(self, new: list[str]) -> None:
        pieces: dict[str, int] = {"": 0}
        odd: list[str] = []
        parts: list[int] = []
        match, number = PLAIN.fullmatch, pieces.setdefault
        for w in new:
            m = match(w)
            if m is None:
                odd.append(w)
                parts += (-len(odd), 0)
            else:
                a, b = m.groups()
                parts += (number(a.lower(), len(pieces)), number(b, len(pieces)))
        known = list(pieces)[1:]
        ids, ends, at = [], [np.zeros(1, np.int64)], 0
        for i in range(0, len(known), 5000):
            got, cut = self._plain(known[i : i + 5000])
            ids.append(got)
            ends.append(cut + at)
            at += len(got)
        others = [e.ids for e in self.whole.encode_batch_fast(odd, add_special_tokens=False)] if odd else []
        ids += [np.array(x, np.uint32) for x in others]
        ends.append(at + np.cumsum([len(x) for x in others], dtype=np.int64))
        ends = np.concatenate(ends)
        lengths = np.diff(ends, prepend=0)
        place = np.array(parts, np.int64)
        place = np.where(place < 0, len(known) - place, place)
        source = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        self._add(new, source, (ends - lengths)[place], lengths[place])

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        unique = coded.dictionary.to_pylist()
        if len(self.index) + len(unique) > self.max_words:
            self._make_room()
        new = [w for w in unique if w not in self.index]
        if new:
            self._learn(new)
        entry = np.fromiter(map(self.index.__getitem__, unique), np.int64, len(unique))
        self.met[entry] += 1
        place = entry[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.length[place]
        offsets = np.concatenate([[0], np.cumsum(lengths)])[np.asarray(words.offsets) - words.offsets[0].as_py()]
        return self.flat[stretches(self.start[place], lengths)], offsets

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has ids[offsets[i]:offsets[i + 1]], with ``end_id`` appended."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        parts, begin = [], 0
        while begin < len(texts):
            done = sizes[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, "right")))
            parts.append(self._slice(texts.slice(begin, stop - begin)))
            begin = stop
        counts = np.concatenate([np.diff(o) for _, o in parts]) if parts else np.zeros(0, np.int64)
        ids = np.concatenate([i for i, _ in parts]) if parts else np.zeros(0, np.uint32)
        if end_id is not None:
            at = np.cumsum(counts) + np.arange(len(counts))
            out = np.empty(len(ids) + len(counts), np.uint32)
            keep = np.ones(len(out), bool)
            keep[at] = False
            out[keep], out[at] = ids, end_id
            ids, counts = out, counts + 1
        return ids, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's own encoder, kept between tasks."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
