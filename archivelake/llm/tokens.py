"""Token ids of whole texts with a public tokenizer, for use inside tasks.

White space always parts this tokenizer's pieces and is dropped, so a text's ids are
those of its words in turn. The words of many texts are found and made distinct in
numpy; every worker keeps a bounded memory of word -> ids, and only new words go
through the tokenizer library.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from archivelake.llm import wordhash
from archivelake.llm.base import WordMemory

#: Name of the vocabulary file; callers may pass a path instead.
VOCABULARY = "word_bpe_49k.json"

#: Words in each of the two generations a worker remembers: about 150 MB in all.
MEMORY_WORDS = 500_000

#: Punctuation after a letter always begins a piece of its own.
_TAIL = b'.,;:!?*$%&#|()"'
#: Only these characters are lowered before the look-up; for others the order of
#: normal form and lower case could matter.
_OTHER = re.compile("[^\x00-įı-ɏ]")
#: Two independent hashes of words.
_VALUES = (wordhash.byte_values(41), wordhash.byte_values(43))


class WordEncoder:
    """ids(texts) -> one array of ids per text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self._ends = np.zeros(self.size, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._memory = WordMemory(self._learn, MEMORY_WORDS)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Encode unknown words: plain letters together, the others one by one."""
        letters = [w for w in new if w.isalpha()]
        learned = {w: self._whole(w) for w in new if not w.isalpha()}
        width = self.dtype.itemsize
        for at in range(0, len(letters), 256):
            part = letters[at:at + 256]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, self.dtype)
            ends = (np.flatnonzero(self._ends[ids]) + 1) * width
            buffer = ids.tobytes()
            if len(ends) != len(part):  # a letter that the tokenizer parts words at
                learned.update((w, self._whole(w)) for w in part)
                continue
            low = 0
            for word, high in zip(part, ends.tolist(), strict=True):
                learned[word] = buffer[low:high]
                low = high
        return learned

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of the texts, as arrays of `dtype`; a null text has none."""
        out: list[np.ndarray] = [np.empty(0, self.dtype)] * len(texts)
        group: list[tuple[int, bytes]] = []
        held = 0

        def flush() -> None:
            if not group:
                return
            for (i, _), found in zip(group, self._group([data for _, data in group]), strict=True):
                out[i] = found if not len(out[i]) else np.concatenate([out[i], found])

        for i, text in enumerate(texts):
            if not text:
                continue
            plain = "<|" in text or _OTHER.search(text)  # special tokens are looked for in the raw text
            for part in wordhash.parts((text if plain else text.lower()).encode()):
                if held + len(part) + 1 > wordhash.CHUNK:
                    flush()
                    group, held = [], 0
                group.append((i, part))
                held += len(part) + 1
        flush()
        return out

    def _group(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of together at most CHUNK bytes, or of one longer word."""
        if len(pieces) == 1 and len(pieces[0]) >= wordhash.CHUNK:
            return [np.frombuffer(self._whole(pieces[0].decode()), self.dtype)]
        data = b"\n".join(pieces)
        raw = np.frombuffer(data, np.uint8)
        starts, ends = wordhash.without_tails(raw, *wordhash.word_spans(raw), _TAIL)
        first, number = self._distinct(data, raw, starts, ends)
        words = [data[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        known = self._memory.values([words])[0]
        width = self.dtype.itemsize
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // width
        offsets = np.cumsum(sizes) - sizes
        # Token positions of every word in turn: its word's ids, one after the other.
        lengths = sizes[number]
        ends_at = np.cumsum(lengths)
        total = int(ends_at[-1]) if len(ends_at) else 0
        places = np.repeat(offsets[number] - (ends_at - lengths), lengths) + np.arange(total)
        ids = np.frombuffer(b"".join(known), self.dtype)[places]
        borders = np.cumsum([len(p) + 1 for p in pieces])[:-1]
        words_before = np.searchsorted(starts, borders)
        tokens_before = np.concatenate([[0], ends_at])[words_before]
        return np.split(ids, tokens_before)

    def _distinct(self, data: bytes, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of one of each word, number of its word for each), by two hashes."""
        one, two = (wordhash.span_hashes(raw, starts, ends, v) for v in _VALUES)
        first, number = wordhash.distinct(one)
        if (two[first][number] == two).all():
            return first, number
        # Unlike words with one hash: number the words themselves.
        seen: dict[bytes, int] = {}
        found = [seen.setdefault(data[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        number = np.array(found, np.int64)
        return np.unique(number, return_index=True)[1], number


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> WordEncoder:
    """This worker's encoder of a vocabulary file (the public word BPE by default)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return WordEncoder(path)
