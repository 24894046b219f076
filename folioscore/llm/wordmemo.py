"""Token ids of words, made once per worker for words that come again."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain, islice, repeat

import numpy as np

MOST_WORDS = 500_000
_CALL = 2_000


class WordMemo:
    """Ids of words by one or more tokenizers, held for at most about ``most`` words.

    ``encode`` takes a list of distinct words and returns, per tokenizer, the ids of all of them in a row and
    how many each has. When more words come than there is room for, those that came last are forgotten: words
    that came first are the frequent ones. Results never depend on what is held.
    """

    def __init__(self, encode: Callable[[list], Sequence], sides: int = 1, most: int = MOST_WORDS):
        self.encode, self.sides, self.most = encode, sides, most
        self.place: dict = {}
        self.ids = [np.empty(1 << 12, np.int32) for _ in range(self.sides)]
        self.ends = [np.zeros(1 << 12, np.int64) for _ in range(self.sides)]

    def _add(self, words: list) -> None:
        for k in range(0, len(words), _CALL):
            part = words[k : k + _CALL]
            n = len(self.place)
            self.place.update(zip(part, range(n, n + len(part))))
            for side, (ids, sizes) in enumerate(self.encode(part)):
                start = int(self.ends[side][n])
                self.ids[side] = _room(self.ids[side], start + len(ids))
                self.ends[side] = _room(self.ends[side], n + len(part) + 1)
                self.ids[side][start : start + len(ids)] = ids
                self.ends[side][n + 1 : n + 1 + len(part)] = start + np.cumsum(sizes)

    def look_up(self, words: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per tokenizer: the ids of all words in a row, and how many each word has."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        self._add(list(dict.fromkeys(map(words.__getitem__, missing))))
        at[missing] = np.fromiter(map(self.place.__getitem__, map(words.__getitem__, missing)), np.int64, len(missing))
        out = []
        for ids, ends in zip(self.ids, self.ends):
            first = ends[at]
            sizes = ends[at + 1] - first
            stops = np.cumsum(sizes)
            where = np.arange(int(sizes.sum())) + np.repeat(first - stops + sizes, sizes)
            out.append((ids[where], sizes))
        if len(self.place) > self.most:
            self.place = dict(islice(self.place.items(), self.most // 2))
        return out


def _room(a: np.ndarray, size: int) -> np.ndarray:
    """``a``, or a longer copy of it where it has fewer than ``size`` places."""
    if size <= len(a):
        return a
    longer = np.zeros(max(size, 2 * len(a)), a.dtype)
    longer[: len(a)] = a
    return longer


def in_a_row(lists: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one, and their sizes."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes


class JoinedWords:
    """Encodes many words in one call of a tokenizer, parted by one of its special tokens.

    The special token is cut out of a text before anything else, so every word is encoded as if it stood alone.
    Words that have the token in them are encoded in calls of their own, in which special tokens are text if
    ``as_text``.
    """

    def __init__(self, tokenizer, prefix: str = "", as_text: bool = False):
        self.tokenizer, self.prefix, self.as_text = tokenizer, prefix, as_text
        special = [(t.content, i) for i, t in tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark, self.mark_id = special[-1] if special else ("", -1)
        self.special = [content.encode() for content, _ in special]

    def each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [self.prefix + w for w in words]
        self.tokenizer.encode_special_tokens = self.as_text
        try:
            return in_a_row([e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)])
        finally:
            self.tokenizer.encode_special_tokens = False

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = self.prefix + (self.mark + self.prefix).join(words)
        if not self.mark or joined.count(self.mark) != len(words) - 1:
            return self.each(words)
        encoded = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0]
        ids = np.array(encoded.ids, np.int32)
        cuts = np.flatnonzero(ids == self.mark_id)
        return np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1


def per_text(word_sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sums of ``word_sizes`` over texts that have ``words[i]`` words each."""
    total = np.concatenate([[0], np.cumsum(word_sizes)])
    ends = np.cumsum(words)
    return total[ends] - total[ends - words]
