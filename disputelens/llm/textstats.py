"""Counts per text, many texts at a time, for the quality operators."""

from __future__ import annotations

import numpy as np

from disputelens.llm.common import NON_SPACE, U64, Rolling, Words, mix, shingle_hash

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_CONTINUATION = np.array([0x80 <= b < 0xC0 for b in range(256)])


def per_text(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` (bytes of the joined texts) between text starts."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[starts[1:]] - sums[starts[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more, found earlier) for each key, in the order given."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    earlier = np.zeros(len(keys), dtype=bool)
    twice = np.zeros(len(keys), dtype=bool)
    if len(k):
        earlier[order[1:]] = same
        twice[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return twice, earlier


class TextStats:
    """Words (white-space separated, case kept), lines and repeats of several texts."""

    def __init__(self, texts: list[bytes], rolling: Rolling):
        words = self.words = Words(texts, NON_SPACE, lower=False, rolling=rolling)
        n, data, starts = len(texts), words.data, words.text_start
        self.n_words = words.count
        self.n_bytes = np.diff(starts) - 1
        inside = NON_SPACE[data]
        self.word_chars = per_text(inside & ~_CONTINUATION[data], starts)
        self.n_symbols = per_text(SYMBOLS[data], starts)

        # lines: the byte after a text is a space, which ends its last line
        cuts = np.flatnonzero(data == 10)
        line_start = np.sort(np.concatenate([starts[:-1], cuts + 1]))
        line_end = np.sort(np.concatenate([cuts, starts[1:] - 1]))
        has_word = np.searchsorted(words.starts, line_end) > np.searchsorted(words.starts, line_start)
        line_start, line_end = line_start[has_word], line_end[has_word]
        line_text = np.searchsorted(starts, line_start, side="right") - 1
        key = self._in_text(rolling.spans(words.prefix, line_start, line_end), line_text)
        self.n_lines = np.bincount(line_text, minlength=n)
        self.n_dup_lines = np.bincount(line_text[repeated(key)[1]], minlength=n)

        self.word_text = words.text_of()
        three = shingle_hash(words.hash, 3)
        covered = np.zeros(len(words.starts), dtype=bool)
        if len(three):
            at = np.flatnonzero(self.word_text[2:] == self.word_text[:-2])
            twice, _ = repeated(self._in_text(three[at], self.word_text[at]))
            at = at[twice]
            for i in range(3):
                covered[at + i] = True
        self.n_repeat_words = np.bincount(self.word_text[covered], minlength=n)

    @staticmethod
    def _in_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
        return mix(hashes + text.astype(np.uint64) * U64(0x9E3779B97F4A7C15))

    def distinct_words(self) -> np.ndarray:
        _, earlier = repeated(self._in_text(self.words.hash, self.word_text))
        return np.bincount(self.word_text[~earlier], minlength=len(self.n_words))

    def count_bytes(self, allowed: np.ndarray) -> np.ndarray:
        return per_text(allowed[self.words.data], self.words.text_start)
