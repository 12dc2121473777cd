"""Words and word windows of many UTF-8 texts at once, as arrays.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; ASCII white space never
occurs inside a UTF-8 character, so words of bytes and of characters agree.
Words and windows are represented by 64-bit hashes; they are only ever
compared within one document or, as whole sets, between two documents.
"""

from __future__ import annotations

import numpy as np

from rankmix.llm.pretoken import mix64, span_hashes

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WINDOW = 5
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                    0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def word_spans(raw: np.ndarray, offsets: np.ndarray):
    """Start and end byte of every word, and the words per text."""
    n = len(raw)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    sp = IS_SPACE[raw]
    before = np.empty(n, bool)
    before[1:], before[0] = sp[:-1], True
    first = offsets[:-1][np.diff(offsets) > 0]
    before[first] = True
    starts = np.flatnonzero(before & ~sp)
    after = np.empty(n, bool)
    after[:-1], after[-1] = sp[1:], True
    after[first[first > 0] - 1] = True
    ends = np.flatnonzero(after & ~sp) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def window_hashes(words: np.ndarray, per_text: np.ndarray, whole_if_short: bool = True):
    """Hash of every 5-word window, in order, and the windows per text.

    A text of one to four words counts as a single window when
    ``whole_if_short``, else it has none.
    """
    n = len(words)
    bounds = np.concatenate([[0], np.cumsum(per_text)])
    pad = np.concatenate([words, np.zeros(WINDOW, np.uint64)])
    total = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        total += pad[j:n + j] * FACTORS[j]
    place = np.arange(n) - np.repeat(bounds[:-1], per_text)
    valid = place + WINDOW <= np.repeat(per_text, per_text)
    if whole_if_short:
        for t in np.flatnonzero((per_text > 0) & (per_text < WINDOW)):
            a, b = bounds[t], bounds[t + 1]
            total[a] = np.sum(words[a:b] * FACTORS[:b - a]) + np.uint64(b - a)
            valid[a] = True
    h = mix64(total[valid])
    per = np.diff(np.searchsorted(np.flatnonzero(valid), bounds))
    return h, per


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    return span_hashes(LOWER[raw] if lower else raw, starts, ends)
