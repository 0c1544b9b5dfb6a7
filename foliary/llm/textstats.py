"""Whole-text statistics of documents, shared by the quality operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from foliary.llm import textarrays as ta

#: Counted per text, in this order.
COLUMNS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
    "n_letters", "n_upper", "n_digits", "n_marks", "n_marked_words", "n_long_words", "n_chars", "n_twins",
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a") : ord("z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b"#*$%&|<>!?=~^_")] = True
WINDOW = 5


def count(texts: ta.Texts) -> dict[str, np.ndarray]:
    """The COLUMNS of each text, as int64."""
    buf, n = texts.buf, len(texts)
    starts, ends, bounds = ta.words(texts)
    n_words = np.diff(bounds)
    point = (buf & 0xC0) != 0x80
    space = ta.IS_SPACE[buf]
    latin = np.zeros(len(buf), bool)  # second bytes of U+00C0 to U+00FF
    latin[1:] = buf[:-1] == 0xC3
    out = {"n_words": n_words, "word_chars": texts.per_text(point & ~space), "n_chars": texts.per_text(point)}
    out["n_symbols"] = texts.per_text(_SYMBOL[buf])
    upper = _UPPER[buf] | latin & (buf <= 0x9E)
    out["n_upper"], out["n_letters"] = texts.per_text(upper), texts.per_text(upper | _LOWER[buf] | latin)
    out["n_digits"], out["n_marks"] = texts.per_text(_DIGIT[buf]), texts.per_text(_MARK[buf])

    def by_word(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[bounds[1:]] - total[bounds[:-1]]

    out["n_marked_words"] = by_word(_CLOSING[buf[ends - 1]]) if len(ends) else np.zeros(n, np.int64)
    out["n_long_words"] = by_word(ends - starts > 30)

    # Lines: \n-split; only those with a word count.
    line_starts, line_ends = texts.edges(buf != 10)
    if len(line_starts):
        filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_starts, line_ends = line_starts[filled], line_ends[filled]
    of = np.searchsorted(texts.offsets, line_starts, "right") - 1
    key = ta.mix64(ta.hash_runs(buf, line_starts, line_ends) + of.astype(ta.U64) * ta.U64(0xD6E8FEB86659FD93))
    _, first = np.unique(key, return_index=True)
    out["n_lines"] = np.bincount(of, minlength=n)[:n]
    out["n_dup_lines"] = out["n_lines"] - np.bincount(of[first], minlength=n)[:n]

    # Words in windows of five that their text has twice or more. Only windows whose
    # slot of a small table is taken twice can repeat, so only those are sorted.
    hashes = ta.hash_runs(buf, starts, ends)
    value, at, text = ta.windows(hashes, bounds, WINDOW)
    key = value + text.astype(ta.U64) * ta.U64(0xD6E8FEB86659FD93)
    slot = (ta.mix64(key) >> ta.U64(max(44, 62 - len(key).bit_length()))).astype(np.int64)
    shared = np.flatnonzero(np.bincount(slot)[slot] > 1) if len(slot) else slot
    _, group, size = np.unique(key[shared], return_inverse=True, return_counts=True)
    at = at[shared[size[group] > 1]]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    out["n_repeat_words"] = by_word(np.cumsum(cover[:-1]) > 0)
    twin = np.zeros(len(starts), bool)
    twin[1:] = hashes[1:] == hashes[:-1]
    twin[bounds[:-1][n_words > 0]] = False
    out["n_twins"] = by_word(twin)
    return {k: np.asarray(out[k], np.int64) for k in COLUMNS}


def count_arrow(column: pa.Array) -> dict[str, np.ndarray]:
    """`count` over an Arrow string column, a few MB at a time."""
    parts = [count(ta.from_arrow(column[a:b])) for a, b in ta.slices(column)]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in COLUMNS}
