"""Statistics of one document's UTF-8 bytes, for the quality classifier and the quality rules."""

from __future__ import annotations

from collections import Counter

import numpy as np

SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
SPACE = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)
SENTENCE_ENDS = np.frombuffer(b".!?", np.uint8)
PUNCTUATION = np.frombuffer(b",;:'\"()-_/", np.uint8)


#: From so many words on, windows are counted as numbers in arrays: tuples of a text of millions of words would take some hundred megabytes.
LONG_TEXT = 20_000


def _marked(words: list[bytes], window: int) -> np.ndarray:
    """Where a window starts that occurs twice or more."""
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    n = len(ids) - window + 1
    key, counts = ids[:n], np.ones(0, np.int64)
    for i in range(1, window):
        _, key, counts = np.unique(key * len(index) + ids[i : n + i], return_inverse=True, return_counts=True)
    return np.flatnonzero(counts[key] > 1)


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words in `window`-word windows that occur twice or more, the first occurrence included."""
    if len(words) <= window:
        return 0
    if len(words) >= LONG_TEXT:
        at = _marked(words, window)
    else:
        windows = list(zip(*(words[i:] for i in range(window)), strict=False))
        if len(set(windows)) == len(windows):
            return 0
        counts = Counter(windows)
        at = [i for i, w in enumerate(windows) if counts[w] > 1]
    total, covered_to = 0, 0
    for i in at:
        total += i + window - max(i, covered_to)
        covered_to = i + window
    return int(total)


def duplicate_lines(lines: list[bytes]) -> tuple[int, int]:
    """Of the lines that hold a word: those equal to an earlier line, and all."""
    full = [x for x in lines if x.strip()]
    return len(full) - len(set(full)), len(full)


def base_stats(text: bytes, words: list[bytes], counts: np.ndarray) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars (code points), n_symbols, n_dup_lines, n_lines with a word, n_repeat_words."""
    dup, lines = duplicate_lines(text.split(b"\n"))
    chars = len(text) - int(counts[128:192].sum()) - int(counts[SPACE].sum())
    return len(words), chars, int(counts[SYMBOLS].sum()), dup, lines, repeated_words(words)


def byte_counts(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256)


FEATURES = (
    "log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "bangs", "sentence_ends",
    "punctuation", "pipes", "non_ascii", "lines", "distinct_words", "long_words", "short_words", "entropy", "capitalised",
)


def features(text: bytes) -> list[float]:
    """The classifier's inputs: FEATURES of a whole text, all finite, about 0 to 1 (an empty text: zeros)."""
    words, counts = text.split(), byte_counts(text)
    n, chars, symbols, dup, lines, repeats = base_stats(text, words, counts)
    if not n:
        return [0.0] * len(FEATURES)
    share = counts / len(text)
    seen = share[share > 0]
    sizes = np.fromiter(map(len, words), np.int64, n)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[192:].sum()
    return [
        np.log1p(n) / 10, min(chars / n / 20, 1), symbols / max(chars, 1), dup / max(lines, 1), repeats / n,
        counts[65:91].sum() / max(letters, 1), counts[48:58].sum() / max(chars, 1), counts[33] / n, counts[SENTENCE_ENDS].sum() / n,
        counts[PUNCTUATION].sum() / n, counts[124] / n, counts[192:].sum() / max(chars, 1), lines / n, len(set(words)) / n,
        float((sizes > 14).mean()), float((sizes < 4).mean()), float(-(seen * np.log2(seen)).sum()) / 8, sum(map(bytes.istitle, words)) / n,
    ]
