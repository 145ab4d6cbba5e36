"""Counts of whole texts, vectorised; shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np

from shopfloor.llm.text import SPACE, U, gram_starts, grams, mix, split_words

NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
UPPER, LETTER, DIGIT, PUNCTUATION = (np.zeros(256, bool) for _ in range(4))
UPPER[65:91] = True
LETTER[65:91] = LETTER[97:123] = True
DIGIT[48:58] = True
PUNCTUATION[[ord(c) for c in ".,;:!?"]] = True
WINDOW = 5


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of True within each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which are not the first of their kind in this order."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    later, many = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    many[order[1:][same]] = many[order[:-1][same]] = True
    return many, later


def text_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    texts = len(offsets) - 1
    words = split_words(data, offsets)
    n_words, owner = np.diff(words.first), words.text
    in_word, lead = ~SPACE[data], (data & 0xC0) != 0x80
    lines = split_words(data, offsets, NEWLINE)
    line_owner = lines.text
    worded = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    key = mix(lines.hash ^ mix(line_owner.astype(np.uint64) + U(1)))[worded]
    dup_lines = np.bincount(line_owner[worded][again(key)[1]], minlength=texts)
    at, of = gram_starts(words.first, WINDOW)
    many = again(mix(grams(words.hash, WINDOW)[at] ^ mix(of.astype(np.uint64) + U(1))))[0] if len(at) else np.zeros(0, bool)
    cover = np.zeros(len(words.start) + WINDOW, np.int64)
    np.add.at(cover, at[many], 1)
    np.add.at(cover, at[many] + WINDOW, -1)
    covered = np.cumsum(cover)[: len(words.start)] > 0
    word_again = again(mix(words.hash ^ mix(owner.astype(np.uint64) + U(1))))[1]
    ends_sentence = np.isin(data[words.end - 1], np.frombuffer(b".!?", np.uint8)) if len(words.start) else np.zeros(0, bool)
    first_upper = UPPER[data[words.start]] if len(words.start) else np.zeros(0, bool)
    return {
        "n_bytes": np.diff(offsets), "n_words": n_words, "word_chars": per_text(in_word & lead, offsets), "n_symbols": per_text(SYMBOLS[data], offsets),
        "n_lines": np.bincount(line_owner[worded], minlength=texts), "n_dup_lines": dup_lines, "n_repeat_words": np.bincount(owner[covered], minlength=texts),
        "n_repeated": np.bincount(owner[word_again], minlength=texts), "n_upper": per_text(UPPER[data], offsets), "n_letters": per_text(LETTER[data], offsets),
        "n_digits": per_text(DIGIT[data], offsets), "n_punctuation": per_text(PUNCTUATION[data], offsets), "n_bang": per_text(data == 33, offsets),
        "n_bar": per_text(data == 124, offsets), "n_wide": per_text(data >= 128, offsets), "n_sentences": np.bincount(owner[ends_sentence], minlength=texts),
        "n_capital": np.bincount(owner[first_upper], minlength=texts), "longest_word": longest(words, texts),
    }


def longest(words, texts: int) -> np.ndarray:
    out = np.zeros(texts, np.int64)
    np.maximum.at(out, words.text, words.end - words.start)
    return out
