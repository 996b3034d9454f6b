"""Statistics of whole texts, computed from the byte buffer of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shingles import row_chunks, shingle_hashes, text_buffers, word_hashes

NAMES = ("n_chars", "n_words", "word_length", "upper_share", "digit_share", "punct_share", "symbol_share",
         "space_share", "symbol_word_share", "distinct_word_share", "top_word_share", "repeated_shingles",
         "n_lines", "repeated_lines", "line_length", "one_char_words", "words_per_stop", "capital_words")
SCHEMA = ", ".join(f"{n} double" for n in NAMES)

#: byte classes: lower, upper, digit, space, stop, other punctuation, symbol, head or continuation of UTF-8
_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _PUNCT, _SYMBOL, _HEAD, _CONT = range(9)
_class = np.full(256, _SYMBOL, dtype=np.int64)
_class[97:123], _class[65:91], _class[48:58] = _LOWER, _UPPER, _DIGIT
_class[[32, 9, 10, 11, 12, 13]] = _SPACE
_class[[ord(c) for c in ".!?"]] = _STOP
_class[[ord(c) for c in ",;:'\"()-"]] = _PUNCT
_class[0xC0:], _class[0x80:0xC0] = _HEAD, _CONT


def _repeats(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: number of distinct values, and the count of the most frequent one."""
    rows = len(counts)
    if not len(values):
        return np.zeros(rows), np.zeros(rows)
    # 20 bits name the row of a chunk, 44 bits of the hash the value
    key = np.repeat(np.arange(rows, dtype=np.uint64) << np.uint64(44), counts)
    key |= values >> np.uint64(20)
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    row = (key[at] >> np.uint64(44)).astype(np.int64)
    size = np.diff(np.append(at, len(key)))
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    top = np.zeros(rows)
    top[row[first]] = np.maximum.reduceat(size, first)
    return np.bincount(row, minlength=rows).astype(float), top


def _line_hashes(raw: np.ndarray, w: np.ndarray, counts: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the words of every line that has words, such lines of each row)."""
    if not len(w):
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    line = np.searchsorted(np.flatnonzero(raw == 10), begin) + row     # grows with lines and with rows
    at = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    pos = np.arange(len(w)) - np.repeat(at, np.diff(np.append(at, len(w))))
    mixed = w * (2 * pos.astype(np.uint64) + np.uint64(0x9E3779B1))
    return np.add.reduceat(mixed, at), np.bincount(row[at], minlength=len(counts))


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, statistics) of a chunk of texts; an empty text has zeros throughout."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows) * 9, np.diff(offsets))
    row += _class[raw]
    c = np.bincount(row, minlength=9 * rows).reshape(rows, 9)
    del row
    w, counts, begin, end = word_hashes(raw, offsets)
    word_row = np.repeat(np.arange(rows), counts)
    by_word = lambda mask: np.bincount(word_row[mask], minlength=rows)
    at_least = lambda x: np.maximum(x, 1)                                # noqa: E731
    distinct, top = _repeats(w, counts)
    s, n_sh = shingle_hashes(w, counts, 5)
    distinct_s, _ = _repeats(s, n_sh)
    lines, n_lines = _line_hashes(raw, w, counts, begin)
    distinct_l, _ = _repeats(lines, n_lines)
    chars = np.diff(offsets) - c[:, _CONT]
    first, last = _class[raw[begin]], _class[raw[end - 1]]
    out = np.column_stack([
        chars, counts, (chars - c[:, _SPACE]) / at_least(counts), c[:, _UPPER] / at_least(c[:, _UPPER] + c[:, _LOWER]),
        c[:, _DIGIT] / at_least(chars), (c[:, _STOP] + c[:, _PUNCT]) / at_least(chars), c[:, _SYMBOL] / at_least(chars),
        c[:, _SPACE] / at_least(chars), by_word(last == _SYMBOL) / at_least(counts), distinct / at_least(counts),
        top / at_least(counts), 1 - distinct_s / at_least(n_sh), n_lines, 1 - distinct_l / at_least(n_lines),
        counts / at_least(n_lines), by_word(end - begin == 1) / at_least(counts), counts / at_least(c[:, _STOP]),
        by_word(first == _UPPER) / at_least(counts)]).astype(float)
    out[counts == 0, 2:] = 0.0
    return out.reshape(rows, len(NAMES))


def stats_pass(keep: tuple[str, ...], text: str = "text"):
    """mapInArrow function: the columns ``keep`` and the statistics of ``text``."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
            parts = [statistics(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                     for a, b in row_chunks(offsets)]
            table = np.vstack(parts) if parts else np.zeros((0, len(NAMES)))
            cols = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.record_batch(cols + [pa.array(table[:, i]) for i in range(len(NAMES))],
                                  names=[*keep, *NAMES])
    return run
