"""Cheap numeric features of whole texts, for the classifiers.

Only the text enters: never labels, language, source or ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import textkernel as K
from lexmill.llm.common import sliced

#: Hashed word buckets that follow the numeric features.
BUCKETS = 192
NAMES = ("log_bytes", "log_words", "upper", "digit", "symbol", "mark", "newline", "wide", "word_length", "word_length_sd", "distinct_words", "distinct_runs", "repeats", "upper_words", "bar")


def _classes() -> np.ndarray:
    """Byte -> class: 0 other, 1 upper case, 2 digit, 3 symbol, 4 sentence mark, 5 newline, 6 not ASCII, 7 bar."""
    out = np.zeros(256, np.uint8)
    out[65:91] = 1
    out[48:58] = 2
    for c in b"!#$%&*+/<=>@[\\]^_`{}~":
        out[c] = 3
    for c in b".,;:?'\"()-":
        out[c] = 4
    out[10] = 5
    out[128:] = 6
    out[124] = 7
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, features): numeric columns as in NAMES, then hashed word shares."""
    data, offsets = K.string_buffer(column)
    classes, out = _classes(), []
    for first, last in K.chunks(offsets):
        own = offsets[first : last + 1]
        part, own = data[own[0] : own[-1]], own - own[0]
        rows, size = last - first, np.diff(own)
        starts, ends, firsts = K.words_of(part, own)
        hashes, words = K.word_hashes(part, starts, ends), np.diff(firsts)
        of_word, of_byte = np.repeat(np.arange(rows), words), np.repeat(np.arange(rows), size)
        kinds = np.bincount(of_byte * 8 + classes[part], minlength=rows * 8).reshape(rows, 8)
        length = (ends - starts).astype(float)
        n = np.maximum(words, 1)
        mean = np.bincount(of_word, length, rows) / n
        spread = np.sqrt(np.maximum(np.bincount(of_word, length**2, rows) / n - mean**2, 0))
        runs, begin = K.shingles(hashes, firsts, 3)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
        shout = (part[starts] >= 65) & (part[starts] < 91) & (part[np.maximum(ends - 1, 0)] < 97)

        def distinct(values, bounds, rows=rows):
            return np.array([len(np.unique(values[bounds[i] : bounds[i + 1]])) / max(1, bounds[i + 1] - bounds[i]) for i in range(rows)])

        share = kinds / np.maximum(size, 1)[:, None]
        numeric = np.column_stack(
            [np.log1p(size) / 5, np.log1p(words) / 5, *(share[:, c] for c in (1, 2, 3, 4, 5, 6)), mean / 10, spread / 10, distinct(hashes, firsts), distinct(runs, begin), np.bincount(of_word, same, rows) / n, np.bincount(of_word, shout, rows) / n, share[:, 7]]
        )
        bag = np.bincount(of_word * BUCKETS + (hashes % K.U64(BUCKETS)).astype(np.int64), minlength=rows * BUCKETS).reshape(rows, BUCKETS) / n[:, None]
        out.append(np.hstack([numeric, np.sqrt(bag)]))
    return np.vstack(out) if out else np.zeros((0, len(NAMES) + BUCKETS))


def collect(docs: DataFrame, *keep: str) -> tuple[np.ndarray, list[tuple]]:
    """Features of a bounded set of rows, on the driver, with the columns ``keep``; in a fixed order."""

    def run(batches):
        for batch in sliced(batches):
            x = matrix(batch.column("text")).astype("<f4")
            arrays = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([r.tobytes() for r in x], pa.binary())], [*keep, "x"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{schema}, x binary").collect()
    rows.sort(key=lambda r: tuple(str(r[c]) for c in keep))
    width = len(NAMES) + BUCKETS
    x = np.array([np.frombuffer(r["x"], "<f4") for r in rows], float).reshape(-1, width)
    return x, [tuple(r[c] for c in keep) for r in rows]
