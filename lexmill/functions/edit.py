"""Word edit distance, its split into substitutions, deletions and insertions, and alignments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

#: Words from which a pair is aligned by itself.
LONG = 65
#: Pairs that are aligned together.
TOGETHER = 2048
#: Words that a task holds with their counts.
SUMMED = 500_000


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _coded(reference: pa.Array, hypothesis: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two arrays of word lists as (codes, lengths) each, end to end; equal words of the batch have equal codes, a null list is empty."""
    sides = reference, hypothesis
    flat = [x.flatten() for x in sides]
    codes = pa.concat_arrays(flat).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    n, m = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in sides)
    return codes[: len(flat[0])], n, codes[len(flat[0]) :], m


def _listed(pairs: list[tuple[list[str], list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _coded(*(pa.array([list(p[side]) for p in pairs], pa.list_(pa.string())) for side in (0, 1)))


def _slices(n: np.ndarray, m: np.ndarray):
    """(first, last) of consecutive pairs: long ones one by one, others up to ``TOGETHER``."""
    long = np.flatnonzero((n >= LONG) | (m >= LONG)).tolist()
    first = 0
    for stop in [*long, len(n)]:
        for i in range(first, stop, TOGETHER):
            yield i, min(i + TOGETHER, stop)
        if stop < len(n):
            yield stop, stop + 1
        first = stop + 1


def _padded(codes: np.ndarray, lengths: np.ndarray, width: int, fill: int) -> np.ndarray:
    out = np.full((len(lengths), width), fill, np.int32)
    out[np.arange(width) < lengths[:, None]] = codes
    return out


class _Table:
    """The tables of short pairs, a column of all of them at a time: each column is bits of one word, as Myers and Hyyrö have it."""

    def __init__(self, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, steps: bool):
        self.n, self.m = n, m
        word = np.uint32 if n.max() <= 32 else np.uint64
        self.a, self.b = _padded(a, n, np.dtype(word).itemsize * 8, -1), np.ascontiguousarray(_padded(b, m, int(m.max()), -2).T)
        one, last = word(1), np.maximum(n - 1, 0).astype(word)
        up, down = np.full(len(n), ~word(0)), np.zeros(len(n), word)
        self.errors = n.copy()
        self.straight, self.down = (np.zeros((int(m.max()), len(n)), word) for _ in range(2)) if steps else (None, None)
        for j in range(int(m.max())):
            same = np.packbits(self.a == self.b[j][:, None], axis=1, bitorder="little").view(word)[:, 0]
            level = (((same & up) + up) ^ up) | same | down
            more, less = down | ~(level | up), level & up
            self.errors += np.where(j < m, (more >> last & one).astype(np.int64) - (less >> last & one).astype(np.int64), 0)
            more, less = more << one | one, less << one
            up, down = less | ~(level | more), more & level
            if steps:
                # A diagonal step costs what it should where words are equal or the cell is one more than that before; a step down where it is one more than that above.
                self.straight[j], self.down[j] = same | ~level, up
        self.errors = np.where(n == 0, m, self.errors)

    def ops(self) -> tuple[np.ndarray, np.ndarray]:
        """The letters of the preferred alignments end to end, and their number for each pair."""
        rows, i, j, letters = np.arange(len(self.n)), self.n.copy(), self.m.copy(), []
        one = self.straight.dtype.type(1)
        while (going := (i > 0) | (j > 0)).any():
            x, y = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
            bit = x.astype(self.straight.dtype)
            both = (i > 0) & (j > 0)
            if len(self.straight):
                direct, above = (self.straight[y, rows] >> bit & one).astype(bool) & both, (self.down[y, rows] >> bit & one).astype(bool)
                same = self.a[rows, x] == self.b[y, rows]
            else:
                direct = above = same = both
            above = ~direct & (i > 0) & ((j == 0) | above)
            letters.append(np.where(direct, np.where(same, ord("C"), ord("S")), np.where(above, ord("D"), np.where(going, ord("I"), 0))).astype(np.uint8))
            i, j = i - (direct | above), j - (going & ~above)
        if not letters:
            return np.zeros(0, np.uint8), np.zeros(len(self.n), np.int64)
        found = np.stack(letters[::-1], axis=1)
        return found[found > 0], (found > 0).sum(1)


def _all_ops(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of the preferred alignment of each pair, end to end, and their number for each pair."""
    ends = [np.concatenate([[0], np.cumsum(x)]) for x in (n, m)]
    ops, sizes = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for first, last in _slices(n, m):
        x, y = a[ends[0][first] : ends[0][last]], b[ends[1][first] : ends[1][last]]
        if max(n[first], m[first]) >= LONG:
            path = np.frombuffer(path_of(x.tolist(), y.tolist()).encode(), np.uint8)
            found = path, np.array([len(path)])
        else:
            found = _Table(x, n[first:last], y, m[first:last], True).ops()
        ops.append(found[0])
        sizes.append(found[1])
    return np.concatenate(ops), np.concatenate(sizes)


def _long_distance(a: list[int], b: list[int]) -> int:
    """As the short pairs' columns, with the bits in one large number."""
    if not a or not b:
        return max(len(a), len(b))
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole, last, errors = (1 << len(a)) - 1, len(a) - 1, len(a)
    up, down = whole, 0
    for y in b:
        same = places.get(y, 0)
        level = (((same & up) + up) ^ up) | same | down
        more, less = down | (whole & ~(level | up)), level & up
        errors += (more >> last & 1) - (less >> last & 1)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(level | more)) & whole, more & level & whole
    return errors


def _distances(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    ends = [np.concatenate([[0], np.cumsum(x)]) for x in (n, m)]
    out = np.zeros(len(n), np.int64)
    for first, last in _slices(n, m):
        x, y = a[ends[0][first] : ends[0][last]], b[ends[1][first] : ends[1][last]]
        out[first:last] = _long_distance(x.tolist(), y.tolist()) if max(n[first], m[first]) >= LONG else _Table(x, n[first:last], y, m[first:last], False).errors
    return out


@F.arrow_udf(LongType())
def edit_distance(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """Unit-cost distance of two word arrays; null if one is."""
    unknown = pc.or_(pc.is_null(reference), pc.is_null(hypothesis))
    return pc.if_else(unknown, pa.scalar(None, pa.int64()), pa.array(_distances(*_coded(reference, hypothesis)), pa.int64()))


def paths(pairs: list[tuple[list[str], list[str]]]) -> list[str]:
    """The preferred alignment of each pair, as ``path_of`` has it; short pairs advance together."""
    ops, sizes = _all_ops(*_listed(pairs))
    return [x.tobytes().decode() for x in np.split(ops, np.cumsum(sizes)[:-1])] if pairs else []


def _counts(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    ops, sizes = _all_ops(a, n, b, m)
    pair = np.repeat(np.arange(len(n)), sizes)
    each = np.stack([np.bincount(pair[ops == ord(op)], minlength=len(n)) for op in "SDI"], axis=1).astype(np.int64)
    return np.column_stack([each.sum(1), each])


def count_edits(pairs: list[tuple[list[str], list[str]]]) -> np.ndarray:
    """(cost, substitutions, deletions, insertions) of each pair; of equal costs a substitution goes before a deletion before an insertion."""
    return _counts(*_listed(pairs))


@F.arrow_udf(StructType([StructField(c, LongType()) for c in ("cost", "substitutions", "deletions", "insertions")]))
def edit_counts(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    found = _counts(*_coded(reference, hypothesis))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in range(4)], ["cost", "substitutions", "deletions", "insertions"])


def count_words(rows: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """(op, word, n): how often the preferred alignments of all rows have a step with a word, that of the reference, or for an insertion that of the hypothesis.

    Each batch is counted where it is aligned, and batches of a task are summed;
    no step becomes a row.
    """

    def counted(batch):
        sides = batch.column(0), batch.column(1)
        a, n, b, m = _coded(*sides)
        words = pa.concat_arrays([x.flatten() for x in sides]).dictionary_encode("encode").dictionary.cast(pa.string())
        ops, _ = _all_ops(a, n, b, m)
        heard, said = ops[ops != ord("I")], ops[ops != ord("D")]
        for op in "CSDI":
            times = np.bincount(b[said == ord("I")] if op == "I" else a[heard == ord(op)], minlength=len(words))
            held = np.flatnonzero(times)
            yield pa.table({"op": pa.array([op] * len(held), pa.string()), "word": words.take(pa.array(held)), "n": pa.array(times[held].astype(np.int64))})

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            parts += counted(batch)
            size += sum(p.num_rows for p in parts[-4:])
            if size > 4 * SUMMED:
                parts = [pa.concat_tables(parts).group_by(["op", "word"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["op", "word", "n"])]
                size = parts[0].num_rows
                if size > SUMMED:
                    yield from parts[0].to_batches(10_000)
                    parts, size = [], 0
        if parts:
            yield from pa.concat_tables(parts).group_by(["op", "word"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["op", "word", "n"]).to_batches(10_000)

    found = rows.select(reference, hypothesis).mapInArrow(run, "op string, word string, n long")
    return found.groupBy("op", "word").agg(F.sum("n").alias("n"))


def path_of(reference: list[str], hypothesis: list[str]) -> str:
    """The preferred alignment from first to last, one letter each: C, S, D or I.

    A row of the table is one step of numpy; of each cell two bits are kept, so
    texts of 20,000 words take 100 MB.
    """
    code: dict[str, int] = {}
    a, b = (np.array([code.setdefault(w, len(code)) for w in x], np.int64) for x in (reference, hypothesis))
    n, m = len(a), len(b)
    places = np.arange(1, m + 1)
    line = np.arange(m + 1)
    straight, down = [], []
    for i in range(n):
        direct, above = line[:-1] + (b != a[i]), line[1:] + 1
        # Insertions along the row: the least of (value - place) so far, plus the place.
        line = np.concatenate([[i + 1], np.minimum(direct, above) - places])
        line[1:] = np.minimum.accumulate(line)[1:] + places
        straight.append(np.packbits(line[1:] == direct))
        down.append(np.packbits(line[1:] == above))
    path, i, j = [], n, m
    while i or j:
        byte, bit = (j - 1) >> 3, 7 - ((j - 1) & 7)
        if i and j and straight[i - 1][byte] >> bit & 1:
            i, j = i - 1, j - 1
            path.append("C" if a[i] == b[j] else "S")
        elif i and (not j or down[i - 1][byte] >> bit & 1):
            i -= 1
            path.append("D")
        else:
            j -= 1
            path.append("I")
    return "".join(reversed(path))


def alignment(reference: list[str], hypothesis: list[str]) -> list[tuple[str, str, str]]:
    """(op, reference word, hypothesis word) from first to last; op is C, S, D or I."""
    out, i, j = [], 0, 0
    for op in path_of(reference, hypothesis):
        out.append((op, "" if op == "I" else reference[i], "" if op == "D" else hypothesis[j]))
        i, j = i + (op != "I"), j + (op != "D")
    return out


@F.arrow_udf(StructType([StructField(c, ArrayType(IntegerType())) for c in ("ref", "hyp")]))
def aligned_places(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """For each step of the preferred alignment the place of its reference word and of its hypothesis word, -1 for none."""
    a, n, b, m = _coded(reference, hypothesis)
    ops, sizes = _all_ops(a, n, b, m)
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())

    def places(has, lengths):
        out = np.full(len(ops), -1, np.int32)
        out[has] = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return pa.ListArray.from_arrays(ends, pa.array(out))

    return pa.StructArray.from_arrays([places(ops != ord("I"), n), places(ops != ord("D"), m)], ["ref", "hyp"])


def align(reference: str, hypothesis: str):
    """array<struct<op,ref,hyp>> from first to last, of two columns by name; op is C, S, D or I. Python gives places alone, the words are put beside them in the JVM."""
    a, b = F.col(reference), F.col(hypothesis)

    def step(i, j):
        x, y = F.when(i < 0, "").otherwise(F.get(a, F.greatest(i, F.lit(0)))), F.when(j < 0, "").otherwise(F.get(b, F.greatest(j, F.lit(0))))
        op = F.when(i < 0, "I").when(j < 0, "D").when(x == y, "C").otherwise("S")
        return F.struct(op.alias("op"), x.alias("ref"), y.alias("hyp"))

    return let(aligned_places(a, b), lambda p: F.zip_with(p["ref"], p["hyp"], step))
