"""Packing: first-fit decreasing with a tournament tree of bin capacities.

A text becomes token ids and an end id, then pieces: full sequences and one
remainder. Remainders are packed by first-fit decreasing, on their own in each
randomised group of documents, so no group sees more than a bounded number of
rows and groups run in parallel. Only lengths and checksums are shuffled.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import cut, persistent, sliced

#: Documents in a group, on average.
GROUP_DOCS = 2048
#: Words that a task keeps before it starts anew.
WORDS_KEPT = 500_000
#: Latin-1 letters, then marks: neither letters nor digits nor white space.
LETTERS_THEN_MARKS = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]+)")
END_ID = 1


class KnownWords(dict):
    """Ids of words, made when a word is first asked for.

    The tokenizer parts letters from marks, so most words are a stem, or a stem
    and marks. A stem of Latin-1 letters in lower case is one piece to it, as it
    stands, so its model alone is asked.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        # How the model spells Latin-1 letters beyond ASCII.
        beyond = [chr(c) for c in range(0x80, 0x100) if chr(c).isalpha()]
        self.spelled = str.maketrans({c: "".join(piece for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in beyond})

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and word.islower() and (word.isascii() or max(word) <= "\xff"):
            ids = array("I", [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.spelled))]).tobytes()
        else:
            m = LETTERS_THEN_MARKS.fullmatch(word)
            ids = self[m[1]] + self[m[2]] if m else self.encode(word)
        self[word] = ids
        return ids


class WordIds:
    """Ids of texts, each distinct word encoded once.

    The tokenizer drops white space and never joins what white space parts,
    so a text's ids are those of its words, one after the other.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.known = KnownWords(Tokenizer.from_file(path))
        self.encode = self.known.encode

    def ids(self, texts: list[str]) -> list[bytes]:
        """All ids of each text.

        In Latin-1 lower case is letter by letter, as the tokenizer has it; the
        words of other texts stay as they are. str.split also splits at x1C-x1F,
        which the tokenizer keeps, so texts that hold those go whole.
        """
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        find, out = self.known.__getitem__, []
        for text in texts:
            if any(c in text for c in "\x1c\x1d\x1e\x1f"):
                out.append(self.encode(text))
                continue
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                words = text.split()
            else:
                words = text.lower().split()
            out.append(b"".join(map(find, words)))
        return out


def word_ids(path: str) -> WordIds:
    kept = persistent("word_ids")
    if getattr(kept, "path", None) != path:
        kept.path, kept.words = path, WordIds(path)
    return kept.words


def piece_table(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, token count and a checksum of each piece of ``capacity`` ids (the last may be shorter)."""

    def run(batches):
        own = word_ids(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in sliced(batches, 1000):
            counts, sums = [], []
            for ids in own.ids([t or "" for t in batch.column(1).to_pylist()]):
                ids += end
                counts.append(len(ids) // 4)
                sums.append([zlib.crc32(ids[i : i + 4 * capacity]) for i in range(0, len(ids), 4 * capacity)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "sums"])
        own.known.clear()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "doc_id long, doc_tokens long, sums array<long>")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; larger items first, ties in the given order.

    A tournament tree over bins keeps the largest room below each node, so the
    leftmost bin with enough room is found in log(bins) steps. Empty bins are
    leaves with full room: first fit opens them from the left.
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, seed: int = 17, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces with their place: one row each, the columns of ``op9``.

    Null texts count as empty: one piece, the end id. Repeated rows are packed
    each for itself. An empty table gives no rows. Other columns are ignored.
    A group is a hash of the row's place, so that repeated rows spread over all
    groups; the checksums are written with it once, and a lost task finds them
    as they were.
    """
    placed = cut(piece_table(docs, tokenizer, capacity).withColumn("_place", F.monotonically_increasing_id()))
    groups = max(1, -(-placed.count() // group_docs))
    pieces = placed.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "_place"), F.lit(groups))).drop("_place")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "doc_tokens"], kind="stable", ignore_index=True)
        tokens = rows["doc_tokens"].to_numpy(np.int64)
        parts = np.array([len(x) for x in rows["sums"]], np.int64)
        doc = np.repeat(np.arange(len(rows)), parts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = nth * capacity
        length = np.minimum(tokens[doc] - start, capacity)
        bins, offsets = first_fit_decreasing(length, capacity)
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].to_numpy()[doc],
                "start": start,
                "length": length,
                "ids_crc32": np.concatenate([np.asarray(x, np.int64) for x in rows["sums"]]),
                "doc_tokens": tokens[doc],
                "sequence_id": int(rows["group"].iloc[0]) * (1 << 32) + bins,
                "offset": offsets,
            }
        )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return pieces.groupBy("group").applyInPandas(run, schema)
