"""LM scoring by cross-entropy difference.

Two bigram models, of a target corpus and of the background, share one
vocabulary, one smoothing rule and one scoring pass; a document's score is the
mean per-token difference of its losses (low: like the target).

Every word is told apart by a 64-bit hash and every bigram has its own count;
what is counted grows with the corpus, and none of it is broadcast or sent to
the driver. Documents are packed into groups, written once. A group asks for
each of its different bigrams once: the questions are dealt by a hash of the
bigram, answered with the corpus's counts, and the answers go back to the
group, in the order of the questions and so without the bigrams. Words are
asked for in the same way. A word or bigram of a third of all documents has one
question a group, not one a document, so no bucket is hot. Questions and
answers are compressed blocks of whole columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import textkernel as K
from lexmill.llm.common import BROADCAST_ROWS, collect_shuffles, cut, give_back, sliced

#: Words of ``vocabulary`` by default.
WORDS = 1023
#: Kinds of words that smoothing allows for at least; a larger vocabulary counts in full.
SIZE = 2048
#: The class of a text's edge.
EDGE = K.U64(0x9E3779B97F4A7C15)
#: Tokens of a group, about (a longer text is a group by itself), and of a bucket of bigrams or words.
GROUP_TOKENS = 2_000_000
BUCKET_TOKENS = 2_000_000
#: Entries held before they are summed in a task, and after which sums are passed on.
FOLD = 4_000_000


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): hashes of all words of all documents with their counts, pre-summed in each task."""

    def summed(words, sums):
        w, back = np.unique(np.concatenate(words), return_inverse=True)
        return [w], [np.bincount(back, np.concatenate(sums)).astype(np.int64)]

    def rows(words, sums):
        (w,), (n,) = summed(words, sums)
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["word", "n"])

    def run(batches):
        words, sums = [], []
        for batch in sliced(batches):
            data, offsets = K.string_buffer(batch.column(0))
            for first, last in K.chunks(offsets):
                own = offsets[first : last + 1]
                part = data[own[0] : own[-1]]
                starts, ends, _ = K.words_of(part, own - own[0])
                w, n = np.unique(K.word_hashes(part, starts, ends), return_counts=True)
                words.append(w), sums.append(n)
            if sum(map(len, words)) >= FOLD // 4:
                words, sums = summed(words, sums)
                if len(words[0]) >= FOLD // 8:
                    yield rows(words, sums)
                    words, sums = [], []
        if words:
            yield rows(words, sums)

    return docs.select("_text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the commonest words; ties by hash."""
    top = word_counts(docs).orderBy(F.desc("n"), "word").limit(words).collect()
    return np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))


def next_words(column: pa.Array):
    """(hashes, first of each row): the words of each text and an edge after them. Each follows the one before it, the first an edge."""
    data, offsets = K.string_buffer(column)
    for first, last in K.chunks(offsets):
        own = offsets[first : last + 1]
        part = data[own[0] : own[-1]]
        starts, ends, firsts = K.words_of(part, own - own[0])
        n = np.diff(firsts)
        begin = np.concatenate([[0], np.cumsum(n + 1)])
        after = np.full(begin[-1], EDGE)
        after[np.arange(len(starts)) + np.repeat(np.arange(last - first), n)] = K.word_hashes(part, starts, ends)
        yield after, begin


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """64-bit keys of ordered pairs of hashes."""
    x = before * K.U64(0xC2B2AE3D27D4EB4F) + (after ^ (after >> K.U64(29))) * K.U64(0x165667B19E3779F9)
    x = (x ^ (x >> K.U64(32))) * K.U64(0xD6E8FEB86659FD93)
    return x ^ (x >> K.U64(32))


# ---- blocks of columns: the bytes of a column place by place, so that high zero bytes lie together --------


def squeeze(*columns: np.ndarray) -> bytes:
    import zstandard

    places = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(places))


def unsqueeze(blob: bytes, *shapes: tuple[int, str]) -> list[np.ndarray]:
    """The columns, given the length and kind of each."""
    import zstandard

    data, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), 0, []
    for n, kind in shapes:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(data[at : at + n * width].reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out


def gaps(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising, prepend=rising[:1] * 0)


#: Words that have a short code in blocks: the commonest ones. The table (half a megabyte) only shortens blocks; it decides nothing.
CODED = 65_535
#: What marks the keys of other words, so that none looks like a code.
MARK, LOW_MARK = K.U64(1 << 63), K.U64(1 << 47)


def low_bytes(keys: np.ndarray) -> np.ndarray:
    """Six bytes of each key, as three 16-bit columns in one array; enough to tell apart the words after one word."""
    short = np.where(keys & MARK, keys | LOW_MARK, keys)
    return np.ascontiguousarray(short.view("<u2").reshape(-1, 4)[:, :3])


def six_bytes(columns: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(columns) // 3, 4), "<u2")
    wide[:, :3] = columns.reshape(-1, 3)
    return wide.view("<u8").ravel()


# ---- groups -------------------------------------------------------------------------


def groups(marked: DataFrame, kind: str) -> DataFrame:
    """(m, ids, targets, lengths, n_words, n_tokens, words, sequence): packed groups of (doc_id, _text, _target), made without moving a row."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, lengths, ids, targets, size = [], [], [], [], 0

        def packed():
            after = np.concatenate(held)
            held.clear()
            words, place, count = kinds_of(after)
            # Frequent words get small places, which compress best; words as frequent as each other stay in order.
            order = np.lexsort((words, -np.frexp(count)[1]))
            words, place = words[order], inverse(order)[place]
            n, all_ids = np.concatenate(lengths), pa.concat_arrays(ids)
            wide = "<u2" if len(words) <= 1 << 16 else "<u4"
            lists = pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids)
            blob = lambda x: pa.array([x], pa.binary())
            whole = lambda x: pa.array([x], pa.int64())
            arrays = [whole(number), lists, blob(np.concatenate(targets).astype(np.uint8).tobytes()), blob(n.astype("<i8").tobytes()), whole(len(words)), whole(len(after)), blob(squeeze(gaps(words))), blob(squeeze(place.astype(wide)))]
            return pa.RecordBatch.from_arrays(arrays, ["m", "ids", "targets", "lengths", "n_words", "n_tokens", "words", "sequence"])

        for batch in sliced(batches):
            target = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            row = 0
            for after, begin in next_words(batch.column(1)):
                last = row + len(begin) - 1
                held.append(after), lengths.append(np.diff(begin)), ids.append(batch.column(0).slice(row, last - row)), targets.append(target[row:last])
                size, row = size + len(after), last
                if size >= GROUP_TOKENS:
                    yield packed()
                    held, lengths, ids, targets, size, number = [], [], [], [], 0, number + 1
                    give_back()
        if held:
            yield packed()

    return marked.select("doc_id", "_text", "_target").mapInArrow(run, f"m long, ids array<{kind}>, targets binary, lengths binary, n_words long, n_tokens long, words binary, sequence binary")


def common_words(packs: DataFrame, least: int = 4) -> np.ndarray:
    """Sorted hashes of at most CODED common words; a word counts in the groups that have it ``least`` times."""

    def run(batches):
        for row in single(batches):
            words, after = opened(row)
            n = np.bincount(after, minlength=len(words))
            often = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(words[often].view(np.int64)), pa.array(n[often])], ["word", "n"])

    top = packs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(CODED).toArrow()
    return np.sort(top.column("word").to_numpy().astype(np.int64).view(np.uint64))


def single(batches):
    """The rows of the batches, each made when it is asked for; what was freed meanwhile goes back to the system."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
            give_back()


def inverse(order: np.ndarray) -> np.ndarray:
    """Where each place went, in 32 bits."""
    out = np.empty(len(order), np.int32)
    out[order] = np.arange(len(order), dtype=np.int32)
    return out


def kinds_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different values, place of each value among them in 32 bits, counts): np.unique with half its memory."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    kinds, first = ordered[new], np.flatnonzero(new)
    del ordered
    place = np.empty(len(order), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return kinds, place, np.diff(first, append=len(new))


def opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, place of each token's word) of a packed group."""
    wide = "<u2" if row["n_words"] <= 1 << 16 else "<u4"
    return np.cumsum(unsqueeze(row["words"], (row["n_words"], "<u8"))[0], dtype=np.uint64), unsqueeze(row["sequence"], (row["n_tokens"], wide))[0].astype(np.int32)


class Group:
    """One packed group: its words (by rising key), and its different bigrams in order of bucket, first and second word."""

    def __init__(self, row: dict, common: np.ndarray, buckets: int):
        words, after = opened(row)
        at = np.minimum(np.searchsorted(common, words), max(0, len(common) - 1))
        keys = np.where(common[at] == words, at.astype(np.uint64), words | MARK) if len(common) else words | MARK
        order = np.argsort(keys, kind="stable")
        rank = inverse(order)
        self.keys = keys[order]
        self.after = rank[after]
        edge = rank[np.flatnonzero(words == EDGE)[0]]
        del after, at, keys, rank, order
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.target = np.repeat(np.frombuffer(row["targets"], np.uint8), self.lengths)
        pairs = np.empty(len(self.after), np.int64)
        pairs[1:] = self.after[:-1]
        pairs[self.begin] = edge
        pairs *= len(words)
        pairs += self.after
        kinds, back, n = kinds_of(pairs)
        del pairs
        a, b = (kinds // len(words)).astype(np.int32), (kinds % len(words)).astype(np.int32)
        del kinds
        bucket = (pair_keys(self.keys[a], self.keys[b]) % K.U64(buckets)).astype(np.int32)
        # In a block, bigrams of two coded words come first.
        order = np.argsort(2 * bucket.astype(np.int64) + (np.maximum(self.keys[a], self.keys[b]) >= MARK), kind="stable")
        self.a, self.b, self.back, self.n = a[order], b[order], inverse(order)[back], n[order]
        self.bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))

    def counted(self, what: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(what[self.target > 0], minlength=size)

    def word_order(self, buckets: int):
        """Places of the words in order of their bucket, and where each bucket begins."""
        bucket = (self.keys % K.U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


BLOCK = "kind int, key long, part long, size long, extra long, blob binary"
#: What a block holds: counts of bigrams, kinds of bigrams by their first word, words, counts of words, and totals.
PAIRS, KINDS, WORD_COUNTS, ANSWERS, TOTALS = range(5)


def block_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 6
    types = [pa.int32(), *[pa.int64()] * 4, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["kind", "key", "part", "size", "extra", "blob"])


def pair_block(a: np.ndarray, b: np.ndarray, n: np.ndarray, t: np.ndarray) -> tuple[int, bytes]:
    """(how many bigrams are of two coded words, block) of bigrams in order of their words' keys, those of two codes first.

    Two codes make one 32-bit number, of which the gaps are kept; of the others
    each different first word is kept once.
    """
    short = (a < MARK) & (b < MARK)
    both = (a[short] << K.U64(16) | b[short]).astype("<u4")
    first, runs = np.unique(a[~short], return_counts=True)
    sizes = np.array([len(first)], "<i8")
    return int(short.sum()), squeeze(sizes) + squeeze(gaps(both), gaps(first), runs.astype("<i8"), low_bytes(b[~short]).ravel(), n.astype("<i8"), t.astype("<i8"))


def opened_pairs(blob: bytes, size: int, short: int):
    """(first key, second key as far as kept, n, t) of a block's bigrams."""
    import zstandard

    head = zstandard.ZstdDecompressor().decompressobj()
    firsts = int(np.frombuffer(head.decompress(blob), "<i8")[0])
    both, first, runs, low, n, t = unsqueeze(head.unused_data, (short, "<u4"), (firsts, "<u8"), (firsts, "<i8"), (3 * (size - short), "<u2"), (size, "<i8"), (size, "<i8"))
    both = np.cumsum(both, dtype=np.uint32).astype(np.uint64)
    a = np.concatenate([both >> K.U64(16), np.repeat(np.cumsum(first, dtype=np.uint64), runs)])
    return a, np.concatenate([both & K.U64(0xFFFF), six_bytes(low)]), n, t


def ask_pairs(packs: DataFrame, shared: Broadcast, buckets: int) -> DataFrame:
    """Blocks of bigrams with their counts in a group, keyed by bucket."""

    def run(batches):
        for row in single(batches):
            g = Group(row, np.frombuffer(shared.value, np.uint64), buckets)
            t = g.counted(g.back, len(g.n))
            del g.after, g.back, g.target
            out = []
            for p in np.flatnonzero(np.diff(g.bounds)):
                own = slice(g.bounds[p], g.bounds[p + 1])
                out.append((PAIRS, int(p), row["m"], len(g.n[own]), *pair_block(g.keys[g.a[own]], g.keys[g.b[own]], g.n[own], t[own])))
                if len(out) == 64:
                    yield block_batch(out)
                    out = []
            yield block_batch(out)
            del g, t, out, row

    return packs.mapInArrow(run, BLOCK)


def summed(keys: list[np.ndarray], *values: np.ndarray):
    """(first place of each different key, place of each row's key among them, sums of the values), keys in order of the last."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        ordered = k[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    number = np.cumsum(new) - 1
    back = np.empty_like(number)
    back[order] = number
    first = np.flatnonzero(new)
    return order[first], back, [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def answer_pairs(asked: DataFrame, buckets: int) -> DataFrame:
    """For each block its bigrams' counts over all groups, keyed by group; and for each bucket how many bigrams that occur more than once start with a word, and how often they occur, keyed by the word's bucket."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [opened_pairs(r.pop("blob"), r["size"], r["extra"]) for r in rows]
        a, b, n, t = (np.concatenate(x) for x in zip(*parts))
        del parts
        first, back, (n, t) = summed([b, a], n, t)
        out, at = [], 0
        for r in rows:
            mine = back[at : at + r["size"]]
            out.append((PAIRS, r["part"], r["key"], r["size"], 0, squeeze(n[mine], t[mine])))
            at += r["size"]
        # Bigrams that occur once need no mention: they are what a word's count leaves beside the others.
        several = n > 1
        n, t = n[several], t[several]
        word, _, sums = summed([a[first][several]], np.ones(len(n), np.int64), (t > 0).astype(np.int64), n, t)
        word = a[first][several][word]
        bucket = (word % K.U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for q in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[q] : bounds[q + 1]]
            out.append((KINDS, int(q), rows[0]["key"], len(own), 0, squeeze(gaps(word[own]), *(x[own] for x in sums))))
        del back, n, t, a, b
        give_back()
        return pa.Table.from_batches([block_batch(out)])

    return asked.groupBy("key").applyInArrow(run, BLOCK)


def ask_words(packs: DataFrame, shared: Broadcast, buckets: int) -> DataFrame:
    """Blocks of words with their counts in a group, keyed by bucket."""

    def run(batches):
        for row in single(batches):
            g = Group(row, np.frombuffer(shared.value, np.uint64), 1)
            order, bounds = g.word_order(buckets)
            n, t = np.bincount(g.after, minlength=len(g.keys)), g.counted(g.after, len(g.keys))
            out = []
            for q in np.flatnonzero(np.diff(bounds)):
                own = order[bounds[q] : bounds[q + 1]]
                out.append((WORD_COUNTS, int(q), row["m"], len(own), 0, squeeze(gaps(g.keys[own]), n[own].astype("<i8"), t[own].astype("<i8"))))
            yield block_batch(out)
            del g, n, t, out, row

    return packs.mapInArrow(run, BLOCK)


def answer_words(asked: DataFrame) -> DataFrame:
    """For each block its words' counts and kinds over all groups, keyed by group; and the totals of each bucket (different words, then occurrences in all and in target texts)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words = [r for r in rows if r["kind"] == WORD_COUNTS]
        blocks = lambda some, more: [unsqueeze(r["blob"], (r["size"], "<u8"), *[(r["size"], "<i8")] * more) for r in some]
        parts, starts = blocks(words, 2), blocks([r for r in rows if r["kind"] == KINDS], 4)
        keys = lambda some: np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in some] or [np.zeros(0, np.uint64)])
        column = lambda some, i: np.concatenate([p[i] for p in some] or [np.zeros(0, np.int64)])
        w = keys(parts)
        first, back, (n, t) = summed([w], column(parts, 1), column(parts, 2))
        kinds = np.stack([n, t])
        at = np.searchsorted(w[first], keys(starts))
        for i in (0, 1):
            # Occurrences that no repeated bigram accounts for are bigrams that occur once.
            np.add.at(kinds[i], at, column(starts, i + 1) - column(starts, i + 3))
        out, at = [], 0
        for r in words:
            mine = back[at : at + r["size"]]
            out.append((ANSWERS, r["part"], r["key"], r["size"], 0, squeeze(n[mine], t[mine], kinds[0][mine], kinds[1][mine])))
            at += r["size"]
        out.append((TOTALS, len(first), 0, int(n.sum()), int(t.sum()), b""))
        return pa.Table.from_batches([block_batch(out)])

    return asked.groupBy("key").applyInArrow(run, BLOCK)


def score(documents: DataFrame, target_ids: DataFrame, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every document.

    ``target_ids`` (doc_id) names the target corpus; the background is all
    documents. Losses are Witten-Bell mixtures of bigrams and add-one unigrams.
    The end of a text counts as a token, so null and empty texts have one.
    Repeated rows are counted and scored each; extra columns are ignored.
    Without a target its model is uniform; an empty table gives no rows.
    Buckets hold about ``bucket_tokens`` tokens, 1,000 at least.
    """
    ids = target_ids.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().withColumn("_in", F.lit(True))
    rows = documents.select("doc_id", F.col("text").cast("string").alias("_text"))
    small = ids.count() <= BROADCAST_ROWS
    marked = rows.join(F.broadcast(ids) if small else ids, "doc_id", "left").select("doc_id", "_text", F.coalesce("_in", F.lit(False)).alias("_target"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    packs = cut(groups(marked, kind))
    tokens = packs.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(1, -(-tokens // max(1000, bucket_tokens)))
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(common_words(packs).tobytes())
    told = cut(answer_pairs(ask_pairs(packs, shared, buckets), buckets))
    collect_shuffles(spark)
    words = cut(answer_words(ask_words(packs, shared, buckets).unionByName(told.where(F.col("kind") == KINDS))))
    totals = words.where(F.col("kind") == TOTALS).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("key", "size", "extra"))).first()
    known = max(SIZE, totals["key"])

    def run(table: pa.Table) -> pa.Table:
        held = table.to_pylist()
        row = next(r for r in held if r["kind"] is None)
        g = Group(row, np.frombuffer(shared.value, np.uint64), buckets)
        del g.after, g.target, row["words"], row["sequence"]
        order, bounds = g.word_order(buckets)
        pair = np.zeros((2, len(g.n)), np.int64)
        word = np.zeros((4, len(g.keys)), np.int64)
        for r in held:
            if r["kind"] == PAIRS:
                pair[:, g.bounds[r["part"]] : g.bounds[r["part"] + 1]] = unsqueeze(r.pop("blob"), *[(r["size"], "<i8")] * 2)
            elif r["kind"] == ANSWERS:
                word[:, order[bounds[r["part"]] : bounds[r["part"] + 1]]] = unsqueeze(r.pop("blob"), *[(r["size"], "<i8")] * 4)
        losses = []
        for c, every in ((1, totals["extra"]), (0, totals["size"])):
            # A word comes as often before another (or the edge) as after one.
            total, kinds = word[c][g.a], word[c + 2][g.a]
            unigram = (word[c][g.b] + 1.0) / (every + known)
            # Of the weight of the bigrams, total / (total + kinds), the bigram has count / total.
            mixed = -np.log(np.where(total > 0, (pair[c] + kinds * unigram) / np.maximum(total + kinds, 1), unigram))
            del total, kinds, unigram
            losses.append(np.add.reduceat(mixed[g.back], g.begin) / g.lengths)
        lengths = g.lengths
        del g, pair, word, mixed
        give_back()
        ids = table.column("ids").combine_chunks().filter(table.column("kind").combine_chunks().is_null()).flatten()
        return pa.table([ids, pa.array(lengths), *(pa.array(x) for x in losses), pa.array(losses[0] - losses[1])], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    blocks = told.where(F.col("kind") == PAIRS).unionByName(words.where(F.col("kind") == ANSWERS))
    every = packs.unionByName(blocks.select(F.col("key").alias("m"), "kind", "part", "size", "blob"), allowMissingColumns=True)
    return every.groupBy("m").applyInArrow(run, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")
