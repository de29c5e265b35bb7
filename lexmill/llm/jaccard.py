"""N-gram Jaccard join: an exact join in Jaccard metric space by pivots and windows.

Documents as pivots do not divide a corpus of word shingles: unrelated texts all
lie at distance 1 from every pivot, and the window of twice the radius then
takes in all of them. The points that do divide it are single shingles: a set's
distance to the pivot {s} is below 1 only if s is in the set. With ties broken by
one order over all shingles (rare ones first), the cell of a set is its first
shingle, and the triangle inequality bounds the window: two sets within the
radius differ in so few shingles that some shingle is among the first
``window(n)`` of both. Each set is replicated to the cells in its window, so
every linked pair meets in a cell.

Cells then join recursively with documents as pivots: in every round each
member is attached to the pivot it shares most cells with and their distance is
computed exactly; linked parts merge. Members leave a cell when it holds nobody
else whom they could link with: shingles that occur once in the corpus are
shared with nobody, and with the sizes they bound the likeness of a pair from
above. When few pairs of different parts are left, all of them are compared.
Nothing is capped: the rounds only decide the order of comparisons.

Rarity comes from counts of all shingles of all documents; a shingle that occurs
once needs no cell. What is counted grows with the corpus and is neither
broadcast nor sent to the driver: documents are packed into groups that ask
once for each of their different shingles, and buckets of the hashes answer
with the levels of the corpus's counts. Exact copies are one point. Distances
are computed from whole texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import textkernel as K
from lexmill.llm.common import collect_shuffles, cut, drop_cut, give_back, join_checked, sliced
from lexmill.llm.lmscore import gaps, kinds_of, single, squeeze, unsqueeze

#: Words of a shingle, and the likeness from which two sets link, in hundredths.
WORDS = 4
PERCENT = 85
#: Bits of a shingle's hash by which it is counted: of 10^10 different shingles one in a hundred shares its slot.
SLOT_BITS = 40
#: Shingles of a group, about (a longer text is a group by itself), and rows of a group, at most.
GROUP_SHINGLES = 1_000_000
GROUP_ROWS = 250_000
#: Different shingles of all groups that a bucket counts, about.
BUCKET_SHINGLES = 3_000_000
#: Counts from which a slot has level 1, 2 and 3.
LEVELS = (2, 16, 256)
#: Followers that one task compares with a pivot before the pivot is replicated.
FOLLOWERS = 256
#: Pairs of different parts that are compared without another round, at least.
FEW_PAIRS = 20_000
ROUNDS = 6


def window(n: np.ndarray | int, percent: int = PERCENT):
    """How many shingles of a set of n can come first without any being in a set that links with it, plus one."""
    return n + (-n * percent) // 100 + 1


def links(common: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (a + b - common)


def packed_sets(texts: DataFrame, words: int) -> DataFrame:
    """Packed groups of (doc_id, _key, _text), made without moving a row: for each row its id, key, set size and digest of the set; the group's different slots with the rows that have them; and each row's places among the slots, as gaps."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, ids, keys, sizes, nodes, size = [], [], [], [], [], 0

        def packed():
            every = np.concatenate(held)
            held.clear()
            slots, place, count = kinds_of(every)
            del every
            n = np.array(sizes, "<i8")
            first = (np.cumsum(n) - n)[n > 0]
            rise = np.diff(place, prepend=np.int32(0))
            rise[first] = place[first]
            lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.concat_arrays(x))
            blob = lambda x: pa.array([x], pa.binary())
            whole = lambda x: pa.array([x], pa.int64())
            counts = squeeze(np.minimum(count, 65_535).astype("<u2"))
            arrays = [whole(number), lists(ids), lists(keys), blob(n.tobytes()), blob(b"".join(nodes)), whole(len(slots)), blob(squeeze(gaps(slots))), blob(counts), blob(squeeze(rise.astype("<u4")))]
            return pa.RecordBatch.from_arrays(arrays, ["m", "ids", "keys", "sizes", "nodes", "n_slots", "slots", "counts", "places"])

        for batch in sliced(batches):
            row = 0
            for i, s in enumerate(K.shingle_sets(batch.column(2), words)):
                held.append(s >> K.U64(64 - SLOT_BITS)), sizes.append(len(s)), nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                size += len(s)
                if size >= GROUP_SHINGLES or len(sizes) >= GROUP_ROWS or i == batch.num_rows - 1:
                    ids.append(batch.column(0).slice(row, i + 1 - row)), keys.append(batch.column(1).slice(row, i + 1 - row))
                    row = i + 1
                if size >= GROUP_SHINGLES or len(sizes) >= GROUP_ROWS:
                    yield packed()
                    held, ids, keys, sizes, nodes, size, number = [], [], [], [], [], 0, number + 1
                    give_back()
        if sizes:
            yield packed()

    schema = "m long, ids array<long>, keys array<long>, sizes binary, nodes binary, n_slots long, slots binary, counts binary, places binary"
    return texts.select("doc_id", "_key", "_text").mapInArrow(run, schema)


def opened_slots(row: dict) -> np.ndarray:
    return np.cumsum(unsqueeze(row["slots"], (row["n_slots"], "<u8"))[0], dtype=np.uint64)


def told_levels(packs: DataFrame, buckets: int) -> DataFrame:
    """(m, part, size, blob): for each group and bucket the levels of the group's slots there, by their counts over all groups (a row counts once). ``buckets`` is a power of two."""
    bounds = np.arange(buckets + 1, dtype=np.uint64) << np.uint64(SLOT_BITS - buckets.bit_length() + 1)

    def ask(batches):
        for row in single(batches):
            slots = opened_slots(row)
            (count,) = unsqueeze(row["counts"], (len(slots), "<u2"))
            at = np.searchsorted(slots, bounds)
            full = np.flatnonzero(np.diff(at))
            for some in range(0, len(full), 64):
                own = [slice(at[p], at[p + 1]) for p in full[some : some + 64]]
                blobs = [squeeze(gaps(slots[x])) for x in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full[some : some + 64], pa.int64()), pa.array([row["m"]] * len(own), pa.int64()), pa.array([x.stop - x.start for x in own], pa.int64()), pa.array(blobs, pa.binary()), pa.array([squeeze(count[x]) for x in own], pa.binary())],
                    ["part", "m", "size", "slots", "counts"],
                )

    def answer(table: pa.Table) -> pa.Table:
        m, size = table.column("m"), table.column("size").to_pylist()
        slots = np.concatenate([np.cumsum(unsqueeze(x.as_py(), (n, "<u8"))[0], dtype=np.uint64) for x, n in zip(table.column("slots"), size)])
        count = np.concatenate([unsqueeze(x.as_py(), (n, "<u2"))[0] for x, n in zip(table.column("counts"), size)])
        _, place, _ = kinds_of(slots)
        del slots
        total = np.bincount(place, count)
        level = sum((total >= x).astype(np.uint8) for x in LEVELS)[place]
        ends = np.cumsum(size)
        blobs = [squeeze(level[end - n : end]) for n, end in zip(size, ends)]
        del place, total, level, count
        give_back()
        return pa.table([m, table.column("part"), table.column("size"), pa.array(blobs, pa.binary())], ["m", "part", "size", "blob"])

    asked = packs.select("m", "n_slots", "slots", "counts").mapInArrow(ask, "part long, m long, size long, slots binary, counts binary")
    return asked.groupBy("part").applyInArrow(answer, "m long, part long, size long, blob binary")


def points(packs: DataFrame, told: DataFrame, percent: int) -> DataFrame:
    """(doc_id, key, n, u, node, pivots) of every row: size, number of unique shingles, digest of the set, and the slots of the pivots in its window that are not unique."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        row = next(r for r in rows if r["part"] is None)
        answers = sorted((r for r in rows if r["part"] is not None), key=lambda r: r["part"])
        del rows
        slots = opened_slots(row)
        levels = np.concatenate([unsqueeze(r["blob"], (r["size"], "|u1"))[0] for r in answers] or [np.zeros(0, np.uint8)])
        n = np.frombuffer(row["sizes"], "<i8")
        begin = np.cumsum(n) - n
        (rise,) = unsqueeze(row["places"], (int(n.sum()), "<u4"))
        place = np.cumsum(rise, dtype=np.int64)
        first = begin[n > 0]
        place -= np.repeat(place[first] - rise[first], n[n > 0])
        level = levels[place]
        once = np.concatenate([[0], np.cumsum(level == 0)])
        widths, pivots = window(n, percent), []
        for i in range(len(n)):
            own = level[begin[i] : begin[i] + n[i]]
            chosen = np.argsort(own, kind="stable")[: widths[i]] if n[i] else np.zeros(0, np.int64)
            pivots.append(np.unique(slots[place[begin[i] + chosen[own[chosen] > 0]]]))
        lengths = np.array([len(p) for p in pivots], np.int64)
        flat = np.concatenate(pivots).astype(np.int64) if pivots else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat))
        nodes = pa.array([row["nodes"][16 * i : 16 * i + 16] for i in range(len(n))], pa.binary())
        ids, keys, u = pa.array(row["ids"], pa.int64()), pa.array(row["keys"], pa.int64()), pa.array(once[begin + n] - once[begin])
        del place, level, once, levels, slots, row, answers, rise
        give_back()
        return pa.table([ids, keys, pa.array(n), u, nodes, lists], ["doc_id", "key", "n", "u", "node", "pivots"])

    every = packs.unionByName(told, allowMissingColumns=True)
    return every.groupBy("m").applyInArrow(run, "doc_id long, key long, n long, u long, node binary, pivots array<long>")


def counted_points(texts: DataFrame, words: int, percent: int, bucket: int | None = None) -> DataFrame:
    """The points of (doc_id, _key, _text); buckets count about ``bucket`` shingles."""
    packs = cut(packed_sets(texts, words))
    asked = packs.agg(F.sum("n_slots")).first()[0] or 0
    buckets = 1 << max(0, -(-asked // (bucket or BUCKET_SHINGLES)) - 1).bit_length()
    told = cut(told_levels(packs, buckets))
    collect_shuffles(texts.sparkSession)
    found = cut(points(packs, told, percent))
    drop_cut(packs)
    drop_cut(told)
    collect_shuffles(texts.sparkSession)
    return found


#: What is known of a member: size, unique shingles, and how it differs from its pivot p (of n_p shingles):
#: r of them it lacks, s others it has that are not unique.
PROFILE = ("n", "u", "p", "n_p", "r", "s")


def may_link(x: dict, y: dict, added, percent: int):
    """Whether two members can link at all, by the most shingles they can share.

    Neither shares what is unique to it. If both were compared with one pivot,
    they share no more of it than the one that lacks more of it has, and of
    other shingles no more than the one with fewer has. Pairs that do share
    such other shingles meet in cells of their own (``added``), so elsewhere
    they count as none.
    """
    common = F.least(x["n"] - x["u"], y["n"] - y["u"])
    of_pivot = x["n_p"] - F.greatest(x["r"], y["r"]) + F.when(added, F.least(x["s"], y["s"])).otherwise(0)
    common = F.when(x["p"] == y["p"], F.least(common, of_pivot)).otherwise(common)
    return common * 100 >= (x["n"] + y["n"] - common) * percent


def profile(suffix: str = "") -> dict:
    return {c: F.col(c + suffix) for c in PROFILE}


def compare(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, n_a, n_b, common, linked, added: shingles of b that a lacks) of the (a, b) in ``pairs``, from whole texts.

    Rows stream past their pivot a; a pivot with many followers is replicated,
    so that its followers spread over tasks.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("followers"))
    counts = counts.withColumn("copies", F.ceil(F.col("followers") / FOLLOWERS))
    followers = (
        pairs.join(counts, "a")
        .withColumn("salt", F.pmod(F.xxhash64("b"), F.col("copies")))
        .join(texts.withColumnRenamed("node", "b"), "b")
        .select("a", "salt", F.lit(1).alias("rank"), "b", "text")
    )
    pivots = (
        counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .join(texts.withColumnRenamed("node", "a"), "a")
        .select("a", "salt", F.lit(0).alias("rank"), F.col("a").alias("b"), "text")
    )

    def run(batches):
        now, own = None, np.zeros(0, np.uint64)
        for batch in sliced(batches):
            a, rank, b = (batch.column(i).to_pylist() for i in (0, 2, 3))
            out = []
            for i, s in enumerate(K.shingle_sets(batch.column(4), words)):
                if rank[i] == 0:
                    now, own = a[i], s
                elif now == a[i]:
                    at = np.searchsorted(own, s)
                    same = own[np.minimum(at, len(own) - 1)] == s if len(own) else np.zeros(len(s), bool)
                    common = int(same.sum())
                    out.append((a[i], b[i], len(own), len(s), common, links(common, len(own), len(s), percent), s[~same].view(np.int64)))
            columns = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "b", "n_a", "n_b", "common", "linked", "added"])

    dealt = followers.unionByName(pivots).repartition("a", "salt").sortWithinPartitions("a", "salt", "rank")
    return dealt.mapInArrow(run, "a long, b long, n_a long, n_b long, common long, linked boolean, added array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, part): the smallest node reachable, for every node with an edge.

    Labels take their neighbours' minimum and then their label's label, until
    nothing changes; each round is written out.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("part")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "part"), "b").groupBy(F.col("a").alias("node")).agg(F.min("part").alias("near"))
        lower = labels.join(near, "node").select("node", "part", F.least("part", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("part").alias("jumped"))
        found = cut(lower.join(jump, "next").select("node", "part", F.least("next", "jumped").alias("next")))
        changed = found.where(F.col("part") != F.col("next")).limit(1).count()
        drop_cut(labels)
        labels = found.select("node", F.col("next").alias("part"))
        if not changed:
            drop_cut(both)
            return labels


def merge(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """``parts`` (node, part, ...) with the parts that ``edges`` connect made one."""
    of = lambda c: parts.select(F.col("node").alias(c), F.col("part").alias(f"part_{c}"))
    between = edges.join(of("a"), "a").join(of("b"), "b").where("part_a != part_b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b")).distinct()
    joined = components(between).select(F.col("node").alias("part"), F.col("part").alias("whole"))
    return parts.join(joined, "part", "left").withColumn("part", F.coalesce("whole", "part")).drop("whole")


def open_members(cells: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Members that can still link with a member of another part of their cell.

    A member is held against the kinds of members in its cell (equal profiles),
    of which there are few, not against every other member.
    """
    placed = cells.join(parts, "node")
    kinds = placed.groupBy("pivot", *PROFILE).agg(F.min("part").alias("low"), F.max("part").alias("high"))
    mixed = kinds.groupBy("pivot").agg(F.min("low").alias("_low"), F.max("high").alias("_high")).where("_low != _high").select("pivot")
    kinds = kinds.join(mixed, "pivot", "left_semi").withColumnsRenamed({c: f"{c}_k" for c in ("pivot", *PROFILE)})
    other = (F.col("low") != F.col("part")) | (F.col("high") != F.col("part"))
    return placed.join(kinds, (F.col("pivot") == F.col("pivot_k")) & other & may_link(profile(), profile("_k"), F.col("added"), percent), "left_semi")


def with_added(cells: DataFrame, held: DataFrame | None, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cells`` with the cells that the entries in ``more`` (pivot, node, n, u, added) make with each other and with ``held``, those of earlier rounds; and all entries so far.

    Members profiled in different rounds meet here too: a cell that gets a new
    entry is made anew from all its entries, also those that had left it.
    """
    more = cut(more)
    held = more if held is None else held.unionByName(more)
    fresh = more.select("pivot").distinct()
    shared = held.join(fresh, "pivot", "left_semi").groupBy("pivot").agg(F.count("*").alias("_m")).where("_m > 1").select("pivot")
    again = cut(held.join(shared, "pivot").select(*cells.columns))
    return cells.join(again.select("pivot").distinct(), "pivot", "left_anti").select(*cells.columns).unionByName(again), held


def join_cells(cells: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, part) of every node in a cell: the components of the links between them."""
    cells = cells.withColumn("added", F.lit(False))
    parts = cut(cells.select("node").distinct().select("node", F.col("node").alias("part"), *(F.lit(None).cast("long").alias(c) for c in PROFILE[2:])))
    turn, useful, held, done = 0, True, None, []
    while True:
        placed = cut(open_members(cells, parts, percent))
        # What only the round before read goes, and so do the shuffles of its frames.
        for frame in done:
            drop_cut(frame)
        collect_shuffles(texts.sparkSession)
        cells = placed.select(*cells.columns)
        sums = placed.groupBy("pivot", "part").agg(F.count("*").alias("m")).groupBy("pivot").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("same"))
        found = sums.agg(F.sum((F.col("m") * F.col("m") - F.col("same")) / 2).alias("pairs"), F.sum("m").alias("members")).first()
        if not found["pairs"]:
            return parts
        if not useful or turn == ROUNDS or found["pairs"] <= max(FEW_PAIRS, found["members"]):
            # A pair is formed in the first cell that both are in (of either sort), not in every one.
            mine = placed.groupBy("node", "added").agg(F.collect_list("pivot").alias("pivots"))
            listed = placed.join(mine, ["node", "added"])
            side = lambda c, x: listed.select("pivot", "added", F.col("node").alias(c), F.col("part").alias(f"part_{c}"), F.col("pivots").alias(f"pivots_{x}"), *(F.col(k).alias(f"{k}_{x}") for k in PROFILE))
            fits = (F.col("part_a") != F.col("part_b")) & (F.col("a") < F.col("b")) & may_link(profile("_x"), profile("_y"), F.col("added"), percent)
            once = F.col("pivot") == F.array_min(F.array_intersect("pivots_x", "pivots_y"))
            pairs = side("a", "x").join(side("b", "y").drop("added"), "pivot").where(fits & once).select("a", "b").distinct()
            return cut(merge(parts, cut(compare(cut(pairs), texts, words, percent).where("linked"))))
        # Sets with few unique shingles are the likely centres; every other round any set may be one.
        rank = F.struct(F.when(F.lit(turn % 2 == 0), F.col("u")).otherwise(F.lit(0)), F.xxhash64("node", F.lit(turn)))
        centres = placed.groupBy("pivot").agg(F.min_by(F.struct(*(F.col(c).alias(f"{c}_a") for c in ("node", "part", *PROFILE))), rank).alias("c")).select("pivot", "c.*")
        # Members without a profile are compared too, even if they cannot link with this pivot: the profile rules out others.
        fits = (F.col("part") != F.col("part_a")) & (F.col("p").isNull() | may_link(profile(), profile("_a"), F.col("added"), percent))
        shared = placed.join(centres, "pivot").where(fits).groupBy(F.col("node_a").alias("a"), F.col("node").alias("b"), "u_a", "u").agg(F.count("*").alias("cells"))
        nearest = cut(shared.groupBy("b", "u").agg(F.max_by("a", F.struct("cells", -F.col("u_a"), "a")).alias("a")).select("a", "b", "u"))
        tested = cut(compare(nearest.select("a", "b"), texts, words, percent).join(nearest, ["a", "b"]))
        # The first comparison with a pivot that shares half of it is a member's profile; a pivot differs from itself in nothing.
        close = tested.where(2 * F.col("common") >= F.greatest("n_a", "n_b"))
        fresh = close.join(parts.where("p is null").select(F.col("node").alias("b")), "b", "left_semi")
        told = close.select(F.col("b").alias("node"), F.col("a").alias("_p"), F.col("n_a").alias("_n_p"), (F.col("n_a") - F.col("common")).alias("_r"), (F.col("n_b") - F.col("common") - F.col("u")).alias("_s"))
        centre = close.select(F.col("a").alias("node"), F.col("a").alias("_p"), F.col("n_a").alias("_n_p"), F.lit(0).cast("long").alias("_r"), F.lit(0).cast("long").alias("_s")).distinct().join(told.select("node"), "node", "left_anti")
        known = parts.join(told.unionByName(centre), "node", "left")
        news = [F.when(F.col("p").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in PROFILE[2:]]
        # Shingles that a member has beyond its pivot and the unique ones: with those it may meet others in cells of their own.
        first = fresh.where(F.col("n_b") - F.col("common") > F.col("u")).select(F.explode("added").alias("e"), F.col("b").alias("node"), F.col("n_b").alias("n"), "u")
        more = first.select(F.xxhash64(F.lit("added"), "e").alias("pivot"), "node", "n", "u", F.lit(True).alias("added"))
        cells, held = with_added(cells, held, more)
        useful = 8 * (tested.where("linked").count() + fresh.where("not linked").count()) > tested.count()
        done = [placed, nearest, tested, parts]
        parts = cut(merge(known.select("node", "part", *news), tested.where("linked").select("a", "b")))
        turn += 1


def link_classes(documents: DataFrame, words: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Null and empty texts, and texts without words, have no shingles and link
    with nothing: their component is their own id. Repeated rows are copies of
    one point. Rows that share an id but not a text are different points. Extra
    columns are ignored; an empty table gives no rows.
    """
    text = F.col(text_column).cast("string")
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("_key"), text.alias("_text"))
    found = counted_points(texts, words, percent)
    met = found.where(F.size("pivots") > 0)
    # Exact copies are one point; points get numbers, which the written table fixes.
    made = met.groupBy(F.col("node").alias("digest")).agg(F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("key").alias("_key"))).alias("who"), F.first("n").alias("n"), F.first("u").alias("u"), F.first("pivots").alias("pivots"))
    numbered = cut(made.withColumn("node", F.monotonically_increasing_id()))
    entries = numbered.select("node", "n", "u", F.explode("pivots").alias("pivot"))
    crowded = entries.groupBy("pivot").agg(F.count("*").alias("members")).where("members > 1").select("pivot")
    cells = cut(entries.join(crowded, "pivot").select("pivot", "node", "n", "u"))
    involved = cut(numbered.select("node", "who.*").join(cells.select("node").distinct(), "node"))
    own = join_checked(texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(0))), involved, ["doc_id", "_key"], "inner").select("node", F.col("_text").alias("text"))
    parts = join_cells(cells, cut(own), words, percent).join(numbered.select("node", "digest"), "node").select(F.col("digest").alias("node"), "part")
    classes = found.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    classes = classes.join(parts, "node", "left")
    wholes = classes.where(F.col("part").isNotNull()).groupBy("part").agg(F.min("first").alias("least"))
    known = classes.where("copies > 1 or part is not null").join(wholes, "part", "left").select("node", F.coalesce("least", "first").alias("component_id"))
    return found.select("doc_id", "n", "node").join(known, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows that stay when one document of each linked group does: that with the smallest id.

    Documents without words are in no group and stay. Of repeated rows one
    stays. Only the ids of what goes are joined to the texts.
    """
    found = cut(link_classes(documents, words, percent))
    kept = found.where("doc_id <=> component_id")
    gone = found.where("not doc_id <=> component_id").select("doc_id").join(kept.select("doc_id"), "doc_id", "left_anti").distinct()
    out = join_checked(documents, cut(gone), "doc_id", "left_anti")
    repeated = cut(kept.where("n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"))
    if not repeated.limit(1).count():
        return out
    same = join_checked(out, repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return join_checked(out, repeated, "doc_id", "left_anti").unionByName(same)
