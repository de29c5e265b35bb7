"""Document fingerprints by winnowing, in DataFrame expressions alone.

Every run of K words is hashed; from each window of WINDOW consecutive hashes
the smallest is chosen, the rightmost on ties, with its position. Two texts
that share K + WINDOW - 1 consecutive words share a chosen hash, and positions
say where. Words are runs of characters other than white space (x20, x09-x0D),
in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import BROADCAST_ROWS, cut, join_checked

K = 3
WINDOW = 4
#: Rows of a bucket of neighbouring ids, on average.
BUCKET_ROWS = 1500
#: Quantiles in one list, at most.
PARTS = 256
_LAST = (1 << 31) - 1


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.lower(text), "\t\n\x0b\f\r", " " * 5), " "), "")


def packed(gram: Column, at: Column) -> Column:
    """A 32-bit hash above a position: the least of a window is the smallest hash, the rightmost on ties."""
    return F.shiftleft(gram.bitwiseAND(F.lit((1 << 32) - 1)), 31).bitwiseOR(F.lit(_LAST) - at)


def winnow(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """array<bigint> of chosen (hash, position) pairs, packed, by position.

    A text of fewer than ``k`` words has one hash, of all of them; one of fewer
    runs than a window holds has the least of them; without words there are
    none.
    """
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))

    def grams(h):
        whole = F.array(packed(F.xxhash64(h), F.lit(0).cast("long")))
        runs = F.transform(F.slice(h, F.lit(1), F.size(h) - (k - 1)), lambda x, i: packed(F.xxhash64(x, *(h[i + j] for j in range(1, k))), i.cast("long")))
        return F.when(F.size(h) < k, whole).otherwise(runs)

    def choose(g):
        slid = F.transform(F.slice(g, F.lit(1), F.size(g) - (window - 1)), lambda x, i: F.least(x, *(g[i + j] for j in range(1, window))))
        return F.when(F.size(g) < window, F.array(F.array_min(g))).otherwise(F.array_distinct(slid))

    none = F.array().cast("array<bigint>")
    return let(hashes(words(text)), lambda h: F.when(F.size(h) == 0, none).otherwise(let(grams(h), choose)))


def hash_of(pair: Column) -> Column:
    return F.shiftrightunsigned(pair, 31)


def position_of(pair: Column) -> Column:
    return F.lit(_LAST) - pair.bitwiseAND(F.lit(_LAST))


def as_text(pairs: Column) -> Column:
    """``hash:position`` of each chosen pair, hash in hexadecimal."""
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", F.lower(F.hex(hash_of(p))), position_of(p))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of two arrays of distinct hashes; two empty ones are alike."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def id_bounds(docs: DataFrame, id_column: str, buckets: int) -> list[int]:
    """Ids that part the rows into about as many equal buckets: quantiles, which outlying ids do not move."""
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    found = docs.agg(F.percentile_approx(id_column, F.array(*map(F.lit, shares)), 20 * buckets)).first()[0]
    return sorted(set(found or []))


def with_next(docs: DataFrame, id_column: str = "doc_id", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` in buckets of neighbouring ids, ready for a window over (_bucket, _order).

    Buckets lie between quantiles of the ids, which outlying ids do not move:
    at most PARTS parts of the order, each with at most PARTS buckets between
    quantiles of its own. Each bucket also holds, as a guest, the first row of
    the next one (the last bucket: of the first), so the next row is always in
    the bucket. Texts are dealt out once. Null ids count as before all others.
    """
    key = F.col(id_column)
    wanted = -(-docs.count() // bucket_rows)
    coarse = id_bounds(docs, id_column, min(PARTS, wanted))
    many = min(PARTS, -(-wanted // (len(coarse) + 1)))
    keyed = docs.withColumn("_order", F.coalesce(key, F.lit(-(1 << 63))))
    below = lambda bounds: F.coalesce(F.size(F.filter(bounds, lambda x: x <= F.col("_order"))), F.lit(0)).cast("long")
    dealt = keyed.withColumn("_bucket", below(F.array(*map(F.lit, coarse)).cast("array<bigint>")))
    if many > 1:
        shares = F.array(*(F.lit(i / many) for i in range(1, many)))
        fine = dealt.where(key.isNotNull()).groupBy("_bucket").agg(F.percentile_approx(id_column, shares, 20 * many).alias("_fine"))
        dealt = dealt.join(F.broadcast(cut(fine)), "_bucket", "left").withColumn("_bucket", F.col("_bucket") * many + below(F.col("_fine"))).drop("_fine")
    dealt = dealt.withColumn("_guest", F.lit(False))
    firsts = cut(dealt.groupBy("_bucket").agg(F.min("_order").alias("_order")))
    # One row per bucket (1/1500 of the rows), two longs each: sorted in one task.
    order = Window.orderBy("_bucket")
    ring = firsts.select(
        F.col("_bucket").alias("_own"),
        "_order",
        F.lag("_bucket").over(order).alias("_before"),
    )
    last = firsts.agg(F.max("_bucket")).first()[0]
    guests = ring.select("_own", "_order", F.coalesce("_before", F.lit(last)).alias("_to"), F.col("_before").isNull().alias("_wraps"))
    rows = firsts.count()
    if rows > BROADCAST_ROWS:
        dealt = dealt.repartition("_bucket")
    first_rows = join_checked(dealt, guests.withColumnRenamed("_own", "_bucket"), ["_bucket", "_order"], "inner", rows)
    first_rows = first_rows.withColumn("_bucket", F.col("_to")).withColumn("_order", F.when(F.col("_wraps"), F.lit((1 << 63) - 1)).otherwise(F.col("_order"))).withColumn("_guest", F.lit(True))
    return dealt.unionByName(first_rows.select(*dealt.columns))


def fingerprint_all(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, with their likeness and that of the next text.

    Null texts count as empty: no words, an empty fingerprint, like every other
    empty text and unlike the rest. Rows of one id follow each other by text.
    A single row is its own next. Extra columns are ignored; an empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_text"))
    rows = with_next(rows, bucket_rows=BUCKET_ROWS)
    w = Window.partitionBy("_bucket").orderBy("_order", "_guest", "_text")
    rows = rows.withColumn("_next", F.lead("_text").over(w)).withColumn("_n", F.length("_text"))
    half = F.floor(F.col("_n") / 2).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substr("_text", F.lit(1), F.col("_n") - half), F.substr(F.coalesce("_next", F.lit("")), F.lit(1), half)))
    rows = rows.select(
        "doc_id", "_bucket", "_order", "_guest", F.col("_n").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        winnow(F.col("_text"), k, window).alias("_own"), winnow(F.col("_edited"), k, window).alias("_other"), "_text",
    )
    rows = rows.withColumn("_set", F.array_distinct(F.transform("_own", hash_of)))
    rows = rows.withColumn("_next_set", F.lead("_set").over(w)).where(~F.col("_guest"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_other")).alias("edited_fingerprint"),
        likeness(F.col("_set"), F.array_distinct(F.transform("_other", hash_of))).alias("near_edited"),
        likeness(F.col("_set"), F.col("_next_set")).alias("near_next"),
    )
