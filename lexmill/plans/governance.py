"""Queries: selection, governance, profiles, signals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexmill.functions import text as T
from lexmill.functions.stats import confirmed, signal_pair
from lexmill.operators import govern, select, splits
from lexmill.operators.curate import numbered
from lexmill.operators.report import share
from lexmill.plans import views as V
from lexmill.plans.registry import query


@F.pandas_udf(StructType([StructField("filled", LongType()), StructField("items", LongType())]))
def best_fills(lengths: pd.Series, capacity: pd.Series) -> pd.DataFrame:
    chosen = [[int(x[i]) for i in splits.best_fit([int(v) for v in x], int(c))] for x, c in zip(lengths, capacity)]
    return pd.DataFrame({"filled": [sum(c) for c in chosen], "items": [len(c) for c in chosen]})


def _arms(spark, sf):
    return V.table(spark, sf, "part").groupBy(F.col("p_brand").alias("label")).agg(F.round(F.avg("p_size") / 100, 4).alias("wer"), F.count("*").alias("n"))


_ARMS = "arms AS (SELECT p_brand AS label, round(avg(p_size) / 100, 4) AS wer, count(*) AS n FROM part GROUP BY p_brand)"


@query("SELECT label, wer, row_number() OVER (ORDER BY wer, label)::INTEGER AS place FROM arms", _ARMS)
def sweep_rank(spark, sf):
    return select.ranked(_arms(spark, sf), "wer", "label").select("label", "wer", "place")


@query("SELECT label, round(wer - (SELECT wer FROM arms WHERE label = (SELECT min(label) FROM arms)), 6) AS delta, (SELECT wer FROM arms WHERE label = (SELECT min(label) FROM arms)) - wer >= 0.005 AS promote FROM arms", _ARMS)
def sweep_promote(spark, sf):
    """Against the control arm; the limit counts as reached."""
    arms = _arms(spark, sf)
    control = arms.agg(F.min("label")).first()[0]
    return select.against_baseline(arms, "wer", F.col("label") == F.lit(control), 0.005).select("label", "delta", "promote")


@query("SELECT priority, step, wer FROM (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY wer, step) AS r FROM cand WHERE guard <= 0.5) WHERE r = 1", "cand AS (SELECT o_orderpriority AS priority, o_custkey % 50 AS step, round(avg(o_totalprice) / 1000, 2) AS wer, round(avg((o_orderstatus = 'F')::INTEGER), 4) AS guard FROM orders GROUP BY 1, 2)")
def guarded_argmin(spark, sf):
    """Per group, the best candidate within the guard; of equals the earliest step."""
    c = V.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"), (F.col("o_custkey") % 50).alias("step")).agg(F.round(F.avg("o_totalprice") / 1000, 2).alias("wer"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 4).alias("guard"))
    best = c.where("guard <= 0.5").groupBy("priority").agg(F.min(F.struct("wer", "step")).alias("b"))
    return best.select("priority", "b.step", "b.wer")


@query("SELECT count(*) AS passed FROM arms WHERE wer <= 0", _ARMS)
def guard_no_pass(spark, sf):
    """No candidate passes: no row, and the report says so."""
    return select.guarded_best(_arms(spark, sf), "wer", "wer", F.lit(0.0), "label").agg(F.count("*").alias("passed"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r = n // 2 + 1")
def middle_row(spark, sf):
    d = numbered(V.table(spark, sf, "documents").select("source", "doc_id"), ["source"], "doc_id")
    sizes = d.groupBy("source").agg(F.count("*").alias("n"))
    return d.join(sizes, "source").where(F.col("number") == F.floor(F.col("n") / 2) + 1).select("source", "doc_id")


_PART = "CAST(('0x' || substr(sha256(doc_id || chr(31) || text), {a}, 8)) AS BIGINT)"


@query("SELECT source, sha256(count(*) || ':' || " + " || ':' || ".join(f"sum({_PART.format(a=1 + 8 * i)})" for i in range(4)) + ") AS digest FROM documents GROUP BY source")
def content_digest(spark, sf):
    """One digest per source, whatever the order of rows."""
    d = V.table(spark, sf, "documents").select("source", "doc_id", "text")
    return d.groupBy("source").agg(govern.digest(d, "doc_id", "text").alias("digest"))


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN h.name IS NULL THEN 'missing' WHEN w.name IS NULL THEN 'unexpected' WHEN w.sha = h.sha THEN 'same' ELSE 'changed' END AS status
FROM (SELECT doc_id AS name, sha256(text) AS sha FROM documents WHERE doc_id % 17 <> 0) w FULL JOIN (SELECT doc_id AS name, sha256(CASE WHEN doc_id % 13 = 0 THEN text || 'x' ELSE text END) AS sha FROM documents WHERE doc_id % 19 <> 0) h ON w.name = h.name) GROUP BY status""")
def release_completeness(spark, sf):
    d = V.table(spark, sf, "documents")
    want = d.where("doc_id % 17 <> 0").select(F.col("doc_id").alias("name"), F.sha2("text", 256).alias("sha"))
    have = d.where("doc_id % 19 <> 0").select(F.col("doc_id").alias("name"), F.sha2(F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha"))
    return govern.completeness(want, have, "name", "sha")


@query("SELECT name, expected, actual, expected = actual AS ok FROM (SELECT unnest(['nations', 'regions', 'statuses']) AS name, unnest(['25', '5', '4']) AS expected, unnest([CAST((SELECT count(*) FROM nation) AS VARCHAR), CAST((SELECT count(*) FROM region) AS VARCHAR), CAST((SELECT count(DISTINCT o_orderstatus) FROM orders) AS VARCHAR)]) AS actual)")
def count_gates(spark, sf):
    facts = V.table(spark, sf, "nation").agg(F.count("*").alias("nations")).join(V.table(spark, sf, "region").agg(F.count("*").alias("regions"))).join(V.table(spark, sf, "orders").agg(F.count_distinct("o_orderstatus").alias("statuses")))
    return govern.expectations(facts, {"nations": 25, "regions": 5, "statuses": 4})


@query("""SELECT source, count(*) AS rows, count(*) FILTER (l.doc_id IS NOT NULL) AS labelled, round(count(*) FILTER (l.quality = 1) / nullif(count(l.doc_id), 0), 6) AS good_share, count(*) FILTER (regexp_matches(text, '[0-9]')) AS with_digits, min(n_chars) AS shortest, max(n_chars) AS longest, round(avg(n_chars), 6) AS mean_chars
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source""")
def manifest_profile(spark, sf):
    d = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels").withColumn("labelled", F.lit(1)), "doc_id", "left")
    return d.groupBy("source").agg(
        F.count("*").alias("rows"), F.count("labelled").alias("labelled"), share(F.count_if(F.col("quality") == 1), F.count("labelled")).alias("good_share"), F.count_if(F.col("text").rlike("[0-9]")).alias("with_digits"),
        F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.round(F.avg("n_chars"), 6).alias("mean_chars"),
    )


@query("SELECT day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT CAST(ts AS DATE) AS day, event_type, value FROM events) GROUP BY CUBE (day, event_type)")
def month_airport_rollup(spark, sf):
    e = V.table(spark, sf, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    return e.cube("day", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_RATE = f"len({V.words_sql(V.NORM_SCORE)}) / duration"


@query(f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN airport <> 'en' THEN 'language' WHEN score < 0.9 THEN 'posterior' WHEN NOT duration BETWEEN 0.5 AND 300 THEN 'duration' WHEN NOT {_RATE} BETWEEN 1.0 AND 5.2 THEN 'text_rate' ELSE 'accepted' END AS reason
FROM (SELECT m.*, l.quality * 0.9 + (l.doc_id % 10) / 100.0 AS score FROM manifest m JOIN labels l ON l.doc_id = m.id)) GROUP BY reason""", V.MANIFEST)
def quality_gate_text_rate(spark, sf):
    m = V.manifest(spark, sf).join(V.table(spark, sf, "labels").withColumnRenamed("doc_id", "id"), "id").withColumn("score", F.col("quality") * 0.9 + (F.col("id") % 10) / 100.0)
    rate = F.size(T.score_words(F.col("text"))) / F.col("duration")
    reason = F.when(F.col("airport") != "en", "language").when(F.col("score") < 0.9, "posterior").when(~F.col("duration").between(0.5, 300), "duration").when(~rate.between(1.0, 5.2), "text_rate").otherwise("accepted")
    return m.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT status, count(*) AS n, (SELECT count(*) FROM orders) AS screened FROM (SELECT CASE WHEN o_totalprice > 150000 THEN 'longlist' WHEN o_orderstatus = 'F' THEN 'excluded' WHEN o_orderpriority LIKE '1%' THEN 'A' ELSE 'hold' END AS status FROM orders) GROUP BY status")
def status_ledger(spark, sf):
    """Every screened row has one status; the total is listed beside each."""
    o = V.table(spark, sf, "orders")
    status = F.when(F.col("o_totalprice") > 150000, "longlist").when(F.col("o_orderstatus") == "F", "excluded").when(F.col("o_orderpriority").startswith("1"), "A").otherwise("hold")
    return o.groupBy(status.alias("status")).agg(F.count("*").alias("n")).join(F.broadcast(o.agg(F.count("*").alias("screened"))))


@query("SELECT vec_id AS id, (overlap >= 0.5 AND ((env >= 0.93 AND wav >= 0.55) OR (same AND env >= 0.975))) AS confirmed FROM (SELECT vec_id, (vec_id % 11) / 10.0 AS overlap, 0.9 + (vec_id % 10) / 100.0 AS env, (vec_id % 7) / 10.0 AS wav, vec_id % 3 = 0 AS same FROM embeddings)")
def confirmation_rule(spark, sf):
    i = F.col("vec_id")
    return V.table(spark, sf, "embeddings").select(i.alias("id"), confirmed((i % 11) / 10.0, 0.9 + (i % 10) / 100.0, (i % 7) / 10.0, i % 3 == 0).alias("confirmed"))


@query()
def signal_similarity(spark, sf):
    """Envelope and waveform correlation of neighbouring vectors at their best shift, as signals of 64 samples a second."""
    e = V.table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", signal_pair("embedding", "other", F.lit(64)).alias("s")).select("vec_id", "s.*")


@query()
def capacity_fit(spark, sf):
    """Per order, the line items whose quantities fill a capacity best. An order's items travel as one array."""
    l = V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("items"))
    return l.select("l_orderkey", best_fills(F.col("items.q"), F.lit(75)).alias("f")).select("l_orderkey", "f.filled", "f.items")


@query("SELECT command, n, round(mass / n, 8) AS weight FROM (SELECT o_orderpriority || '/' || o_orderstatus AS command, o_orderstatus AS focus, 1 AS n FROM orders GROUP BY 1, 2) JOIN (SELECT o_orderstatus AS focus, count(*) / (SELECT count(*) FROM orders) AS mass FROM orders GROUP BY 1) USING (focus) WHERE mass > 0".replace("round(mass / n, 8)", "round(mass / k, 8)").replace("JOIN (SELECT o_orderstatus AS focus, count(*) /", "JOIN (SELECT o_orderstatus AS focus, count(DISTINCT o_orderpriority) AS k, count(*) /"))
def category_weights(spark, sf):
    """A category's share of the mass, dealt evenly to its members; categories without mass are dropped."""
    o = V.table(spark, sf, "orders")
    commands = o.select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("command"), F.col("o_orderstatus").alias("focus")).distinct().withColumn("n", F.lit(1))
    mass = o.groupBy(F.col("o_orderstatus").alias("focus")).agg(F.count("*").alias("m")).join(F.broadcast(o.agg(F.count("*").alias("all")))).select("focus", (F.col("m") / F.col("all")).alias("mass"))
    k = commands.groupBy("focus").agg(F.count("*").alias("k"))
    return commands.join(mass, "focus").join(k, "focus").where("mass > 0").select("command", "n", F.round(F.col("mass") / F.col("k"), 8).alias("weight"))


@query("SELECT event_id, CAST(epoch_us(ts) AS DOUBLE) / 1000000.0 AS start_epoch, CAST(epoch_us(ts) AS DOUBLE) / 1000000.0 + value AS end_epoch, strftime(ts, '%Y-%m-%d') AS day, round_even(value / 3600, 6) AS hours FROM events")
def time_windows(spark, sf):
    """Start and end in epoch seconds, the ISO day, and hours rounded half to even."""
    e = V.table(spark, sf, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0
    return e.select("event_id", start.alias("start_epoch"), (start + F.col("value")).alias("end_epoch"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.bround(F.col("value") / 3600, 6).alias("hours"))


@query("SELECT doc_id, sha256(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text})::VARCHAR) AS digest FROM documents")
def canonical_json_digest(spark, sf):
    """The digest of each whole row as JSON with sorted keys, no spaces, escaped quotes, backslashes and control characters, and explicit nulls."""
    keys = sorted(["doc_id", "lang", "n_chars", "source", "text"])
    return V.table(spark, sf, "documents").select("doc_id", F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256).alias("digest"))


@query("SELECT user_id, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_path_counts(spark, sf):
    return V.table(spark, sf, "events").groupBy("user_id", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))
