"""Queries: curation, joins, splits, mixtures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions.stats import pearson, rms, clipped_share
from lexmill.operators import curate, overlap, runs, splits
from lexmill.operators.report import share, split_summary as summarise
from lexmill.plans import views as V
from lexmill.plans.registry import query
from lexmill.session import stored

LEN = "length(text)"


def _rules():
    t = F.col("text")
    return [
        ("crosstalk", t.contains("|")),
        ("incorrect", t.contains("!!")),
        ("non_english", F.col("lang") != "en"),
        ("bad_boundary", F.length(t) < 40),
        ("empty_text", T.norm_score(t) == ""),
    ]


_CASES = [("crosstalk", "contains(text, '|')"), ("incorrect", "contains(text, '!!')"), ("non_english", "lang <> 'en'"), ("bad_boundary", "length(text) < 40"), ("empty_text", f"{V.NORM_SCORE} = ''")]
_CASE = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _CASES) + " ELSE 'accepted' END"


@query(f"SELECT reason, count(*) AS n FROM (SELECT {_CASE} AS reason FROM documents) GROUP BY reason")
def reject_cascade(spark, sf):
    """The first failing rule is counted; every row is in one group."""
    d = V.table(spark, sf, "documents")
    return d.groupBy(F.coalesce(curate.first_reason(_rules()), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT reason, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS reason FROM documents WHERE {c}" for n, c in _CASES) + ") GROUP BY reason")
def reason_flags_hist(spark, sf):
    """All failing rules are counted."""
    d = V.table(spark, sf, "documents")
    return d.select(F.explode(curate.all_reasons(_rules())).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE NOT (" + " OR ".join(f"({c})" for _, c in _CASES) + ")")
def retained_by_flags(spark, sf):
    d = V.table(spark, sf, "documents")
    return d.where(F.size(curate.all_reasons(_rules())) == 0).select("doc_id")


@query("""SELECT source, count(*) AS recordings, sum((n < 45)::INTEGER)::BIGINT AS too_few, sum((longest > 100)::INTEGER)::BIGINT AS too_long FROM (SELECT source, source_record_id, count(*) * 7 AS n, max(duration) / 10 AS longest FROM manifest GROUP BY source, source_record_id) GROUP BY source""", V.MANIFEST)
def record_rejects(spark, sf):
    """Rules at the recording's grain."""
    r = V.manifest(spark, sf).groupBy("source", "source_record_id").agg((F.count("*") * 7).alias("n"), (F.max("duration") / 10).alias("longest"))
    return r.groupBy("source").agg(F.count("*").alias("recordings"), F.sum((F.col("n") < 45).cast("long")).alias("too_few"), F.sum((F.col("longest") > 100).cast("long")).alias("too_long"))


@query("""SELECT conv_id, sum(moved::INTEGER)::BIGINT AS clamped, sum((s < 0 OR e - s < 0.1 OR e > len)::INTEGER)::BIGINT AS bad, round(sum(e - s), 6) AS seconds FROM (
SELECT conv_id, s, len, (e0 > len AND e0 <= len + 0.15) AS moved, CASE WHEN e0 > len AND e0 <= len + 0.15 THEN len ELSE e0 END AS e FROM (
SELECT conv_id, turn * 10.0::DOUBLE AS s, turn * 10 + (length(text) % 25) / 10.0::DOUBLE AS e0, turn * 10 + 1.9::DOUBLE AS len FROM conversations)) GROUP BY conv_id""")
def boundary_clamp(spark, sf):
    c = V.table(spark, sf, "conversations")
    start, end, length = F.col("turn") * 10.0, F.col("turn") * 10 + (F.length("text") % 25) / 10.0, F.col("turn") * 10 + 1.9
    moved_end, moved = curate.clamp_end(end, length)
    rows = c.select("conv_id", start.alias("s"), moved_end.alias("e"), length.alias("len"), moved.alias("moved"))
    return rows.groupBy("conv_id").agg(F.sum(F.col("moved").cast("long")).alias("clamped"), F.sum(curate.bad_boundary(F.col("s"), F.col("e"), F.col("len")).cast("long")).alias("bad"), F.round(F.sum(F.col("e") - F.col("s")), 6).alias("seconds"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_first_seen(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    return curate.first_seen(d, ["sha"], ["doc_id"]).select("doc_id", "lang")


@query(f"""SELECT reason, count(*) AS n FROM (SELECT unnest(list_concat(flags, CASE WHEN EXISTS (SELECT 1 FROM kept k WHERE k.sha = r.sha AND k.doc_id < r.doc_id) THEN ['duplicate'] ELSE [] END)) AS reason FROM rows_ r) GROUP BY reason""",
    "rows_ AS (SELECT doc_id, sha256(text) AS sha, list_filter([CASE WHEN lang <> 'en' THEN 'language' END, CASE WHEN length(text) > 3000 THEN 'long' END], lambda x: x IS NOT NULL) AS flags FROM documents)",
    "kept AS (SELECT sha, min(doc_id) AS doc_id FROM rows_ WHERE len(flags) = 0 GROUP BY sha)",
)
def retained_dedupe_histogram(spark, sf):
    """Reasons with duplicates of *retained* rows: a blocked row also counts as one if an earlier row with its content was retained."""
    d = V.table(spark, sf, "documents")
    rows = d.select("doc_id", F.sha2("text", 256).alias("sha"), curate.all_reasons([("language", F.col("lang") != "en"), ("long", F.length("text") > 3000)]).alias("flags"))
    kept = rows.where(F.size("flags") == 0).groupBy("sha").agg(F.min("doc_id").alias("first"))
    flagged = rows.join(kept, "sha", "left").select(F.concat("flags", F.when(F.col("first") < F.col("doc_id"), F.array(F.lit("duplicate"))).otherwise(F.array().cast("array<string>"))).alias("flags"))
    return flagged.select(F.explode("flags").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT airport, count(*) FILTER (duration BETWEEN 0.1 AND 30) AS usable, count(*) FILTER (duration BETWEEN 0.1 AND 18) AS matchable FROM manifest GROUP BY airport", V.MANIFEST)
def duration_filters(spark, sf):
    d = F.col("duration")
    return V.manifest(spark, sf).groupBy("airport").agg(F.count_if(d.between(0.1, 30)).alias("usable"), F.count_if(d.between(0.1, 18)).alias("matchable"))


@query("SELECT lang, " + ", ".join(f"count(*) FILTER (score >= {t} AND n_chars >= {c}) AS pool_{int(t * 100)}_{c}" for t in (0.0, 0.9, 0.95) for c in (0, 1500)) + " FROM (SELECT lang, n_chars, quality * 0.9 + (doc_id % 10) / 100.0 AS score FROM documents JOIN labels USING (doc_id)) GROUP BY lang")
def threshold_pools(spark, sf):
    """All pools in one pass."""
    d = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id").withColumn("score", F.col("quality") * 0.9 + (F.col("doc_id") % 10) / 100.0)
    return d.groupBy("lang").agg(*(F.count_if((F.col("score") >= t) & (F.col("n_chars") >= c)).alias(f"pool_{int(t * 100)}_{c}") for t in (0.0, 0.9, 0.95) for c in (0, 1500)))


@query("SELECT source, count(*) AS n, round(min(score), 6) AS least, bool_and(lang = 'en') AS one_language, (bool_and(lang = 'en') AND min(score) >= 0.9) AS passes FROM (SELECT source, lang, quality * 0.9 + (doc_id % 10) / 100.0 AS score FROM documents JOIN labels USING (doc_id)) GROUP BY source")
def quality_gate(spark, sf):
    d = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id").withColumn("score", F.col("quality") * 0.9 + (F.col("doc_id") % 10) / 100.0)
    one = F.bool_and(F.col("lang") == "en")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("least"), one.alias("one_language"), (one & (F.min("score") >= 0.9)).alias("passes"))


@query("""SELECT count(*) AS kept, round(sum(duration) / 3600, 6) AS hours FROM manifest WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
AND source_record_id NOT IN (SELECT m.source_record_id FROM manifest m JOIN labels l ON l.doc_id = m.id WHERE l.toxic = 1 AND l.quality = 0)""", V.MANIFEST)
def recording_exclusion(spark, sf):
    """A row goes if it, or its recording, was confirmed."""
    m, l = V.manifest(spark, sf), V.table(spark, sf, "labels")
    ids = l.where("toxic = 1").select(F.col("doc_id").alias("id"))
    records = m.join(l.where("toxic = 1 AND quality = 0").select(F.col("doc_id").alias("id")), "id").select("source_record_id").distinct()
    return m.join(ids, "id", "left_anti").join(records, "source_record_id", "left_anti").agg(F.count("*").alias("kept"), F.round(F.sum("duration") / 3600, 6).alias("hours"))


@query("""SELECT id, '{' || array_to_string(list_filter(['"id":"' || id || '"', CASE WHEN id % 3 <> 0 THEN '"record":"' || source_record_id || '"' END, CASE WHEN id % 5 <> 0 THEN '"airport":"' || airport || '"' END], lambda x: x IS NOT NULL), ',') || '}' AS provenance FROM manifest""", V.MANIFEST)
def provenance_projection(spark, sf):
    """Only keys that have a value are kept."""
    fields = F.struct(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 != 0, F.col("source_record_id")).alias("record"), F.nullif(F.when(F.col("id") % 5 != 0, F.col("airport")).otherwise(F.lit("")), F.lit("")).alias("airport"))
    return V.manifest(spark, sf).select("id", F.to_json(fields, {"ignoreNullFields": "true"}).alias("provenance"))


_ID = "upper(lang) || '_TWR_' || source || '_a_b_c_' || CASE WHEN doc_id % 9 = 0 THEN 'baddate' ELSE strftime(DATE '2020-10-01' + CAST(doc_id % 15 AS INTEGER), '%Y%m%d') END || '_' || lpad(CAST(doc_id % 86400 AS VARCHAR), 6, '0')"


@query(f"""SELECT doc_id, t[1] AS airport, array_to_string(t[3:len(t) - 4], '_') AS channel, CASE WHEN ok THEN t[len(t) - 1][1:4] || '-' || t[len(t) - 1][5:6] || '-' || t[len(t) - 1][7:8] END AS recorded_date FROM (
SELECT doc_id, t, len(t) >= 7 AND regexp_full_match(t[len(t) - 1], '[0-9]{{8}}') AND regexp_full_match(t[len(t)], '[0-9]{{6}}') AS ok FROM (SELECT doc_id, string_split({_ID}, '_') AS t FROM documents))""")
def metadata_parse(spark, sf):
    d = V.table(spark, sf, "documents")
    date = F.when(F.col("doc_id") % 9 == 0, F.lit("baddate")).otherwise(F.date_format(F.date_add(F.lit("2020-10-01").cast("date"), (F.col("doc_id") % 15).cast("int")), "yyyyMMdd"))
    name = F.concat(F.upper("lang"), F.lit("_TWR_"), F.col("source"), F.lit("_a_b_c_"), date, F.lit("_"), F.lpad((F.col("doc_id") % 86400).cast("string"), 6, "0"))
    t = d.select("doc_id", F.split(name, "_").alias("t"))
    day, time = F.element_at("t", -2), F.element_at("t", -1)
    ok = (F.size("t") >= 7) & day.rlike("^[0-9]{8}$") & time.rlike("^[0-9]{6}$")
    iso = F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))
    return t.select("doc_id", F.element_at("t", 1).alias("airport"), F.array_join(F.slice("t", F.lit(3), F.size("t") - 6), "_").alias("channel"), F.when(ok, iso).alias("recorded_date"))


@query("SELECT conv_id, turn, conv_id || '!' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 3, '0') AS segment_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS ordinal FROM conversations")
def segment_ordinals(spark, sf):
    """A segment's id counts from 1 before any filter; the ordinal is read back from it."""
    turns = curate.numbered(V.table(spark, sf, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")
    made = turns.select("conv_id", "turn", F.concat(F.col("conv_id").cast("string"), F.lit("!"), F.lpad(F.col("number").cast("string"), 3, "0")).alias("segment_id"))
    return made.withColumn("ordinal", F.substring_index("segment_id", "!", -1).cast("int"))


@query(f"SELECT reason, doc_id FROM (SELECT reason, doc_id, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS r FROM (SELECT doc_id, {_CASE} AS reason FROM documents) WHERE reason <> 'accepted') WHERE r <= 5")
def example_capture(spark, sf):
    """Five examples of each reason (the report's own limit)."""
    rows = V.table(spark, sf, "documents").select("doc_id", curate.first_reason(_rules()).alias("reason")).where("reason IS NOT NULL")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("reason").orderBy("doc_id"))).where("r <= 5").select("reason", "doc_id")


@query(f"SELECT lang, count(*) FILTER (regexp_full_match(t, '[a-z ]+')) AS plain, count(*) FILTER (n BETWEEN 8 AND 35) AS sized, count(*) FILTER (regexp_full_match(t, '[a-z ]+') AND n BETWEEN 8 AND 35 AND contains(' ' || t || ' ', ' the ')) AS accepted FROM (SELECT lang, lower(text) AS t, len({V.words_sql('lower(text)')}) AS n FROM documents) GROUP BY lang")
def synthetic_text_gate(spark, sf):
    t = F.lower("text")
    plain, sized = t.rlike("^[a-z ]+$"), F.size(F.array_remove(F.split(t, " "), "")).between(8, 35)
    named = F.concat(F.lit(" "), t, F.lit(" ")).contains(" the ")
    return V.table(spark, sf, "documents").groupBy("lang").agg(F.count_if(plain).alias("plain"), F.count_if(sized).alias("sized"), F.count_if(plain & sized & named).alias("accepted"))


# ---- joins -------------------------------------------------------------------


@query("SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS shared, count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right FROM (SELECT d.doc_id AS a, l.doc_id AS b FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id)")
def id_set_identity(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("a"))
    l = V.table(spark, sf, "labels").select(F.col("doc_id").alias("b"))
    return d.join(l, F.col("a") == F.col("b"), "full").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"))


@query(f"SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY {V.NORM_AUDIT}) AS class_id, count(*) OVER (PARTITION BY {V.NORM_AUDIT}) AS class_size FROM documents")
def exact_text_classes(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return overlap.text_classes(d, T.norm_audit(F.col("text")))


_GRAMS = """CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - {n} + 1, 1) + 1), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) END"""


def _sides(spark, sf, n: int = 4):
    words = T.audit_words(F.col("text"))
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), words.alias("words"))
    b = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), words.alias("words"))
    return d, b


_PAIRS = f"""dw AS (SELECT doc_id AS id, {V.words_sql(V.NORM_AUDIT)} AS w FROM documents), bw AS (SELECT item_id AS id, {V.words_sql(V.NORM_AUDIT)} AS w FROM benchmark),
dg AS (SELECT id, unnest({_GRAMS.format(n=4)}) AS gram FROM dw WHERE len(w) >= 4), bg AS (SELECT id, unnest({_GRAMS.format(n=4)}) AS gram FROM bw),
pairs AS (SELECT dg.id AS source_id, bg.id AS target_id, count(*) AS shared FROM dg JOIN bg USING (gram) GROUP BY dg.id, bg.id)"""


@query("SELECT source_id, target_id, shared FROM pairs WHERE source_id IN (SELECT source_id FROM pairs GROUP BY source_id HAVING count(*) <= 500)", _PAIRS)
def ngram_candidate_pairs(spark, sf):
    return overlap.gram_candidates(*_sides(spark, sf))


@query("""SELECT source_id, target_id FROM (SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY abs(d.n_chars - length(b.text)), target_id) AS r
FROM pairs JOIN documents d ON d.doc_id = source_id JOIN benchmark b ON b.item_id = target_id WHERE abs(d.n_chars - length(b.text)) <= greatest(200.0, 0.9 * greatest(d.n_chars, length(b.text)))) WHERE r <= 25""", _PAIRS)
def band_duration_topk(spark, sf):
    pairs = overlap.gram_candidates(*_sides(spark, sf))
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), F.col("n_chars").alias("a"))
    b = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("target_id"), F.length("text").alias("b"))
    near = pairs.join(d, "source_id").join(b, "target_id").where(overlap.in_band(F.col("a"), F.col("b"), 200.0, 0.9))
    return overlap.closest(near, "source_id", F.abs(F.col("a") - F.col("b")), "target_id").select("source_id", "target_id")


@query("""SELECT source_id, target_id, round(common / (na + nb - common), 6) AS likeness FROM (SELECT source_id, target_id, len(d.w) AS na, len(b.w) AS nb,
list_sum(list_transform(list_distinct(list_concat(d.w, b.w)), lambda x: least(len(list_filter(d.w, lambda y: y = x)), len(list_filter(b.w, lambda y: y = x)))))::DOUBLE AS common
FROM pairs JOIN dw d ON d.id = source_id JOIN bw b ON b.id = target_id WHERE shared >= 5)""", _PAIRS)
def bag_jaccard(spark, sf):
    d, b = _sides(spark, sf)
    pairs = overlap.gram_candidates(d, b).where("shared >= 5")
    return overlap.bag_likeness_pairs(pairs, d, b).withColumn("likeness", F.round("likeness", 6))


@query("SELECT doc_id AS hay_id, item_id AS needle_id, (instr(d.text, b.text) - 1)::BIGINT AS position FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''")
def substring_containment(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return overlap.any_containment(d, V.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query("SELECT a.doc_id AS id, count(*) AS matches FROM (SELECT doc_id, source, substr(text, 11, 20) AS crop FROM documents) a JOIN (SELECT DISTINCT source, substr(text, 11, 20) AS crop FROM documents WHERE length(text) > 500) b USING (source, crop) GROUP BY a.doc_id")
def positional_containment(spark, sf):
    """The same stretch at the same place, among rows that share a name."""
    d = V.table(spark, sf, "documents").select("doc_id", "source", F.substring("text", 11, 20).alias("crop"), F.length("text").alias("n"))
    held = d.where("n > 500").select("source", "crop").distinct()
    return d.join(held, ["source", "crop"]).groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("matches"))


@query("SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def hash_identity(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return d.groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


@query("SELECT DISTINCT c.c_custkey AS left_id, s.s_suppkey AS right_id FROM customer c JOIN supplier s ON c.c_custkey = s.s_suppkey OR floor(c.c_acctbal) = floor(s.s_acctbal)")
def name_or_hash_candidates(spark, sf):
    """An OR of two keys as a union of two equi-joins."""
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("key"), F.floor("c_acctbal").alias("amount"))
    s = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("key"), F.floor("s_acctbal").alias("amount"))
    return overlap.any_key(c, s, ["key", "amount"])


@query("SELECT page_id, stem, count(*) OVER (PARTITION BY stem) AS same_stem FROM (SELECT page_id, regexp_replace(list_last(string_split(url, '/')), '\\.[^.]*$', '') AS stem FROM pages)")
def stem_lookup(spark, sf):
    p = V.table(spark, sf, "pages").select("page_id", T.stem(F.col("url")).alias("stem"))
    return p.join(p.groupBy("stem").agg(F.count("*").alias("same_stem")), "stem").select("page_id", "stem", "same_stem")


@query("SELECT m.id, coalesce(c.h, 'computed') AS hash FROM manifest m LEFT JOIN (SELECT source_record_id, \"offset\", duration, min('cached:' || id) AS h FROM manifest WHERE id % 2 = 0 GROUP BY ALL) c ON m.source_record_id = c.source_record_id AND m.\"offset\" = c.\"offset\" AND m.duration = c.duration", V.MANIFEST)
def cache_lookup(spark, sf):
    """A cached digest counts only if path, offset and duration agree."""
    m = V.manifest(spark, sf)
    key = ["source_record_id", "offset", "duration"]
    cached = m.where("id % 2 = 0").groupBy(*key).agg(F.min(F.concat(F.lit("cached:"), F.col("id").cast("string"))).alias("h"))
    return m.join(cached, key, "left").select("id", F.coalesce("h", F.lit("computed")).alias("hash"))


_PROTECTED = f"marked AS (SELECT *, {V.SPLIT} AS split, sha256(text) AS sha FROM manifest), protected AS (SELECT * FROM marked WHERE split = 'test'), rest AS (SELECT * FROM marked WHERE split <> 'test')"


def _marked(spark, sf):
    return V.manifest(spark, sf).withColumn("split", V.split_of(F.col("source_record_id"))).withColumn("sha", F.sha2("text", 256))


@query("""SELECT split, count(*) AS n, count(*) FILTER (sha IN (SELECT sha FROM protected)) AS hit_sha, count(*) FILTER ((airport || '::' || recorded_date) IN (SELECT airport || '::' || recorded_date FROM protected)) AS hit_day,
count(*) FILTER (source_record_id IN (SELECT source_record_id FROM protected)) AS hit_record FROM rest GROUP BY split""", V.MANIFEST, _PROTECTED)
def protected_leak_flags(spark, sf):
    m = _marked(spark, sf).withColumn("day", F.concat_ws("::", "airport", F.col("recorded_date").cast("string"))).withColumn("record", F.col("source_record_id"))
    flagged = overlap.protected_flags(m.where("split <> 'test'").select("split", "sha", "day", "record"), m.where("split = 'test'"), ["sha", "day", "record"])
    return flagged.groupBy("split").agg(F.count("*").alias("n"), *(F.count_if(f"hit_{k}").alias(f"hit_{k}") for k in ("sha", "day", "record")))


@query("SELECT id FROM rest WHERE sha NOT IN (SELECT sha FROM protected)", V.MANIFEST, _PROTECTED)
def protected_anti(spark, sf):
    m = _marked(spark, sf)
    return m.where("split <> 'test'").join(m.where("split = 'test'").select("sha").distinct(), "sha", "left_anti").select("id")


@query("""SELECT k.key, a.split AS split_a, b.split AS split_b, count(DISTINCT a.value) FILTER (b.value IS NOT NULL) AS shared FROM (SELECT 1) x, (SELECT unnest(['record', 'sha', 'day']) AS key) k, (SELECT 1) y
JOIN (SELECT DISTINCT split FROM marked) sa ON true JOIN (SELECT DISTINCT split FROM marked) sb ON sa.split < sb.split
LEFT JOIN vals a ON a.split = sa.split AND a.key = k.key LEFT JOIN vals b ON b.split = sb.split AND b.key = k.key AND b.value = a.value GROUP BY ALL""".replace("a.split AS split_a, b.split AS split_b", "sa.split AS split_a, sb.split AS split_b"), V.MANIFEST, _PROTECTED,
    "vals AS (SELECT DISTINCT split, 'record' AS key, source_record_id AS value FROM marked UNION SELECT DISTINCT split, 'sha', sha FROM marked UNION SELECT DISTINCT split, 'day', airport || '::' || recorded_date FROM marked)",
)
def pairwise_disjointness(spark, sf):
    m = _marked(spark, sf).select("split", F.col("source_record_id").alias("record"), "sha", F.concat_ws("::", "airport", F.col("recorded_date").cast("string")).alias("day"))
    return overlap.pairwise_overlap(m, "split", ["record", "sha", "day"])


@query("""SELECT split, count(*) AS rows, count(*) FILTER (sha IN (SELECT sha FROM protected)) AS matches, NOT bool_or(sha IN (SELECT sha FROM protected)) AS eligible FROM (SELECT source AS split, sha FROM rest) GROUP BY split""", V.MANIFEST, _PROTECTED)
def ancestry_audit(spark, sf):
    """Matches of each ancestor corpus (a source) with the protected split; any match withholds it."""
    m = _marked(spark, sf)
    flagged = overlap.protected_flags(m.where("split <> 'test'").select(F.col("source").alias("split"), "sha"), m.where("split = 'test'"), ["sha"])
    return flagged.groupBy("split").agg(F.count("*").alias("rows"), F.count_if("hit_sha").alias("matches"), (~F.bool_or("hit_sha")).alias("eligible"))


# ---- intervals, masks, splits, mixtures ---------------------------------------


@query("""SELECT conv_id, count(*) AS pieces, sum(greatest(0, stop - greatest(start, coalesce(reached, start))))::BIGINT AS covered FROM (SELECT *, max(stop) OVER (PARTITION BY conv_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM intervals) GROUP BY conv_id""", V.INTERVALS)
def interval_union_minutes(spark, sf):
    return curate.covered(V.intervals(spark, sf), ["conv_id"])


@query("SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_quality, count(*) FILTER (b AND NOT a) AS only_toxic, count(*) FILTER (a OR b) AS either, count(*) FILTER (NOT (a OR b)) AS kept FROM (SELECT quality = 0 AS a, toxic = 1 AS b FROM labels)")
def mask_set_algebra(spark, sf):
    """Union, intersection and differences of two id sets, from long masks."""
    ids = V.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    m = V.masks(spark, sf).where("mask <> 'either'").groupBy("id").agg(F.collect_set("mask").alias("m"))
    rows = ids.join(m, "id", "left").select(F.coalesce(F.array_contains("m", "low_quality"), F.lit(False)).alias("a"), F.coalesce(F.array_contains("m", "toxic"), F.lit(False)).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_quality"), F.count_if(b & ~a).alias("only_toxic"), F.count_if(a | b).alias("either"), F.count_if(~(a | b)).alias("kept"))


@query(f"""SELECT split, count(*) AS segments, round_even(sum(duration) / 3600.0, 4) AS speech_hours, count(DISTINCT source_record_id) AS recordings, count(DISTINCT (airport, recorded_date)) AS sessions, round(min(duration), 3) AS min_duration, round(max(duration), 3) AS max_duration FROM (SELECT *, {V.SPLIT} AS split FROM manifest) GROUP BY split""", V.MANIFEST)
def split_summary(spark, sf):
    return summarise(_marked(spark, sf))


_RANK = "sha256('7:' || id)"


@query(f"SELECT id, cum FROM (SELECT id, n, sum(n) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM (SELECT id, {_RANK} AS r, round(duration * 15)::BIGINT AS n FROM manifest)) WHERE cum - n < 200000", V.MANIFEST)
def token_budget_prefix(spark, sf):
    """In rank order, rows join until the budget is met; the one that meets it is in."""
    m = V.manifest(spark, sf).select("id", F.round(F.col("duration") * 15).cast("long").alias("n"))
    return curate.running_total(m, F.col("n"), T.stable_rank(7, F.col("id"))).where(F.col("cum") - F.col("n") < 200000).select("id", "cum")


@query(f"SELECT airport, budget, count(*) AS n, sum(n)::BIGINT AS total FROM (SELECT airport, n, sum(n) OVER (PARTITION BY airport ORDER BY r ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT airport, {_RANK} AS r, round(duration * 15)::BIGINT AS n FROM manifest)), (SELECT unnest([10000, 50000, 100000]) AS budget) WHERE cum - n < budget GROUP BY airport, budget", V.MANIFEST)
def nested_hour_samples(spark, sf):
    """One rank per airport makes every smaller sample a part of the larger ones."""
    m = V.manifest(spark, sf).select("id", "airport", F.round(F.col("duration") * 15).cast("long").alias("n"))
    rows = curate.running_total(m, F.col("n"), T.stable_rank(7, F.col("id")), ["airport"]).withColumn("budget", F.explode(F.array(*(F.lit(b) for b in (10000, 50000, 100000)))))
    return rows.where(F.col("cum") - F.col("n") < F.col("budget")).groupBy("airport", "budget").agg(F.count("*").alias("n"), F.sum("n").alias("total"))


@query(f"SELECT id, part FROM (SELECT id, part, n, budget, sum(n) OVER (PARTITION BY part ORDER BY r ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT id, {_RANK} AS r, round(duration * 15)::BIGINT AS n, CASE WHEN source = 'src0' THEN 'domain' ELSE 'general' END AS part, CASE WHEN source = 'src0' THEN 40000 ELSE 10000 END AS budget FROM manifest)) WHERE cum - n < budget", V.MANIFEST)
def hash_ranked_budget(spark, sf):
    """A budget per part, filled in rank order."""
    m = V.manifest(spark, sf).select("id", F.round(F.col("duration") * 15).cast("long").alias("n"), F.when(F.col("source") == "src0", "domain").otherwise("general").alias("part"))
    budget = F.when(F.col("part") == "domain", 40000).otherwise(10000)
    return curate.running_total(m, F.col("n"), T.stable_rank(7, F.col("id")), ["part"]).where(F.col("cum") - F.col("n") < budget).select("id", "part")


@query(f"SELECT id, {_RANK} AS rank FROM manifest WHERE {_RANK} < '2'", V.MANIFEST)
def stable_rank_sample(spark, sf):
    """A share of the rows by rank: the sampling operator itself."""
    return V.manifest(spark, sf).select("id", T.stable_rank(7, F.col("id")).alias("rank")).where("rank < '2'")


@query("""SELECT part, count(*) AS n FROM (SELECT unnest(range(k)) AS i, part FROM (SELECT CASE WHEN source = 'src0' THEN 'target' ELSE 'general' END AS part, CASE WHEN source = 'src0' THEN greatest(1, round_even((SELECT sum(n_chars) FROM documents WHERE source <> 'src0') / (4.0 * (SELECT sum(n_chars) FROM documents WHERE source = 'src0')), 0))::BIGINT ELSE 1 END AS k FROM documents)) GROUP BY part""")
def corpus_repeat_mix(spark, sf):
    """The small corpus is repeated until it makes a quarter of the large one, rounded half to even, at least once."""
    d = V.table(spark, sf, "documents").withColumn("part", F.when(F.col("source") == "src0", "target").otherwise("general"))
    s = d.agg(F.sum(F.when(F.col("part") == "general", F.col("n_chars"))).alias("g"), F.sum(F.when(F.col("part") == "target", F.col("n_chars"))).alias("t"))
    times = s.select(F.greatest(F.lit(1), F.bround(F.col("g") / (4.0 * F.col("t")), 0).cast("long")).alias("k"))
    rows = d.join(F.broadcast(times)).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("part") == "target", F.col("k")).otherwise(F.lit(1).cast("long")))))
    return rows.groupBy("part").agg(F.count("*").alias("n"))


_SESSIONS = "sessions AS (SELECT airport, recorded_date, round(sum(duration), 3) AS seconds FROM manifest GROUP BY airport, recorded_date)"


@query("""SELECT airport, recorded_date FROM several UNION ALL SELECT airport, recorded_date FROM (SELECT *, coalesce(sum(seconds) OVER (ORDER BY sha256('s:singleton:' || airport) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM placed WHERE n = 1)
WHERE coalesce((SELECT sum(seconds) FROM several), 0) + b < 0.2 * (SELECT sum(seconds) FROM sessions)""", V.MANIFEST, _SESSIONS,
    """placed AS (SELECT *, count(*) OVER (PARTITION BY airport) AS n, row_number() OVER (PARTITION BY airport ORDER BY r) AS p, coalesce(sum(seconds) OVER (PARTITION BY airport ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, 0.2 * sum(seconds) OVER (PARTITION BY airport) AS target
FROM (SELECT *, sha256('s:' || airport || ':' || CAST(recorded_date AS VARCHAR)) AS r FROM sessions))""", "several AS (SELECT airport, recorded_date, seconds FROM placed WHERE n > 1 AND p < n AND before < target)")
def dev_session_prefix(spark, sf):
    s = V.manifest(spark, sf).groupBy("airport", "recorded_date").agg(F.round(F.sum("duration"), 3).alias("seconds"))
    return splits.development_sessions(s, 0.2, "s").select("airport", "recorded_date")


@query("SELECT airport, recorded_date, seconds FROM (SELECT *, row_number() OVER (PARTITION BY airport ORDER BY seconds DESC, recorded_date DESC) AS r FROM sessions) WHERE r = 1", V.MANIFEST, _SESSIONS)
def protect_largest_group(spark, sf):
    s = V.manifest(spark, sf).groupBy("airport", "recorded_date").agg(F.round(F.sum("duration"), 3).alias("seconds"))
    return s.groupBy("airport").agg(F.max(F.struct("seconds", "recorded_date")).alias("m")).select("airport", "m.recorded_date", "m.seconds")


@query()
def subset_sum_split(spark, sf):
    """Airport days whose seconds come nearest to 30 % of each airport's; the rest stays."""
    s = V.manifest(spark, sf).withColumn("day", F.col("recorded_date").cast("string")).groupBy("airport", "day").agg(F.round(F.sum("duration"), 3).alias("seconds"))
    return splits.subset_per_group(s, "airport", "day", "seconds", 0.3, 11)


@query("SELECT id, (row_number() OVER (PARTITION BY airport ORDER BY r) - 1) % 8 AS shard FROM (SELECT id, airport, sha256('7:' || id) AS r FROM manifest)", V.MANIFEST)
def shard_balance(spark, sf):
    """Rows dealt to eight readers in rank order, within a language: shard sizes differ by one at most."""
    m = V.manifest(spark, sf).select("id", "airport", F.lit(1).alias("one"))
    return curate.running_total(m, F.col("one"), T.stable_rank(7, F.col("id")), ["airport"]).select("id", F.pmod(F.col("cum") - 1, F.lit(8)).cast("long").alias("shard"))


DRAWS = 10_000
_PARTS = "parts AS (SELECT id, part, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY part) AS size FROM (SELECT id, CASE WHEN source = 'src0' THEN 'domain' ELSE 'general' END AS part FROM manifest))"


@query(f"""SELECT p.id, p.part, count(*) AS draws FROM (SELECT i, CASE WHEN {V.hash_sql('3', 'i')} % 100 < 80 THEN 'domain' ELSE 'general' END AS part FROM (SELECT unnest(range({DRAWS})) AS i)) d
JOIN parts p ON p.part = d.part AND p.place = {V.hash_sql('5', 'd.i')} % p.size GROUP BY p.id, p.part""", V.MANIFEST, _PARTS)
def weighted_draws(spark, sf):
    """A sampling operator: ten thousand draws, four fifths of them from the rows of the domain, each row as often as it is drawn.

    Draws are few and meet numbered rows; no row is repeated before it is drawn.
    """
    from lexmill.functions.stats import hash_number

    m = V.manifest(spark, sf).select("id", F.when(F.col("source") == "src0", "domain").otherwise("general").alias("part"))
    rows = curate.numbered(m, ["part"], "id")
    sizes = m.groupBy("part").agg(F.count("*").alias("size"))
    part = F.when(hash_number(F.lit(3), F.col("id")) % 100 < 80, "domain").otherwise("general")
    draws = spark.range(DRAWS).select(part.alias("part"), hash_number(F.lit(5), F.col("id")).alias("h")).join(F.broadcast(sizes), "part")
    picked = draws.groupBy("part", (F.col("h") % F.col("size") + 1).alias("number")).agg(F.count("*").alias("draws"))
    return rows.join(F.broadcast(picked), ["part", "number"]).select("id", "part", "draws")


@query("SELECT level, count(*) AS n, sum(words)::BIGINT AS words FROM (SELECT words, CASE WHEN errors * 100 >= words * 30 THEN 'hard' WHEN errors * 100 >= words * 15 THEN 'middle' ELSE 'easy' END AS level FROM scored WHERE words > 0) GROUP BY level", V.PREDICTIONS)
def hard_slices(spark, sf):
    """A pool parted by each row's error rate."""
    e, w = F.col("errors") * 100, F.col("words")
    level = F.when(e >= w * 30, "hard").when(e >= w * 15, "middle").otherwise("easy")
    return V.scored_utterances(spark, sf).where("words > 0").groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("words").alias("words"))


@query(f"""SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({_GRAMS.format(n=8)}) AS gram FROM (SELECT doc_id, {V.words_sql(V.NORM_SCORE)} AS w FROM documents) WHERE len(w) >= 8) WHERE gram IN (SELECT unnest({_GRAMS.format(n=8)}) FROM (SELECT {V.words_sql(V.NORM_SCORE)} AS w FROM benchmark) WHERE len(w) >= 8)""")
def contamination_8gram(spark, sf):
    """Documents that share an eight-word run with a held-out text. Grams of the held-out texts are few; documents' grams are only tested, never dealt out."""
    words = T.score_words(F.col("text"))

    def hashed(name, key):
        rows = V.table(spark, sf, name).select(F.col(key).alias("id"), words.alias("w"))
        return rows.select("id", F.explode(F.when(F.size("w") >= 8, T.gram_hashes(F.col("w"), 8))).alias("gram"))

    held = hashed("benchmark", "item_id").select("gram").distinct()
    few = held.count() <= 1_000_000
    return hashed("documents", "doc_id").join(F.broadcast(held) if few else held, "gram", "left_semi").select(F.col("id").alias("doc_id")).distinct()


@query(f"SELECT g AS gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM (SELECT {V.words_sql(V.NORM_SCORE)} AS w FROM documents) WHERE len(w) >= 3) GROUP BY g HAVING count(*) >= 20")
def ngram_counts(spark, sf):
    """Three-word runs that occur twenty times or more: counts for language models."""
    return _runs(spark, sf, 3, 20)


def _runs(spark, sf, n: int, least: int):
    """(gram, n) of runs of ``n`` words that occur ``least`` times or more.

    Runs are counted once, by a 64-bit hash, with the smallest document that
    holds them; only those documents are read again, to spell their runs out.
    """
    d = V.table(spark, sf, "documents")
    # Seven characters a word, about: this sets the number of buckets alone.
    size = (d.agg(F.sum("n_chars")).first()[0] or 0) // 7
    d = d.select("doc_id", T.score_words(F.col("text")).alias("w"))
    # No filter by length before the runs: it would move below the words and make them twice.
    hashes = F.when(F.size("w") >= n, T.gram_hashes(F.col("w"), n, distinct=False))
    counted = stored(runs.frequent(d.select("doc_id", hashes.alias("h")), least, size))
    return runs.spelled(d, hashes, counted, n)


@query(f"""WITH w AS (SELECT {V.words_sql(V.NORM_SCORE)} AS w FROM documents),
two AS (SELECT unnest(list_transform(range(1, greatest(len(w) - 1, 0) + 1), lambda i: array_to_string(w[i:i + 1], ' '))) AS g FROM w WHERE len(w) >= 2), three AS (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w WHERE len(w) >= 3),
seen2 AS (SELECT g, count(*) AS n FROM two GROUP BY g), seen3 AS (SELECT g, count(*) AS n FROM three GROUP BY g HAVING count(*) >= 20)
SELECT t.g AS gram, t.n, round(t.n / b.n, 6) AS p, round(log10(t.n / b.n), 6) AS log10_p FROM seen3 t JOIN seen2 b ON b.g = array_to_string(string_split(t.g, ' ')[1:2], ' ')""")
def trigram_estimates(spark, sf):
    """Maximum-likelihood estimates of a word after two, for the runs of three that occur twenty times or more."""
    three = _runs(spark, sf, 3, 20).withColumn("before", F.array_join(F.slice(F.split("gram", " "), 1, 2), " "))
    two = _runs(spark, sf, 2, 20).select(F.col("gram").alias("before"), F.col("n").alias("times"))
    p = F.col("n") / F.col("times")
    return three.join(two, "before").select("gram", "n", F.round(p, 6).alias("p"), F.round(F.log10(p), 6).alias("log10_p"))


@query("SELECT vec_id, round(length(embedding) / 64.0, 6) AS seconds, (length(embedding) / 64.0 BETWEEN 1 AND 30) AND sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) > 0.001 AND len(list_filter(embedding, lambda x: abs(x) >= 0.3)) / len(embedding) < 0.005 AS accepted FROM embeddings")
def synthetic_audio_gate(spark, sf):
    """Made audio passes by duration, loudness and clipping; vectors stand in for a second of sound each."""
    v = F.col("embedding")
    seconds = F.size(v) / 64.0
    return V.table(spark, sf, "embeddings").select("vec_id", F.round(seconds, 6).alias("seconds"), (seconds.between(1, 30) & (rms(v) > 0.001) & (clipped_share(v, 0.3) < 0.005)).alias("accepted"))


@query("SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 20) || '.wav' AS name FROM documents")
def hash_names(spark, sf):
    """File names that do not tell the id."""
    return V.table(spark, sf, "documents").select("doc_id", T.hash_name(F.col("doc_id"), ".wav").alias("name"))


@query("SELECT a.doc_id AS left_id, b.doc_id AS right_id, a.place FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents WHERE doc_id % 2 = 0) a JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents WHERE doc_id % 2 = 1) b USING (place)")
def positional_pairs(spark, sf):
    """Two lists row by row, by place alone; the longer one's rest has no partner."""
    d = V.table(spark, sf, "documents").select("doc_id")
    side = lambda rest, name: curate.numbered(d.where(F.col("doc_id") % 2 == rest), [], "doc_id").select(F.col("doc_id").alias(name), F.col("number").alias("place"))
    return side(0, "left_id").join(side(1, "right_id"), "place").select("left_id", "right_id", "place")


# ---- vectors -------------------------------------------------------------------


@query("""SELECT a.vec_id AS id, round(coalesce(CASE WHEN va.v > 0 AND vb.v > 0 THEN (list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - a.m) * (z[2] - b.m)))) / sqrt(va.v * vb.v) END, 0), 6) AS r
FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN s va ON va.vec_id = a.vec_id JOIN s vb ON vb.vec_id = b.vec_id""",
    "v AS (SELECT vec_id, list_transform(embedding, lambda y: y::DOUBLE) AS x, list_avg(list_transform(embedding, lambda y: y::DOUBLE)) AS m FROM embeddings)", "s AS (SELECT vec_id, list_sum(list_transform(x, lambda y: (y - m) * (y - m))) AS v FROM v)")
def vector_pearson_pairs(spark, sf):
    """Correlation of each vector with the one of the next id."""
    e = V.table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select(F.col("vec_id").alias("id"), F.round(pearson(F.col("embedding"), F.col("other")), 6).alias("r"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 6) AS rms, round(len(list_filter(embedding, lambda x: abs(x) >= 0.2)) / len(embedding), 6) AS clipped FROM embeddings")
def rms_and_clipping(spark, sf):
    return V.table(spark, sf, "embeddings").select("vec_id", F.round(rms(F.col("embedding")), 6).alias("rms"), F.round(clipped_share(F.col("embedding"), 0.2), 6).alias("clipped"))


@query("SELECT hay_id, needle_id, start FROM (SELECT d.doc_id AS hay_id, b.item_id AS needle_id, list_min(list_filter(range(0, (length(hd) - length(hb)) // 4 + 1), lambda i: substr(hd, (i * 4 + 1)::BIGINT, length(hb)) = hb)) AS start FROM (SELECT doc_id, hex(encode(text)) AS hd FROM documents) d JOIN (SELECT item_id, hex(encode(text)) AS hb FROM benchmark) b ON contains(hd, hb)) WHERE start IS NOT NULL")
def aligned_byte_containment(spark, sf):
    """Byte containment at even places, as for 16-bit samples; texts stand in for sound."""
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("data"))
    b = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.encode("text", "UTF-8").alias("data"))
    return overlap.aligned_containment(d, b)


@query("SELECT lang, count(*) AS paired FROM documents GROUP BY lang")
def paired_rows(spark, sf):
    """Two result files row by row: by key, with the same text on both sides, or the job fails."""
    d = V.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return overlap.paired(d, d.select("doc_id", "text"), "doc_id", ["text"]).groupBy("lang").agg(F.count("*").alias("paired"))


@query("SELECT count(*) AS planted, count(*) FILTER (EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))) AS recovered FROM benchmark b")
def positive_controls(spark, sf):
    """Known items, and how many the search recovers."""
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    b = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    found = overlap.any_containment(d, b).select(F.col("needle_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    return b.join(found, "id", "left").agg(F.count("*").alias("planted"), F.count("hit").alias("recovered"))


@query("SELECT a.source, count(*) AS files, count(*) FILTER (a.sha = b.sha) AS identical, bool_and(a.sha = b.sha) AS all_identical FROM (SELECT source, doc_id, sha256(text) AS sha FROM documents) a JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 40 = 0 THEN text || '.' ELSE text END) AS sha FROM documents) b ON a.doc_id = b.doc_id GROUP BY a.source")
def parent_child_release(spark, sf):
    """A release against its parent: which files are the same, byte for byte."""
    d = V.table(spark, sf, "documents")
    parent = d.select("source", "doc_id", F.sha2("text", 256).alias("sha"))
    child = d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 40 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("child"))
    same = F.col("sha") == F.col("child")
    return parent.join(child, "doc_id").groupBy("source").agg(F.count("*").alias("files"), F.count_if(same).alias("identical"), F.bool_and(same).alias("all_identical"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS origin, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS with_extra FROM documents GROUP BY 1")
def tagged_union(spark, sf):
    """A bag union with a source tag; a column that only one side has is null for the other."""
    from lexmill.operators.govern import union_all

    d = V.table(spark, sf, "documents").select("doc_id")
    both = union_all([d.where("doc_id % 2 = 0").withColumn("origin", F.lit("first")).withColumn("extra", F.lit(1)), d.where("doc_id % 2 <> 0").withColumn("origin", F.lit("second"))])
    return both.groupBy("origin").agg(F.count("*").alias("n"), F.count("extra").alias("with_extra"))


@query("SELECT source, count(*) FILTER (a AND b) AS common, count(*) FILTER (a AND NOT b) AS first_only, count(*) FILTER (b AND NOT a) AS second_only FROM (SELECT source, n_chars > 1000 AS a, lang = 'en' AS b FROM documents) GROUP BY source")
def set_difference_counts(spark, sf):
    """Intersection and differences of two id sets per source."""
    d = V.table(spark, sf, "documents")
    a, b = d.where("n_chars > 1000").select("source", "doc_id"), d.where("lang = 'en'").select("source", "doc_id")
    tagged = a.intersect(b).withColumn("k", F.lit("common")).unionByName(a.exceptAll(b).withColumn("k", F.lit("first_only"))).unionByName(b.exceptAll(a).withColumn("k", F.lit("second_only")))
    counts = tagged.groupBy("source").agg(*(F.count_if(F.col("k") == k).alias(k) for k in ("common", "first_only", "second_only")))
    return d.select("source").distinct().join(counts, "source", "left").fillna(0)
