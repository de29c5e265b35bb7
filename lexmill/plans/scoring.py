"""Queries: error rates, masks, normalisation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions.edit import count_words, edit_counts
from lexmill.functions.stats import hash_number, multinomial_draws, resample
from lexmill.operators import report
from lexmill.plans import views as V
from lexmill.plans.registry import query
from lexmill.session import stored

WER = "count(*) AS utterances, sum(errors)::BIGINT AS errors, sum(words)::BIGINT AS words, round(sum(errors) / nullif(sum(words), 0), 6) AS wer"


@query(f"SELECT lang, {WER} FROM scored GROUP BY lang", V.PREDICTIONS)
def wer_by_lang(spark, sf):
    return report.error_rates(V.scored_utterances(spark, sf), "lang")


@query(
    f"""SELECT view, {WER} FROM (SELECT 'full' AS view, errors, words FROM scored
UNION ALL SELECT 'disjoint', errors, words FROM scored WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) GROUP BY view""",
    V.PREDICTIONS,
)
def wer_by_view(spark, sf):
    """Full and disjoint view in one pass over the rows."""
    marked = V.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("hit")).distinct()
    rows = V.scored_utterances(spark, sf).join(marked, "id", "left")
    seen = F.when(F.coalesce("hit", F.lit(False)), F.array(F.lit("full"))).otherwise(F.array(F.lit("full"), F.lit("disjoint")))
    return report.error_rates(rows.withColumn("view", F.explode(seen)), "view")


@query(f"SELECT mask, {WER} FROM scored, (SELECT DISTINCT mask FROM masks) m WHERE NOT EXISTS (SELECT 1 FROM masks x WHERE x.mask = m.mask AND x.id = scored.id) GROUP BY mask", V.PREDICTIONS, V.MASKS)
def wer_mask_fanout(spark, sf):
    """Rates under each exclusion mask: the sums over all rows less those over the rows that a mask excludes. No list of masks is held anywhere."""
    sums = [F.count("*").alias("utterances"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")]
    # Both sums read it: utterances are scored once.
    each = stored(V.scored_utterances(spark, sf).groupBy("id").agg(*sums))
    held = V.masks(spark, sf).distinct()
    out = held.join(each, "id", "left").groupBy("mask").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"out_{c}") for c in ("utterances", "errors", "words")))
    whole = each.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"all_{c}") for c in ("utterances", "errors", "words")))
    left = {c: (F.col(f"all_{c}") - F.col(f"out_{c}")).alias(c) for c in ("utterances", "errors", "words")}
    rows = out.join(F.broadcast(whole)).select("mask", *left.values()).where("utterances > 0")
    return rows.withColumn("wer", report.rate(F.col("errors"), F.col("words")))


@query()
def wer_sdi_by_lang(spark, sf):
    """Substitutions, deletions and insertions of the preferred alignment; their sum is held against the distance."""
    e = V.scored_utterances(spark, sf).withColumn("e", edit_counts("ref", "hyp"))
    return e.groupBy("lang").agg(F.sum("words").alias("words"), F.sum("errors").alias("errors"), *(F.sum(f"e.{c}").alias(c) for c in ("substitutions", "deletions", "insertions")), F.sum((F.col("e.cost") != F.col("errors")).cast("long")).alias("disagreements"))


@query()
def class_error_attribution(spark, sf):
    """Errors by word class; insertions count for the hypothesis word's class, reference words only for references."""
    rows = count_words(V.utterances(spark, sf), "ref", "hyp").withColumn("word_class", T.word_class(F.col("word")))
    hit = lambda op: F.sum(F.when(F.col("op") == op, F.col("n")).otherwise(0))
    return rows.groupBy("word_class").agg(
        F.sum(F.when(F.col("op") != "I", F.col("n")).otherwise(0)).alias("reference_words"), hit("S").alias("substitutions"), hit("D").alias("deletions"), hit("I").alias("insertions"),
        F.sum(F.when(F.col("op") != "C", F.col("n")).otherwise(0)).alias("attributed_errors"),
    )


def _vocabulary(words):
    return words.groupBy("lang", "w").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))


@query(f"SELECT lang, count(*) AS tokens, count(DISTINCT w) AS types FROM (SELECT lang, unnest({V.words_sql(V.NORM_SCORE)}) AS w FROM documents) GROUP BY lang")
def norm_score_vocabulary(spark, sf):
    d = V.table(spark, sf, "documents")
    return _vocabulary(d.select("lang", F.explode(T.score_words(F.col("text"))).alias("w")))


@query(f"SELECT lang, count(*) AS tokens, count(DISTINCT w) AS types FROM (SELECT lang, unnest({V.words_sql(V.NORM_AUDIT)}) AS w FROM documents) GROUP BY lang")
def norm_audit_vocabulary(spark, sf):
    d = V.table(spark, sf, "documents")
    return _vocabulary(d.select("lang", F.explode(T.audit_words(F.col("text"))).alias("w")))


@query(f"SELECT doc_id, sha256({V.NORM_SCORE}) AS score_sha, sha256({V.NORM_AUDIT}) AS audit_sha FROM documents")
def norm_digests(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.sha2(T.norm_score(F.col("text")), 256).alias("score_sha"), F.sha2(T.norm_audit(F.col("text")), 256).alias("audit_sha"))


_MARKED = "'[hes] ' || text || ' [unk] [NE loc] fin (-ab) [#noise]'"
_STRIPPED = "regexp_replace(regexp_replace(replace(replace(t, '[hes]', ' uh '), '[unk]', ' unknown '), '\\[(?:#|NE |/)[^\\]]*\\]', ' ', 'g'), '\\(-[^)]*\\)', ' ', 'g')"


@query(f"SELECT doc_id, sha256({V.NORM_SCORE.replace('text', 'u')}) AS markup_sha FROM (SELECT doc_id, {_STRIPPED} AS u FROM (SELECT doc_id, {_MARKED} AS t FROM documents))")
def norm_markup_digests(spark, sf):
    marked = F.concat(F.lit("[hes] "), F.col("text"), F.lit(" [unk] [NE loc] fin (-ab) [#noise]"))
    return V.table(spark, sf, "documents").select("doc_id", F.sha2(T.norm_markup(marked), 256).alias("markup_sha"))


def _digits_sql(t: str) -> str:
    for i, w in enumerate(T.DIGIT_WORDS):
        t = f"replace({t}, '{i}', ' {w} ')"
    return t


@query(
    f"SELECT doc_id, sha256(replace({V.NORM_SCORE.replace('text', 'u')}, 'niner', 'nine')) AS number_sha FROM (SELECT doc_id, "
    + _digits_sql("regexp_replace(regexp_replace(text, '([0-9])\\.([0-9])', '\\1 decimal \\2', 'g'), '([0-9])\\.([0-9])', '\\1 decimal \\2', 'g')")
    + " AS u FROM documents)"
)
def number_view_digests(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.sha2(T.number_view(F.col("text")), 256).alias("number_sha"))


def _policy_sql() -> str:
    cols = ", ".join(f"sum(regexp_matches(t, '{p.replace('(?i)', '')}', 'i')::INTEGER)::BIGINT AS {n}" for n, p in T.UNKNOWN_POLICIES.items())
    return f"SELECT lang, {cols} FROM (SELECT lang, CASE doc_id % 5 WHEN 0 THEN text || ' [UNK]' WHEN 1 THEN text || ' <unk>' WHEN 2 THEN text || ' [unknown]' WHEN 3 THEN text || ' trunk' ELSE text END AS t FROM documents) GROUP BY lang"


@query(_policy_sql())
def unknown_marker_policies(spark, sf):
    """The five policies side by side: the loose one also hits words that hold the marker."""
    added = F.element_at(F.array(F.lit(" [UNK]"), F.lit(" <unk>"), F.lit(" [unknown]"), F.lit(" trunk"), F.lit("")), (F.col("doc_id") % 5 + 1).cast("int"))
    d = V.table(spark, sf, "documents").select("lang", F.concat("text", added).alias("t"))
    return d.groupBy("lang").agg(*(F.sum(F.col("t").rlike(p).cast("long")).alias(n) for n, p in T.UNKNOWN_POLICIES.items()))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '<br\\s*/?>', ' ', 'g'), '[`*]', '', 'g'), '\\s+', ' ', 'g')) AS cell FROM (SELECT doc_id, '**[' || source || '](http://x/' || doc_id || ')**<br/>`' || lang || '`' AS t FROM documents)")
def plain_cells(spark, sf):
    t = F.concat(F.lit("**["), F.col("source"), F.lit("](http://x/"), F.col("doc_id").cast("string"), F.lit(")**<br/>`"), F.col("lang"), F.lit("`"))
    return V.table(spark, sf, "documents").select("doc_id", T.plain_cell(t).alias("cell"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(lpad(CAST(p_size AS VARCHAR), 3, '0'), ''), lambda d: (['zero','one','two','three','four','five','six','seven','eight','nine'])[d::INTEGER + 1]), ' ') AS spelled FROM part")
def spelled_numbers(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", T.spelled_digits(F.col("p_size"), 3).alias("spelled"))


@query("""SELECT lang, sum((text <> lower(text))::INTEGER)::BIGINT AS has_upper, sum(regexp_matches(text, '[\\p{P}\\p{S}]')::INTEGER)::BIGINT AS has_mark, sum(regexp_matches(text, '[^\\x00-\\x7F]')::INTEGER)::BIGINT AS not_ascii,
sum(regexp_matches(text, '[0-9]')::INTEGER)::BIGINT AS has_digit, sum((text <> """ + V.NORM_SCORE + """)::INTEGER)::BIGINT AS changed FROM documents GROUP BY lang""")
def style_profile(spark, sf):
    t = F.col("text")
    tests = {"has_upper": t != F.lower(t), "has_mark": t.rlike(r"[\p{P}\p{S}]"), "not_ascii": t.rlike(r"[^\x00-\x7F]"), "has_digit": t.rlike("[0-9]"), "changed": t != T.norm_score(t)}
    return V.table(spark, sf, "documents").groupBy("lang").agg(*(F.sum(c.cast("long")).alias(n) for n, c in tests.items()))


@query("SELECT lang, sum((regexp_matches(array_to_string(ref, ' '), '[0-9]') <> regexp_matches(coalesce(array_to_string(hyp, ' '), ''), '[0-9]'))::INTEGER)::BIGINT AS differing FROM predictions GROUP BY lang", V.PREDICTIONS)
def digit_format_difference(spark, sf):
    a, b = (F.array_join(c, " ").rlike("[0-9]") for c in ("ref", "hyp"))
    return V.utterances(spark, sf).groupBy("lang").agg(F.sum((a != b).cast("long")).alias("differing"))


@query("""SELECT word_class, count(*) AS n FROM (SELECT CASE WHEN w IN (%s) OR regexp_matches(w, '^\\p{Nd}+$') THEN 'number_terms' WHEN w IN (%s) THEN 'phonetic_alphabet' WHEN w IN (%s) THEN 'atc_commands' WHEN w IN (%s) THEN 'callsign_related_terms' ELSE 'other' END AS word_class
FROM (SELECT unnest(%s) AS w FROM documents)) GROUP BY word_class""" % (*(", ".join(f"'{w}'" for w in x) for x in (T.NUMBER_TERMS, T.PHONETIC, T.COMMANDS, T.CALLSIGNS)), V.words_sql(V.NORM_SCORE)))
def word_class_histogram(spark, sf):
    words = V.table(spark, sf, "documents").select(F.explode(T.score_words(F.col("text"))).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).groupBy(T.word_class(F.col("w")).alias("word_class")).agg(F.sum("n").alias("n"))


DRAWS, SEED = 2000, 20261106


def _boot_sql(units: str, values: dict[str, str], final: str, draws: int, seed: int) -> str:
    h = V.hash_sql(str(seed), "draw", "slot")
    return f"""units AS ({units}), numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM units),
drawn AS (SELECT a.g, draw, {h} % a.n AS i FROM (SELECT g, i AS slot, n FROM numbered) a, (SELECT unnest(range({draws})) AS draw) d),
totals AS (SELECT d.g, d.draw, {', '.join(f'sum({e})::BIGINT AS {n}' for n, e in values.items())} FROM drawn d JOIN numbered u ON d.g = u.g AND d.i = u.i GROUP BY d.g, d.draw)
{final}"""


@query("WITH " + V.PREDICTIONS + ", " + _boot_sql("SELECT lang AS g, source AS o, sum(errors)::BIGINT AS errors, sum(words)::BIGINT AS words FROM scored GROUP BY lang, source", {"errors": "errors", "words": "words"}, "SELECT g AS lang, round(quantile_cont(errors / nullif(words, 0), 0.025), 6) AS low, round(quantile_cont(errors / nullif(words, 0), 0.975), 6) AS high FROM totals GROUP BY g", DRAWS, SEED))
def cluster_bootstrap_ci(spark, sf):
    """95 % interval of the error rate, sources drawn whole."""
    clusters = V.scored_utterances(spark, sf).groupBy("lang", "source").agg(F.sum("errors").alias("errors"), F.sum("words").alias("words"))
    # Clusters are few: as many rows as there are sources and languages.
    clusters = clusters.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
    draws = resample(clusters, ["lang"], ["errors", "words"], DRAWS, SEED).withColumn("wer", F.col("errors") / F.nullif(F.col("words"), F.lit(0)))
    return draws.groupBy("lang").agg(F.round(F.percentile("wer", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("wer", F.lit(0.975)), 6).alias("high"))


PAIRED_DRAWS = 10_000


@query()
def paired_bootstrap_delta(spark, sf):
    """Two systems over the same utterances: mean and 95 % interval of the difference of their rates, from 10,000 draws.

    Utterances with the same counts are one kind, and the kinds' multinomial
    counts are the draws: the work follows the number of kinds (utterances are
    short, so there are few), not that of utterances.
    """
    better = F.when((F.col("errors") > 0) & (F.col("id") % 3 == 0), F.col("errors") - 1).otherwise(F.col("errors"))
    kinds = V.scored_utterances(spark, sf).groupBy("lang", F.col("errors").alias("a"), better.alias("b"), "words").agg(F.count("*").alias("n"))
    d = multinomial_draws(kinds, "lang", ["a", "b", "words"], "n", PAIRED_DRAWS, SEED + 1)
    delta = (F.col("b") - F.col("a")) / F.nullif(F.col("words"), F.lit(0))
    return d.groupBy("lang").agg(F.round(F.avg(delta), 6).alias("delta"), F.round(F.percentile(delta, F.lit(0.025)), 6).alias("low"), F.round(F.percentile(delta, F.lit(0.975)), 6).alias("high"), F.round(F.avg((F.col("b") >= F.col("a")).cast("int")), 6).alias("not_better"))


@query("SELECT source, count(*) AS utterances, sum(errors)::BIGINT AS errors, sum(words)::BIGINT AS words FROM scored GROUP BY source", V.PREDICTIONS)
def cluster_rollup(spark, sf):
    return V.scored_utterances(spark, sf).groupBy("source").agg(F.count("*").alias("utterances"), F.sum("errors").alias("errors"), F.sum("words").alias("words"))


@query("SELECT sum(utterances)::BIGINT AS utterances, sum(errors)::BIGINT AS errors, sum(words)::BIGINT AS words, round(sum(errors) / sum(words), 6) AS wer, round(avg(errors / words), 6) AS mean_of_rates FROM (SELECT lang, count(*) AS utterances, sum(errors) AS errors, sum(words) AS words FROM scored GROUP BY lang)", V.PREDICTIONS)
def combined_split_wer(spark, sf):
    """The rate over several splits comes from summed counts; the mean of their rates is shown beside it."""
    each = report.error_rates(V.scored_utterances(spark, sf), "lang")
    return each.agg(F.sum("utterances").alias("utterances"), F.sum("errors").alias("errors"), F.sum("words").alias("words"), F.round(F.sum("errors") / F.sum("words"), 6).alias("wer"), F.round(F.avg(F.col("errors") / F.col("words")), 6).alias("mean_of_rates"))


@query("SELECT lang, max(errors)::BIGINT AS worst, sum(errors)::BIGINT AS errors, round(max(errors) / nullif(sum(errors), 0), 6) AS worst_share, sum((errors * 2 >= words AND words > 0)::INTEGER)::BIGINT AS half_wrong FROM scored GROUP BY lang", V.PREDICTIONS)
def error_concentration(spark, sf):
    """How much of the errors a single utterance holds; nothing is left out of the score."""
    return V.scored_utterances(spark, sf).groupBy("lang").agg(F.max("errors").alias("worst"), F.sum("errors").alias("errors"), report.share(F.max("errors"), F.sum("errors")).alias("worst_share"), F.sum(((F.col("errors") * 2 >= F.col("words")) & (F.col("words") > 0)).cast("long")).alias("half_wrong"))


@query("SELECT lang, source, " + WER + " FROM scored GROUP BY ROLLUP (lang, source)", V.PREDICTIONS)
def wer_slices(spark, sf):
    rows = V.scored_utterances(spark, sf).rollup("lang", "source").agg(F.count("*").alias("utterances"), F.sum("errors").alias("errors"), F.sum("words").alias("words"))
    return rows.withColumn("wer", report.rate(F.col("errors"), F.col("words")))


@query("SELECT lang, round(quantile_cont(duration, 0.5), 6) AS p50, round(quantile_cont(duration, 0.9), 6) AS p90, round(min(duration), 6) AS least, round(max(duration), 6) AS most FROM (SELECT airport AS lang, duration FROM manifest) GROUP BY lang", V.MANIFEST)
def duration_percentiles(spark, sf):
    m = V.manifest(spark, sf)
    return m.groupBy(F.col("airport").alias("lang")).agg(F.round(F.percentile("duration", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("duration", F.lit(0.9)), 6).alias("p90"), F.round(F.min("duration"), 6).alias("least"), F.round(F.max("duration"), 6).alias("most"))


@query(f"SELECT id, {V.hash_sql('7', 'id')} % 1000 AS draw FROM manifest", V.MANIFEST)
def hash_draws(spark, sf):
    return V.manifest(spark, sf).select("id", (hash_number(F.lit(7), F.col("id")) % 1000).alias("draw"))
