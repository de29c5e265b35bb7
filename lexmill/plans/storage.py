"""Queries: what sinks write, scans read back, for every row of a table."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from lexmill.plans import views as V
from lexmill.plans.registry import query
from lexmill.session import shared_dir
from lexmill.sources import readers, schema, sinks

DOCUMENT = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType())])


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"


def _documents(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", "text", "lang")


@query("SELECT doc_id, lang, sha256(text) AS sha FROM documents")
def json_lines_read_back(spark, sf):
    """JSON lines, written once and read leniently."""
    path = _folder(spark)
    sinks.write_lines(_documents(spark, sf), path)
    return readers.json_lines(spark, path, DOCUMENT).select("doc_id", "lang", F.sha2("text", 256).alias("sha"))


@query("SELECT doc_id, lang, sha256(text) AS sha FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL")
def checked_lines_read_back(spark, sf):
    """JSON lines between blank ones, read with required keys: any other line would raise."""
    path = _folder(spark)
    lines = _documents(spark, sf).where("doc_id is not null and text is not null").select(F.explode(F.array(F.to_json(F.struct("doc_id", "text", "lang")), F.lit("  "), F.lit(""))).alias("value"))
    lines.write.text(path)
    return readers.checked_lines(spark, path, DOCUMENT, ("doc_id", "text"), allow_empty=True).select("doc_id", "lang", F.sha2("text", 256).alias("sha"))


@query("SELECT doc_id, 'documents.parquet:' || CAST(row_number() OVER () - 1 AS VARCHAR) AS row_id FROM documents")
def parquet_row_ids(spark, sf):
    """The file and the place in it, for every row."""
    return readers.parquet_with_ids(spark, f"{sf}/documents.parquet").select("doc_id", "row_id")


_CSV = StructType([StructField(n, t) for n, t in (("id", LongType()), ("long", BooleanType()), ("duration", DoubleType()), ("sha", StringType()), ("split", StringType()))])


@query("SELECT doc_id AS id, n_chars > 500 AS long, n_chars / 16.0::DOUBLE AS duration, sha256(text) AS sha, lang AS split FROM documents")
def csv_read_back(spark, sf):
    """CSV in one folder per split, booleans as words; read back with types."""
    path = _folder(spark)
    d = V.table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").alias("id"), F.initcap((F.col("n_chars") > 500).cast("string")).alias("long"), (F.col("n_chars") / 16.0).alias("duration"), F.sha2("text", 256).alias("sha"), F.col("lang").alias("split"))
    sinks.write_splits(rows, path, ["id", "long", "duration", "sha"])
    return readers.csv_rows(spark, path, _CSV)


#: Turns of a conversation in one XML document.
TURNS = 64
_SPACED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(
    f"""SELECT conv_id, turn, coalesce(role, '') AS speaker, sha256(coalesce({_SPACED}, '')) AS sha, turn * 1.5::DOUBLE AS start, CASE WHEN turn % 2 = 0 THEN '1' ELSE '0' END AS correct_transcript, '0' AS non_english
    FROM conversations"""
)
def xml_segments_read_back(spark, sf):
    """Conversations as XML documents of up to 64 turns each; every other turn has a tag, the others its default."""
    clean = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    turn = F.col("turn").cast("string")
    tags = F.when(F.col("turn") % 2 == 0, "<tags><correct_transcript>1</correct_transcript></tags>").otherwise("")
    segment = F.concat(F.lit("<segment><speaker>"), F.coalesce(clean("role"), F.lit("")), F.lit("</speaker><text>"), F.coalesce(clean("text"), F.lit("")), F.lit("</text><start>"), (F.col("turn") * 1.5).cast("string"), F.lit("</start><end>"), turn, F.lit("</end>"), tags, F.lit("</segment>"))
    block = F.floor(F.col("turn") / TURNS)
    files = V.table(spark, sf, "conversations").groupBy(F.concat_ws(":", F.col("conv_id").cast("string"), block.cast("string")).alias("file")).agg(F.concat(F.lit("<recording>"), F.array_join(F.collect_list(segment), ""), F.lit("</recording>")).alias("value"))
    rows = readers.segments_of(files)
    spaced = F.trim(F.regexp_replace("text", r"\s+", " "))
    return rows.select(F.split("file", ":")[0].cast("long").alias("conv_id"), F.col("end").cast("long").alias("turn"), "speaker", F.sha2(spaced, 256).alias("sha"), "start", "correct_transcript", "non_english")


@query("SELECT DISTINCT sha256(line) AS sha, length(line) AS length FROM (SELECT trim(unnest(regexp_split_to_array(text, '[\\r\\n]+'))) AS line FROM documents) WHERE line <> ''")
def unique_lines_read_back(spark, sf):
    """A text corpus in order, one line each; its lines, trimmed, once each."""
    path = _folder(spark)
    lines = _documents(spark, sf).select("doc_id", F.posexplode(F.split("text", r"[\r\n]+")).alias("line", "text"))
    sinks.write_corpus(lines.withColumn("rank", F.struct("doc_id", "line")), path)
    return readers.unique_lines(spark, path).select(F.sha2("value", 256).alias("sha"), F.length("value").cast("long").alias("length"))


@query("SELECT lang AS label, 'complete' AS status, sum(n_chars) / (1000.0::DOUBLE * count(*)) AS normalized_wer FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def arm_reports(spark, sf):
    """One JSON report per arm; a missing or an extra file would raise."""
    path = _folder(spark)
    arms = V.table(spark, sf, "documents").where("lang is not null").groupBy(F.col("lang").alias("label")).agg((F.sum("n_chars") / (F.lit(1000.0) * F.count("*"))).alias("wer"))
    arms.select(F.col("label").alias("arm"), "label", F.lit("complete").alias("status"), F.struct(F.col("wer").alias("normalized_wer")).alias("score")).write.partitionBy("arm").json(path)
    return readers.arms(spark, path, schema.ARM, arms.count()).select("label", "status", "score.normalized_wer")


@query("SELECT sha256(text) AS sha, lang || '/a  b/' || CAST(doc_id AS VARCHAR) AS name FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def checksum_list(spark, sf):
    """A list of digests and names, names with two spaces among them."""
    path = _folder(spark)
    name = F.concat(F.col("lang"), F.lit("/a  b/"), F.col("doc_id").cast("string"))
    _documents(spark, sf).where("text is not null and lang is not null").select(F.concat(F.sha2("text", 256), F.lit("  "), name)).write.text(path)
    return readers.checksums(spark, path)


def _little(number, width: int):
    """Hex of an integer's bytes, lowest first."""
    h = F.lpad(F.hex(number), 2 * width, "0")
    return F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))))


def _wav_of(data, rate: int = 16000):
    """A 16-bit mono WAV file whose samples are the bytes, of even number."""
    size = F.length(data)
    word = lambda text: F.lit(text.encode().hex())
    head = F.concat(
        word("RIFF"), _little(size + 36, 4), word("WAVE"), word("fmt "), _little(F.lit(16), 4), _little(F.lit(1), 2), _little(F.lit(1), 2),
        _little(F.lit(rate), 4), _little(F.lit(2 * rate), 4), _little(F.lit(2), 2), _little(F.lit(16), 2), word("data"), _little(size, 4),
    )
    return F.concat(F.unhex(head), data)


def _sounds(spark, sf):
    """(doc_id, pcm properties): every text's bytes as the samples of a WAV file, parsed."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    even = F.substr(data, F.lit(1), (F.floor(F.length(data) / 2) * 2).cast("int"))
    return _documents(spark, sf).select("doc_id", readers._parse_wav(_wav_of(even)).alias("w")).select("doc_id", "w.*")


_HEX = "hex(encode(coalesce(text, '')))"


@query(f"SELECT doc_id, 16000 AS rate, 1 AS channels, 2 AS width, length({_HEX}) // 4 AS frames, (length({_HEX}) // 4) / 16000.0::DOUBLE AS seconds FROM documents")
def wav_properties(spark, sf):
    """Rate, channels, width, frames and seconds from the headers of WAV files."""
    return _sounds(spark, sf).drop("pcm")


@query(f"SELECT doc_id, sha256(substr({_HEX}, 4 * (doc_id % 90) + 1, 4 * least(160, greatest(0, length({_HEX}) // 4 - doc_id % 90)))) AS sha FROM documents")
def pcm_crops(spark, sf):
    """A hundredth of a second (160 frames) of each sound, from an offset of a few frames; frames are truncated."""
    offset = ((F.col("doc_id") % 90) + 0.5) / 16000.0
    return _sounds(spark, sf).select("doc_id", F.sha2(F.hex(readers.pcm_crop(F.col("pcm"), offset, F.lit(0.01))), 256).alias("sha"))


@query("SELECT doc_id, lang, sha256(text) AS sha FROM documents WHERE lang = 'en' OR text IS NULL OR sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL)")
def first_available_texts(spark, sf):
    """Texts from the first of two places that has them: English documents, then all."""
    d = V.table(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    return readers.first_available([d.where("lang = 'en'"), d.where("not (lang <=> 'en')")], "sha")


_NAMES = ("documents", "pages", "labels", "benchmark", "orders", "absent")


@query(" UNION ALL ".join(f"SELECT '{n}.parquet' AS path, {str(n != 'absent').lower()} AS \"exists\"" for n in _NAMES))
def files_present(spark, sf):
    """Which of the named files are in the folder, by one listing of it."""
    rows = spark.createDataFrame([(f"{n}.parquet",) for n in _NAMES], "path string")
    return readers.present(rows, "path", spark, sf).select("path", "exists")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def two_tier_counts(spark, sf):
    """Row evidence under one root; the counts that another root publishes."""
    path = _folder(spark)
    evidence = V.table(spark, sf, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("sha"))
    sinks.write_two_tiers(evidence, ["source", "lang"], f"{path}/public", f"{path}/private")
    return spark.read.schema("source string, lang string, n long").json(f"{path}/public")


@query("SELECT * FROM (VALUES ('copy', 'copied'), ('copy again', 'kept'), ('copy of other content', 'refused'), ('write', 'written'), ('write again', 'refused')) AS t(action, outcome)")
def sink_guards(spark, sf):
    """What sinks do where a destination exists."""
    path = _folder(spark)
    nations = V.table(spark, sf, "nation")

    def write(rows):
        try:
            sinks.write_lines(rows, f"{path}/lines")
            return "written"
        except AnalysisException:
            return "refused"

    def copy(source):
        try:
            return "copied" if sinks.copy_once(spark, source, f"{path}/copy.parquet") else "kept"
        except sinks.SinkError:
            return "refused"

    outcomes = [("write", write(nations)), ("write again", write(nations))]
    one, other = f"{sf}/nation.parquet", f"{sf}/region.parquet"
    outcomes += [("copy", copy(one)), ("copy again", copy(one)), ("copy of other content", copy(other))]
    return spark.createDataFrame(outcomes, "action string, outcome string")
