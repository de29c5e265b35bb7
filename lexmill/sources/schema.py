"""Explicit schemas of the entities; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import BinaryType, BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


S, D, L, I, B = StringType(), DoubleType(), LongType(), IntegerType(), BooleanType()

MANIFEST = _struct(id=S, audio_filepath=S, offset=D, duration=D, text=S, target_lang=S, lang=S, airport=S, channel=S, recorded_date=DateType(), source_record_id=S, gold_acceptance=S)
REQUIRED = ("id", "audio_filepath", "offset", "duration", "text", "airport", "recorded_date", "source_record_id")
WINDOW = _struct(source_record_id=S, airport=S, channel=S, start_utc=TimestampType(), duration=D, start_epoch=D, end_epoch=D)
SEGMENT = _struct(speaker=S, text=S, start=S, end=S, tags=_struct(correct_transcript=S, non_english=S))
PREDICTION = StructType([*MANIFEST.fields, StructField("pred_text", S, True), StructField("model", S, True)])
CANDIDATE = _struct(source_id=S, target_id=S, source_duration=D, target_duration=D, likeness=D, exact_text=B, envelope_correlation=D, waveform_correlation=D, overlap_seconds=D, confirmed=B)
MATCH = _struct(file=S, row=L, target_id=S, method=S, public_start_frame=L, gold_start_frame=L, match_frames=L, complete_source_identical=B, sha=S)
MASK = _struct(mask=S, id=S)
AUDIO = _struct(audio=_struct(bytes=BinaryType(), path=S), text=S)
ARM = _struct(label=S, status=S, score=_struct(normalized_wer=D))
CHECKPOINT = _struct(step=L, status=S, splits=_struct(development=_struct(wer=D), english_guard=_struct(wer=D)))
RESULT = _struct(model=S, view=S, excluded_utterances=L, retained_utterances=L, reference_words=L, hours=D, source_recordings=L, word_errors=L, substitutions=L, deletions=L, insertions=L, wer_percent=D)


def language(columns: list[str]):
    """The language of a row under any of its names; a sentinel if none has a value."""
    from pyspark.sql import functions as F

    named = [F.nullif(F.col(c), F.lit("")) for c in ("lang", "target_lang") if c in columns]
    return F.coalesce(*named, F.lit("unknown"))
