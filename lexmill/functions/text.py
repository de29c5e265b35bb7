"""Text policies as column expressions; nothing here leaves the JVM but the exact mode.

The native policies fold accents with a table of Latin letters. For text outside
that table use ``normalise_exact``, an Arrow UDF over full Unicode tables.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Lower-case letters up to U+024F that decompose into one ASCII letter and marks."""
    pairs = []
    for code in range(0xC0, 0x250):
        letter = chr(code).lower()
        base = unicodedata.normalize("NFKD", letter)
        if len(letter) == 1 and len(base) > 1 and base[0].isascii() and all(unicodedata.combining(c) for c in base[1:]):
            pairs.append((letter, base[0]))
    kept = dict(pairs)
    return "".join(kept), "".join(kept.values())


FOLD_FROM, FOLD_TO = _fold_table()
MARKS = r"\p{M}"

#: Markers of unintelligible words. Five policies are in use; each is a pattern of its own.
UNKNOWN_POLICIES = {
    "release": r"(?i)\[unk\]",
    "ablation": r"(?i)(\[unk\]|<unk>)",
    "language_model": r"(?i)\[(unk|unknown)\]",
    "language_model_loose": r"(?i)(\[|<)?(unk|unknown)(\]|>)?",
    "preparation": r"(?i)(\[unk\]|IGNORE_TIME_SEGMENT_IN_SCORING)",
}


def fold(text: Column) -> Column:
    """Lower case without accents; a text of ASCII alone has none."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(F.regexp_replace(F.lower(text), MARKS, ""), FOLD_FROM, FOLD_TO)).otherwise(F.lower(text))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def norm_score(text: Column) -> Column:
    """For scoring: letters, digits and apostrophes stay, the rest separates words."""
    return squeeze(F.regexp_replace(fold(text), r"[^\p{L}\p{N}' ]", " "))


def norm_audit(text: Column) -> Column:
    """For audits and language models: sharp s is ss, punctuation and symbols (apostrophes too) separate words."""
    return squeeze(F.regexp_replace(F.replace(fold(text), F.lit("ß"), F.lit("ss")), r"[\p{P}\p{S}]", " "))


def norm_markup(text: Column) -> Column:
    """For annotated transcripts: hesitations and unknowns are words, tags and fragments go, then as for scoring."""
    out = F.replace(F.replace(text, F.lit("[hes]"), F.lit(" uh ")), F.lit("[unk]"), F.lit(" unknown "))
    out = F.regexp_replace(out, r"\[(?:#|NE |/)[^\]]*\]", " ")
    return norm_score(F.regexp_replace(out, r"\(-[^)]*\)", " "))


DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def number_view(text: Column) -> Column:
    """Spoken numbers: a point between digits is a word, so is each digit; 'niner' is 'nine'."""
    out = F.regexp_replace(text, r"(?<=[0-9])\.(?=[0-9])", " decimal ")
    for digit, word in enumerate(DIGIT_WORDS):
        out = F.replace(out, F.lit(str(digit)), F.lit(f" {word} "))
    return F.replace(norm_score(out), F.lit("niner"), F.lit("nine"))


def tokens(text: Column) -> Column:
    """Words between white space; none of an empty text."""
    return F.array_remove(F.split(text, r"\s+"), "")


def score_words(text: Column) -> Column:
    """``tokens`` of ``norm_score`` in one pass."""
    return F.array_remove(F.split(fold(text), r"[^\p{L}\p{N}']+"), "")


def audit_words(text: Column) -> Column:
    """``tokens`` of ``norm_audit`` in one pass."""
    return F.array_remove(F.split(F.replace(fold(text), F.lit("ß"), F.lit("ss")), r"[\p{P}\p{S}\s]+"), "")


def word_grams(words: Column, n: int) -> Column:
    """Distinct n-word runs; a shorter text is one run of all its words; without words there are none."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def gram_hashes(words: Column, n: int, distinct: bool = True) -> Column:
    """64-bit hashes of the n-word runs that ``word_grams`` spells out; with ``distinct`` off, one for each occurrence."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, F.lit(n))))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(runs) if distinct else runs)


def stable_rank(seed: int | str, *values: Column) -> Column:
    """A rank that does not depend on order or placement: the hexadecimal digest of seed and values."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(v.cast("string") for v in values)), 256)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def resolved(path: Column) -> Column:
    """A path without empty, '.' and '..' steps; it stays absolute or relative, and never climbs above its start."""
    none = F.array().cast("array<string>")
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(F.aggregate(F.split(path, "/"), none, step), "/"))


def hash_name(value: Column, suffix: str = "") -> Column:
    """The first 20 hexadecimal digits of the value's SHA-256, and a suffix."""
    return F.concat(F.substring(F.sha2(value.cast("string"), 256), 1, 20), F.lit(suffix))


def plain_cell(text: Column) -> Column:
    """A Markdown table cell without links, code marks, emphasis and line breaks."""
    out = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"<br\s*/?>", " ")
    return squeeze(F.regexp_replace(out, r"[`*]", ""))


def spelled_digits(number: Column, width: int) -> Column:
    """A number, padded with zeros, digit by digit in words."""
    words = F.array(*(F.lit(w) for w in DIGIT_WORDS))
    return F.array_join(F.transform(F.split(F.lpad(number.cast("string"), width, "0"), ""), lambda d: F.element_at(words, d.cast("int") + 1)), " ")


# The classes of spoken words. The first class that holds a word wins.
NUMBER_TERMS = "zero oh one two three four five six seven eight nine niner fife tree hundred thousand decimal point double triple".split()
PHONETIC = "alpha alfa bravo charlie delta echo foxtrot golf hotel india juliet juliett kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray x ray yankee zulu".split()
COMMANDS = "climb descend maintain cleared clearance runway heading flight level contact squawk taxi hold short approach departure tower ground center centre speed knots turn left right direct report landing takeoff wind traffic".split()
CALLSIGNS = "speedbird lufthansa swiss easy ryanair wizz klm airfrance air france austrian delta united american emirates qantas".split()


def word_class(word: Column) -> Column:
    out = F.when(word.isin(NUMBER_TERMS) | word.rlike(r"^\p{Nd}+$"), "number_terms")
    for name, words in (("phonetic_alphabet", PHONETIC), ("atc_commands", COMMANDS), ("callsign_related_terms", CALLSIGNS)):
        out = out.when(word.isin(words), name)
    return out.otherwise("other")


def exact(policy: str):
    """An Arrow UDF for ``score`` or ``audit`` over full Unicode tables (NFKD, case folding, categories)."""

    def score(text: str) -> str:
        kept = (c for c in unicodedata.normalize("NFKD", text).lower() if not unicodedata.combining(c))
        return " ".join("".join(c if c.isalnum() or c in "' " else " " for c in kept).split())

    def audit(text: str) -> str:
        kept = (c for c in unicodedata.normalize("NFKD", text).casefold() if not unicodedata.combining(c))
        return " ".join("".join(" " if unicodedata.category(c)[0] in "PS" else c for c in kept).split())

    one = {"score": score, "audit": audit}[policy]

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else one(x))

    return run
