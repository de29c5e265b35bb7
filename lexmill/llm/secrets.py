"""Secret scans: fixed patterns plus dictionary-primed zstandard novelty.

A candidate string near a sensitive word is compressed with a dictionary of
identifiers and code, primed further by the text around it. Known identifiers
and words cost few bytes; keys and tokens do not compress. Candidates whose
marginal bytes per character reach the limit, or nearly those of random text of
their length and alphabet, are reported beside the patterns' matches, which are
always kept.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import string
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import sliced

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
#: Words that make a context sensitive, in any case.
SENSITIVE = re.compile(r"(?ai)(passw|passwd|pwd|secret|token|api.?key|credential|bearer|auth|private|signature|client.?id|access.?key)")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{20,}")
#: Characters before a candidate in which a sensitive word counts.
REACH = 64
#: Characters of the text before and after that prime the compressor.
AROUND = 512
#: Marginal bytes per character from which a candidate is incompressible.
LIMIT = 0.85
#: The part of the bytes of random text of one's length and alphabet from which a candidate is incompressible: long strings get less than a byte a character.
RANDOM_PART = 0.92
#: Alphabets of keys, small ones first.
ALPHABETS = tuple(map(frozenset, (string.digits + "ABCDEF", string.digits + "abcdef", string.ascii_uppercase + "234567", string.ascii_lowercase + "234567", string.digits + string.ascii_uppercase, string.digits + string.ascii_lowercase, string.digits + string.ascii_letters)))
#: What lies between the lines of one key: a line break, real or escaped, and quotes or signs that join strings.
JOINT = re.compile(r"""(?:["'+,\s]|\\[nrt])*(?:\n|\\n)(?:["'+,\s]|\\[nrt])*""")
#: The short last line of a key in PEM form.
LAST_LINE = re.compile(r"""(?:["'+,\s]|\\[nrt]){0,64}(?:\n|\\n)(?:["'+,\s]|\\[nrt]){0,64}([A-Za-z0-9+/]{1,19}={0,2})(?=(?:["'+,\s]|\\[nrt]){1,64}-----END)""")
#: Words, identifiers and code that need no bytes of their own.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 username user_name password passwd secret token api_key apikey "
    "access_token refresh_token client_secret client_id authorization bearer authentication configuration credentials private_key public_key "
    "signature localhost example.com www.example.org http:// https:// index.html default settings environment variable function return "
    "import from class self public static void string integer boolean true false null None undefined const export require module package "
    "request response session header content-type application/json text/html utf-8 charset version license copyright repository project "
    "description parameter argument exception error warning message database connection timeout retry interval threshold maximum minimum "
    "createdAt updatedAt timestamp identifier document collection controller service manager factory builder handler listener component "
    "placeholder changeme your_token_here your-api-key example_secret sample test testing production development staging release candidate"
)


class Novelty:
    """Marginal compressed bytes of a string, given identifiers and the text around it."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        self.identifiers = identifiers.encode()

    def size(self, primer: bytes, data: bytes) -> int:
        import zstandard

        primed = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made = zstandard.ZstdCompressor(level=6, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
        return len(made.compress(data))

    def per_char(self, before: str, text: str, after: str) -> float:
        """Bytes that ``text`` adds to a compressed neighbourhood, per character."""
        primer = self.identifiers + b" " + after.encode("utf-8", "replace") + b" " + before.encode("utf-8", "replace")
        return max(0, self.size(primer, text.encode()) - self.size(primer, b" ")) / len(text)

    @functools.lru_cache(4096)
    def random_size(self, alphabet: str, length: int) -> int:
        """Marginal bytes of random text."""
        text = "".join(random.Random(length).choices(alphabet, k=length))
        primer = self.identifiers + b" "
        return self.size(primer, text.encode()) - self.size(primer, b" ")

    def incompressible(self, before: str, text: str, after: str, limit: float = LIMIT) -> bool:
        """Whether ``text`` costs ``limit`` bytes a character, or nearly what random text of its length and alphabet does."""
        cost = self.per_char(before, text, after)
        if cost >= limit:
            return True
        used = set(text)
        alphabet = next((a for a in ALPHABETS if used <= a), ALPHABETS[-1] | used)
        part = limit / LIMIT * RANDOM_PART
        # No code takes random text below its entropy.
        if cost < part * math.log2(len(alphabet)) / 8:
            return False
        return cost * len(text) >= part * self.random_size("".join(sorted(alphabet)), len(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, in order."""
    low = text.lower()
    out = []
    if "passw" in low or "secret" in low or "token" in low or "key" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty, limit: float = LIMIT) -> list[tuple[int, int, int]]:
    """Incompressible candidates shortly after a sensitive word, or on the line after one of the same key, outside what is taken."""
    words = [m.end() for m in SENSITIVE.finditer(text)]
    out = []
    if not words:
        return out
    busy = sorted((s, e) for s, _, e in taken)
    starts, ends = [s for s, _ in busy], list(accumulate((e for _, e in busy), max))
    is_taken = lambda s, e: (i := bisect_left(starts, e)) > 0 and ends[i - 1] > s
    word, stop, joint = 0, -1, -1
    for m in CANDIDATE.finditer(text):
        first, e = m.span()
        if text.startswith("\\n", first - 1) and first:
            first += 1
        # The last sensitive word before the candidate reaches furthest; one inside it leaves its rest.
        while word < len(words) and words[word] <= first:
            stop = words[word] + REACH
            word += 1
        s = first
        follows = joint >= 0 and first - joint <= REACH and JOINT.fullmatch(text, joint, first)
        joint = -1
        if first > stop and not follows:
            if word == len(words):
                # Only the line after a key could still count, and this was not one.
                break
            if words[word] > e - 20:
                continue
            s = words[word]
        value = text[s:e]
        if is_taken(s, e):
            joint = e
            continue
        kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
        if kinds < 2 or not re.search("[0-9]", value):
            continue
        if novelty.incompressible(text[max(0, s - AROUND) : s], value, text[e : e + AROUND], limit):
            out.append((s, 3, e))
            joint = e
            last = LAST_LINE.match(text, e)
            if last and not is_taken(*last.span(1)):
                out.append((last.start(1), 3, last.end(1)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, *keep: str, text_column: str = "text", limit: float = LIMIT, redact: bool = False) -> DataFrame:
    """``keep`` columns, counts by kind, base and all spans; with ``redact`` also the text with each span masked.

    Null texts count as empty and have no spans. Spans are code points, end
    exclusive. Each row stands alone: repeated rows get equal results, extra
    columns are ignored, an empty table gives no rows.
    """

    def run(batches):
        novelty = Novelty()
        for batch in sliced(batches):
            counts, sums, spans, texts = [[], [], []], [], [], []
            for value in batch.column(batch.num_columns - 1):
                text = value.as_py() or ""
                base = base_spans(text)
                every = sorted(base + novel_spans(text, base, novelty, limit))
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                sums.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                if redact:
                    texts.append(value.as_py() if not every else masked(text, every))
            arrays = [*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(spans, pa.string())]
            names = [*keep, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            if redact:
                arrays, names = [*arrays, pa.array(texts, pa.string())], [*names, "redacted"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema += ", n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", redacted string" * redact
    return docs.select(*keep, F.col(text_column).cast("string").alias("_text")).mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str = "<SECRET>") -> str:
    """The text with each stretch that any span covers replaced once."""
    out, at = [], 0
    for start, end in sorted((s, e) for s, _, e in spans):
        if start >= at or not out:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """All rows and columns, every secret in ``text`` masked and ``n_chars`` (if there) that of the new text; texts without secrets, null ones too, stay as they are."""
    out = docs.withColumn("text", F.col("text").cast("string"))
    at = out.columns.index("text")

    def run(batches):
        novelty = Novelty()
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            for i, text in enumerate(texts):
                if text:
                    base = base_spans(text)
                    every = base + novel_spans(text, base, novelty, limit)
                    if every:
                        texts[i] = masked(text, every)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    found = out.mapInArrow(run, out.schema)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found
