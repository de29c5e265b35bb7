"""Added spans of the personal-data operator, against a plain version and on sentences that no tree has seen."""

import random
import re

import numpy as np

from lexmill.llm import pii


def probability(row):
    trees, a, b = pii.model()
    return 1 / (1 + np.exp(-(a * sum(pii.evaluate(t, row) for t in trees) + b)))


def test_held_out_sentences():
    x, y = pii.examples(1500, seed=79, folds=(3,))
    found = np.array([probability(row) for row in x]) >= pii.THRESHOLD
    assert found[y == 1].mean() > 0.95 and found[y == 0].mean() < 0.12


def test_check_digits_of_ibans():
    assert pii.plausible_python("iban", "GB82 WEST 1234 5698 7654 32") and not pii.plausible_python("iban", "GB82 WEST 1234 5698 7654 33")


def plain_spans(text):
    base = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(c if i % 2 == 0 else sum(divmod(2 * c, 10)) for i, c in enumerate(d)) % 10 == 0:
            base.append((m.start(), 2, m.end()))
    base += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    added = []
    for i, (kind, pattern) in enumerate(pii.WIDER.items(), len(pii.KINDS)):
        for m in re.finditer(pattern, text, re.ASCII):
            if any(b[0] < m.end() and m.start() < b[2] for b in base):
                continue
            if probability(pii.features_python(kind, m[0], text[max(0, m.start() - pii.CONTEXT) : m.start()], text[m.end() : m.end() + 2])) >= pii.THRESHOLD:
                added.append((m.start(), i, m.end()))
    apart, at = [], 0
    for s in sorted(added, key=lambda s: (s[0], -s[2], s[1])):
        if s[0] >= at:
            apart.append(s)
            at = s[2]
    return ",".join(f"{pii.ALL_KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + apart))


def test_added_spans_are_those_of_the_plain_version(spark):
    r = random.Random(6)
    sentences = [(s, k) for lists in (pii.PERSONAL, pii.IMPERSONAL) for k, group in lists.items() for s in group]
    texts = [None, "", "no data at all", "0" * 5000]
    for _ in range(500):
        parts = []
        for _ in range(r.randint(1, 6)):
            sentence, kind = r.choice(sentences)
            parts.append(sentence.replace("{}", pii.made_value(kind or r.choice(list(pii.WIDER)), r, r.random() < 0.7)))
        texts.append(r.choice((" ", "\n", "é", "𝄞 ")).join(parts) + r.choice(("", " a@b.cd", " 10.0.0.1")))
    rows = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "doc_id").collect()
    kinds = set()
    for row in rows:
        assert row.spans == plain_spans(texts[row.doc_id] or ""), texts[row.doc_id]
        kinds |= {s.split(":")[0] for s in row.spans.split(",") if s}
    assert kinds >= set(pii.WIDER)
