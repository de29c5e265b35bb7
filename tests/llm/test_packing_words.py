"""Words of letters are encoded by the model alone, and get the tokenizer's ids."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from lexmill.llm import packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_letters_take_no_whole_encoding():
    r, own = random.Random(3), packing.WordIds(TOKENIZER)
    letters = [chr(c) for c in range(256) if chr(c).isalpha()]
    plain = [c for c in letters if c.islower() and c not in "ªµº"]
    words = [c * n for c in letters for n in (1, 2, 5)] + ["".join(r.choices(plain, k=r.randint(1, 14))) + r.choice(["", "", ".", ",", "%%%"]) for _ in range(2000)]
    whole = Tokenizer.from_file(TOKENIZER)
    calls, encode = [], own.known.encode
    own.known.encode = lambda text: calls.append(text) or encode(text)
    for text in (" ".join(words), " ".join(w for w in words if not {"ÿ", "µ"} & set(w)).upper(), " ".join(words) + " ﬁ ΑΣ", "it's I'll they've 'Tis x1y2 ab-cd a.b " + " ".join(words[:9])):
        assert [int.from_bytes(x, "little") for x in zip(*[iter(own.ids([text])[0])] * 4)] == whole.encode(text, add_special_tokens=False).ids
    # Marks, once each, words of the odd texts and capitals beside words that are not of Latin-1.
    assert len(calls) < 250 and not [c for c in calls if c.isalpha() and c.islower() and c.isascii()]
