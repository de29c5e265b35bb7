"""Long keys, keys of small alphabets and keys over several lines are found whole."""

import random
import string

import pytest

from lexmill.llm import secrets

HEX, BASE32, BASE64 = "0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "+/"


@pytest.mark.parametrize("alphabet, length", [(HEX, 64), (HEX, 128), (BASE32, 128), (BASE64, 500), (BASE64, 4096), (BASE64, 12000)])
def test_long_keys(alphabet, length):
    novelty = secrets.Novelty()
    for seed in range(10):
        key = "".join(random.Random(seed).choices(alphabet, k=length))
        text = f"we call it with the bearer {key} and read the reply"
        assert secrets.novel_spans(text, [], novelty) == [(27, 3, 27 + length)]


def test_identifiers_stay():
    novelty = secrets.Novelty()
    for plain in (
        "client_credentials_grant_type_v2_example_configuration_production_environment_default_settings",
        "my-service-production-eu-west-1.example.com/api/v2/users/authentication/session/timeout/threshold",
        "abc123" * 40,
        "0" * 50 + "A" * 50 + "1" * 50,
    ):
        assert secrets.novel_spans(f"the bearer {plain} is here", [], novelty) == []


@pytest.mark.parametrize("joint", ["\n", '\\n', '" +\n    "'])
def test_every_line_of_a_key(joint):
    lines = ["".join(random.Random(i).choices(BASE64, k=64)) for i in range(25)] + ["q8Zt/w=="]
    text = "-----BEGIN PRIVATE KEY-----" + joint + joint.join(lines) + joint + "-----END PRIVATE KEY----- and\nmore"
    found = secrets.novel_spans(text, [], secrets.Novelty())
    shown = [text[s:e] for s, _, e in found]
    assert shown == lines


def test_context_ends_with_the_key():
    key = "".join(random.Random(1).choices(BASE64, k=64))
    text = "bearer " + key + " " + "word " * 20 + key[::-1]
    assert secrets.novel_spans(text, [], secrets.Novelty()) == [(7, 3, 71)]
