"""Values beside other groups, and dates as they are written."""

import random
import re

import pytest

from hinflow.llm import pii

CASES = [
    ("card", "4111 1111 1111 1111", "pay {} 12/27 now"), ("card", "4111111111111111", "{} 123"), ("card", "5500-0000-0000-0004", "{}-99 x"),
    ("iban", "DE89 3704 0044 0532 0130 00", "{} BIC X"), ("iban", "DE89370400440532013000", "{} RECHNUNG"),
    ("date", "2024-05-01", "{}T12:00:00Z"), ("date", "3/7/2021", "on {}."), ("date", "12/31/1999", "{}T"[:2] + " at"), ("date", "2021-3-07", "{},"),
]


@pytest.mark.parametrize("kind,value,text", CASES)
def test_value_is_hidden_and_comes_back(kind, value, text):
    whole, same = text.format(value), 0
    for k in range(40):
        key = b"key%d" % k
        hidden, spans = pii.pseudonymise(whole, key)
        at = whole.index(value)
        assert spans == [(kind, at, at + len(value))]
        same += value in hidden
        assert re.sub("[0-9]", "0", hidden) == re.sub("[0-9]", "0", whole)
        assert pii.pseudonymise(hidden, key, back=True)[0] == whole
    assert same <= 1  # a permutation may have a fixed point under some key


def test_card_after_another_group():
    hidden, spans = pii.pseudonymise("item 12345 4111 1111 1111 1111.", b"key")
    assert spans == [("card", 11, 30)] and hidden.startswith("item 12345 ")


def test_longer_cards_still_come_back():
    rng = random.Random(4)
    for _ in range(200):
        body = "4" + "".join(rng.choice("0123456789") for _ in range(17))
        digits = body + pii.luhn_digit(body)
        text = " ".join((digits[:4], digits[4:8], digits[8:12], digits[12:16], digits[16:]))
        hidden, spans = pii.pseudonymise(text, b"key")
        assert len(spans) == 1 and pii.pseudonymise(hidden, b"key", back=True)[0] == text
