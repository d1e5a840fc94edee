"""Adverse texts of a million characters take seconds."""

import random
import time

import pytest
from test_llm import docs  # noqa: F401

from quillspark.llm import bpe, licenses, pii, token_counts


def _joined(text):
    return f" {' '.join(w for w in licenses.words_of(text) if w)} "


def test_token_counts_of_blanks(spark):
    texts = [" " * 2_000_000, "\n" * 1_000_000, " \n" * 500_000, "a" * 1_000_000, "a b" * 5, "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = bpe.MonoidBpe.from_file(*bpe.public_ranks())
    began = time.time()
    found = sorted(r["n_tokens"] for r in token_counts.lengths(frame, *bpe.public_ranks()).collect())
    assert found == sorted(len(model.encode(t)) for t in texts) and time.time() - began < 60


@pytest.mark.parametrize("text", ["ab12." * 200_000, "x" * 1_000_000, "a@" * 500_000, "0123456789" * 100_000, "f0" * 500_000, "a.b@" + "c" * 1_000_000, "a1 " * 300_000])
def test_pii_takes_time_in_proportion(text):
    began = time.time()
    pii.replaced(text)
    assert time.time() - began < 5


@pytest.mark.parametrize("text", [f"password={'aB3x' * 2_000} end", f"{'q.w-E7' * 1_000}@mail.example"])
def test_pii_long_values(text):
    new, spans = pii.replaced(text)
    assert len(spans) == 1 and new != text and len(new) == len(text)
    assert pii.restored(new, spans) == text
    assert pii.replaced(text)[0] == new


def test_mail_behind_other_values():
    """A mail address that another one's end or a number cuts is still found."""
    assert [k for k, _, _ in pii.replaced("a.b@c.de%x.y@c.de")[1]] == ["email", "email"]
    assert [k for k, _, _ in pii.replaced("4111 1111 1111 1111@q.w@e.com")[1]] == ["card", "email"]
    assert [k for k, _, _ in pii.replaced("(555) 123-4567foo@bar.com")[1]] == ["phone", "email"]


@pytest.mark.parametrize("unit", ["licensed under the mit license ", "licensed undr the mit license ", "under the ", "the mit license of the gnu general "])
def test_licenses_of_dense_texts(unit):
    scanner, words = licenses.Scanner(), _joined(unit * (1_000_000 // len(unit)))
    began = time.time()
    found = scanner.fuzzy(words)
    scanner.places(words)
    assert time.time() - began < 5
    assert len(found) == (1_000_000 // len(unit) if unit.startswith("licensed") else 0)


def test_near_equals_least_edits():
    chance = random.Random(4)
    for _ in range(300):
        notice = "".join(chance.choices("abc ", k=chance.randrange(3, 12)))
        text, errors = "".join(chance.choices("abc ", k=chance.randrange(0, 30))), chance.randrange(0, 3)
        column = list(range(len(notice) + 1))
        least = column[-1]
        for c in text:
            new = [0]
            for i, x in enumerate(notice):
                new.append(min(column[i] + (x != c), column[i + 1] + 1, new[i] + 1))
            column, least = new, min(least, new[-1])
        if errors < len(notice) and text:
            assert licenses.Near(notice, errors)(text) == (least <= errors)
