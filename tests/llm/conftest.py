"""Documents with nulls, ties, copies, repeats, odd white space and long texts."""

from __future__ import annotations

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.5 else "") for _ in range(n))


def edited(rng: random.Random, text: str, n: int) -> str:
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "changed" + str(rng.randrange(1000))
    return " ".join(words)


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars)"""
    rng = random.Random(4)
    texts: list[str | None] = [None, "", " \t\n", "one", "ONE", "two words", "Two Words", "a b c d", "a b c d", "a b c d e", "A B C D E", "... !!! ..."]
    for _ in range(40):
        texts.append(prose(rng, rng.randrange(5, 120)))
    base = prose(rng, 60)
    texts += [base, base, base.upper(), base + " "]
    texts += [edited(rng, base, k % 6 + 1) for k in range(25)]
    short = prose(rng, 8)
    texts += [short, short + " more", "less " + short, edited(rng, short, 1)]
    passage = prose(rng, 70)
    texts += [prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 20) for _ in range(3)]
    texts += [prose(rng, 9000), "é" * 5000, "x" * 40_000, "日本語 の テキスト です ね", "naïve Ünïcode İstanbul ſtrange Kelvin K"]
    return [(i, t, ("en", "fr", None)[i % 3], ("hot", "hot", "s1", None)[i % 4], len(t or "")) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
