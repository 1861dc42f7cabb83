"""Invented prose for the fixtures."""

import random

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qi ro su ta ve wi xo yu".split()


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


def sentences(rng: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        words = prose(rng, rng.randint(4, 14))
        out.append(" ".join(words).capitalize() + ".")
    return " ".join(out)
