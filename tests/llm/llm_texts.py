"""Invented prose for the tests of this folder."""

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti", "vu", "we") for b in ("dan", "fel", "gor", "hin", "jas", "kep", "lum")]


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
