"""Texts for the tests."""

import random


def word_texts(seed, n, size=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, size))) for _ in range(n)]
