"""Small awkward tables shared by the tests of this folder."""

from __future__ import annotations

import random

AWKWARD = [None, "", " ", "a", "one two", "ONE\tTwo", "one two", "one  two", "É é ß  x", "x" * 5000, "the same words " * 400]


def rows(n: int = 60, seed: int = 3, words: int = 40) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): awkward texts first, then prose with exact and near copies."""
    rnd = random.Random(seed)
    vocab = ["w%d" % i for i in range(200)] + ["Été", "naïve", "STRASSE", "x1", "the", "of"]
    out = [(i, t, "en", "s0", len(t or "")) for i, t in enumerate(AWKWARD)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(5, words * 4))] for _ in range(8)]
    for i in range(len(AWKWARD), n):
        w = list(rnd.choice(base)) if rnd.random() < 0.7 else [rnd.choice(vocab) for _ in range(rnd.randint(1, words))]
        for _ in range(rnd.choice((0, 0, 1, 2, 8))):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        t = " ".join(w)
        out.append((i, t, rnd.choice(["en", "fr", None]), "s%d" % (i % 3), len(t)))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
