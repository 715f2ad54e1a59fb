"""Paths of many reads at once, against those of each alone."""

import random

import numpy as np

from seqloom.operators import alignment


def test_paths_of_many_reads():
    rng = random.Random(6)
    pairs = []
    for _ in range(400):
        ref = "".join(rng.choice("ACGT" if rng.random() < 0.5 else "AC") for _ in range(rng.choice([1, 9, 30])))
        a = rng.randrange(len(ref))
        read = list(ref[a : a + rng.choice([1, 5, 25])])
        for _ in range(rng.randrange(3)):
            read.insert(rng.randrange(len(read) + 1), rng.choice("ACGTN"))
            if len(read) > 4:
                del read[rng.randrange(len(read) - 1)]
        pairs.append(("".join(read), ref))
    codes = lambda t: np.frombuffer(t.encode(), np.uint8)
    assert alignment.best_paths(pairs) == [alignment.best_path(codes(s), codes(w)) for s, w in pairs]
    assert alignment.best_paths([]) == []
