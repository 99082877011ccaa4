"""Generated texts for tests."""

import random


def near_copies(seed=5, groups=6, size=7):
    """Texts in groups of near copies with chains, shared passages, and texts of their own."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(55)]
    texts = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([12, 60, 200]))] + (passage if g % 2 else [])
        for _ in range(size):
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
    texts += [" ".join([rng.choice(words) for _ in range(80)] + passage) for _ in range(25)]
    texts += [" ".join(passage + [rng.choice(words) for _ in range(6)]) for _ in range(25)]
    rng.shuffle(texts)
    return texts
