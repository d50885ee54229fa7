"""Made-up prose."""

import random


def prose(seed, n_words, vocabulary=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n_words)]
    lines, at = [], 0
    while at < len(words):
        step = rng.randint(6, 14)
        lines.append(" ".join(words[at : at + step]).capitalize() + ".")
        at += step
    return "\n".join(lines)
