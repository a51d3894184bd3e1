"""Small hostile inputs, and plain versions of the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id long, norm string, words string, part long"


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, empty, null and long texts, repeated rows, a null id."""
    rng = random.Random(seed)
    vocab = [f"{rng.choice('abcdeéß')}{i:x}{rng.choice(['', ',', '.', '!'])}" for i in range(400)]
    words = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, texts = words(60), []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not texts:
            own = words(rng.randint(1, 160))
        elif kind == 1:
            own = [*rng.choice(texts)]
        elif kind == 2:
            own = [*rng.choice(texts)]
            for _ in range(max(1, len(own) // 40)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
        elif kind == 3:
            own = words(40) + passage + words(30)
        elif kind == 4:
            own = [w.upper() for w in rng.choice(texts)]
        else:
            own = words(3) * rng.randint(1, 50)
        texts.append(own or ["x"])
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(t)) for i, t in enumerate(texts)]
    return [*rows, (900, ""), (901, None), (902, "  \n"), (None, "no id at all"), (903, " ".join(words(20000))), rows[0], rows[0], (904, "one"), (905, "ONE"), (906, "one two three")]


def frame(spark, rows):
    """documents with columns whose names clash with those that the operators use inside."""
    full = [(i, t, "en", "src0", len(t or ""), 1, "x", "y", 2) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def tokens(text):
    return WORD.findall(text or "")
