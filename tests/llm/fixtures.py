"""Small corpora with the awkward cases that every operator has to take."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, node long, score double, shard int, slot long, value string"


def documents(seed=0, n=60):
    """Prose with exact and near copies, shared passages, nulls, empty and long texts, and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = prose(30)
    texts = [prose(rng.randint(5, 120)) for _ in range(n)]
    for i in range(0, n, 7):
        texts[i] = prose(rng.randint(3, 20)) + " " + passage + ". " + prose(10)
    texts[5] = texts[3]
    words = texts[8].split()
    words[len(words) // 2] = "changed"
    texts[9] = " ".join(words)
    texts += [None, "", "   \n", "x", "a" * 400, "a" * 300, "ab" * 200, prose(4000), passage]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id at all " * 12), (None, None)]
    return rows, passage


def frame(spark, rows):
    """The rows with extra columns, some named like the operators' own."""
    full = [(i, t, "en", ["a", "b", None][k % 3], len(t or ""), 1, 2, 0.5, 3, 4, "v") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOC_SCHEMA)
