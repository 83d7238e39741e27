"""Small documents with every awkward case: nulls, empty and long texts, repeats and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, score double, kept boolean"


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "an", "re", "on", "ed", "ly", "is"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def documents(seed=1, n=60):
    rng = random.Random(seed)
    texts = [words(rng, rng.randint(1, 80)) for _ in range(n)]
    out = []
    for i, t in enumerate(texts):
        out.append((i, t))
    long_ = words(rng, 6000)
    base = words(rng, 60).split()
    for k in range(12):  # a chain of growing edits
        x = base[:]
        for j in range(k):
            x[(7 * j) % len(x)] = f"edit{j}"
        out.append((100 + k, " ".join(x)))
    out += [(200, None), (201, ""), (202, " \t\n"), (203, long_), (204, long_ + " "), (205, "one"), (206, "One"), (207, "two words"), (208, "\x0btwo  words\n")]
    out += [(None, "no identifier here at all"), (None, "no identifier here at all"), (209, texts[0]), (209, texts[0]), (210, texts[1].upper()), (3, texts[4])]
    out += [(211, "Licensed under the Apache License, Version 2.0. " + texts[2]), (212, "é ü ñ 日本 \U0001f600 <|im_end|>")]
    rng.shuffle(out)
    return [(i, t, None if k % 9 == 0 else "en", None if k % 7 == 0 else f"src{k % 3}", 0, 1, 0.5, True) for k, (i, t) in enumerate(out)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
