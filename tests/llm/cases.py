"""Small tables that every operator must stand: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp string, start long, node long"


def odd_documents(seed: int = 3):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "Eau", "ßtre", "x", "tion,", "ÉTÉ", "and.", "thore", "ingen", "日本", "ou"] + [f"w{i}" for i in range(40)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(70))
    long = " ".join(rnd.choice(vocabulary) for _ in range(9000))
    texts = [None, "", " ", "one", "one two", "a b c", "A\tB  C\n", "a b c", passage, passage, passage.replace(" ", "  "), long, long[:30000] + " changed " + long[30010:], "o " * 300, "aaaa" * 200, "aaaa" * 90]
    for _ in range(60):
        parts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60)))]
        if rnd.random() < 0.5:
            at = rnd.randint(0, 200)
            parts.append(passage[at : at + rnd.randint(0, 260)])
        if rnd.random() < 0.2:
            parts.append(rnd.choice([t for t in texts if t]))
        rnd.shuffle(parts)
        texts.append(rnd.choice([" ", "\n", ""]).join(parts))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[9], rows[20], (None, passage + " more"), (1000, texts[30])]
    rnd.shuffle(rows)
    return [(i, t, rnd.choice(["en", None]), rnd.choice(["s0", "s0", "s1", None]), None, None, "clash", None, 1) for i, t in rows]


def frame(spark, rows=None, parts: int = 3):
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA).repartition(parts)
