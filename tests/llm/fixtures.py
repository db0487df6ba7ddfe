"""Small rows with every awkward case: nulls, ties, repeated rows, extra columns, empty and long texts."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long, score string, node string, key string"
WORDS = "red green blue cyan lime teal navy plum rust sand gold jade onyx opal ruby pearl".split()


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    texts = [None, "", " \n\t ", "one", "one two", "Äpfel ÄPFEL äpfel", "A b  c\n\nd", "x" * 5000]
    base = [" ".join(rng.choices(WORDS, k=rng.randint(30, 90))) for _ in range(n)]
    texts += base + base[:9] + [t.upper() for t in base[:4]]
    for t in base[:20]:  # near copies
        words = t.split()
        words[rng.randrange(len(words))] = "swapped"
        texts.append(" ".join(words))
    texts.append(" ".join(rng.choices(WORDS, k=30_000)))
    out = [(k, t, "en", "s", len(t or ""), "clash", "clash", "clash") for k, t in enumerate(texts)]
    return out + [out[12], out[12], (None, base[0], None, None, None, None, None, None), (None, base[0], None, None, None, None, None, None)]


#: Names that operators might use for columns of their own.
CLASHES = "wanted kept_id kept_node again_id __node __id __digest __gone __spans id digest h n size comp component row __score lang_pred removed".split()


def docs(spark, given=None):
    df = spark.createDataFrame(rows() if given is None else given, DDL)
    return df.selectExpr("*", *(f"concat('{c}', doc_id) AS `{c}`" for c in CLASHES))


def intact(df):
    """Whether every clashing column still holds its own value."""
    return all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in df.collect() for c in CLASHES)
