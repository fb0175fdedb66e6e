"""Small document tables with the cases every operator must define."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long, found string, ids string, kept string, lang_pred string"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


def docs(spark, texts):
    """Rows with clashing extra columns; texts may be (id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y", "z", "w") for i, t in rows], DOC)


EDGE = [None, "", "   ", "?!.", "a", "ÄÖ\n\tß", words(1, 20_000), "x" * 30_000]
