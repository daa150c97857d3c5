"""Small tables for the tests of the llm operators."""

import random

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, score string, keep_id string, "
          "part string, digest string, component_id string, `print` string, spans string, size string")


def docs_table(spark, rows):
    """From (doc_id, text, lang, source); the other columns clash with names operators use."""
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * 8) for r in rows], SCHEMA)


def words(draw, n, vocabulary=400):
    return " ".join(f"w{draw.randrange(vocabulary)}x" for _ in range(n))


def messy_rows():
    draw = random.Random(3)
    base = [words(draw, n) for n in (60, 80, 120, 40, 25)]
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "", "en", None), (4, " \t\n", "de", "b")]
    rows += [(10 + i, t, "en", "a") for i, t in enumerate(base)]
    rows += [(20, base[0], "en", "b"), (21, base[0], "en", "b"), (21, base[0], "en", "b")]  # ties, a repeated row
    rows += [(30, base[1].replace("w1", "W1"), "fr", "c"), (31, base[2] + " tail", "fr", "c")]
    rows += [(None, base[3], "en", "a"), (None, "alone w5x", None, "a"), (40, "ÄÖ ßé 日本語 🙂 " + base[4], "de", "d")]
    rows += [(50, words(draw, 30_000, 5_000), "en", "a"), (51, "same " * 3_000, "en", "a"), (52, "a", "en", "d")]
    rows += [(60 + i, base[2] + f" n{i}", "en", "hot") for i in range(30)]
    return rows
