"""Odd rows that every operator must take: nulls, empty and long texts, repeated rows, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h long, size long, n int, score double, label int, rank int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def rows(*texts, start=1):
    """(doc_id, text) pairs, or texts numbered from start, as full rows."""
    out = []
    for i, t in enumerate(texts, start):
        doc_id, text = t if isinstance(t, tuple) else (i, t)
        out.append((doc_id, text, "en", f"s{(doc_id or 0) % 3}" if doc_id != 2 else None, len(text or ""), "k", 7, 9, 3, 0.5, 1, 4))
    return out


def frame(spark, found):
    return spark.createDataFrame(found, SCHEMA)


def odd(spark):
    long_text = " ".join(f"{WORDS[i % 20]}{i % 97}" for i in range(60_000)) + "\n" + "x" * 50_000
    texts = ["One line\nof two", None, "", " \t\n ", (5, "same Text"), (5, "same Text"), (6, "SAME text"), (None, "no id here"), (None, None), (9, long_text), (10, long_text.upper()), (11, "ünï ÇÖDE 日本語 \x00 ▁")]
    return frame(spark, rows(*texts))


def empty(spark):
    return frame(spark, [])
