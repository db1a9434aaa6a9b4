"""Documents with what goes wrong: nulls, empty and long texts, repeated rows, ties, clashing names."""

LONG = "the quick brown fox jumps over the lazy dog and runs away. " * 400
TEXTS = [
    (1, "a plain text with some words in it, and a few more words to have enough of them for every rule"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, LONG), (7, "x" * 20_000), (None, "no id but a text that is long enough to be looked at by all rules"),
    (8, "one"), (8, "one"), (9, "Ünïcödé ÀÉ 漢字 🙂 ﬁne"), (10, LONG[3:]), (11, "<|endoftext|> in a text <|startoftext|>"), (12, "."),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, low long, digest string, host string, words string, component_id long, label int, uid long, path string"


def documents(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None if t is None else len(t), 1, "k", 2, "d", "h", "w", 3, None, 4, "p") for k, (i, t) in enumerate(rows)], SCHEMA)


def none(spark):
    return documents(spark).where("false")
