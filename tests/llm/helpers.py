import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, cid string"


def odd_texts():
    """Nulls, empty and very long texts, repeated rows, ties, odd characters."""
    r = random.Random(7)
    long = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(30_000))
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "Hello World"), (5, base), (6, base), (6, base), (7, base.upper() + " end"), (8, long), (9, "x" * 20_000),
        (10, "été ça ñandú Straße ΑΣ 中文 🙂 İ   a\x1cb"), (11, "<|endoftext|> it's 3.14 !!"), (None, base), (None, "alone here"), (12, base + " more"), (13, "one two three"),
        (14, "9" * 3000), (15, "a\tb\x0bc\x0cd\re"),
    ]


def docs(spark, rows=None):
    """A documents table whose further columns have names that operators use themselves."""
    rows = odd_texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, 1, "x") for i, t in rows], SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
