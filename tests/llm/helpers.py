"""Small tables with all the awkward rows an operator must take."""

LONG = "the quick brown fox jumps over the lazy dog and runs away from it all " * 3000
TEXTS = ["A plain sentence of several words, and then some more of them.", "A plain sentence of several words, and then some more of them.", "", None, "   \n\t ", "!!! ??? ...", "x", "Ünïcödé wörds — ñandú ça été 日本語 \U0001f600 end", LONG, "tab\tand\r\nlines\n\n\nhere", "\x00\x01 control \x7f"]


def awkward(spark, texts=TEXTS):
    """Documents with nulls in every column, repeated rows, and columns whose names clash."""
    rows = [(i, t, "en", "host", len(t) if t is not None else None, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], None, None, None, None, None), (50, texts[0], None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep string, grams int")
    return df.toDF("doc_id", "text", "lang", "source", "n_chars", "TEXT", "Doc_Id")


def empty(spark):
    return awkward(spark).limit(0)
