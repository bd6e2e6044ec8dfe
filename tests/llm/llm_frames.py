SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, _stay long, room int"


def docs_frame(spark, texts, first=0, langs=None):
    """Documents with extra columns whose names clash with columns of results."""
    rows = [(first + i, t, langs[i] if langs else "en", "s", None, 1.0, "x", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)
