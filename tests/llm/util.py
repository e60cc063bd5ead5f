"""Fixtures that several tests share."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, base long, n long"


def docs(spark, rows):
    """Documents (doc_id, text[, lang]) with columns whose names the operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or ""), 0.5, "k", 7, 8) for r in rows]
    return spark.createDataFrame(full, DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}
