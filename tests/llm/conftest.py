import pytest

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
}


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables of given rows and returns their folder; further columns clash with names that operators use inside."""

    def write(extra=False, **tables):
        for name, rows in tables.items():
            df = spark.createDataFrame(rows, SCHEMAS[name])
            if extra:
                from pyspark.sql import functions as F

                df = df.withColumns({c: F.lit("x") for c in ("row", "words", "key", "rep", "score", "blob", "kept", "piece", "host", "role_", "record", "n_words", "fold")})
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


@pytest.fixture
def docs(folder):
    return lambda texts, extra=False, lang="en": folder(extra, documents=[(i, t, lang, "s", None if t is None else len(t)) for i, t in texts])
