import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long, __row string, _salt string, rank string, component_id string, row string, spans string, base string, added string, g1 string, gone string, mark string, _g1 string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts (or ``(id, text)`` pairs), with extra columns whose names operators use inside."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        extra = {c.split()[0]: F.lit("x") for c in DOC.split(", ")[5:]}
        return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")} | extra)

    return make
