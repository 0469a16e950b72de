import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that the operators use inside.
CLASHING = ("ids", "bytes", "score", "predicted", "n_words", "spans", "items", "h", "t", "uid", "bands", "band", "rest", "key", "kept",
            "leader", "member", "role", "salt", "n", "n_docs", "comp", "ident", "n_tokens", "toxic", "class_id", "_n", "_s", "_i", "text_sha256")


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table; ``clash`` adds columns named as the operators' own."""
    def make(rows, clash=False):
        full = [(i, x, "en", "src0", None if x is None else len(x)) for i, x in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for name in CLASHING:
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df
    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, a long text, copies, ties, repeated rows."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "two words here and more of them"),
            (6, "two words here and more of them"), (7, long), (8, long), (None, "a null id has this text"), (None, None),
            (9, "ünï cödé 日本語 🙂 text"), (10, "x" * 50_000), (11, "a " * 5_000), (12, "A a A a " * 40)]
