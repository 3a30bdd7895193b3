import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                     StructField("source", StringType()), StructField("n_chars", LongType())])
LABELS = StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()), StructField("toxic", IntegerType())])

EN = "the shore and river were calm that morning when people walked along with their dogs"
DE = "der Fluss und das Ufer waren ruhig als die Leute früh mit ihren Hunden spazierten"


def odd_texts():
    """Null, empty, blank, very long, repeated and plain texts."""
    return [None, "", " \n\t ", EN, EN, DE, "x" * 50_000, (EN + ". ") * 3000, "É\x85 \x1c<|endoftext|> ﬁ 中文 😀", "a  b\n\n c \n"]


@pytest.fixture
def odd_docs(spark):
    rows = [(i, t, "de" if t == DE else "en", f"s{i % 2}", 0) for i, t in enumerate(odd_texts())]
    rows += [(3, EN, "en", None, 0), (None, EN, None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(10)] + [(3, None, None), (None, 1, 1), (77, 0, 0)]
    return spark.createDataFrame(rows, LABELS)


def wide(docs):
    """The rows with further columns whose names clash with results and helpers."""
    from pyspark.sql import functions as F
    return docs.select("*", *[F.lit(1).alias(c) for c in ("score", "key", "label", "ids", "part", "fp", "row", "lang_pred", "kept", "n_words", "component", "_key", "_words", "rank", "id", "v")])
