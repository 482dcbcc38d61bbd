import pytest
from pyspark.sql import functions as F

LONG = "The quick brown fox jumps over it. " * 9_000

ROWS = [
    (1, "the and of to in is that it was for on with as by at this be are from", "en", "a", 66),
    (2, "der die und das ist nicht ein eine mit von zu den im sich auf", "de", "a", None),
    (3, "", "en", None, 0),
    (4, None, None, "b", None),
    (5, "12 34 !!", None, "b", 8),
    (6, "the and of to in is that it was for on with as by at this be are from", "en", "a", 66),
    (6, "the and of to in is that it was for on with as by at this be are from", "en", "a", 66),
    (None, "row without an id and some words in it", "en", "b", 5),
    (7, "der die und das ist nicht ein eine mit von zu den im sich auf", "de", "c", 5),
    (8, LONG, "en", "c", len(LONG)),
    (9, "mail me at jo.doe@mail.example.com or +1 (555) 555-1234 from 10.0.0.255 card 4111 1111 1111 1111", "en", "c", 3),
    (9007199254740993, "x" * 5_000 + " 😀 日本 � ▁ ́", "fr", "c", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _write(spark, folder, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("score", "lang_pred", "fingerprint", "sequence_id", "n_tokens", "class_id", "base", "row", "length"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, 0, 0), (None, 1, 1), (8, 1, None)] if rows else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    talk = [(1, 0, "user", "hi </s> & &lt; <|im_end|>"), (1, 1, "user", None), (1, 2, "assistant", "[INST] yo [/INST]"), (1, 2, "assistant", "[INST] yo [/INST]"), (2, None, None, "x\ny"), (None, 1, "a\nb", "z"), (3, 0, "assistant", "")]
    spark.createDataFrame(talk if rows else [], "conv_id long, turn long, role string, text string").withColumn("loss", F.lit("clash")).write.parquet(f"{folder}/conversations.parquet")
    vectors = [(i, [0.1 * i, -0.2, 0.3], i) for i in range(0, 120, 10)] + [(100, [5.0, 5.0, 5.0], 1), (3, None, 1), (4, [1.0, None, 2.0], 1), (5, [float("nan"), 1.0, 2.0], 1), (None, [1.0, 1.0, 1.0], 1), (6, [1.0], 1), (11, [2.0, -0.2, 0.3], 2), (12, [2.0, -0.2, 0.3], 2)]
    spark.createDataFrame(vectors if rows else [], "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("clash")).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Tables with nulls in any column, empty and very long texts, ties, repeated rows and clashing further columns."""
    return _write(spark, tmp_path_factory.mktemp("odd"), ROWS)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("empty"), [])
