import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("block", T.StringType()), T.StructField("n", T.IntegerType())])
VOCABULARY = "the of and to house river stone, cloud. Tree 12 km Anna über éclair naïve 漢字 #tag x".split()


def rows(n=60, seed=3):
    """Texts with copies, near copies, shared lines and passages, and every odd case."""
    pick = random.Random(seed)
    words = lambda k: " ".join(pick.choice(VOCABULARY) for _ in range(k))
    shared_line = "This line of boilerplate is shared by many of the documents here."
    passage = " ".join(f"passage{i}" for i in range(30))
    texts = []
    for i in range(n):
        text = "\n".join(f"{words(pick.randint(1, 12))} w{i}x{j}" for j in range(pick.randint(1, 8)))
        if i % 4 == 0:
            text += f"\n  {shared_line.upper() if i % 8 else shared_line}\t\n" + words(3)
        if i % 5 == 0:
            text += f" {passage} " + words(2)
        texts.append(text)
    texts[7] = texts[3]
    texts[11] = texts[3] + " end"
    texts[20] = texts[21] = texts[22] = " ".join(f"copy{j}" for j in range(100))
    texts[23] = texts[20].replace("copy50", "other")
    data = [(i, t, f"host{i % 3}" if i % 7 else None, "clash", i) for i, t in enumerate(texts)]
    data += [
        (1000, None, "host0", "clash", 0),
        (1001, "", "host0", "clash", 0),
        (1002, " \t\n \x0b ", "host0", "clash", 0),
        (1003, "word " * 9000, "host1", "clash", 0),
        (1004, "once", "host1", "clash", 0),
        (1004, "once", "host1", "clash", 0),
        (None, passage + " without id", "host1", "clash", 0),
        (1005, f"{shared_line}\n{shared_line}\n{passage}", "host1", None, None),
    ]
    return data


@pytest.fixture(scope="session")
def data():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.createDataFrame(data, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
