import random

import pytest

from llm_frames import SCHEMA, docs_frame


@pytest.fixture(scope="session")
def odd_texts():
    rng = random.Random(5)
    alphabet = "ab '\n \té½Σİ,.1漢́\x01<|>sS’@+-()0"
    out = [None, "", " ", "  ", "a", "a b", "a  b \n\n c ", "\x01 x \x01  y", "don't we'LL", "日本 語  テ", "x\x00y z"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    out += ["long text with words and password = hunter2hunter " * 4000, "1" * 20000, "é" * 5000, "same text here"] + ["same text here"] * 3
    return out


@pytest.fixture()
def odd_docs(spark, odd_texts):
    return docs_frame(spark, odd_texts).union(spark.createDataFrame([(None, "null id 4111111111111111", None, None, None, None, None, None, None)], SCHEMA))


@pytest.fixture()
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
