import random
import re

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.operators import documents
from wordloom.settings import LABEL_NAMES, NA_STRINGS, TOKEN_PATTERN

# Python's own \d is what \p{Nd} is in Java
PYTHON_TOKEN = re.compile(TOKEN_PATTERN.replace(r"\p{Nd}", r"\d"))

EDGES = {
    "Don't stop 3.14 rock'n'roll 1.2.3": ["don't", "stop", "3.14", "rock'n", "roll", "1.2", "3"],
    "<pad> <unk>": ["pad", "unk"],
    "ABC-12,000.50 x": ["abc", "12", "000.50", "x"],
    "": [],
    " \n\t": [],
    "café": ["caf"],
    "٣٤.٥ x": ["٣٤.٥", "x"],
}


def token_lists(spark, texts, lower=True):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = documents.tokenize(df, lower=lower).orderBy("doc_id").collect()
    return [r["tokens"] for r in rows]


def test_token_edges(spark):
    assert token_lists(spark, list(EDGES)) == list(EDGES.values())


@pytest.mark.parametrize("lower", [True, False])
def test_tokens_equal_python_findall(spark, lower):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB'.,1 2é-\nZ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    expected = [PYTHON_TOKEN.findall(t.lower() if lower else t) for t in texts]
    assert token_lists(spark, texts, lower) == expected


def test_documents_equal_python_findall(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in documents.tokenize(docs).collect():
        assert r["tokens"] == PYTHON_TOKEN.findall(texts[r["doc_id"]].lower())


def test_missing_spellings(spark):
    values = NA_STRINGS + ["na", "none", " NA", "0"]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string")
    got = [r[0] for r in documents.decode_missing(df, ["v"]).collect()]
    assert got == [None] * len(NA_STRINGS) + ["na", "none", " NA", "0", None]


def test_labels_and_text(spark):
    raw = spark.createDataFrame(
        [(0, "1", "a", "b"), (1, "4.0", None, "b"), (2, " 2 ", "a", None), (3, "3", "NA", "None")],
        "doc_id bigint, `Class Index` string, Title string, Description string",
    )
    got = [(r["label"], r["text"]) for r in documents.derive_documents(raw).orderBy("doc_id").collect()]
    assert got == [(0, "a b"), (3, " b"), (1, "a "), (2, " ")]


@pytest.mark.parametrize("bad", [None, "NA", "x"])
def test_bad_class_index_is_an_error(spark, bad):
    raw = spark.createDataFrame([(0, bad, "a", "b")], "doc_id bigint, `Class Index` string, Title string, Description string")
    with pytest.raises(Exception):
        documents.derive_documents(raw).collect()


def test_missing_column_is_an_error(spark):
    raw = spark.createDataFrame([(0, "1", "a")], "doc_id bigint, `Class Index` string, Title string")
    with pytest.raises(ValueError, match="Description"):
        documents.derive_documents(raw)


def test_label_names(spark):
    df = spark.createDataFrame([(0,), (3,), (4,), (-1,)], "label int")
    got = [r["label_name"] for r in documents.label_names(df).collect()]
    assert got == [LABEL_NAMES[0], LABEL_NAMES[3], None, None]


def test_tokenizer_runs_once_in_the_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    long = documents.token_positions(documents.tokenize(docs))
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_real_positions(spark):
    df = spark.createDataFrame([([2, 1, 0, 0],)], "ids array<int>")
    assert df.select(tx.real_positions(F.col("ids"))).head()[0] == [True, True, False, False]
