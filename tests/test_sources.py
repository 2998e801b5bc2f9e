import csv
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordloom.operators.documents import tokenize
from wordloom.operators.encoding import encode
from wordloom.operators.vocabulary import build_vocab
from wordloom.sources import batches, labelled, vectors
from wordloom.sources import runs as run_files
from wordloom.streaming.ingest import stream_labelled_csv

HEADER = ["Class Index", "Title", "Description", "Extra"]
ROWS = [
    ["1", 'He said "hi", twice', "line one\nline two", "x"],
    ["2", "NA", "None", ""],
    ["4.0", "", "plain", "y"],
    [" 3 ", "null", " padded ", ""],
]
EXPECTED = {
    (0, 'He said "hi", twice line one\nline two'),
    (1, " "),
    (3, " plain"),
    (2, "  padded "),
}


def write_csv(path, header=HEADER, rows=ROWS):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([header, *rows])
    return str(path)


def pairs(df):
    return {(r["label"], r["text"]) for r in df.collect()}


def test_csv_file_folder_and_glob(spark, tmp_path):
    path = write_csv(tmp_path / "set" / "train.csv")
    assert pairs(labelled.read_labelled_csv(spark, path)) == EXPECTED
    assert pairs(labelled.read_labelled_csv(spark, str(tmp_path / "set"))) == EXPECTED
    write_csv(tmp_path / "parts" / "a.csv", rows=ROWS[:2])
    write_csv(tmp_path / "parts" / "b.csv", rows=ROWS[2:])
    for parts in (str(tmp_path / "parts"), str(tmp_path / "parts" / "*.csv")):
        df = labelled.read_labelled_csv(spark, parts)
        assert pairs(df) == EXPECTED
        assert df.select("doc_id").distinct().count() == 4


def test_default_path(spark, tmp_path, monkeypatch):
    path = write_csv(tmp_path / "data" / "train.csv")
    monkeypatch.setattr(labelled, "DEFAULT_PATH", path)
    assert pairs(labelled.read_labelled_csv(spark)) == EXPECTED


def test_single_line_files_may_be_split(spark, tmp_path):
    path = write_csv(tmp_path / "train.csv", rows=ROWS[1:])
    got = pairs(labelled.read_labelled_csv(spark, path, multi_line=False))
    assert got == {e for e in EXPECTED if e[0] != 0}


def test_csv_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        labelled.read_labelled_csv(spark, str(tmp_path / "nothing.csv"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        labelled.read_labelled_csv(spark, str(tmp_path / "empty"))
    short = write_csv(tmp_path / "short.csv", header=HEADER[:2], rows=[["1", "a"]])
    with pytest.raises(ValueError):
        labelled.read_labelled_csv(spark, short)
    gap = write_csv(tmp_path / "gap.csv", rows=[["", "a", "b", "c"]])
    with pytest.raises(Exception, match="class index"):
        labelled.read_labelled_csv(spark, gap).collect()


def test_vectors_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.5])], "token string, vector array<float>")
    path = str(tmp_path / "vectors")
    vectors.write_vectors(df, path)
    assert {(r["token"], tuple(r["vector"])) for r in vectors.read_vectors(spark, path, 2).collect()} == {
        ("a", (1.0, 2.0)), ("b", (3.0, 4.5)),
    }
    with pytest.raises(ValueError):
        vectors.read_vectors(spark, path, 3)
    with pytest.raises(FileNotFoundError):
        vectors.read_vectors(spark, str(tmp_path / "none"), 2)


def test_ragged_vectors_are_an_error(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0])], "token string, vector array<float>")
    vectors.write_vectors(df.coalesce(1).orderBy("token"), str(tmp_path / "v"))
    with pytest.raises(Exception, match="width"):
        vectors.read_vectors(spark, str(tmp_path / "v"), 2).collect()


def test_histories_of_many_runs(spark, tmp_path):
    rows = [(f"run {i}/x", e, 1.0, 0.5, 0.4, 1.1, 0.5, 0.1 * e, None) for i in range(3) for e in (1, 2)]
    history = spark.createDataFrame(rows, "run_name string, " + run_files.HISTORY_SCHEMA)
    run_files.write_histories(history, str(tmp_path / "h"))
    back = run_files.read_history_table(spark, str(tmp_path / "h"))
    assert back.columns == history.columns
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, history.collect()), key=str)


def test_history_files_of_single_runs(spark, tmp_path):
    for name in ("one", "run + 2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "history.csv").write_text(
            ",".join(run_files.HISTORY_COLUMNS) + "\n1,0.5,0.5,0.5,0.5,0.5,NaN,0.001\n2,0.4,0.5,0.5,0.5,0.5,0.25,0.001\n"
        )
    got = run_files.read_histories(spark, str(tmp_path / "*" / "history.csv")).collect()
    assert Counter(r["run_name"] for r in got) == {"one": 2, "run + 2": 2}
    assert {str(r["val_macro_f1"]) for r in got} == {"nan", "0.25"}


def test_summary_round_trip(spark, tmp_path):
    row = ("r", "out/r", 0.5, 3, "out/r/history.csv", "out/r/best_model")
    run_files.write_summary(spark.createDataFrame([row], run_files.SUMMARY_SCHEMA), str(tmp_path / "s"))
    assert [tuple(r) for r in run_files.read_summary(spark, str(tmp_path / "s")).collect()] == [row]


@pytest.mark.parametrize("shuffle", [True, False])
def test_batch_files(spark, tmp_path, shuffle):
    docs = spark.createDataFrame([(i, ["a", "b"][: i % 3]) for i in range(100)], "doc_id bigint, tokens array<string>")
    encoded = encode(docs, build_vocab(docs), 4)
    batches.write_batches(encoded, str(tmp_path / "b"), batch_size=16, shuffle=shuffle, batches_per_shard=2)
    back = batches.read_batches(spark, str(tmp_path / "b"))
    assert back.count() == 100 and set(encoded.columns) <= set(back.columns)
    files = back.select("batch_id", F.input_file_name().alias("f")).distinct().groupBy("batch_id").count()
    assert files.where("count > 1").count() == 0  # no batch is torn over two files
    sizes = {r["batch_id"]: r["count"] for r in back.groupBy("batch_id").count().collect()}
    assert sizes == {**{b: 16 for b in range(6)}, 6: 4}


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    write_csv(folder / "a.csv", rows=ROWS[:2])
    write_csv(folder / "b.csv", rows=ROWS[2:])
    stream = stream_labelled_csv(spark, str(folder))
    query = (
        stream.writeStream.format("memory")
        .queryName("arrived")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    got = {(r["label"], tuple(r["tokens"])) for r in spark.sql("SELECT * FROM arrived").collect()}
    batch = tokenize(labelled.read_labelled_csv(spark, str(folder)))
    assert got == {(r["label"], tuple(r["tokens"])) for r in batch.collect()} and len(got) == 4


@pytest.mark.parametrize("multi_line", [True, False])
def test_ids_do_not_depend_on_splits(spark, tmp_path, multi_line):
    rows = [[str(i % 4 + 1), f"t{i}", "some text " * (i % 7), ""] for i in range(1200)]
    for n in range(6):
        write_csv(tmp_path / "parts" / f"{n}.csv", rows=rows[n * 200 : n * 200 + 200])
    found = []
    try:
        for size in ("128m", "4k", "30k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            raw = labelled.read_raw_csv(spark, str(tmp_path / "parts"), multi_line=multi_line)
            found.append({r["doc_id"]: r["Title"] for r in raw.collect()})
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == {i: f"t{i}" for i in range(1200)} and found[0] == found[1] == found[2]


def test_records_of_byte_ranges(spark, tmp_path):
    """Ranges of any size cut the same records as one task per file: newlines, doubled quotes and
    characters of several bytes at the borders, blank lines, records over several ranges."""
    rng = random.Random(8)
    words = ['a "quoted" word', "été", "line\nbreak", "\n\n", "comma, here", "日本語", '""', "x" * 40, " padded ", ""]
    for n in range(3):
        rows = [[str(i % 4 + 1), " ".join(rng.choices(words, k=3)), "\n".join(rng.choices(words, k=rng.randint(0, 9))), str(i)] for i in range(60)]
        rows[30][2] = "long é\n" * 400
        write_csv(tmp_path / "set" / f"{n}.csv", rows=rows)
    with open(tmp_path / "set" / "1.csv", "a", encoding="utf-8", newline="") as f:
        f.write('\r\n1,last,"no end of line"')
    path = str(tmp_path / "set")
    whole = {tuple(r) for r in labelled.read_raw_csv(spark, path, whole_files=True).collect()}
    assert len(whole) == 181
    try:
        for size in ("128m", "2k", "901"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "10")
            assert {tuple(r) for r in labelled.read_raw_csv(spark, path).collect()} == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_records_beyond_the_broadcast_budget(spark, tmp_path, budget):
    path = write_csv(tmp_path / "train.csv", rows=ROWS * 20)
    assert pairs(labelled.read_labelled_csv(spark, path)) == EXPECTED


def test_odd_quotes_are_an_error(spark, tmp_path):
    path = write_csv(tmp_path / "train.csv")
    with open(path, "a") as f:
        f.write('1,5" disk,text,x\n')
    with pytest.raises(ValueError, match="odd number of quotes"):
        labelled.read_raw_csv(spark, path)
