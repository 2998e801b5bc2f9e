import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wordloom.operators import splitting


def table(spark, labels, start=0):
    return spark.createDataFrame([(start + i, c) for i, c in enumerate(labels)], "doc_id bigint, label int")


def python_quotas(counts, val_size):
    n = sum(counts.values())
    train = n - math.ceil(val_size * n)
    base = {c: k * train // n for c, k in counts.items()}
    order = sorted(counts, key=lambda c: (-(counts[c] * train % n), c))
    for c in order[: train - sum(base.values())]:
        base[c] += 1
    return base


def python_split(rows, val_size, seed):
    groups = defaultdict(list)
    for doc, label in rows:
        groups[label].append(doc)
    quotas = python_quotas(Counter(label for _, label in rows), val_size)
    train = set()
    for label, docs in groups.items():
        docs.sort(key=lambda d: (hashlib.md5(f"{seed}|{d}".encode()).hexdigest(), d))
        train |= set(docs[: quotas[label]])
    return train


LABELS = [0] * 400 + [1] * 37 + [2] * 5 + [3] * 61


@pytest.mark.parametrize("val_size,seed", [(0.1, 42), (0.25, 7), (0.5, 42)])
def test_split_equals_python(spark, val_size, seed):
    df = table(spark, LABELS)
    got = splitting.stratified_split(df, val_size=val_size, seed=seed).collect()
    assert len(got) == len(LABELS)
    train = {r["doc_id"] for r in got if r["split"] == "train"}
    assert train == python_split(list(enumerate(LABELS)), val_size, seed)
    quotas = {r["label"]: (r["n_train"], r["n_val"]) for r in splitting.split_quotas(df, val_size=val_size).collect()}
    sizes = Counter((r["label"], r["split"]) for r in got)
    assert quotas == {c: (sizes[c, "train"], sizes[c, "val"]) for c in set(LABELS)}


def test_split_does_not_depend_on_partitions(spark):
    df = table(spark, LABELS)
    one = {tuple(r) for r in splitting.stratified_split(df.repartition(1)).collect()}
    many = {tuple(r) for r in splitting.stratified_split(df.repartition(11)).collect()}
    assert one == many


def test_split_moves_no_rows(spark):
    split = splitting.stratified_split(table(spark, LABELS))
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_quotas_of_huge_counts(spark):
    counts = spark.createDataFrame(
        [(0, "", 30_000_000_001), (1, "", 10_000_000_000)], "label int, bucket string, here bigint"
    )
    got = {r["label"]: r["n_train"] for r in splitting._with_quotas(counts, "label", 0.1).collect()}
    assert got == python_quotas({0: 30_000_000_001, 1: 10_000_000_000}, 0.1)


@pytest.mark.parametrize("labels,val_size", [([0] * 50 + [1], 0.1), ([0, 0, 1, 1, 2, 2], 0.1), ([0, 0, 1, 1, 2, 2], 0.9)])
def test_impossible_splits_are_errors(spark, labels, val_size):
    with pytest.raises(Exception, match="class"):
        splitting.stratified_split(table(spark, labels), val_size=val_size)


@pytest.mark.parametrize("size", [1, 7, 128])
def test_shuffled_batches(spark, size):
    df = table(spark, [0] * 300)
    rows = splitting.training_batches(df, batch_size=size, seed=3, epoch=2).collect()
    order = sorted(range(300), key=lambda d: (hashlib.md5(f"3|2|{d}".encode()).hexdigest(), d))
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: (r["batch_id"], r["slot"]))] == order
    sizes = Counter(r["batch_id"] for r in rows)
    assert sorted(sizes) == list(range(math.ceil(300 / size)))
    assert all(sizes[b] == size for b in sizes if b != max(sizes))


def test_epochs_shuffle_differently(spark):
    df = table(spark, [0] * 100)
    one, two = (
        {tuple(r) for r in splitting.training_batches(df, batch_size=10, epoch=e).collect()} for e in (1, 2)
    )
    assert one != two


def test_ordered_batches(spark):
    df = table(spark, [0] * 300, start=-100).repartition(7)
    rows = splitting.training_batches(df, batch_size=64, shuffle=False).collect()
    assert {r["doc_id"]: (r["batch_id"], r["slot"]) for r in rows} == {
        d: divmod(i, 64) for i, d in enumerate(range(-100, 200))
    }


def test_ordered_rank_descending(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(50)], "id bigint, v double")
    rows = splitting.ordered_rank(df, F.desc("v"), F.asc("id"), parts=4).collect()
    expected = sorted(range(50), key=lambda i: (-(i % 5), i))
    assert [r["id"] for r in sorted(rows, key=lambda r: r["rank"])] == expected
    assert sorted(r["rank"] for r in rows) == list(range(1, 51))


def test_missing_label_is_an_error(spark):
    rows = [(i, None if i % 5 == 0 else i % 3) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, label int")
    with pytest.raises(Exception, match="a label is missing"):
        splitting.split_quotas(df).collect()
    with pytest.raises(Exception, match="a label is missing"):
        splitting.stratified_split(df)


def test_the_most_classes(spark, monkeypatch):
    """One class more than allowed fails before any window is planned."""
    monkeypatch.setattr(splitting, "MAX_CLASSES", 50)

    def rows(n):
        return table(spark, [c for c in range(n) for _ in range(4)])

    assert splitting.split_quotas(rows(50), val_size=0.5).count() == 50
    assert splitting.stratified_split(rows(50), val_size=0.5).where("split = 'val'").count() == 100
    with pytest.raises(ValueError, match="too many classes"):
        splitting.split_quotas(rows(51), val_size=0.5)
    with pytest.raises(ValueError, match="too many classes"):
        splitting.stratified_split(rows(51), val_size=0.5)


def test_ten_thousand_classes(spark):
    many = spark.range(40_004).selectExpr("id as doc_id", "cast(id % 10001 as int) as label")
    with pytest.raises(ValueError, match="too many classes"):
        splitting.split_quotas(many, val_size=0.5)
    quotas = splitting.split_quotas(many.where("label < 10000"), val_size=0.5)
    assert quotas.agg(F.count("*"), F.sum("n_train")).first()[:] == (10_000, 20_000)


def test_all_labels_missing(spark):
    df = spark.createDataFrame([(i, None) for i in range(30)], "doc_id bigint, label int")
    with pytest.raises(Exception, match="a label is missing"):
        splitting.stratified_split(df)
