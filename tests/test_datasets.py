"""Splits and exports of memberships."""

from veracal.operators import datasets


def test_long_ids_are_ordered(spark):
    ids = ["a" * 25 + str(i) for i in range(50)]
    df = spark.createDataFrame([(x, 0) for x in reversed(ids)], "id string, label int")
    got = datasets.split(df, 7).orderBy("pool_index").collect()
    assert [r["id"] for r in got] == sorted(ids, key=lambda x: (len(x), x)) and [r["pool_index"] for r in got] == list(range(50))


def test_export_keeps_members_columns(spark):
    sources = spark.createDataFrame([("x", 1, "one", 9), ("y", 0, "two", 8)], "id string, label int, document string, pool_index long")
    members = spark.createDataFrame([("y", 0, 5, "training", 0), ("x", 1, 6, "training", 1)], "id string, label int, pool_index long, selected_split string, selected_index long")
    got = datasets.export(sources, members, "training").collect()
    assert [(r["id"], r["label"], r["document"], r["pool_index"]) for r in got] == [("y", 0, "two", 5), ("x", 1, "one", 6)]
