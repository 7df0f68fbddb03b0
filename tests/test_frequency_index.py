"""Indexes by joins against Spark's own indexer, with hot and unseen values; plans without a dictionary."""

import pytest

from packetloom.operators import encode, ids
from packetloom.operators.frequency_index import IndexedModel, fit_frequency_index, global_ranks
from packetloom.operators.lookup import lookup
from packetloom.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def rows(spark):
    values = ["hot"] * 400 + [f"v{i % 37}" for i in range(300)] + ["é", "É", "", " "] * 3
    return spark.createDataFrame([(i, v, f"d{i % 5}", float(i % 7), int(i % 3 == 0)) for i, v in enumerate(values)], "id int, a string, b string, x double, y int").repartition(6).persist()


def test_equals_the_indexer(rows):
    own = fit_frequency_index(rows, ["a", "b"]).transform(rows)
    other = encode.string_index(["a", "b"]).fit(rows).transform(rows)
    assert own.columns == other.columns
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, other.collect()))


def test_unseen_and_null(spark, rows):
    index = fit_frequency_index(rows, ["b"], "keep")
    more = spark.createDataFrame([(1, "d0"), (2, "new"), (3, None)], "id int, b string")
    assert {r["id"]: r["b_index"] for r in index.transform(more).collect()} == {1: 0.0, 2: 5.0, 3: 5.0}
    index.handle_invalid = "skip"
    assert [r["id"] for r in index.transform(more).collect()] == [1]
    index.handle_invalid = "error"
    with pytest.raises(Exception, match="unseen value in b"):
        index.transform(more).collect()
    with pytest.raises(ValueError):
        fit_frequency_index(rows, ["b"], "guess")


def test_saved_model_scores_the_same(spark, rows, tmp_path):
    rows = rows.where("a <> ''")  # Spark's own indexer refuses an empty category
    model = ids.fit_ids(rows, "y", ["a"], ["x"], "keep", "table", regParam=0.01)
    save_model(model, str(tmp_path / "m"), spark)
    again = load_model(str(tmp_path / "m"), IndexedModel, spark)
    one, two = (ids.probability_of_one(ids.score(m, rows)).orderBy("id").select("id", "score").collect() for m in (model, again))
    assert one == two
    index = ids.probability_of_one(ids.score(ids.fit_ids(rows, "y", ["a"], ["x"], "keep", "index", regParam=0.01), rows))
    assert [r["score"] for r in one] == pytest.approx([r["score"] for r in index.orderBy("id").collect()], abs=1e-4)


def test_global_ranks(spark):
    df = spark.range(0, 5000).selectExpr("id * 7919 % 5000 as v").repartition(7)
    assert sorted((r["v"], r["rank"]) for r in global_ranks(df, ["v"]).collect()) == [(i, i) for i in range(5000)]
    assert global_ranks(df.limit(0), ["v"]).collect() == []


def test_lookup_keeps_rows_and_spreads_hot_keys(spark, rows):
    table = rows.groupBy("a").count().withColumnRenamed("a", "k").selectExpr("k as a", "count as n", "concat(k, '!') as w")
    null = rows.unionByName(spark.createDataFrame([(9000, None, "d", 0.0, 0)], rows.schema))
    got = lookup(null, "a", table.where("a <> 'v3'"), "n", 713, ["w"]).collect()
    assert len(got) == null.count()
    assert all(r["w"] == (None if r["a"] in (None, "v3") else r["a"] + "!") for r in got)


@pytest.mark.parametrize("invalid", ["keep", "error"])
def test_vectors_name_no_slot(spark, rows, invalid):
    """The same vectors as one-hot encoding and assembling give, null and unseen values too, without a name for each address."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder

    from packetloom.operators.encode import assemble

    rows = rows.where("a <> ''")
    train = rows.unionByName(spark.createDataFrame([(9000, None, "d", 0.0, 0)], rows.schema)) if invalid == "keep" else rows
    more = train.unionByName(spark.createDataFrame([(9001, "never", "d", 2.0, 1)], rows.schema)) if invalid == "keep" else rows
    model = ids.fit_ids(train, "y", ["a", "b"], ["x"], invalid, "table", order=["a", "x", "b"], regParam=0.01)
    got = model.transform(more)
    assert "ml_attr" not in got.schema["features"].metadata
    indexed = model.index.transform(train)
    encoder = OneHotEncoder(inputCols=["a_index", "b_index"], outputCols=["a_vec", "b_vec"], dropLast=True, handleInvalid=invalid)
    plain = Pipeline(stages=[encoder, assemble(["a_vec", "x", "b_vec"])]).fit(indexed).transform(model.index.transform(more))
    one, two = ({r["id"]: r["features"] for r in df.select("id", "features").collect()} for df in (got, plain))
    assert one.keys() == two.keys() and all(one[i].size == two[i].size and (one[i].toArray() == two[i].toArray()).all() for i in one)
