import json

import pytest

from packetloom.sources import readers, writers

TRICKY = [
    (1, ' lead "quoted", comma', 1.5),
    (2, "tab\tinside", None),
    (3, None, -0.25),
    (4, "back\\slash", 1e-9),
    (5, "", 3.0),
]
# An empty string comes back from delimited text as null.
READ_BACK = [(i, t or None, v) for i, t, v in TRICKY]
SCHEMA = "row_id int, ` text` string, `Flow Bytes/s` double"


@pytest.fixture
def tricky(spark):
    return spark.createDataFrame(TRICKY, SCHEMA)


def rows(df, key="row_id"):
    return [tuple(r) for r in df.orderBy(key).collect()]


def test_csv_round_trip_keeps_names_and_values(spark, tricky, tmp_path):
    path = str(tmp_path / "a.csv")
    writers.write_csv(tricky, path)
    again = readers.load(spark, path, SCHEMA)
    assert again.columns == tricky.columns and rows(again) == READ_BACK


def test_line_breaks_inside_values(spark, tmp_path):
    df = spark.createDataFrame([(1, "two\nlines"), (2, "x")], "row_id int, t string")
    path = str(tmp_path / "b.csv")
    writers.write_csv(df, path)
    assert rows(readers.read_csv(spark, path, "row_id int, t string", multiline=True)) == [(1, "two\nlines"), (2, "x")]


def test_inference(spark, tmp_path):
    (tmp_path / "c.CSV").write_text(" Source Port,rate,name\n80,1.5,a\n443,2,b\n")
    df = readers.load(spark, str(tmp_path / "c.CSV"))
    assert df.dtypes == [(" Source Port", "int"), ("rate", "double"), ("name", "string")]


def test_tsv_index(spark, tricky, tmp_path):
    path = str(tmp_path / "d.csv")
    writers.write_tsv(tricky.select(" text", "row_id", "Flow Bytes/s"), path, index="row_id")
    assert rows(readers.load(spark, path, SCHEMA, tabbed=True, index_col="row_id")) == READ_BACK
    assert readers.read_tsv(spark, path, SCHEMA).columns == [" text", "Flow Bytes/s"]
    assert readers.read_tsv(spark, path, SCHEMA, rows=2).count() == 2
    with pytest.raises(ValueError):
        readers.read_tsv(spark, path, SCHEMA, index_col=False, rows=2)


def test_tsv_with_unnamed_index(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("\t Protocol\t Label\n0\t6\tBENIGN\n1\t17\t0\n")
    df = readers.load(spark, str(tmp_path / "e.tsv"))
    assert df.columns == [" Protocol", " Label"]
    assert [tuple(r) for r in df.orderBy(" Protocol").collect()] == [(6, "BENIGN"), (17, "0")]


def test_json_records(spark, tricky, tmp_path):
    path = str(tmp_path / "f.json")
    writers.write_json(tricky, path)
    assert rows(readers.load(spark, path, SCHEMA)) == TRICKY
    (tmp_path / "g.json").write_text('{"protocol_type": "tcp",\n "count": 1}')
    assert readers.read_json(spark, str(tmp_path / "g.json"), multiline=True).first()["count"] == 1


@pytest.mark.parametrize("schema", ["a bigint, ` b` string, c double", None])
def test_json_columns_layout(spark, tmp_path, schema):
    whole = {"a": {"0": 1, "1": 2, "2": None}, " b": {"0": "x", "2": "z"}, "c": {"0": 0.5, "1": 1, "2": 2}}
    path = tmp_path / "h.json"
    path.write_text(json.dumps(whole, indent=1))
    df = readers.read_json(spark, str(path), schema, layout="columns", multiline=True).select("row_id", "a", " b", "c")
    assert rows(df) == [("0", 1, "x", 0.5), ("1", 2, None, 1.0), ("2", None, "z", 2.0)]


@pytest.mark.parametrize("block", ["40", "128m"])
def test_json_columns_document_in_blocks(spark, tmp_path, block):
    """Strings with commas, quotes, braces and escapes over block borders; empty columns; two documents."""
    tricky = ['a,b', '"', '\\', '\\"', '},"x":{"0":1', '', 'é😀', '\n\t,', None, ',' * 40]
    whole = [
        {"n": {str(i): i * 1.5 for i in range(10)}, "none": {}, "t,\"": {str(i): t for i, t in enumerate(tricky)}, "last": {"3": True}},
        {"t,\"": {"k,": "only"}, "n": {"k,": 2}},
    ]
    for i, doc in enumerate(whole):
        (tmp_path / f"d{i}.json").write_text(json.dumps(doc, ensure_ascii=i == 0, indent=2 if i else None))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = readers.read_json(spark, str(tmp_path), 'n double, `t,"` string, last boolean, none int', layout="columns", multiline=True)
        got = sorted(map(tuple, df.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(str(i), i * 1.5, t, True if i == 3 else None, None) for i, t in enumerate(tricky)] + [("k,", 2.0, "only", None, None)]
    assert got == sorted(want, key=str)


def test_one_file_from_ranges_sorted_apart(spark, tmp_path, monkeypatch):
    """One file in order, although no task sorts or keeps more than its range."""
    passed = []
    monkeypatch.setattr(writers, "forget", lambda df: passed.append(df))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).selectExpr("id % 2 at", "id * 7919 % 5000 n").selectExpr("*", "concat(at, ':', n) line")
        writers.write_one_file(df, ["at", "n"], "line", str(tmp_path / "one"))
        writers.write_one_file(df.limit(0), ["at", "n"], "line", str(tmp_path / "none"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    (file,) = (tmp_path / "one").glob("part-*")
    assert file.read_text().splitlines() == [r["line"] for r in df.orderBy("at", "n").collect()]
    assert "".join(f.read_text() for f in (tmp_path / "none").glob("part-*")) == ""
    sizes = [r["count"] for r in passed[0].groupBy("_metadata.file_path").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2500


def test_json_columns_refuses_other_documents(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": {"0": [1, 2]}}')
    with pytest.raises(Exception, match="not a document of columns"):
        readers.read_json(spark, str(tmp_path / "x.json"), "a string", layout="columns", multiline=True).collect()


def test_json_columns_objects_per_line(spark, tmp_path):
    path = tmp_path / "i.json"
    path.write_text('{"a":{"0":1},"b":{"0":"x"}}\n{"a":{"0":5},"b":{"0":"y"}}\n')
    df = readers.read_json(spark, str(path), "a bigint, b string", layout="columns")
    assert sorted(tuple(r) for r in df.collect()) == [("0", 1, "x"), ("0", 5, "y")]


def test_unknown_choices_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.load(spark, str(tmp_path / "x.parquet"))
    with pytest.raises(ValueError):
        readers.read_json(spark, "x.json", layout="rows")


def test_preview(spark):
    assert writers.preview(spark.range(100)).count() == 5
