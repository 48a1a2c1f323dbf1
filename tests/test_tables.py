import pytest
from pyspark.sql import functions as F

from isoplane.sources import tables

CSV = """Experiment,well,Stock (µL),well,skip?,potassium,silver nitrate,time,flag,note,plate
A,G01,1,G01,,0.0005,0.07,2024-01-02 10:11:12:131415,True,NA,1D
A,G02,1,G02,,0.0015,0.0699999999999999,2024-01-02 12:13:14:151617,False,"x, y",2D
A,G03,1,G03,,0,,2/1/24 9:08,True,None,3
"""


@pytest.fixture
def csv_path(tmp_path):
    path = tmp_path / "sample.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_types_and_names(spark, csv_path):
    df = tables.read_table(spark, csv_path)
    assert dict(df.dtypes) == {
        "Experiment": "string", "well": "string", "Stock (µL)": "bigint", "well.1": "string",
        "skip?": "double", "potassium": "double", "silver nitrate": "double", "time": "string",
        "flag": "boolean", "note": "string", "plate": "string"}
    rows = df.collect()
    assert [r["note"] for r in rows] == [None, "x, y", None]
    assert rows[1]["silver nitrate"] == 0.0699999999999999 and rows[2]["silver nitrate"] is None
    roles = tables.classify_columns(df, "potassium")
    assert roles["num_cols"] == ["Stock (µL)", "skip?", "silver nitrate"]
    assert "flag" in roles["cat_cols"] and "potassium" not in roles["cat_cols"]


def test_csv_without_empty_columns(spark, csv_path):
    assert "skip?" not in tables.read_csv(spark, csv_path, drop_all_null=True).columns


def test_csv_schema_skips_inference(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,NaN\n2,3.5\n")
    df = tables.read_csv(spark, str(path), schema=None)
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, None), (2, 3.5)]
    from pyspark.sql import types as T
    schema = T.StructType().add("a", T.DoubleType()).add("b", T.DoubleType())
    assert [tuple(r) for r in tables.read_csv(spark, str(path), schema).orderBy("a").collect()] == [
        (1.0, None), (2.0, 3.5)]


def test_unique_names():
    assert tables.unique_names(["a", "a", None, "a.1", "a"]) == ["a", "a.2", "Unnamed: 2", "a.1", "a.3"]
    assert tables.unique_names(["w", "w"]) == ["w", "w.1"]


@pytest.mark.parametrize("ending", [".csv", ".parquet"])
def test_write_and_read_back(spark, tmp_path, ending):
    df = spark.createDataFrame([(1, 0.5, "x"), (2, None, "y")], "id long, v double, s string")
    path = str(tmp_path / f"out{ending}")
    tables.write_table(df, path)
    assert sorted(map(tuple, tables.read_table(spark, path).collect())) == [(1, 0.5, "x"), (2, None, "y")]


def test_examples(spark, csv_path):
    df = tables.load_example(spark, {"1d": csv_path}, "anything")
    assert df.count() == 3 and spark.table("example_1d").count() == 3
    with pytest.raises(ValueError):
        tables.load_example(spark, {"1d": csv_path}, "2d")


def test_required_columns_and_complete_cases(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (float("nan"), 2.0, 1.0), (None, 1.0, 1.0)], "a double, b double, y double")
    with pytest.raises(ValueError, match="missing columns: \\['c', 'z'\\]"):
        tables.require_columns(df, ["a", "c"], "z")
    assert [tuple(r) for r in tables.complete_cases(df, ["a"], "y").collect()] == [(1.0, 3.0)]


def test_list_columns(spark):
    df = spark.createDataFrame([(1, None), (2, 1.5)], "a int, b double")
    assert [tuple(r) for r in tables.list_columns(df).collect()] == [(1, "a", "int", 2), (2, "b", "double", 1)]


def test_nan_becomes_null(spark):
    df = tables.nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "v double"))
    assert df.agg(F.avg("v")).first()[0] == 1.0
