import math

from pyspark.sql import functions as F

from tablewright.functions import scalars as S
from tablewright.operators import prepare
from tablewright.sources import tables as IO


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_numbers(spark):
    df = spark.createDataFrame([(t,) for t in ["1", " 2.5 ", "-3e2", "5d", "NaN", "Infinity", "", "2024-01-01", None, "1e999", ".5"]], "t string")
    assert values(df, S.parse_number("t")) == [1.0, 2.5, -300.0, None, None, None, None, None, None, None, 0.5]
    assert values(df, S.parse_number("t", lenient=True))[3] == 5.0
    assert values(df, S.parse_number("t", lenient=True))[7] == 2024.0


def test_null_tokens_and_finite(spark):
    df = spark.createDataFrame([(" NaN ", math.nan), ("Null", math.inf), ("undefined", -math.inf), (" ", 1.0), ("x", None)], "t string, v double")
    assert values(df, S.null_tokens("t")) == [None, None, None, None, "x"]
    assert values(df, S.finite("v")) == [None, None, None, 1.0, None]


def test_complex_cells(spark):
    df = spark.createDataFrame(
        [([1.5, 2.0], ["a"], {"k": 1}, '["p", "q"]'), ([math.nan], ["a", "b"], {}, '{"k": 1}'), ([], [], None, "[broken"), (None, None, None, None)],
        "n array<double>, s array<string>, m map<string,int>, t string",
    )
    assert values(df, S.scalar_cell(df, "n")) == [1.5, 0.0, None, None]
    assert values(df, S.scalar_cell(df, "s")) == ["a", '["a","b"]', None, None]
    assert values(df, S.scalar_cell(df, "m")) == ['{"k":1}', "{}", None, None]
    # a list of text stays whole, as a column of such lists does
    assert values(df, S.scalar_cell(df, "t")) == ['["p", "q"]', '{"k": 1}', "[broken", None]
    df = spark.createDataFrame([("[2.5, 3]",), ("[]",), ('["7"]',), ("[4",)], "t string")
    assert values(df, S.scalar_cell(df, "t")) == ["2.5", "[]", '["7"]', "[4"]


def test_row_key_keeps_long_texts_apart(spark):
    df = spark.createDataFrame([("a" * 500,), ("a" * 500,), ("a" * 501,), ("a",), (None,)], "t string")
    assert df.groupBy(*S.row_key(df)).count().count() == 4


def test_encoding_and_one_hot(spark):
    df = spark.createDataFrame([("b", "u"), ("a", "v"), (None, "w"), ("c", "x")], "c string, wide string")
    assert [tuple(r) for r in prepare.label_encode(df, limit=3).collect()] == [(1,), (0,), (None,), (2,)]
    assert prepare.one_hot(df.select("c"), ["c"]).columns == ["c_b", "c_c"]
    assert [tuple(r) for r in prepare.one_hot(df.select("c"), ["c"]).collect()] == [(1, 0), (0, 0), (0, 0), (0, 1)]


def test_feature_pipeline_keeps_its_constants(spark):
    train = spark.createDataFrame([(1.0, "x'1"), (3.0, "y"), (None, "y"), (5.0, None)], "v double, c string")
    model, used = prepare.fit_feature_pipeline(train, ["v", "c"])
    assert used == ["v", "c"]
    one = spark.createDataFrame([(None, None), (math.nan, "x'1"), (2.0, "new")], "v double, c string")
    assert [list(r[0]) for r in model.transform(one).select("features").collect()] == [[3.0, 1.0], [3.0, 0.0], [2.0, 0.0]]


def test_tolerant_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('name, "value",note\na, 1 ,"x,y"\nshort,2\nlong,3,4,5\nb,NaN,"say ""hi"""\n')
    df = IO.read_csv_tolerant(spark, str(path))
    assert df.columns == ["name", "value", "note"]
    assert df.count() == 2 and df.select("name").count() == 2
    assert sorted(tuple(r) for r in df.collect()) == [("a", 1.0, "x,y"), ("b", None, 'say "hi"')]


def test_cleaned_name():
    assert IO.cleaned_name("sales.csv") == "sales_cleaned.csv"
    assert IO.cleaned_name("sales_cleaned.csv") == "sales_cleaned.csv"
    assert IO.cleaned_name("sales") == "sales_cleaned.csv"
