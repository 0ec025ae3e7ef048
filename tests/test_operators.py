"""Operators on small tables: nulls, empty texts, ties, repeated rows, empty tables, odd names."""

import datetime as dt
import math
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.core import prefix
from millrace.core.errors import UnsupportedOperation, ValidationError
from millrace.core.ordering import OrderRule
from millrace.operators import fuzzy
from millrace.operators import (
    AssertExpression,
    CountRecords,
    DataCleansing,
    DataEncoderDecoder,
    DataMasking,
    DynamicSelect,
    FindDuplicates,
    FuzzyMatch,
    GenerateRows,
    Imputation,
    JSONParse,
    MatchField,
    MultiColumnEdit,
    MultiColumnRename,
    RecordID,
    Regex,
    RegexGroup,
    RunningTotal,
    Sample,
    TableOperations,
    TextToColumns,
    Tile,
    ToDo,
    Transpose,
    UnionByName,
    WeightedAverage,
    XMLParse,
)
from millrace.operators.tables import assignments
from millrace.streaming import by_batch, on_stream


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def weights(spark):
    return spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 3.0), ("b", 5.0, 0.0), (None, None, 2.0), (None, 4.0, 2.0)], "g string, v double, w double")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, repeated rows, ties, names with dots, blanks and quotes."""
    rows = [(1, "x", 1.0, None), (1, "x", 1.0, None), (2, "", None, "b"), (None, None, None, None), (3, "y z", 2.0, "b"), (3, "é", -2.0, "c")]
    return spark.createDataFrame(rows, "`Mixed Name` int, `a.b` string, `c``d` double, plain string")


# --- every operator on nothing and on odd names ---------------------------------------------

EVERY = [
    CountRecords(["a.b"], "count_non_null_records"),
    CountRecords(["a.b", "mixed name"], "count_distinct_records"),
    WeightedAverage("c`d", "mixed name", group_by=["a.b"]),
    RunningTotal(["c`d"], ["a.b"], ["`Mixed Name`"]),
    RunningTotal(["c`d", "Mixed Name"], order_by=[("`c``d`", "desc")], spread=True),
    RecordID(order_by=["`a.b`"]),
    RecordID(order_by=["`Mixed Name`"], spread=True),
    RecordID(),
    RecordID(method="uuid"),
    FindDuplicates(),
    FindDuplicates(["a.b"], "custom_group_count", "selectedCols", "greater_than", 0),
    Sample("lastN", 2, order_by=["plain"]),
    Sample("randomNPercent", 50, "sampleGroup", ["a.b"]),
    Sample("oneInN", 2),
    Tile("equal_records", n=3, order_by=["plain"]),
    Tile("equal_sum_tile", "c`d", n=2, group_by=["plain"]),
    Tile("smart_tile", "c`d", smart_output="output_column_verbose"),
    Tile("unique_value", columns=["a.b"]),
    Tile("manual", "c`d", cutoffs=[0.5, 1.5]),
    DataCleansing(["a.b", "c`d"], True, True, "NA", True, 7, case="title", trim=True, collapse_spaces=True),
    DataMasking(["a.b"], "mask"),
    DataMasking(["a.b", "c`d"], "hash", naming="combinedHash_substitute", combined="h"),
    DataEncoderDecoder(["a.b"], "base64"),
    DynamicSelect(["string"]),
    DynamicSelect(using="SELECT_EXPR", expression="field_number % 2 = 0"),
    MultiColumnEdit(["a.b"], "upper(column_value)"),
    MultiColumnRename(["a.b"], edit_with="p_"),
    Transpose(["plain"], ["a.b", "c`d", "plain"]),
    Regex("a.b", "[a-z]", output="tokenize"),
    TextToColumns("a.b", " ", n=2),
    Imputation(["c`d"], "mode"),
    FuzzyMatch("Mixed Name", [MatchField("a.b"), MatchField("plain", "equals")], threshold=10, with_score=True),
    GenerateRows("1", "i < 3", "i + 1", "i"),
    AssertExpression("plain IS NOT NULL"),
]


@pytest.mark.parametrize("operator", EVERY, ids=lambda o: type(o).__name__)
def test_odd_and_empty(odd, operator):
    out = operator(odd)
    many = out.collect()
    none = operator(odd.limit(0))
    assert none.columns == out.columns
    assert len(none.collect()) == (1 if isinstance(operator, CountRecords) else 0)
    assert many is not None


@pytest.mark.parametrize("operator", [CountRecords([], "count_non_null_records"), WeightedAverage("", "w"), WeightedAverage("v", "none"), RunningTotal([]), RunningTotal(["v"], order_by=[("v", "upwards")]), FindDuplicates(["v"], "custom_row_number", "selectedCols", "between", lower=3, upper=1), Sample("someN"), Tile("manual", "v", cutoffs=[2, 1]), Tile("equal_sum_tile", "g"), DataMasking(["g"], "mask", upper="XX"), DataMasking(["g"], "sha2", bits=100), DataCleansing(["v"], fill_date=True, date_value="1.1.2000"), Regex("g", ""), Imputation(["g"]), FuzzyMatch("g", []), MultiColumnEdit(["v"], "")], ids=repr)
def test_validation(weights, operator):
    with pytest.raises(ValidationError):
        operator(weights)


def test_every_problem_is_listed(weights):
    with pytest.raises(ValidationError) as e:
        WeightedAverage("none", "nope", "")(weights)
    assert len(e.value.problems) == 3


# --- aggregates and windows --------------------------------------------------------------------


def test_weighted_average(weights):
    assert got(WeightedAverage("V", "w", "avg", ["G"])(weights)) == [("a", 2.5), ("b", None), (None, 2.0)]


@pytest.mark.parametrize("spread", [False, True])
@pytest.mark.parametrize("sort", ["asc", "desc", "asc_nulls_last", "desc_nulls_first"])
def test_running_total_of_a_table(spark, spread, sort):
    rows = [(i, None if i % 11 == 0 else float(i * 7919 % 101), i % 5 or None) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, k double, x int").repartition(7)
    out = RunningTotal(["x"], order_by=[("k", sort), "i"], spread=spread)(df)
    key = lambda r: ((r[1] is None) != (sort in ("asc", "desc_nulls_first")), (r[1] or 0) * (1 if sort.startswith("asc") else -1), r[0])
    total, expected = 0, {}
    for r in sorted(rows, key=key):
        total += r[2] or 0
        expected[r[0]] = total
    assert {r["i"]: r["RunTot_x"] for r in out.collect()} == expected
    numbered = RecordID(type="integer", start=1, order_by=[("k", sort), "i"], spread=spread)(df)
    assert [r["i"] for r in sorted(numbered.collect(), key=lambda r: r["RecordID"])] == [r[0] for r in sorted(rows, key=key)]


def test_spread_over_dates(spark):
    df = spark.range(300).select("id", F.timestamp_add("HOUR", F.col("id") * 13 % 100, F.lit("2024-01-01").cast("timestamp_ntz")).alias("t"))
    out = RecordID(type="integer", start=1, order_by=["t", "id"], spread=True)(df)
    assert [r["id"] for r in sorted(out.collect(), key=lambda r: r["RecordID"])] == [r["id"] for r in df.orderBy("t", "id").collect()]


def test_running_total_ends_at_the_sum(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    out = RunningTotal(["o_custkey"], ["o_orderstatus"], ["o_orderkey"])(orders)
    assert got(out.groupBy("o_orderstatus").agg(F.max("RunTot_o_custkey"))) == got(orders.groupBy("o_orderstatus").agg(F.sum("o_custkey")))


def test_record_ids(spark):
    df = spark.range(0, 1000, numPartitions=9).filter("id % 3 != 1")
    ids = sorted(r[0] for r in RecordID(type="integer", start=5)(df).collect())
    assert ids == list(range(5, 5 + df.count()))
    assert RecordID(size=3, start=998)(spark.range(4)).columns == ["RecordID", "id"]
    assert sorted(r[0] for r in RecordID(size=3, start=998, order_by=["id"])(spark.range(4)).collect()) == ["100", "100", "998", "999"]
    assert RecordID(position="last_column", name="n")(spark.range(1)).columns == ["id", "n"]


def test_duplicates_split_the_table(odd):
    one = FindDuplicates(["plain"], "unique", "selectedCols", order_by=[OrderRule("`Mixed Name`")])(odd)
    more = FindDuplicates(["plain"], "duplicate", "selectedCols", order_by=[OrderRule("`Mixed Name`")])(odd)
    assert got(one.union(more)) == got(odd)
    assert FindDuplicates()(odd).count() == 5


@pytest.mark.parametrize(("mode", "n", "size"), [("firstN", 4, 4), ("lastN", 4, 4), ("skipN", 4, 46), ("oneOfN", 7, 8), ("oneInN", 7, 7), ("randomN", 9, 9), ("nPercent", 15, 8), ("randomNPercent", 15, 8), ("firstN", 400, 50), ("nPercent", 150, 50)])
def test_sample_sizes(spark, mode, n, size):
    df = spark.range(50).withColumn("g", F.col("id") % 2)
    assert Sample(mode, n, order_by=["id"])(df).count() == size
    assert got(Sample(mode, n, order_by=["id"])(df)) == got(Sample(mode, n, order_by=["id"], spread=True)(df.repartition(5)))
    assert Sample(mode, n, "sampleGroup", ["g"], ["id"])(df).groupBy("g").count().count() == 2


def test_random_sample_keeps_its_rows(spark):
    df = spark.range(200)
    first = got(Sample("randomN", 20)(df))
    assert first == got(Sample("randomN", 20)(df.repartition(11))) != got(Sample("randomN", 20, seed=7)(df))


def test_tiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), (None, -1.0), (None, 1.0)], "g string, v double")
    sizes = [r["n"] for r in Tile("equal_records", n=3, order_by=["v"])(df).groupBy("Tile_Num").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 1
    sums = Tile("equal_sum_tile", "v", n=2, group_by=["g"], order_by=["v"])(df)
    assert got(sums.select("g", "v", "Tile_Num", "tile_sum")) == sorted([("a", 1.0, 1, 4.0), ("a", 1.0, 1, 4.0), ("a", 2.0, 1, 4.0), ("a", 4.0, 2, 4.0), ("b", 3.0, 1, 3.0), (None, -1.0, 1, 0.0), (None, 1.0, 1, 0.0)], key=repr)
    smart = {r["v"]: r["SmartTile_Num"] for r in Tile("smart_tile", "v", smart_output="output_column_smartTile")(spark.createDataFrame([(float(i),) for i in range(9)] + [(40.0,)], "v double")).collect()}
    assert smart[40.0] == "Extremely High" and smart[7.0] == "Average"
    assert {r["Tile_Num"] for r in Tile("smart_tile", "v")(spark.createDataFrame([(2.0,), (2.0,)], "v double")).collect()} == {0}
    manual = Tile("manual", "v", cutoffs=[1, 2.5])(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "v double"))
    assert got(manual.select("v", "Tile_Num")) == [(1.0, 1), (2.0, 2), (3.0, 3), (None, 3)]


# --- text ---------------------------------------------------------------------------------------


def test_cleansing_steps(spark):
    df = spark.createDataFrame([(1, "  Ab_c\t\n 1-é "), (2, ""), (3, None)], "id int, t string")
    one = lambda **k: [r["t"] for r in DataCleansing(["T"], **k)(df).orderBy("id").collect()]
    assert one(trim=True) == ["Ab_c\t\n 1-é", "", None]
    assert one(collapse_spaces=True) == [" Ab_c 1-é ", "", None]
    assert one(remove_spaces=True) == ["Ab_c1-é", "", None]
    assert one(remove_letters=True, trim=True) == ["_\t\n 1-é", "", None]
    assert one(remove_punctuation=True, remove_spaces=True) == ["Abc1", "", None]
    assert one(remove_digits=True, remove_spaces=True, case="upper") == ["AB_C-É", "", None]
    assert one(fill_text=True, text_value="-")[2] == "-"
    assert DataCleansing()(df).columns == ["id", "t"]


def test_masks_and_codes(spark):
    df = spark.createDataFrame([("Ab1-é",), ("",), (None,)], "s string")
    assert [r[0] for r in DataMasking(["s"], "mask")(df).collect()] == ["Xxn-x", "", None] or [r[0] for r in DataMasking(["s"], "mask")(df).collect()][0].startswith("Xxn-")
    for there, back, more in (("base64", "unbase64", {}), ("hex", "unhex", {}), ("encode", "decode", {"charset": "UTF-16LE"}), ("aes_encrypt", "aes_decrypt", {"key": lambda: "0123456789abcdef"}), ("aes_encrypt", "try_aes_decrypt", {"key": "0123456789abcdef", "mode": "CBC"})):
        out = DataEncoderDecoder(["s"], back, **more)(DataEncoderDecoder(["s"], there, **more)(df))
        assert got(out) == got(df), there
    beside = DataEncoderDecoder(["s"], "hex", naming="prefix_suffix_substitute", affix_option="Suffix", affix="_h")(df)
    assert beside.columns == ["s", "s_h"]


def test_columns(spark):
    df = spark.createDataFrame([(1, "John", 50)], "id int, first_name string, age int")
    assert MultiColumnEdit(["AGE"], "column_value * 1.5")(df).first()["age"] == 75
    assert MultiColumnEdit(["first_name"], "concat(column_name, column_value, 'my_column_value')")(df).first()["first_name"] == "first_nameJohnmy_column_value"
    assert MultiColumnRename(["age"], "advancedRename", expression="upper(column_name)")(df).columns == ["id", "first_name", "AGE"]
    assert DynamicSelect(["Date"])(df).columns == ["no_columns_matched"]
    assert Transpose(["id"], [])(df).columns == df.columns
    assert got(Transpose(["id"], ["id", "age"])(df)) == [(1, "age", "50"), (1, "id", "1")]
    with pytest.raises(ValidationError):
        UnionByName("nameBasedUnionOperation")(df, df.drop("age"))
    assert UnionByName()(df, df.select(F.col("age").alias("AGE")), df).count() == 3


def test_regex(spark):
    df = spark.createDataFrame([(1, "a1 b22 c"), (2, "none"), (3, ""), (4, None)], "id int, t string")
    out = lambda **k: {r["id"]: tuple(r)[2:] for r in Regex("t", r"([a-z])(\d+)", **k)(df).collect()}
    assert out(replacement="<$2>")[1] == ("<1> <22> c",)
    assert out(output="parse", groups=[RegexGroup("l"), RegexGroup("n", "int")]) == {1: ("a", 1), 2: (None, None), 3: (None, None), 4: (None, None)}
    assert out(output="tokenize", n=3, root="r")[1] == ("a", "b", None)
    assert out(output="tokenize", n=3, allow_blank=True)[1] == ("a", "b", "") and out(output="tokenize", n=3, allow_blank=True)[2] == (None, None, None)
    assert out(output="tokenize", n=1, extra="dropExtraWithError")[1] == ("ERROR: Found 2 regex matches, but only 1 columns expected",)
    assert out(output="match") == {1: (1,), 2: (0,), 3: (0,), 4: (0,)}
    rows = Regex("t", r"([a-z])(\d+)", "tokenize", tokenize_output="splitRows", root="r")(df)
    assert got(rows) == [(1, "a1 b22 c", "a", 1), (1, "a1 b22 c", "b", 2)]
    assert Regex("t", "b", "match", only_matches=True)(df).count() == 1


def test_splitting(spark):
    df = spark.createDataFrame([(1, "a,b,c,d"), (2, "a"), (3, "{x}_,"), (4, None)], "id int, t string")
    wide = {r["id"]: tuple(r)[2:] for r in TextToColumns("t", ",", n=3)(df).collect()}
    assert wide == {1: ("a", "b", "c,d"), 2: ("a", None, None), 3: ("{x}_", "", None), 4: (None, None, None)}
    assert {r["id"]: tuple(r)[2:] for r in TextToColumns("t", ",", n=2, extra="Drop")(df).collect()}[1] == ("a", "b")
    assert got(TextToColumns("t", ",", "splitRows", rows_column="T")(df)) == sorted([(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "a"), (3, " x  "), (3, ""), (4, "")], key=repr)
    assert TextToColumns("t", "||", n=2)(spark.createDataFrame([("a||b|c",)], "t string")).first()[1:] == ("a", "b|c")


def test_documents(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": [1, 2]}}',), ("not json",), (None,)], "p string")
    parsed = [r["p_parsed"] for r in JSONParse("p", sample='{"a": 1,\n "b": {"c": [1]}}')(df).collect()]
    assert parsed[0]["b"]["c"] == [1, 2] and parsed[2] is None
    assert JSONParse("p", "none")(df).columns == ["p"]
    xml = spark.createDataFrame([("<r><a>1</a><b x='2'>t</b></r>",), (None,)], "p string")
    assert XMLParse("p", "parseFromSchema", schema="a int")(xml).first()["p_parsed"]["a"] == 1
    with pytest.raises(ValidationError):
        JSONParse("p", "parseFromSchema")(df)


# --- statistics, matching, generation --------------------------------------------------------------


def test_imputation(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (2, 2.0, "a"), (None, None, None), (-1, 3.0, "a"), (4, 4.0, "b")], "n int, x double, c string")
    put = lambda **k: Imputation(**k)(df).collect()[2]
    assert put(columns=["n"])["n"] == 1  # 6 / 4, cut
    assert put(columns=["x"], method="median")["x"] == 2.0
    assert put(columns=["c"], method="mode")["c"] == "a"
    assert put(columns=["c"], method="user_value", user_value="z", indicator=True)["c_Indicator"] == 1
    away = Imputation(["n"], "median", sentinel=-1, keep_original=True)(df)
    assert [r["n_ImputedValue"] for r in away.collect()] == [1, 2, None, 2, 4]
    assert Imputation(["x"])(df.filter("x IS NULL")).first()["x"] is None


def test_fuzzy(spark):
    rows = [("9", "s", "O'Neil", "1"), ("10", "t", "ONEIL", "1"), ("2", "s", "", "2"), ("3", "t", "", None), ("4", "s", None, "2")]
    df = spark.createDataFrame(rows, "rid string, src string, name string, phone string")
    fields = [MatchField("name", "name"), MatchField("phone", "phone")]
    assert got(FuzzyMatch("rid", fields, threshold=100, with_score=True)(df)) == [("4", "2", 100.0), ("9", "10", 100.0)]
    assert got(FuzzyMatch("rid", fields, "MERGE", "src", 100)(df)) == [("9", "10")]
    assert got(FuzzyMatch("rid", fields, threshold=100, block_on="src")(df)) == [("4", "2")]
    assert FuzzyMatch("rid", fields, "other")(df).columns == df.columns
    mirrored = spark.createDataFrame([("1", "abc"), ("2", "cba"), ("3", "abc")], "rid string, v string")
    assert got(FuzzyMatch("rid", [MatchField("v", "exact")], threshold=100)(mirrored)) == [("2", "1"), ("3", "2")]


def test_generated_rows(spark):
    values = lambda *a, **k: [r[0] for r in GenerateRows(*a, **k)(spark).collect()]
    assert values("1", "value <= 10", "value + 1") == list(range(1, 11))
    assert values("10", "value > 0", "value - 3") == [10, 7, 4, 1]
    assert values("1", "value < 1", "value + 1") == []
    assert len(values("1", "value > 0", "value + 1")) == 100
    assert len(values("1", "value > 0", "value + 1", max_rows=1000)) == 1000
    assert values("1", "value < 100", "value * 3") == [1, 3, 9, 27, 81]
    assert values("1", "value % 4 != 0", "value + 1") == [1, 2, 3]  # stops at the first that fails
    assert values("1", "v * 0 = 0", "v * -1.5D", "v", max_rows=3) == [1, -1.5, 2.25]
    assert values("'2024-01-30'", "d < date '2024-02-02'", "date_add(d, 1)", "d")[-1] == dt.date(2024, 2, 1)
    assert values("'a'", "length(s) < 4", "concat(s, 'b')", "s") == ["a", "ab", "abb"]
    assert len(values("0.5D", "x < 1e9", "x + 1", "x", max_rows=1500)) == 1500
    df = spark.createDataFrame([(1, 3), (5, 4), (None, 2)], "start int, stop int")
    assert got(GenerateRows("payload.start", "stop <= payload.stop", "stop + 1", "stop")(df)) == [(1, 1), (1, 2), (1, 3)]
    with pytest.warns(UserWarning):
        assert len(values("1", "value > 0", "value + 1", max_rows=-5)) == 100
    with pytest.raises(ValidationError):
        GenerateRows("1", "", "value + 1")(spark)


@pytest.mark.parametrize("made", [
    lambda df: RunningTotal(["v"], spread=True)(df),
    lambda df: RunningTotal(["v"], order_by=["s"], spread=True)(df),
    lambda df: RunningTotal(["v"], order_by=["t", "v"], spread=True)(df),
    lambda df: Sample("randomNPercent", 20, spread=True)(df),
    lambda df: Tile("smart_tile", "v")(df),
    lambda df: Tile("unique_value", columns=["s"], spread=True)(df),
    lambda df: Tile("equal_sum_tile", "v", n=5, spread=True)(df),
    lambda df: Tile("equal_records", n=5, order_by=["v"], no_split=["t"], spread=True)(df),
])
def test_no_task_has_all_rows(spark, made):
    """Only counts and sums of bins meet in one task: its exchanges follow an aggregate."""
    df = spark.range(5000).select(F.col("id").alias("v"), F.md5(F.col("id").cast("string")).alias("s"), F.expr("timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id % 977)").alias("t"))
    out = made(df)
    physical = out._jdf.queryExecution().executedPlan().toString()
    for below in physical.split("Exchange SinglePartition")[1:]:
        assert "HashAggregate" in "".join(below.split("\n")[1:3]), below[:300]
    assert out.count() in (1000, 5000)


def test_totals_by_text_and_time(spark):
    df = spark.range(5000).select(F.col("id").alias("v"), F.md5(F.col("id").cast("string")).alias("s"), F.expr("cast(timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id % 977 / 1000) AS timestamp_ntz)").alias("t"))
    for order in (["s"], [("s", "desc"), "v"], ["t", "v"], [("t", "desc"), "v"]):
        whole, spread = (sorted(map(tuple, RunningTotal(["v"], order_by=order, spread=x)(df).collect())) for x in (False, True))
        assert whole == spread


def test_detected_groups():
    from millrace.operators.parse import detected_groups

    found = {g.name: g.type for g in detected_groups(r"(?<day>\d{4}-\d{2}-\d{2}) (\d+) (?:x|y) ([0-9]+\.[0-9]{2}) (true|false) [(] \( (a(b))")}
    assert found == {"day": "date", "regex_col2": "int", "regex_col3": "double", "regex_col4": "boolean", "regex_col5": "string", "regex_col6": "string"}


def test_relations(spark, tmp_path):
    from millrace.sources import relation, save

    name = f"t{uuid.uuid4().hex[:8]}"
    save(spark.range(3).withColumn("g", F.col("id") % 2), name, partition_by=["g"])
    try:
        assert relation(spark, name).count() == 3 and relation(spark, [name, name]).count() == 9 and relation(spark, []).count() == 1
        save(spark.range(2).withColumn("g", F.lit(0).cast("long")), name, mode="append", partition_by=["g"])
        assert relation(spark, name).count() == 5
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_fuzzy_repeated_ids(spark):
    """Rows that share an id are averaged over their pairs."""
    df = spark.createDataFrame([("1", "abcd"), ("1", "abxx"), ("2", "abcd"), ("3", None)], "rid string, v string")
    assert got(FuzzyMatch("rid", [MatchField("v")], threshold=0, with_score=True)(df)) == [("2", "1", 75.0)]


def test_assertion_and_todo(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    assert got(AssertExpression("> 0", "x")(df)) == [(-1,), (None,)]
    with pytest.raises(Exception, match="ToDo: later"):
        ToDo("later")(df).collect()


# --- tables --------------------------------------------------------------------------------------------


def test_table_operations(spark, tmp_path):
    name = f"t{uuid.uuid4().hex[:8]}"
    spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, s string").write.parquet(f"{tmp_path}/t")
    run = lambda action, **k: TableOperations(name, action, **k)(spark).first()
    rows = lambda: got(spark.table(name))
    assert run("registerTableInCatalog", path=f"{tmp_path}/t")["status"] == "Success"
    assert len(rows()) == 3
    run("deleteFromTable", delete_condition="s = 'a'")
    assert rows() == [(2, None), (3, "c")]
    run("updateTable", update_set="s = concat(s, ', x'), id = id + 1", update_condition="id > 2")
    assert rows() == [(2, None), (4, "c, x")]
    run("updateTable", update_set="s = 'z'")
    assert rows() == [(2, "z"), (4, "z")]
    run("optimiseTable", zorder=["id"])
    run("optimiseTable")
    assert rows() == [(2, "z"), (4, "z")]
    for action, more in (("vacuumTable", {}), ("restoreTable", {"restore_value": "1"}), ("fsckRepairTable", {})):
        with pytest.raises(UnsupportedOperation):
            run(action, **more)
    run("runDDL", ddl="ALTER TABLE {table_name} SET TBLPROPERTIES ('k' = 'v')")
    run("deleteFromTable")
    assert rows() == []
    run("dropTable")
    assert not spark.catalog.tableExists(name)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(f"{name}_staging")]


@pytest.mark.parametrize("more", [{"action": "vacuumTable", "retain_hours": 1}, {"action": "registerTableInCatalog"}, {"action": "other"}, {"action": "restoreTable", "restore_value": "0"}, {"action": "restoreTable", "restore_via": "timestamp", "restore_value": "yesterday"}, {"action": "updateTable"}, {"action": "runDDL"}])
def test_table_validation(spark, more):
    with pytest.raises(ValidationError):
        TableOperations("t", **more)(spark)


def test_assignments():
    assert assignments("a = f(x, ','), `b c` = 'd, e'") == [("a", "f(x, ',')"), ("b c", "'d, e'")]


# --- streams -------------------------------------------------------------------------------------------


def test_streams(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/customer.parquet")
    table.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    steps = [DataCleansing(["c_mktsegment"], case="lower"), DataMasking(["c_name"], "md5"), Regex("c_mktsegment", "[a-z]+", "tokenize", tokenize_output="splitRows"), Transpose(["c_custkey"], ["c_name", "regex_col"])]
    name = f"s{uuid.uuid4().hex[:8]}"
    running = on_stream(stream(), *steps).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    running.awaitTermination(120)
    expected = table
    for step in steps:
        expected = step(expected)
    assert got(spark.table(name)) == got(expected)
    with pytest.raises(UnsupportedOperation):
        on_stream(stream(), RecordID())
    seen = []
    running = by_batch(stream(), lambda batch, n: seen.append(batch.count()), FindDuplicates(["c_nationkey"], generation="selectedCols")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert sum(seen) == table.select("c_nationkey").distinct().count()


def test_percent_is_rounded_up():
    from millrace.operators.rows import percent_rows

    assert [percent_rows(10, p) for p in (0, 1, 10, 11, 200)] == [0, 1, 1, 2, 10] and math.ceil(0.1) == 1


def test_transpose_names_odd_columns(odd):
    out = Transpose(["plain"], ["a.b", "c`d", "plain"], "n", "v")(odd.filter("`Mixed Name` = 2"))
    assert got(out) == [("b", "a.b", ""), ("b", "c`d", None), ("b", "plain", "b")]


@pytest.mark.parametrize("n", [1, 3, 7, 400])
def test_spread_tiles(spark, n):
    df = spark.createDataFrame([(i, None if i % 13 == 0 else i * 31 % 97, "x") for i in range(200)], "i int, v int, s string").repartition(5)
    for method in ("equal_records", "equal_sum_tile"):
        for order in ([("v", "desc"), "i"], ["s", "i"]):
            one, many = (Tile(method, "v", n=n, order_by=order, spread=s)(df) for s in (False, True))
            assert one.columns == many.columns and got(one) == got(many)
    assert sorted(r["n"] for r in Tile("equal_records", n=n, spread=True)(df).groupBy("Tile_Num").agg(F.count("*").alias("n")).collect()) == sorted(200 // n + (k < 200 % n) for k in range(min(n, 200)))


@pytest.fixture(scope="module")
def hot(spark):
    """A group of a third of the rows, a null group of a third, and groups of two; nulls and ties in the order."""
    groups = {0: "a", 1: None}
    rows = [(i, groups.get(i % 3, f"g{i // 6}"), None if i % 17 == 0 else float(i * 7919 % 101), i % 5 or None) for i in range(600)]
    return spark.createDataFrame(rows, "i int, g string, k double, x int").repartition(7).cache()


@pytest.mark.parametrize("sort", ["asc", "desc_nulls_first"])
@pytest.mark.parametrize("made", [
    lambda o, s: RunningTotal(["x"], ["g"], o, spread=s),
    lambda o, s: RecordID(type="integer", generation="groupLevel", group_by=["g"], order_by=o, spread=s),
    lambda o, s: FindDuplicates(["g"], "duplicate", "selectedCols", order_by=o, spread=s),
    lambda o, s: FindDuplicates(["g"], "custom_row_number", "selectedCols", "between", lower=2, upper=150, order_by=o, spread=s),
    lambda o, s: Tile("unique_value", columns=["g"], order_by=o, spread=s),
    lambda o, s: Tile("manual", "x", cutoffs=[3, 4], group_by=["g"], order_by=o, spread=s),
    lambda o, s: Tile("smart_tile", "x", group_by=["g"], order_by=o, smart_output="output_column_smartTile", spread=s),
    lambda o, s: Tile("equal_records", n=4, order_by=o, no_split=["x"], spread=s),
    *[lambda o, s, m=m: Sample(m, 20, "selectedGroup", ["g"], o, spread=s) for m in ("lastN", "skipN", "oneOfN", "oneInN", "nPercent", "randomNPercent")],
])
def test_hot_groups(hot, monkeypatch, made, sort):
    monkeypatch.setattr(prefix, "HOT_ROWS", 20)
    order = [("k", sort), "i"]
    one, many = made(order, False)(hot), made(order, True)(hot)
    assert one.columns == many.columns and got(one) == got(many)


def test_hot_groups_are_parted(hot, monkeypatch):
    """Rows of a hot group are windowed by group and bin; without hot groups one window does."""
    operator = RunningTotal(["x"], ["g"], ["k", "i"], spread=True)
    plan = lambda: operator(hot)._jdf.queryExecution().optimizedPlan().toString()
    assert prefix.BIN not in plan()
    monkeypatch.setattr(prefix, "HOT_ROWS", 20)
    assert prefix.BIN in plan()
    sizes = prefix.within(hot, ["g"], ["k", "i"], {"n": F.lit(1)})
    assert sizes.columns == [*hot.columns, "n"]
    monkeypatch.setattr(prefix, "HOT_GROUPS", 2)  # now hot is what holds more than half of the rows
    assert prefix.within(hot, ["g"], ["k", "i"], {"n": F.lit(1)}) is None
    assert prefix.within(hot.limit(0), ["g"], ["k"], {"n": F.lit(1)}) is None


def test_bins_take_each_key_once(spark):
    """Placing a row among many bounds costs a few steps, and a dear first key is not computed for each bound."""
    df = spark.range(0, 200_000, 1, 1).select("id", *[F.concat(F.lit(c), F.col("id").cast("string")).alias(c) for c in "abcdef"]).localCheckpoint()
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "500")
    try:
        began = time.monotonic()
        assert Sample("randomNPercent", 10, spread=True)(df).count() == 20_000
        assert time.monotonic() - began < 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


@pytest.mark.parametrize("edges", [[5.0], [1.0, 2.0], [0.5, 1.0, 7.0], [float(i) for i in range(0, 200, 3)]])
def test_bins_by_halving(spark, edges):
    values = [-1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 6.9, 7.0, 100.0, 198.0, 1e9, float("inf"), float("-inf")]
    found = spark.createDataFrame([(v,) for v in values], "x double").select("x", prefix._below(edges, F.col("x")).alias("n")).collect()
    assert [(r["x"], r["n"]) for r in found] == [(v, sum(e < v for e in edges)) for v in values]
    assert spark.createDataFrame([(float("nan"),)], "x double").select(prefix._below(edges, F.col("x"))).first()[0] == len(edges)


def _all_pairs(rows, fields, threshold, merge, block):
    """Scores of all pairs, mean by mean, as FuzzyMatch defines them."""

    def edits(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    sums = {}
    for a in rows:
        for b in rows:
            if a["rid"] is None or b["rid"] is None or a["rid"] <= b["rid"]:
                continue
            if (merge or block) and (a["src"] is None or b["src"] is None or (a["src"] != b["src"]) != merge):
                continue
            for column, kind in fields:
                x, y = a[column], b[column]
                if x is None or y is None or (kind == "custom" and not x and not y):
                    continue
                score = 100 * (1 - edits(x, y) / max(len(x), len(y))) if kind == "custom" else 100.0 * (x == (y[::-1] if kind == "exact" else y))
                sums.setdefault((a["rid"], b["rid"]), []).append(score)
    found = {k: sum(v) / len(v) for k, v in sums.items()}
    return {k: v for k, v in found.items() if round(v + 1e-9, 2) >= threshold}


@pytest.mark.parametrize(("most", "chunk"), [(1024, 1024), (8, 2)])
@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize(("fields", "threshold"), [([("v", "custom")], 66), ([("u", "exact"), ("v", "custom"), ("w", "equals")], 60), ([("w", "phone")], 100)])
def test_fuzzy_equals_all_pairs(spark, monkeypatch, most, chunk, repeated, fields, threshold):
    monkeypatch.setattr(fuzzy, "MOST_FORMS", most)
    monkeypatch.setattr(fuzzy, "CHUNK", chunk)
    draw = random.Random(5)
    text = lambda letters, n: "".join(draw.choice(letters) for _ in range(draw.randint(0, n))) if draw.random() > 0.1 else None
    rows = [(str(i // 2 if repeated else i) if i else None, text("AB", 8), text("XYZ", 3), text("aé𝄞", 3), draw.choice(["s", "t", None])) for i in range(40)]
    df = spark.createDataFrame(rows, "rid string, v string, w string, u string, src string").localCheckpoint()
    for merge, block in ((False, None), (True, None), (False, "src")):
        made = FuzzyMatch("rid", [MatchField(*f) for f in fields], "MERGE" if merge else "PURGE", "src" if merge else None, threshold, True, block)(df).collect()
        expected = _all_pairs(df.collect(), fields, threshold, merge, block)
        assert len(made) == len(expected)
        assert {(r[0], r[1]): r[2] for r in made} == {k: pytest.approx(v, abs=0.0051) for k, v in expected.items()}


def test_fuzzy_does_not_compare_all_pairs(spark):
    """60,000 records make 1.8e9 pairs; only near ones meet."""
    df = spark.range(60_000).select("id", F.format_string("Supplier#%09d", "id").alias("name"), (F.col("id") % 5000).alias("phone"))
    began = time.monotonic()
    assert FuzzyMatch("id", [MatchField("phone", "phone")], threshold=100)(df).count() == 5000 * 66
    near = FuzzyMatch("id", [MatchField("name")], threshold=94, with_score=True)(df)
    # Each digit that changes is another record, as far as the numbers go.
    assert near.count() == sum(1 for n in range(60_000) for p in range(5) for c in range(n // 10**p % 10 + 1, 10) if n + (c - n // 10**p % 10) * 10**p < 60_000)
    assert time.monotonic() - began < 60


LAST = [("id", "desc")]


@pytest.mark.parametrize(
    "operator",
    [RecordID(size=8, order_by=["id"]), *[Sample(m, 7, order_by=LAST) for m in ("lastN", "oneInN", "oneOfN", "nPercent", "skipN")], RunningTotal(["id"], order_by=LAST)],
    ids=["record_id", "last", "one_in", "one_of", "percent", "skip", "running_total"],
)
def test_two_million_rows_are_not_numbered_by_one_task(spark, operator):
    """16 MB by Spark's estimate, and more than 100 MB to a task that sorts them all."""
    plan = operator(spark.range(2_000_000).withColumn("v", F.col("id") % 10))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_millrace_bin" in plan


@pytest.mark.parametrize("no_split", [(), ["x"]])
@pytest.mark.parametrize("n", [1, 4, 7, 150])
def test_equal_records_of_hot_groups(spark, monkeypatch, n, no_split):
    """Hot groups are tiled from places made in bins, no group by one task; small groups and null ones as ever."""
    monkeypatch.setattr(prefix, "HOT_ROWS", 20)
    rows = [("a" if i % 3 else "b", i * 7 % 50, i, i % 11) for i in range(200)] + [(None, i, 200 + i, None) for i in range(25)] + [("c", None, 300, 1), ("c", 2, 301, None)]
    df = spark.createDataFrame(rows, "g string, k int, i int, x int").localCheckpoint()
    one, many = (Tile("equal_records", n=n, group_by=["g"], order_by=[("k", "desc"), "i"], no_split=no_split, spread=s)(df) for s in (False, True))
    assert got(one) == got(many)
    assert "ntile" in one._jdf.queryExecution().optimizedPlan().toString()
    assert "ntile" not in many._jdf.queryExecution().optimizedPlan().toString()


def test_bins_place_each_row_once(spark):
    """Rows are placed once for their numbers and once for the sums of bins, not again for a filter on null bins."""
    df = spark.range(0, 1000, 1, 4).selectExpr("id", "CASE WHEN id % 10 > 0 THEN timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 7919 % 997) END AS ts", "1 AS one")
    one, many = (RunningTotal(["one"], order_by=["ts", "id"], spread=s)(df) for s in (False, True))
    assert many._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 2
    assert got(one) == got(many)
