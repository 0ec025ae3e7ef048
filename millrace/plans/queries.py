"""Queries over the library's own operators, each with the SQL that gives the same rows.

Sums and averages of doubles are rounded on both sides, as engines add in
different orders.  Where rows tie, the order rules go on to columns that decide.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (
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
from ..sources import load

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Orders a line item among those of its order: whole rows differ.
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
#: The same as SQL; no table here holds nulls, but the rule is stated.
LINE_SQL = ", ".join(f"{c} ASC NULLS FIRST" for c in LINE)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# --- counts and averages -------------------------------------------------------------------


@query("count_all_records", "SELECT count(*) AS total_records FROM lineitem")
def _(spark, d):
    return load(spark, d, "lineitem").transform(CountRecords())


@query("count_non_null_records", "SELECT count(o_orderkey) AS o_orderkey_count, count(nullif(o_orderstatus, 'F')) AS o_orderstatus_count FROM orders")
def _(spark, d):
    orders = load(spark, d, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("F")))
    return orders.transform(CountRecords(["o_orderkey", "O_ORDERSTATUS"], "count_non_null_records"))


@query("count_distinct_records", "SELECT count(DISTINCT l_suppkey) AS l_suppkey_distinct_count, count(DISTINCT l_returnflag) AS l_returnflag_distinct_count FROM lineitem")
def _(spark, d):
    return load(spark, d, "lineitem").transform(CountRecords(["l_suppkey", "l_returnflag"], "count_distinct_records"))


@query("weighted_average", "SELECT round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 4) AS \"WeightedAverage\" FROM lineitem")
def _(spark, d):
    return _rounded(load(spark, d, "lineitem").transform(WeightedAverage("l_extendedprice", "l_quantity")), 4, "WeightedAverage")


@query("weighted_average_grouped", "SELECT l_returnflag, l_linestatus, round(sum(l_discount * l_extendedprice) / nullif(sum(l_extendedprice), 0), 6) AS discount FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return _rounded(load(spark, d, "lineitem").transform(WeightedAverage("l_discount", "l_extendedprice", "discount", ["l_returnflag", "l_linestatus"])), 6, "discount")


# --- running totals and record ids -----------------------------------------------------------


@query(
    "running_total_grouped",
    "SELECT o_orderkey, o_custkey, round(sum(coalesce(o_totalprice, 0)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate ASC NULLS FIRST, o_orderkey ASC NULLS FIRST ROWS UNBOUNDED PRECEDING), 2) AS \"RunTot_o_totalprice\" FROM orders",
)
def _(spark, d):
    out = load(spark, d, "orders").transform(RunningTotal(["o_totalprice"], ["o_custkey"], ["o_orderdate", "o_orderkey"]))
    return _rounded(out.select("o_orderkey", "o_custkey", "RunTot_o_totalprice"), 2, "RunTot_o_totalprice")


@query(
    "running_total_table",
    "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS sum_o_totalprice, sum(o_custkey) OVER w AS sum_o_custkey FROM orders WINDOW w AS (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS FIRST ROWS UNBOUNDED PRECEDING)",
)
def _(spark, d):
    out = load(spark, d, "orders").transform(RunningTotal(["o_totalprice", "o_custkey"], order_by=[("o_totalprice", "desc"), "o_orderkey"], prefix="sum_"))
    return _long(_rounded(out.select("o_orderkey", "sum_o_totalprice", "sum_o_custkey"), 2, "sum_o_totalprice"), "sum_o_custkey")


@query("record_id_ordered", "SELECT lpad(CAST(row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey ASC NULLS FIRST) + 999 AS VARCHAR), 6, '0') AS \"RecordID\", c_custkey, c_name FROM customer")
def _(spark, d):
    return load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").transform(RecordID(order_by=[("c_acctbal", "desc"), "c_custkey"])).drop("c_acctbal")


@query("record_id_group", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate ASC NULLS FIRST, o_orderkey ASC NULLS FIRST) AS nr FROM orders")
def _(spark, d):
    made = RecordID(name="nr", type="integer", start=1, generation="groupLevel", position="last_column", group_by=["o_custkey"], order_by=["o_orderdate", "o_orderkey"])
    return _long(load(spark, d, "orders").transform(made).select("o_orderkey", "o_custkey", "nr"), "nr")


@query("record_id_unordered", "SELECT row_number() OVER () + 999 AS \"RecordID\" FROM lineitem")
def _(spark, d):
    return _long(load(spark, d, "lineitem").select("l_orderkey").transform(RecordID(type="integer")).select("RecordID"), "RecordID")


@query("record_id_uuid")
def _(spark, d):
    return load(spark, d, "nation").transform(RecordID(method="uuid", name="id"))


# --- duplicates --------------------------------------------------------------------------------

_FLAGS = "SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem"


@query("find_duplicates_unique_all", f"SELECT DISTINCT * FROM ({_FLAGS})")
def _(spark, d):
    return load(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").transform(FindDuplicates())


@query("find_duplicates_duplicate_all", "SELECT o_custkey, o_orderpriority FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders) WHERE n > 1")
def _(spark, d):
    return load(spark, d, "orders").select("o_custkey", "o_orderpriority").transform(FindDuplicates(output="duplicate"))


def _by_line(n: str) -> str:
    return f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_SQL}) AS n FROM lineitem) WHERE {n}"


def _line(**more) -> FindDuplicates:
    return FindDuplicates(["l_orderkey", "l_linenumber"], generation="selectedCols", order_by=LINE, **more)


@query("find_duplicates_unique", _by_line("n = 1"))
def _(spark, d):
    return load(spark, d, "lineitem").transform(_line())


@query("find_duplicates_duplicate", _by_line("n > 1"))
def _(spark, d):
    return load(spark, d, "lineitem").transform(_line(output="duplicate"))


@query("find_duplicates_row_between", _by_line("n BETWEEN 2 AND 3"))
def _(spark, d):
    return load(spark, d, "lineitem").transform(_line(output="custom_row_number", condition="between", lower=2, upper=3))


@query("find_duplicates_row_not_equal", _by_line("n != 2"))
def _(spark, d):
    return load(spark, d, "lineitem").transform(_line(output="custom_row_number", condition="not_equal_to", n=2))


@query("find_duplicates_row_less", _by_line("n < 2"))
def _(spark, d):
    return load(spark, d, "lineitem").transform(_line(output="custom_row_number", condition="less_than", n=2))


def _by_count(n: str) -> str:
    return f"SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE {n}"


@query("find_duplicates_count_greater", _by_count("n > 12"))
def _(spark, d):
    return load(spark, d, "orders").transform(FindDuplicates(["o_custkey"], "custom_group_count", "selectedCols", "greater_than", 12))


@query("find_duplicates_count_equal", _by_count("n = 10"))
def _(spark, d):
    return load(spark, d, "orders").transform(FindDuplicates(["o_custkey"], "custom_group_count", "selectedCols", "equal_to", 10))


# --- samples -------------------------------------------------------------------------------------


def _orders(where: str, by: str = "") -> str:
    over = f"PARTITION BY {by} " if by else ""
    return f"SELECT * EXCLUDE (rn, rows) FROM (SELECT *, row_number() OVER ({over}ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS FIRST) AS rn, count(*) OVER ({over}) AS rows FROM orders) WHERE {where}"


def _sample(mode: str, n: float, by: str | None = None) -> Query:
    grouped = {"level": "sampleGroup", "group_by": [by]} if by else {}
    return lambda spark, d: load(spark, d, "orders").transform(Sample(mode, n, order_by=[("o_totalprice", "desc"), "o_orderkey"], **grouped))


for _name, _mode, _n, _where in (
    ("first", "firstN", 80, "rn <= 80"),
    ("last", "lastN", 80, "rn > rows - 80"),
    ("skip", "skipN", 1000, "rn > 1000"),
    ("one_of", "oneOfN", 7, "(rn - 1) % 7 = 0"),
    ("one_in", "oneInN", 7, "rn % 7 = 0"),
    ("percent", "nPercent", 2.5, "rn <= ceil(rows * 2.5 / 100.0)"),
):
    query(f"sample_{_name}", _orders(_where))(_sample(_mode, _n))
for _name, _mode, _n, _where in (("first", "firstN", 3, "rn <= 3"), ("last", "lastN", 2, "rn > rows - 2"), ("percent", "nPercent", 20, "rn <= ceil(rows * 20 / 100.0)")):
    query(f"sample_{_name}_grouped", _orders(_where, "o_custkey"))(_sample(_mode, _n, "o_custkey"))


@query("sample_random")
def _(spark, d):
    return load(spark, d, "orders").transform(Sample("randomN", 500))


@query("sample_random_percent_grouped")
def _(spark, d):
    return load(spark, d, "orders").transform(Sample("randomNPercent", 10, "sampleGroup", ["o_orderpriority"]))


# --- tiles -----------------------------------------------------------------------------------------


@query(
    "tile_equal_records",
    """
    WITH t AS (SELECT o_orderkey, o_orderstatus, o_totalprice, ntile(7) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice ASC NULLS FIRST, o_orderkey ASC NULLS FIRST) AS "Tile_Num" FROM orders)
    SELECT o_orderkey, "Tile_Num", count(*) OVER (PARTITION BY o_orderstatus, "Tile_Num") AS "Tile_RecordCount",
      row_number() OVER (PARTITION BY o_orderstatus, "Tile_Num" ORDER BY o_totalprice ASC NULLS FIRST, o_orderkey ASC NULLS FIRST) AS "Tile_SequenceNum" FROM t
    """,
)
def _(spark, d):
    out = load(spark, d, "orders").transform(Tile("equal_records", n=7, group_by=["o_orderstatus"], order_by=["o_totalprice", "o_orderkey"]))
    return _long(out.select("o_orderkey", "Tile_Num", "Tile_RecordCount", "Tile_SequenceNum"), "Tile_Num", "Tile_RecordCount", "Tile_SequenceNum")


@query(
    "tile_equal_records_together",
    """
    WITH t AS (SELECT c_custkey, c_acctbal, c_nationkey, ntile(5) OVER (ORDER BY c_nationkey ASC NULLS FIRST, c_custkey ASC NULLS FIRST) AS t FROM customer),
    u AS (SELECT *, min(t) OVER (PARTITION BY c_nationkey) AS m FROM t)
    SELECT c_custkey, dense_rank() OVER (ORDER BY m) AS "Tile_Num" FROM u
    """,
)
def _(spark, d):
    out = load(spark, d, "customer").transform(Tile("equal_records", n=5, order_by=["c_nationkey", "c_custkey"], no_split=["c_nationkey"]))
    return _long(out.select("c_custkey", "Tile_Num"), "Tile_Num")


@query(
    "tile_equal_sum",
    """
    WITH r AS (SELECT p_partkey, p_brand, p_size, p_retailprice, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ASC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS running, sum(p_size) OVER (PARTITION BY p_brand) AS total FROM part),
    t AS (SELECT *, ceil(running / CAST(total AS DOUBLE) * 4) AS t FROM r),
    u AS (SELECT *, dense_rank() OVER (PARTITION BY p_brand ORDER BY t) AS "Tile_Num" FROM t)
    SELECT p_partkey, "Tile_Num", CAST(sum(p_size) OVER (PARTITION BY p_brand, "Tile_Num") AS BIGINT) AS tile_sum, row_number() OVER (PARTITION BY p_brand, "Tile_Num" ORDER BY p_partkey ASC NULLS FIRST) AS "Tile_SequenceNum" FROM u
    """,
)
def _(spark, d):
    out = load(spark, d, "part").transform(Tile("equal_sum_tile", "p_size", n=4, group_by=["p_brand"], order_by=["p_partkey"]))
    return _long(out.select("p_partkey", "Tile_Num", "tile_sum", "Tile_SequenceNum"), "Tile_Num", "tile_sum", "Tile_SequenceNum")


@query(
    "tile_smart",
    """
    WITH s AS (SELECT o_orderkey, o_orderpriority, o_totalprice, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS m, stddev_samp(o_totalprice) OVER (PARTITION BY o_orderpriority) AS s FROM orders)
    SELECT o_orderkey, CAST(CASE WHEN s = 0 THEN 0 ELSE floor((o_totalprice - m) / s + 0.5) END AS BIGINT) AS "Tile_Num",
      CASE CAST(CASE WHEN s = 0 THEN 0 ELSE floor((o_totalprice - m) / s + 0.5) END AS BIGINT) WHEN 0 THEN 'Average' WHEN 1 THEN 'Above Average' WHEN 2 THEN 'High' WHEN 3 THEN 'Extremely High'
        WHEN -1 THEN 'Below Average' WHEN -2 THEN 'Low' WHEN -3 THEN 'Extremely Low' END AS "SmartTile_Num" FROM s
    """,
)
def _(spark, d):
    out = load(spark, d, "orders").transform(Tile("smart_tile", "o_totalprice", group_by=["o_orderpriority"], smart_output="output_column_smartTile"))
    return _long(out.select("o_orderkey", "Tile_Num", "SmartTile_Num"), "Tile_Num")


@query("tile_unique_value", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand ASC NULLS FIRST, p_type ASC NULLS FIRST) AS \"Tile_Num\", row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey ASC NULLS FIRST) AS \"Tile_SequenceNum\" FROM part")
def _(spark, d):
    out = load(spark, d, "part").transform(Tile("unique_value", columns=["p_brand", "p_type"], order_by=["p_partkey"]))
    return _long(out.select("p_partkey", "Tile_Num", "Tile_SequenceNum"), "Tile_Num", "Tile_SequenceNum")


@query(
    "tile_manual",
    """
    WITH t AS (SELECT *, CASE WHEN CAST(c_acctbal AS FLOAT) <= CAST(0 AS FLOAT) THEN 1 WHEN CAST(c_acctbal AS FLOAT) <= CAST(2500.5 AS FLOAT) THEN 2 WHEN CAST(c_acctbal AS FLOAT) <= CAST(7000 AS FLOAT) THEN 3 ELSE 4 END AS "Tile_Num" FROM customer)
    SELECT c_custkey, CAST("Tile_Num" AS BIGINT) AS "Tile_Num", row_number() OVER (PARTITION BY c_mktsegment, "Tile_Num" ORDER BY c_custkey ASC NULLS FIRST) AS "Tile_SequenceNum" FROM t
    """,
)
def _(spark, d):
    out = load(spark, d, "customer").transform(Tile("manual", "c_acctbal", group_by=["c_mktsegment"], order_by=["c_custkey"], cutoffs=[0, 2500.5, 7000]))
    return _long(out.select("c_custkey", "Tile_Num", "Tile_SequenceNum"), "Tile_Num", "Tile_SequenceNum")


# --- cleansing, masking, encoding --------------------------------------------------------------------


@query(
    "cleansing_text",
    r"""SELECT p_partkey, upper(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(nullif(p_brand, 'Brand#2'), 'none given'), ' '), '\s+', ' ', 'g'), '[^a-zA-Z0-9\s]', '', 'g'), '[0-9]+', '', 'g')) AS p_brand,
      upper(regexp_replace(regexp_replace(regexp_replace(trim(p_name, ' '), '\s+', ' ', 'g'), '[^a-zA-Z0-9\s]', '', 'g'), '[0-9]+', '', 'g')) AS p_name FROM part""",
)
def _(spark, d):
    parts = load(spark, d, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#2")).alias("p_brand"), "p_name")
    return parts.transform(DataCleansing(["p_brand", "p_name"], fill_text=True, text_value="none given", trim=True, collapse_spaces=True, remove_punctuation=True, remove_digits=True, case="upper"))


@query("cleansing_letters", r"SELECT o_orderkey, lower(regexp_replace(regexp_replace(o_orderpriority, '\s+', '', 'g'), '[A-Za-z]+', '', 'g')) AS o_orderpriority FROM orders")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_orderpriority").transform(DataCleansing(["o_orderpriority"], remove_spaces=True, remove_letters=True, case="lower"))


@query(
    "cleansing_nulls",
    """SELECT l_orderkey, l_linenumber, l_partkey, coalesce(nullif(l_quantity, 5), -1) AS l_quantity, coalesce(CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_shipdate END, TIMESTAMP '1970-01-01 00:00:00') AS l_shipdate,
      coalesce(CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_shipdate AS DATE) END, DATE '2000-01-01') AS ship_day FROM lineitem""",
)
def _(spark, d):
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.nullif("l_quantity", F.lit(5.0)).alias("l_quantity"), F.when(F.col("l_returnflag") != "A", F.col("l_shipdate")).alias("l_shipdate"), F.when(F.col("l_returnflag") != "N", F.col("l_shipdate").cast("date")).alias("ship_day"))
    return lines.transform(DataCleansing(["l_quantity", "l_shipdate", "ship_day"], fill_number=True, number_value=-1, fill_timestamp=True, fill_date=True, date_value="2000-01-01"))


@query("cleansing_drop_null_rows", "SELECT * FROM (SELECT nullif(o_orderstatus, 'F') AS s, nullif(o_orderpriority, '5-LOW') AS p FROM orders) WHERE s IS NOT NULL OR p IS NOT NULL")
def _(spark, d):
    return load(spark, d, "orders").select(F.nullif("o_orderstatus", F.lit("F")).alias("s"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p")).transform(DataCleansing(drop_null_rows=True))


_MASK = "regexp_replace(regexp_replace(regexp_replace({0}, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', '{1}', 'g')"


@query("masking_mask", f"SELECT c_custkey, {_MASK.format('c_name', 'n')} AS c_name, {_MASK.format('c_mktsegment', 'n')} AS c_mktsegment FROM customer")
def _(spark, d):
    return load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").transform(DataMasking(["c_name", "c_mktsegment"], "mask"))


@query("masking_mask_affix", "SELECT c_custkey, c_name, regexp_replace(regexp_replace(regexp_replace(c_name, '[^A-Za-z0-9]', '_', 'g'), '[a-z]', '*', 'g'), '[0-9]', '9', 'g') AS masked_c_name FROM customer")
def _(spark, d):
    return load(spark, d, "customer").select("c_custkey", "c_name").transform(DataMasking(["c_name"], "mask", upper="NULL", lower="*", digit="9", other="_", naming="prefix_suffix_substitute", affix="masked_"))


@query("masking_digests", "SELECT c_custkey, sha256(c_name) AS c_name, md5(c_mktsegment) AS c_mktsegment, c_name AS plain, sha1(c_name) AS plain_sha FROM customer")
def _(spark, d):
    step = load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_name").alias("plain"))
    step = step.transform(DataMasking(["plain"], "sha", naming="prefix_suffix_substitute", affix_option="Suffix", affix="_sha"))
    return step.transform(DataMasking(["c_name"], "sha2")).transform(DataMasking(["c_mktsegment"], "md5"))


@query("masking_hash_combined")
def _(spark, d):
    return load(spark, d, "customer").transform(DataMasking(["c_name", "c_nationkey"], "hash", naming="combinedHash_substitute", combined="both")).transform(DataMasking(["c_mktsegment"], "crc32"))


@query("encode_base64_hex", "SELECT s_suppkey, base64(encode(s_name)) AS b64_s_name, hex(encode(s_name)) AS hex_s_name FROM supplier")
def _(spark, d):
    step = load(spark, d, "supplier").select("s_suppkey", "s_name")
    for method, affix in (("base64", "b64_"), ("hex", "hex_")):
        step = step.transform(DataEncoderDecoder(["s_name"], method, naming="prefix_suffix_substitute", affix=affix))
    return step.drop("s_name")


@query("decode_round_trips", "SELECT s_suppkey, s_name AS a, s_name AS b, s_name AS c, s_name AS d FROM supplier")
def _(spark, d):
    step = load(spark, d, "supplier").select("s_suppkey", *[F.col("s_name").alias(c) for c in "abcd"])
    for column, there, back in (("a", "base64", "unbase64"), ("b", "hex", "unhex"), ("c", "encode", "decode"), ("d", "aes_encrypt", "aes_decrypt")):
        more = {"charset": "UTF-16BE"} if there == "encode" else {"mode": "ECB", "key": "0123456789abcdef"} if "aes" in there else {}
        for method in (there, back):
            step = step.transform(DataEncoderDecoder([column], method, **more))
    return step


# --- columns ---------------------------------------------------------------------------------------------


@query("dynamic_select_types", "SELECT p_partkey, p_name, p_brand, p_type, p_retailprice FROM part")
def _(spark, d):
    return load(spark, d, "part").transform(DynamicSelect(["string", "long", "double"]))


@query("dynamic_select_expression", "SELECT l_partkey, l_suppkey, l_linenumber FROM lineitem")
def _(spark, d):
    return load(spark, d, "lineitem").transform(DynamicSelect(using="SELECT_EXPR", expression="column_type IN ('bigint', 'int') AND field_number > 0 AND column_name LIKE 'l%'"))


@query("multi_column_edit", "SELECT p_partkey, p_name || '!' || 'p_name' AS p_name, p_brand || '!' || 'p_brand' AS p_brand FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", "p_name", "p_brand").transform(MultiColumnEdit(["p_name", "p_brand"], "concat(column_value, '!', column_name)"))


@query("multi_column_edit_added", "SELECT c_custkey, c_acctbal, c_nationkey, round(c_acctbal * 1.5, 3) AS new_c_acctbal, round(c_nationkey * 1.5, 3) AS new_c_nationkey FROM customer")
def _(spark, d):
    out = load(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey").transform(MultiColumnEdit(["c_acctbal", "c_nationkey"], "round(cast(column_value AS double) * 1.5D, 3)", True, "Prefix", "new_"))
    return out


@query("multi_column_rename", "SELECT n_nationkey AS n_nationkey_old, n_name AS n_name_old, n_regionkey FROM nation")
def _(spark, d):
    return load(spark, d, "nation").transform(MultiColumnRename(["n_nationkey", "N_NAME"], edit_type="Suffix", edit_with="_old"))


@query("multi_column_rename_advanced", "SELECT n_nationkey AS nationkey, n_name AS \"name\", n_regionkey FROM nation")
def _(spark, d):
    return load(spark, d, "nation").transform(MultiColumnRename(["n_nationkey", "n_name"], "advancedRename", expression="substring(column_name, 3)"))


@query(
    "transpose",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_returnflag' AS metric, l_returnflag AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_linestatus', nullif(l_linestatus, 'O') FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_partkey', CAST(l_partkey AS VARCHAR) FROM lineitem",
)
def _(spark, d):
    lines = load(spark, d, "lineitem").withColumn("l_linestatus", F.nullif("l_linestatus", F.lit("O")))
    return lines.transform(Transpose(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_returnflag", "l_linestatus", "l_partkey"], "metric", "amount"))


@query("union_by_name", "SELECT n_nationkey AS k, n_name AS \"name\", n_regionkey AS region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def _(spark, d):
    nation = load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    region = load(spark, d, "region").select(F.col("r_name").alias("NAME"), F.col("r_regionkey").alias("K"))
    return UnionByName()(nation, region)


@query("union_by_name_strict", "SELECT s_suppkey AS k, s_nationkey AS nation FROM supplier UNION ALL SELECT c_custkey, c_nationkey FROM customer")
def _(spark, d):
    supplier = load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    customer = load(spark, d, "customer").select(F.col("c_nationkey").alias("Nation"), F.col("c_custkey").alias("k"))
    return UnionByName("nameBasedUnionOperation")(supplier, customer)


@query("assert_expression", "SELECT * FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') != 'F' AND o_totalprice > 1000, false)")
def _(spark, d):
    return load(spark, d, "orders").transform(AssertExpression("nullif(o_orderstatus, 'P') != 'F' AND o_totalprice > 1000"))


# --- patterns, delimiters, documents -------------------------------------------------------------------------


@query("regex_replace", "SELECT p_partkey, p_brand, regexp_replace(p_brand, '[0-9]+', '<n>', 'g') AS p_brand_replaced FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", "p_brand").transform(Regex("p_brand", "[0-9]+", replacement="<n>"))


@query(
    "regex_parse",
    r"""SELECT page_id, nullif(regexp_extract(url, 'https?://([^/]+)/([a-z]+)/([0-9]+)', 1), '') AS host, nullif(regexp_extract(url, 'https?://([^/]+)/([a-z]+)/([0-9]+)', 2), '') AS lang,
      TRY_CAST(nullif(regexp_extract(url, 'https?://([^/]+)/([a-z]+)/([0-9]+)', 3), '') AS INTEGER) AS nr FROM pages""",
)
def _(spark, d):
    groups = [RegexGroup("host"), RegexGroup("lang"), RegexGroup("nr", "int")]
    return load(spark, d, "pages").select("page_id", "url").transform(Regex("url", "https?://([^/]+)/([a-z]+)/([0-9]+)", "parse", groups, ignore_case=False)).drop("url")


_WORDS = "regexp_extract_all(p_name, '[a-z]+', 0)"


@query("regex_tokens_to_columns", f"SELECT p_partkey, {_WORDS}[1] AS w1, {_WORDS}[2] AS w2, {_WORDS}[3] AS w3 FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", "p_name").transform(Regex("p_name", "[a-z]+", "tokenize", ignore_case=False, n=3, root="w")).drop("p_name")


@query("regex_tokens_error", "SELECT p_partkey, CASE WHEN len(x) > 1 THEN 'ERROR: Found ' || len(x) || ' regex matches, but only 1 columns expected' ELSE x[1] END AS w1 FROM (SELECT p_partkey, regexp_extract_all(p_type, '[AEIOU]', 0) AS x FROM part)")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", "p_type").transform(Regex("p_type", "[AEIOU]", "tokenize", ignore_case=False, n=1, extra="dropExtraWithError", root="w")).drop("p_type")


@query("regex_tokens_rest", "SELECT p_partkey, x[1] AS w1, CASE WHEN len(x) >= 2 THEN array_to_string(x[2:], '') END AS w2 FROM (SELECT p_partkey, regexp_extract_all(p_type, '[A-Z]{2}', 0) AS x FROM part)")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", "p_type").transform(Regex("p_type", "[A-Z]{2}", "tokenize", ignore_case=False, n=2, extra="saveAllRemainingText", root="w")).drop("p_type")


@query("regex_tokens_to_rows", "SELECT doc_id, unnest(x) AS token, generate_subscripts(x, 1) AS token_position FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+', 0) AS x FROM documents)")
def _(spark, d):
    out = load(spark, d, "documents").select("doc_id", "text").transform(Regex("text", "[0-9]+", "tokenize", tokenize_output="splitRows", root="token"))
    return _long(out.drop("text"), "token_position")


@query("regex_match", "SELECT o_orderkey, CAST(coalesce(regexp_matches(nullif(o_orderpriority, '5-LOW'), '(?i)^[1-3]-.*h'), false) AS INTEGER) AS regex_match FROM orders")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p")).transform(Regex("p", "^[1-3]-.*h", "match")).drop("p")


@query("regex_match_filter", "SELECT o_orderkey, 1 AS hit FROM orders WHERE regexp_matches(o_orderpriority, '^[12]-')")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_orderpriority").transform(Regex("o_orderpriority", "^[12]-", "match", match_column="hit", only_matches=True)).drop("o_orderpriority")


@query("text_to_columns", "SELECT o_orderkey, split_part(o_orderpriority, ' ', 1) AS root_1_generated, CASE WHEN contains(o_orderpriority, ' ') THEN substr(o_orderpriority, strpos(o_orderpriority, ' ') + 1) END AS root_2_generated FROM orders")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_orderpriority").transform(TextToColumns("o_orderpriority", " ", n=2)).drop("o_orderpriority")


@query("text_to_columns_drop", "SELECT page_id, string_split(url, '/')[3] AS u_3_x, string_split(url, '/')[4] AS u_4_x FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", "url").transform(TextToColumns("url", "/", n=4, extra="Drop extra", prefix="u", suffix="x")).drop("url", "u_1_x", "u_2_x")


@query("text_to_rows", "SELECT conv_id, turn, regexp_replace(unnest(string_split(coalesce(nullif(text, ''), ''), '. ')), '[{}_]', ' ', 'g') AS sentence FROM conversations")
def _(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", "text").transform(TextToColumns("text", ". ", "splitRows", rows_column="sentence")).drop("text")


@query("json_parse", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", "props").transform(JSONParse("props", sample='{"k": 1}')).select("event_id", F.col("props_parsed.k").alias("k"))


@query("json_parse_schema", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, NULL::VARCHAR AS absent FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", "props").transform(JSONParse("props", "parseFromSchema", schema="k double, absent string")).select("event_id", F.col("props_parsed.k").alias("k"), F.col("props_parsed.absent").alias("absent"))


@query("xml_parse", "SELECT c_custkey, c_custkey AS k, c_mktsegment AS s FROM customer")
def _(spark, d):
    made = F.concat(F.lit("<c><k>"), F.col("c_custkey").cast("string"), F.lit("</k><s>"), F.col("c_mktsegment"), F.lit("</s></c>"))
    return load(spark, d, "customer").select("c_custkey", made.alias("x")).transform(XMLParse("x", sample="<c><k>1</k><s>text</s></c>")).select("c_custkey", F.col("x_parsed.k").alias("k"), F.col("x_parsed.s").alias("s"))


# --- imputation and matching -------------------------------------------------------------------------------------

_HOLES = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 != 0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 7 != 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 3 != 0 THEN o_orderpriority END AS o_orderpriority FROM orders"


def _holes(spark: SparkSession, d: str) -> DataFrame:
    hole = lambda c, n: F.when(F.col("o_orderkey") % n != 0, F.col(c)).alias(c)
    return load(spark, d, "orders").select("o_orderkey", hole("o_custkey", 5), hole("o_totalprice", 7), hole("o_orderpriority", 3))


@query("impute_average", f"WITH t AS ({_HOLES}) SELECT o_orderkey, coalesce(o_custkey, (SELECT CAST(trunc(avg(o_custkey)) AS BIGINT) FROM t)) AS o_custkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM t)), 4) AS o_totalprice, CAST(o_custkey IS NULL AS INTEGER) AS \"o_custkey_Indicator\", CAST(o_totalprice IS NULL AS INTEGER) AS \"o_totalprice_Indicator\" FROM t")
def _(spark, d):
    return _rounded(_holes(spark, d).drop("o_orderpriority").transform(Imputation(["o_custkey", "o_totalprice"], indicator=True)), 4, "o_totalprice")


_FEW = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 7 != 0 THEN l_quantity END AS l_quantity FROM lineitem"


@query("impute_median", f"WITH t AS ({_FEW}) SELECT *, coalesce(l_quantity, (SELECT quantile_disc(l_quantity, 0.5) FROM t)) AS \"l_quantity_ImputedValue\" FROM t")
def _(spark, d):
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")).alias("l_quantity"))
    return lines.transform(Imputation(["l_quantity"], "median", keep_original=True))


@query("impute_mode", f"WITH t AS ({_HOLES}) SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM t WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority FROM t")
def _(spark, d):
    return _holes(spark, d).select("o_orderkey", "o_orderpriority").transform(Imputation(["o_orderpriority"], "mode"))


@query("impute_sentinel", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber END AS number, round(CASE WHEN l_quantity = 1 THEN (SELECT avg(l_quantity) FROM lineitem WHERE l_quantity != 1) ELSE l_quantity END, 6) AS l_quantity FROM lineitem")
def _(spark, d):
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_linenumber").alias("number"), "l_quantity")
    out = lines.transform(Imputation(["number"], "user_value", sentinel=1, user_value=0)).transform(Imputation(["l_quantity"], sentinel=1))
    return _rounded(out, 6, "l_quantity")


def _fuzzy(where: str, table: str, key: str, name: str, threshold: int) -> str:
    return f"""
    WITH t AS (SELECT CAST({key} AS VARCHAR) AS id, upper(regexp_replace({name}, '[[:punct:]]', '', 'g')) AS v, * FROM {table}),
    p AS (SELECT greatest(a.id, b.id) AS record_id1, least(a.id, b.id) AS record_id2, round((1 - levenshtein(a.v, b.v) / CAST(greatest(length(a.v), length(b.v)) AS DOUBLE)) * 100, 2) AS similarity_score FROM t a JOIN t b ON a.id > b.id {where})
    SELECT * FROM p WHERE similarity_score >= {threshold}"""


@query("fuzzy_match_purge", _fuzzy("", "supplier", "s_suppkey", "s_name", 94))
def _(spark, d):
    return load(spark, d, "supplier").transform(FuzzyMatch("s_suppkey", [MatchField("s_name", "name")], threshold=94, with_score=True))


@query("fuzzy_match_merge", _fuzzy("AND a.s_nationkey != b.s_nationkey", "supplier", "s_suppkey", "s_name", 94))
def _(spark, d):
    return load(spark, d, "supplier").transform(FuzzyMatch("s_suppkey", [MatchField("s_name")], "MERGE", "s_nationkey", 94, True))


@query("fuzzy_match_blocked", _fuzzy("AND a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment", "customer", "c_custkey", "c_name", 94))
def _(spark, d):
    return load(spark, d, "customer").transform(FuzzyMatch("c_custkey", [MatchField("c_name")], threshold=94, with_score=True, block_on="concat(c_nationkey, ' ', c_mktsegment)"))


# --- generated rows ------------------------------------------------------------------------------------------------


@query("generate_rows", "SELECT unnest(range(1, 98, 3)) AS value")
def _(spark, d):
    return _long(GenerateRows("1", "value <= 97", "value + 3")(spark), "value")


@query("generate_rows_per_row", "SELECT n_nationkey, n_regionkey, unnest(range(n_regionkey, n_nationkey)) AS i FROM nation")
def _(spark, d):
    return _long(load(spark, d, "nation").select("n_nationkey", "n_regionkey").transform(GenerateRows("payload.n_regionkey", "i < payload.n_nationkey", "i + 1", "i")), "i")


@query("generate_rows_loop", "WITH RECURSIVE g AS (SELECT n_nationkey, CAST(n_nationkey + 1 AS BIGINT) AS v FROM nation UNION ALL SELECT n_nationkey, v * 2 + 1 FROM g WHERE v * 2 + 1 < 1000) SELECT * FROM g")
def _(spark, d):
    return load(spark, d, "nation").select("n_nationkey").transform(GenerateRows("cast(payload.n_nationkey + 1 AS bigint)", "v < 1000", "v * 2 + 1", "v"))


@query("generate_rows_dates", "SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-04-09', INTERVAL 1 DAY)) AS DATE) AS day")
def _(spark, d):
    return GenerateRows("2024-01-01", "day < date '2025-01-01'", "date_add(day, 1)", "day")(spark)


# --- tables and what is yet to be written ---------------------------------------------------------------------------------


def _after(spark: SparkSession, d: str, *steps: TableOperations, say: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """``say`` of a copy of the orders after ``steps``, each made for that copy's name; its few rows outlive the copy."""
    name = f"millrace_{uuid.uuid4().hex}"
    load(spark, d, "orders").write.saveAsTable(name)
    try:
        for step in steps:
            step(name)(spark)
        found = say(spark, name)
        return spark.createDataFrame(found.collect(), found.schema)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _by_status(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_BY_STATUS = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {} GROUP BY 1, 2"


@query("table_delete", _BY_STATUS.format("orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 1000)"))
def _(spark, d):
    return _after(spark, d, lambda t: TableOperations(t, "deleteFromTable", delete_condition="o_orderstatus = 'F' AND o_totalprice > 1000"), say=_by_status)


@query("table_update", _BY_STATUS.format("(SELECT o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN concat(o_orderpriority, ', seen') ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders)"))
def _(spark, d):
    return _after(spark, d, lambda t: TableOperations(t, "updateTable", update_set="o_orderpriority = concat(o_orderpriority, ', seen'), o_totalprice = o_totalprice + 1", update_condition="o_orderkey % 3 = 0"), say=_by_status)


@query("table_optimise", _BY_STATUS.format("orders"))
def _(spark, d):
    return _after(spark, d, lambda t: TableOperations(t, "optimiseTable", zorder=["o_custkey", "o_orderkey"]), say=_by_status)


@query("table_run_ddl", "SELECT count(*) AS n, count(*) - count(NULL) AS without FROM orders")
def _(spark, d):
    return _after(spark, d, lambda t: TableOperations(t, "runDDL", ddl="ALTER TABLE {table_name} ADD COLUMNS (note string)"), say=lambda s, t: s.table(t).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("note").isNull(), 1)).alias("without")))


@query("table_register", "SELECT count(*) AS n, min(o_orderkey) AS least, max(o_orderkey) AS most FROM orders")
def _(spark, d):
    name = f"millrace_{uuid.uuid4().hex}"
    TableOperations(name, "registerTableInCatalog", path=f"{d.rstrip('/')}/orders.parquet")(spark)
    try:
        found = spark.table(name).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"))
        return spark.createDataFrame(found.collect(), found.schema)
    finally:
        spark.sql(f"DROP TABLE {name}")


@query("table_drop", "SELECT 'dropTable' AS operation, 'Success' AS status, false AS there")
def _(spark, d):
    def drop(spark: SparkSession, name: str) -> DataFrame:
        said = TableOperations(name, "dropTable")(spark)
        return said.select("operation", "status", F.lit(spark.catalog.tableExists(name)).alias("there"))

    return _after(spark, d, say=drop)


@query("table_no_action", "SELECT 'No Action' AS operation, '`orders`' AS target_table, 'Failed' AS status")
def _(spark, d):
    return TableOperations("orders", "")(spark).drop("executed_at")


@query("todo", "SELECT 'ToDo: rank the regions' AS message, true AS raised")
def _(spark, d):
    message = ""
    try:
        load(spark, d, "region").transform(ToDo("rank the regions")).collect()
    except Exception as e:  # what the operator is for
        message = str(e)
    wanted = "ToDo: rank the regions"
    return spark.createDataFrame([(wanted, wanted in message)], "message string, raised boolean")


# --- modes that draw or hash, by what holds of them --------------------------------------------------------------------


@query("sample_random_holds", "SELECT 500 AS n, 500 AS ids, 500 AS known")
def _(spark, d):
    orders = load(spark, d, "orders")
    found = orders.transform(Sample("randomN", 500))
    return found.join(orders.select(F.col("o_orderkey").alias("k")), F.col("k") == F.col("o_orderkey"), "left").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("ids"), F.count("k").alias("known")).select(*[F.col(c).cast("int").alias(c) for c in ("n", "ids", "known")])


@query("sample_random_percent", "SELECT CAST(ceil(count(*) * 10 / 100.0) AS BIGINT) AS n, CAST(ceil(count(*) * 10 / 100.0) AS BIGINT) AS ids FROM orders")
def _(spark, d):
    return load(spark, d, "orders").transform(Sample("randomNPercent", 10, spread=True)).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("ids"))


@query("record_id_uuid_holds", "SELECT count(*) AS n, count(*) AS ids, count(*) AS formed FROM orders")
def _(spark, d):
    ids = load(spark, d, "orders").transform(RecordID("uuid"))
    return ids.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("RecordID").alias("ids"), F.count(F.when(F.col("RecordID").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), 1)).alias("formed"))


@query("masking_hash_holds", "SELECT count(DISTINCT c_name) AS names, count(DISTINCT c_name) AS hashes, count(DISTINCT c_name) AS pairs FROM customer")
def _(spark, d):
    step = load(spark, d, "customer").select("c_name", F.col("c_name").alias("masked")).transform(DataMasking(["masked"], "hash"))
    return step.agg(F.countDistinct("c_name").alias("names"), F.countDistinct("masked").alias("hashes"), F.countDistinct("c_name", "masked").alias("pairs"))


# --- modes not met above ------------------------------------------------------------------------------------------------


@query("record_id_string", "SELECT lpad(CAST(row_number() OVER (ORDER BY o_orderkey) + 6 AS VARCHAR), 8, '0') AS \"RecordID\", o_orderkey FROM orders")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderkey").transform(RecordID(type="string", size=8, start=7, order_by=["o_orderkey"]))


@query("find_duplicates_row_number_equal", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 3")
def _(spark, d):
    return load(spark, d, "orders").transform(FindDuplicates(["o_custkey"], "custom_row_number", "selectedCols", "equal_to", 3, order_by=["o_orderkey"])).select("o_orderkey")


@query("find_duplicates_row_number_greater", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n > 9")
def _(spark, d):
    return load(spark, d, "orders").transform(FindDuplicates(["o_custkey"], "custom_row_number", "selectedCols", "greater_than", 9, order_by=["o_orderkey"])).select("o_orderkey")


for _name, _condition, _values, _where in (("less", "less_than", {"n": 8}, "n < 8"), ("not_equal", "not_equal_to", {"n": 10}, "n != 10"), ("between", "between", {"lower": 9, "upper": 11}, "n BETWEEN 9 AND 11")):
    query(f"find_duplicates_count_{_name}", _by_count(_where))(lambda spark, d, c=_condition, v=_values: load(spark, d, "orders").transform(FindDuplicates(["o_custkey"], "custom_group_count", "selectedCols", c, **v)))


@query("running_total_unordered", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS last, count(DISTINCT o_orderkey) AS steps FROM orders")
def _(spark, d):
    """Totals in the order in which rows come: as many as rows, rising, the last the sum of all."""
    out = load(spark, d, "orders").select("o_orderkey").transform(RunningTotal(["o_orderkey"], spread=True))
    return out.agg(F.count(F.lit(1)).alias("n"), F.max("RunTot_o_orderkey").alias("last"), F.countDistinct("RunTot_o_orderkey").alias("steps"))


@query("running_total_text_key", "SELECT c_custkey, round(sum(c_acctbal) OVER (ORDER BY c_name ROWS UNBOUNDED PRECEDING), 2) AS \"RunTot_c_acctbal\" FROM customer")
def _(spark, d):
    out = load(spark, d, "customer").transform(RunningTotal(["c_acctbal"], order_by=["c_name"], spread=True))
    return _rounded(out.select("c_custkey", "RunTot_c_acctbal"), 2, "RunTot_c_acctbal")


@query("running_total_time_key", "SELECT event_id, count(*) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS \"RunTot_one\" FROM events")
def _(spark, d):
    out = load(spark, d, "events").select("event_id", "ts", F.lit(1).alias("one")).transform(RunningTotal(["one"], order_by=["ts", "event_id"], spread=True))
    return out.select("event_id", "RunTot_one")


@query("tile_smart_table", "WITH s AS (SELECT o_orderkey, o_totalprice AS x, avg(o_totalprice) OVER () AS m, stddev_samp(o_totalprice) OVER () AS s FROM orders) SELECT o_orderkey, CAST(floor((x - m) / s + 0.5) AS BIGINT) AS \"Tile_Num\" FROM s")
def _(spark, d):
    return _long(load(spark, d, "orders").transform(Tile("smart_tile", "o_totalprice")).select("o_orderkey", "Tile_Num"), "Tile_Num")


@query("dynamic_select_none", "SELECT CAST(NULL AS VARCHAR) AS no_columns_matched FROM region")
def _(spark, d):
    return load(spark, d, "region").transform(DynamicSelect(["Date"]))


@query("regex_first_groups", "SELECT p_partkey, nullif(regexp_extract(p_type, '([A-Z])([A-Z]+)', 1), '') AS w1, nullif(regexp_extract(p_type, '([A-Z])([A-Z]+)', 2), '') AS w2 FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", "p_type").transform(Regex("p_type", "([A-Z])([A-Z]+)", "tokenize", ignore_case=False, tokenize_output="firstGroups", n=2, root="w")).drop("p_type")


@query("regex_detected_groups", "SELECT page_id, nullif(regexp_extract(url, 'https?://([^/]+)/([a-z]+)/([0-9]+)', 1), '') AS host, TRY_CAST(regexp_extract(url, 'https?://([^/]+)/([a-z]+)/([0-9]+)', 3) AS INTEGER) AS regex_col3 FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", "url").transform(Regex("url", "https?://(?<host>[^/]+)/([a-z]+)/([0-9]+)", "parse", ignore_case=False)).drop("url", "regex_col2")


@query("xml_parse_schema", "SELECT c_custkey, c_custkey AS k, c_mktsegment AS s FROM customer")
def _(spark, d):
    made = F.concat(F.lit("<c><k>"), F.col("c_custkey").cast("string"), F.lit("</k><s>"), F.col("c_mktsegment"), F.lit("</s></c>"))
    return load(spark, d, "customer").select("c_custkey", made.alias("x")).transform(XMLParse("x", "parseFromSchema", schema="k bigint, s string")).select("c_custkey", F.col("x_parsed.k").alias("k"), F.col("x_parsed.s").alias("s"))


_PAIRS = "SELECT greatest(a.id, b.id) AS record_id1, least(a.id, b.id) AS record_id2, 100.0::DOUBLE AS similarity_score FROM (SELECT CAST(s_suppkey AS VARCHAR) AS id, {0} AS v FROM supplier) a JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS id, {0} AS v FROM supplier) b ON a.id > b.id AND {1}"


@query("fuzzy_match_equals", _PAIRS.format("CAST(s_nationkey AS VARCHAR)", "a.v = b.v"))
def _(spark, d):
    return load(spark, d, "supplier").transform(FuzzyMatch("s_suppkey", [MatchField("s_nationkey", "equals")], threshold=100, with_score=True))


@query("fuzzy_match_phone", _PAIRS.format("substr(s_name, length(s_name), 1)", "a.v = b.v"))
def _(spark, d):
    return load(spark, d, "supplier").select("s_suppkey", F.expr("right(s_name, 1)").alias("p")).transform(FuzzyMatch("s_suppkey", [MatchField("p", "phone")], threshold=100, with_score=True))


@query("fuzzy_match_exact", _PAIRS.format("right(s_name, 2)", "a.v = reverse(b.v)"))
def _(spark, d):
    return load(spark, d, "supplier").select("s_suppkey", F.expr("right(s_name, 2)").alias("p")).transform(FuzzyMatch("s_suppkey", [MatchField("p", "exact")], threshold=100, with_score=True))
