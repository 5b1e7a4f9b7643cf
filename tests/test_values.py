import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from retroledger.functions import redact, values
from retroledger.model import contains, same_value


def one(spark, column, **given):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items())) if given else spark.range(1)
    return df.select(column.alias("x")).head()["x"]


@pytest.mark.parametrize(("native", "kind"), [("BIGINT unsigned", "integer"), ("year", "integer"), ("numeric(3)", "decimal"), ("double", "float"), ("varbinary(3)", "binary"), ("longtext", "text"), ("datetime(6)", "datetime"), ("timestamp", "datetime"), ("date", "date"), ("time", "time"), ("json", "json"), ("bit(64)", "bit"), ("enum('a')", "enum"), ("set('a')", "set"), ("geometry", "unknown")])
def test_kinds(spark, native, kind):
    assert one(spark, values.kind_of(F.col("n")), n=native) == kind


def test_numbers(spark):
    assert str(one(spark, values.unsigned(F.lit(-1).cast("long")))) == "18446744073709551615"
    assert str(one(spark, values.unsigned(F.lit(-81985529216486896).cast("long")))) == "18364758544493064720"
    assert one(spark, values.bit_text(F.unhex(F.lit("FEDCBA9876543210")))) == "18364758544493064720"
    assert bytes(one(spark, values.bit_bytes(F.lit("18364758544493064720"), 64))).hex() == "fedcba9876543210"
    assert one(spark, values.bit_bytes(F.lit("4"), 2)) is None
    assert [one(spark, values.integer_text(F.lit(x))) for x in ("+0017", " -5 ", "-0", "1.5", "")] == ["17", "-5", "0", None, None]
    assert one(spark, values.float_text(F.lit(float("nan")))) is None


def test_members():
    assert values.members("enum('alpha','beta','雪')") == ["alpha", "beta", "雪"]
    assert values.members("set('it''s', 'a\\'b','c,d')") == ["it's", "a'b", "c,d"]
    with pytest.raises(ValueError):
        values.members("enum('a'")
    with pytest.raises(ValueError):
        values.members("enum(a)")


def test_labels(spark):
    enum, flags = (F.array(*map(F.lit, x)) for x in (("alpha", "beta", "雪"), ("red", "green", "蓝")))
    assert one(spark, values.enum_label(F.lit(3), enum)) == "雪"
    assert one(spark, values.set_labels(F.lit(5), flags)) == "red,蓝"
    assert one(spark, values.set_labels(F.lit(8), flags)) is None


def test_equality(spark):
    v = lambda native, x: values.value(native, F.lit(x))
    equal = lambda a, b: one(spark, same_value(a, b))
    assert not equal(v("bigint", "9007199254740992"), v("bigint", "9007199254740993"))
    assert equal(v("decimal(4,2)", "1.0"), v("decimal(4,2)", "1.00"))
    assert not equal(v("varchar(3)", "1.0"), v("varchar(3)", "1.00"))
    assert equal(v("varchar(3)", None), v("varchar(3)", None)) and not equal(v("varchar(3)", None), v("varchar(3)", ""))
    assert one(spark, values.plain(values.value("varchar(9)", F.lit('a"\\b\n')))) == 'a"\\b\n'
    assert one(spark, values.value("varbinary(2)", F.unhex(F.lit("00FF"))))["data"] == '"AP8="'
    assert one(spark, values.plain(values.value("json", F.lit('{"b":1,"a":9007199254740993}')))) == '{"a":9007199254740993,"b":1}'


def test_undecodable_values_fail(spark):
    for native, raw in (("geometry", "x"), ("int", "1x"), ("decimal(3)", "1e5")):
        with pytest.raises(PySparkException):
            one(spark, values.value(native, F.lit(raw)))


def test_predicate_and_redaction(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [r.a for r in df.where(values.predicate([{"a": F.lit(1), "b": F.lit(None)}, {"a": F.lit(9)}])).collect()] == [1]
    with pytest.raises(ValueError):
        values.predicate([])
    row = values.row({"id": ("bigint", F.lit("7")), "note": ("text", F.lit("y" * 40)), "raw": ("blob", F.lit("z")), "none": ("text", F.lit(None))})
    assert one(spark, redact.row_summary(row)) == "id=7, note=<text len=40>, raw=<binary len=4>, none=NULL"
    assert one(spark, contains(row, row))
    assert [one(spark, redact.truncated(F.lit(x), 4)) for x in ("abcd", "abcde")] == ["abcd", "abc…"]
    assert one(spark, redact.or_dash(F.lit(""))) == "-" and one(spark, redact.first_word(F.lit("  ab cd"))) == "ab"
