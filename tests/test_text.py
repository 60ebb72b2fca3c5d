import pytest
from pyspark.sql import functions as F

from docloom.plans import catalog
from docloom.functions import text as fn


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("said", "tokens"),
    [("", []), ("a", []), ("ab", ["ab"]), ("车窗 PEPS_Mode", ["车", "窗", "peps_mode", "车窗"]), ("车x窗", ["车", "窗", "车窗"]), ("单", ["单"]), (None, [])],
)
def test_tokenize(spark, said, tokens):
    assert one(spark, fn.tokenize("t"), t=said) == tokens


@pytest.mark.parametrize(("said", "n"), [("", 1), (None, 1), ("车窗", 3), ("a" * 10, 3), ("车窗" + "a" * 10, 6)])
def test_estimate_tokens(spark, said, n):
    assert one(spark, fn.estimate_tokens("t"), t=said) == n


@pytest.mark.parametrize(("said", "low", "high"), [("9V-16V", 9, 16), (">18V", 18, 99), ("<6V", 0, 6), ("none", None, None), (None, None, None)])
def test_voltage(spark, said, low, high):
    assert tuple(one(spark, fn.voltage_range("t"), t=said)) == (low, high)


@pytest.mark.parametrize(("said", "value"), [("CONFIDENCE=0.8", 0.8), ("置信度：0.7", 0.7), ("85%", 0.85), ("so 3 of 0.25", 0.25), ("none", 0.5), ("confidence: 90", 0.9), (None, 0.5)])
def test_confidence(spark, said, value):
    assert one(spark, fn.confidence("t"), t=said) == pytest.approx(value)


def test_small_functions(spark):
    assert [tuple(x) for x in one(spark, fn.coding_list("t"), t="0x0=Off, 0x1＝On, bad")] == [("0x0", "Off"), ("0x1", "On")]
    assert one(spark, fn.section_number("t"), t="3.2.1 Lock") == "3.2.1"
    assert one(spark, fn.section_number("t"), t="Lock") is None
    assert one(spark, fn.safe_id("t"), t="a b--c/处于") == "a_b_c_处于"
    assert one(spark, fn.capitalised("t"), t="driving mode") == "Driving mode"
    assert one(spark, fn.module_name("t"), t="外部灯光控制系统功能规范") == "外部灯光控制系统"
    assert one(spark, fn.module_name("t"), t="Exterior light control unit") == "Exterior_light_contr"
    assert one(spark, fn.json_part("t"), t='```json\n[{"a": 1}]\n``` done') == '[{"a": 1}]'
    assert one(spark, fn.html_rows("t"), t="<table><tr><th>A</th><td> b <b>c</b></td></tr></table>") == [["A", "b c"]]
    assert one(spark, fn.signals("t"), t="PEPS_Mode == 1 and xy = 2 or z = 3") == ["PEPS_Mode", "xy"]
    assert one(spark, fn.expand_query("t", {"车窗": "Window"}), t="车窗 up") == "车窗 up Window"
    assert one(spark, fn.is_toc_only("t"), t="## a\n## b\n## c\n") is True
    assert one(spark, fn.resolve_days("t", F.lit("2025-03-10").cast("date")), t="since 2025年3月1日") == 9


def test_numbers_beyond_six_digits(spark, tmp_path):
    n = 1_000_050
    docs = spark.range(1, n + 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") <= n - 40, "hot").when(F.col("id") <= n - 10, "cold").alias("source"))
    docs.repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["seq_ids_per_module"](spark, str(tmp_path)).cache()
    assert got.count() == n
    assert got.where("chunk_id is not null").select("chunk_id").distinct().count() == n - 10  # no id without a source, as in SQL
    want = F.when(F.col("doc_id") <= n - 40, F.format_string("chunk_hot_%06d", "doc_id")).when(F.col("doc_id") <= n - 10, F.format_string("chunk_cold_%06d", F.col("doc_id") - (n - 40)))
    assert got.where(~F.col("chunk_id").eqNullSafe(want)).count() == 0
