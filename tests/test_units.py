import pytest
from pyspark.sql import functions as F

from pagelens.operators import units

UNITS = [("мм", "length", 0.001), ("см", "length", 0.01), ("м", "length", 1.0), ("м2", "area", 1.0), ("га", "area", 10000.0), ("м3", "volume", 1.0), ("м3/ч", "flow", 1 / 3600), ("л/с", "flow", 0.001), ("МПа", "pressure", 1e6), ("кПа", "pressure", 1e3), ("кВт", "power", 1e3), ("МВт", "power", 1e6), ("%", "ratio", 0.01), ("‰", "ratio", 0.001), ("кг", "mass", 1.0), ("т", "mass", 1000.0), ("тыс.м2", "area", 1000.0)]
TEXTS = [
    ("2,09 Гкал/час", 2.09, "гкал/час"),
    ("пом. 849: 11.02m", 11.02, "m"),
    ("см. лист 7", None, None),
    ("вылет в осях 9-18 составляет 14,9\xa0М", 14.9, "м"),
    ('{"value": "1,49", "unit": "KW"}', 1.49, "кw"),
    ("3.602,4 м3/сут", 3602.4, "м3/сут"),
    ("1 104\xa0м3/сутки", 1104.0, "м3/сутки"),
    ("расход, л / с - 112,4444", 112.4444, "л/с"),
    ("Q (Гкал/час): 0,154", 0.154, "гкал/час"),
    ("площадь, м2 - 2", 2.0, "м2"),
    ("109 920 м3 (лист 34)", 109920.0, "м3"),
    ("1,234,567.5", 1234567.5, ""),
    ("７0 мм", 70.0, "мм"),
    ("вместимость (л.): 5,5", 5.5, "л"),
    ("12 л. (л. 3)", 12.0, "л"),
    ("не указано", None, None),
    ("", None, None),
    (None, None, None),
    ("—", None, None),
]


def test_stated(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TEXTS)], "i int, t string").select("i", units.stated(F.col("t")).alias("s"))
    got = {r.i: (r.s.number, r.s.unit) if r.s else (None, None) for r in df.collect()}
    for i, (t, number, unit) in enumerate(TEXTS):
        assert got[i] == (number, unit), t


@pytest.mark.parametrize(("a", "b", "near"), [("килограммов", "килограмм", True), ("мм", "м", False), ("м2", "м3", False), ("кв. м", "кв.м", True), ("см", "мм", False), ("гкал/час", "гкал/чаc".replace("c", "с"), True)])
def test_weighted_distance(a, b, near):
    limit = min(units.FAR, max(units.NEAR, units.SHARE * max(len(a), len(b))))
    assert (units.weighted_distance(a, b) <= limit) == near
    assert units.weighted_distance(a, b) == units.weighted_distance(b, a)


def tables(spark, checks):
    params = spark.createDataFrame([(1, "A-1", "Площадь", "кв. м", "number"), (2, "A-2", "Давление, кпа", None, "number"), (3, "A-3", "Тип", "Марка", "enum"), (4, "A-4", "Расход", " м³/ч", "number")], "id int, code string, parameter_name string, unit string, data_type string")
    return spark.createDataFrame(checks, "check_id string, parameter_code string, pd_value string, rd_value string"), params, spark.createDataFrame(UNITS, "canon string, dimension string, si_factor double")


CHECKS = [
    ("same", "A-1", "2 900 м.кв.", "2900 м2"),
    ("hectares", "A-1", "18600", "1.86 га"),
    ("near", "A-1", "18600", "1.869 га"),
    ("far", "A-1", "18600", "1.9 га"),
    ("pressure", "A-2", "0,2285 MPa", "228,5 кпа"),
    ("dimension", "A-2", "0,2285 MPa", "228,5 кВт"),
    ("flow", "A-4", "3,6 куб.м/ч", "1 л / с"),
    ("flow", "A-4", "3,6 куб.м/ч", "1 л / с"),
    ("enum", "A-3", "1 м", "100 см"),
    ("null", "A-1", None, "1 га"),
    ("long", "A-1", "слово " * 5000, "1 га"),
]


def test_same_amount_other_unit(spark):
    checks, params, u = tables(spark, CHECKS)
    a = units.amounts(checks.withColumn("unit", F.lit("x")), "check_id", "parameter_code", ["pd_value", "rd_value"], params, u)
    got = [r.key for r in units.same_amount_other_unit(a, "pd_value", "rd_value").collect()]
    assert sorted(got) == ["flow", "hectares", "near", "pressure"]


def test_empty(spark):
    checks, params, u = tables(spark, [])
    a = units.amounts(checks, "check_id", "parameter_code", ["pd_value", "rd_value"], params, u)
    assert a.count() == 0 and units.same_amount_other_unit(a, "pd_value", "rd_value").count() == 0
