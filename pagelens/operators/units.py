"""Amounts in free text, brought to common units through a fuzzy dictionary of unit spellings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.text import bind
from pagelens.session import cut_lineage, nonblank, small

# Characters of the same shape, and the ones without ink.
LATIN_GREEK = "ABCEHKMOPTXYaceopxykΑΒΕΗΚΜΟΡΤΧοα"
CYRILLIC = "АВСЕНКМОРТХУасеорхукАВЕНКМОРТХоа"
INVISIBLE = "­​‌‍‎‏⁠﻿"
SPACES = "               　\t\n\r"
HYPHENS = "‐‑‒−"

# Reference spellings of each unit; other spellings are found from these.
SPELLINGS: dict[str, tuple[str, ...]] = {
    "мм": ("мм", "mm", "миллиметров", "millimetres"),
    "см": ("см", "cm", "сантиметров", "centimetres"),
    "м": ("м", "m", "метров", "пог. м", "п.м", "погонных метров", "metres"),
    "мм2": ("мм2", "mm2", "кв. мм", "мм кв", "квадратных миллиметров"),
    "см2": ("см2", "cm2", "кв. см", "см кв", "квадратных сантиметров"),
    "м2": ("м2", "m2", "кв. м", "м кв", "квадратных метров", "square metres"),
    "тыс.м2": ("тыс. м2", "тыс. кв. м", "тысяч квадратных метров", "тыс. м кв"),
    "га": ("га", "ha", "гектаров", "hectares"),
    "л": ("л", "l", "литров", "litres"),
    "м3": ("м3", "m3", "куб. м", "м куб", "кубометров", "кубических метров", "cubic metres"),
    "тыс.м3": ("тыс. м3", "тыс. куб. м", "тысяч кубометров", "тысяч кубических метров", "тыс. м куб"),
    "Вт": ("Вт", "W", "ватт", "watts"),
    "кВт": ("кВт", "kW", "киловатт", "kilowatts"),
    "МВт": ("МВт", "MW", "мегаватт", "megawatts"),
    "Гкал/ч": ("Гкал/ч", "Гкал/час", "Gcal/h", "гигакалорий в час"),
    "Па": ("Па", "Pa", "паскалей", "pascals"),
    "кПа": ("кПа", "kPa", "килопаскалей", "kilopascals"),
    "МПа": ("МПа", "MPa", "мегапаскалей", "megapascals"),
    "бар": ("бар", "bar"),
    "м3/ч": ("м3/ч", "м3/час", "m3/h", "куб. м/ч", "куб. м/час", "куб. м в час", "кубометров в час"),
    "л/с": ("л/с", "л/сек", "l/s", "литров в секунду"),
    "м3/сут": ("м3/сут", "м3/сутки", "m3/d", "куб. м/сут", "куб. м в сутки", "кубометров в сутки"),
    "%": ("%", "процентов", "проц", "percent"),
    "‰": ("‰", "промилле", "permille"),
    "кг": ("кг", "kg", "килограммов", "kilograms"),
    "т": ("т", "t", "тн", "тонн", "tonnes"),
}
#: Words before a number that only points somewhere.
POINTER_STEMS = ("лист", "л.", "пом", "ос", "стр", "этаж", "узел", "разрез", "секци", "прим", "№")
POINTERS = r"лист\w*|пом\w*|осях|оси|ось|стр\w*|этаж\w*|узел|разрез\w*|секци\w*|прим\w*|№"

GRAMS = 2
#: Weights of the edit distance: a mark or blank, a letter of a word's ending, another letter, a digit.
MARK, ENDING, LETTER, DIGIT = 0.1, 0.25, 1.0, 3.0
#: Distance allowed: a share of the longer spelling's length, at least NEAR, at most FAR.
SHARE, NEAR, FAR = 0.12, 0.35, 1.5


def _one_table() -> dict[str, str]:
    """Each character that needs it and what it becomes, in one step; '' for removed ones."""
    shapes = dict(zip(LATIN_GREEK + "ëË²³", CYRILLIC + "ёЁ23"))
    table = dict.fromkeys(INVISIBLE, "") | dict.fromkeys(SPACES, " ") | dict.fromkeys(HYPHENS, "-") | shapes
    return table | {chr(c): shapes.get(chr(c - 0xFEE0), chr(c - 0xFEE0)) for c in range(0xFF01, 0xFF5F)}


def clean(col) -> F.Column:
    """Text without ink-less characters, with plain blanks, hyphens, digits and width, raised digits on the line, look-alikes Cyrillic."""
    table = sorted(_one_table().items(), key=lambda x: x[1] == "")  # those without a counterpart are removed
    col = F.translate(col.cast("string"), "".join(k for k, _ in table), "".join(v for _, v in table))
    return F.when(F.contains(col, F.lit("\u0308")) | F.contains(col, F.lit("\u0306")), F.replace(F.replace(F.replace(F.replace(col, F.lit("е\u0308"), F.lit("ё")), F.lit("Е\u0308"), F.lit("Ё")), F.lit("и\u0306"), F.lit("й")), F.lit("И\u0306"), F.lit("Й"))).otherwise(col)


def spelling(col) -> F.Column:
    """The form in which spellings of units are compared: lower case, one blank between words, no outer blanks, stops or commas."""
    col = F.regexp_replace(F.regexp_replace(F.lower(col), r"\s+", " "), r"\s*([/.])\s*", "$1")
    return F.regexp_replace(F.regexp_replace(col, r"^[\s.,;:=]+|[\s.,;:]+$", ""), r"\.(?=\S)", ". ")


NUMBER = r"(?=[-\d])(?<![\wа-яёА-ЯЁ.,/])-?(?:\d{1,3}(?: \d{3})+(?:[.,]\d+)*(?!\d)|\d+(?:[.,]\d+)*)"


def _figure(raw) -> F.Column:
    """The double that digits with blanks, points and commas write, or null."""
    dots, commas = (F.length(raw) - F.length(F.translate(raw, c, "")) for c in ".,")
    last_comma = F.locate(",", F.reverse(raw)) < F.locate(".", F.reverse(raw))
    plain = (
        F.when((dots > 0) & (commas > 0) & last_comma, F.translate(F.translate(raw, ".", ""), ",", "."))
        .when((dots > 0) & (commas > 0), F.translate(raw, ",", ""))
        .when(commas == 1, F.translate(raw, ",", "."))
        .when(commas > 1, F.translate(raw, ",", ""))
        .when(dots > 1, F.translate(raw, ".", ""))
        .otherwise(raw)
    )
    return F.translate(plain, " ", "").try_cast("double")


def _unit(before, after) -> F.Column:
    """The unit's text after the figure; else in brackets or after a comma before it; else ''."""
    bracket = nonblank(F.regexp_extract(before, r"\(([^()]*)\)\s*[:=-]?\s*$", 1))
    comma = nonblank(F.regexp_extract(before, r",\s*([^,()]*?)\s*[:=-]\s*$", 1))
    return spelling(F.coalesce(nonblank(F.regexp_extract(after, r"^([^()]*)", 1)), bracket, comma, F.lit("")))


def stated(value) -> F.Column:
    """struct(number, unit) of the quantity that a free text states; unit '' for a bare number; null where it states none.

    Numbers that follow a pointing word (sheet, room, axes ...) and those of ranges of axes are no
    part of it.  The unit stands after the figure, or before it in brackets or after a comma, or
    in a field of its own of a JSON object.  Where a text has both points and commas the last one
    is the decimal sign; a single one is; several of one kind part thousands, as blanks do.
    """
    pointing = rf"(?<![а-яё])(?:см\.\s*)?(?:{POINTERS})\.?\s*№?\s*\d+(?:\s*-\s*\d+)?\s*:?"
    json = r'^\s*\{[^:]*:\s*"?([^"]*?)"?\s*,\s*"[^"]*"\s*:\s*"([^"]*)"\s*\}\s*$'

    def has(text, *words):
        out = F.contains(text, F.lit(words[0]))
        for w in words[1:]:
            out = out | F.contains(text, F.lit(w))
        return out

    def without_pointers(text):
        text = F.regexp_replace(F.regexp_replace(text, rf"\([^()]*(?:{POINTERS}|л)\.?\s*№?\s*\d[^()]*\)", " "), r"(?<![а-яё])в\s+осях\s+\S+\s+составляет", " ")
        return F.regexp_replace(text, pointing, " ")

    t = bind(F.lower(clean(value)), lambda x: F.when(has(x, "{"), F.regexp_replace(x, json, "$1 $2")).otherwise(x))
    t = bind(t, lambda x: F.when(has(x, *POINTER_STEMS), without_pointers(x)).otherwise(x))

    def parts(text):
        return F.struct(F.regexp_extract(text, f"({NUMBER})", 1).alias("raw"), F.regexp_instr(text, F.lit(NUMBER)).alias("at"), text.alias("text"))

    def read(x):
        return F.when(F.length(x["raw"]) > 0, F.struct(_figure(x["raw"]).alias("number"), _unit(F.substr(x["text"], F.lit(1), x["at"] - 1), F.substr(x["text"], x["at"] + F.length(x["raw"]))).alias("unit")))

    return bind(bind(t, parts), read)


def declared_units(params: DataFrame) -> DataFrame:
    """code, unit of the number parameters: from the unit column, or what follows the last comma of the name; null if neither names one."""
    tail = F.when(F.instr("parameter_name", ",") > 0, F.substring_index("parameter_name", ",", -1))
    unit = spelling(clean(F.coalesce(nonblank(F.col("unit")), nonblank(tail))))
    return params.where((F.col("data_type") == "number") & F.col("code").isNotNull()).groupBy("code").agg(F.min(unit).alias("unit"))


def weighted_distance(a: str, b: str) -> float:
    """Edit distance in which marks and blanks weigh little, endings of words of five letters or more less than letters, digits most."""

    def weights(s: str) -> list[float]:
        out, run = [], 0
        for i, ch in enumerate(s):
            run = run + 1 if ch.isalpha() else 0
            rest = 0
            while i + rest < len(s) and s[i + rest].isalpha():
                rest += 1
            out.append(DIGIT if ch.isdigit() or ch in "%‰/" else MARK if not ch.isalpha() else ENDING if run > 4 and rest <= 3 else LETTER)
        return out

    wa, wb = weights(a), weights(b)
    row = [0.0]
    for w in wb:
        row.append(row[-1] + w)
    for x, w in zip(a, wa):
        new = [row[0] + w]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + w, new[j] + wb[j], row[j] + (0.0 if x == y else max(w, wb[j]))))
        row = new
    return row[-1]


def _grams(col) -> F.Column:
    """Distinct character n-grams of a spelling, marks and blanks left out, with its ends marked."""
    s = F.concat(F.lit("^"), F.regexp_replace(col, r"[\s.]", ""), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - (GRAMS - 1)), lambda i: F.substring(s, i, GRAMS)))


def alias_dictionary(spellings: DataFrame, units: DataFrame) -> DataFrame:
    """unit, canon: the distinct spellings (column unit) that name one of the units (column canon).

    Each reference stands in the list's case and in capitals, since look-alikes differ by case.
    The n-grams of the reference spellings, a fixed list, are the inverted index; a spelling's
    candidates are the references that share at least half of the grams of the shorter of the
    two, and those that share the most.  Candidates are verified by the weighted edit distance;
    a spelling is taken if its nearest reference is near enough and no other unit is as near.
    A character too much costs MARK at least, so a spelling that is longer than every reference by
    more than FAR / MARK characters is near to none and need not be looked up.  Empty and null
    spellings name none.
    """
    spark = spellings.sparkSession
    fixed = spark.createDataFrame([(c, s) for c, names in SPELLINGS.items() for n in names for s in {n, n.upper()}], "canon string, ref string")
    known = small(units.select("canon").distinct())
    fixed = fixed.join(known, "canon", "left_semi").unionByName(units.select("canon", F.col("canon").alias("ref"))).select("canon", spelling(clean(F.col("ref"))).alias("ref")).distinct()
    index = fixed.withColumn("grams", _grams(F.col("ref"))).select("canon", "ref", F.size("grams").alias("n_ref"), F.explode("grams").alias("gram"))
    longest = max(len(n) for names in SPELLINGS.values() for n in names) + round(FAR / MARK)
    longest = units.agg(F.greatest(F.lit(longest), F.max(F.length("canon")) + round(FAR / MARK)).alias("n")).first()["n"]
    own = spellings.select("unit").where((F.length("unit") > 0) & (F.length("unit") <= longest)).distinct().withColumn("grams", _grams(F.col("unit"))).select("unit", F.size("grams").alias("n_own"), F.explode("grams").alias("gram"))
    pairs = own.join(small(index), "gram").groupBy("unit", "canon", "ref", "n_own", "n_ref").agg((F.count(F.lit(1)) / F.least("n_own", "n_ref")).alias("shared"))
    most = F.max("shared").over(Window.partitionBy("unit"))
    pairs = pairs.withColumn("most", most).where((F.col("shared") >= 0.5) | (F.col("shared") == F.col("most")))

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([weighted_distance(x, y) for x, y in zip(a, b)], dtype="float64")

    near = pairs.withColumn("d", distance("unit", "ref")).where(F.col("d") <= F.least(F.greatest(F.greatest(F.length("unit"), F.length("ref")) * SHARE, F.lit(NEAR)), F.lit(FAR)))
    best = near.groupBy("unit", "canon").agg(F.min("d").alias("d"))
    order = Window.partitionBy("unit").orderBy("d", "canon")
    best = best.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("d").over(order))
    return best.where((F.col("place") == 1) & (F.col("next").isNull() | (F.col("next") > F.col("d")))).select("unit", "canon")


def amounts(rows: DataFrame, key: str, code: str, values: list[str], params: DataFrame, units: DataFrame) -> DataFrame:
    """key, code, field, number, canon, dimension, amount_si, amount, param_unit: every stated quantity, one row per row and value column.

    amount is in the parameter's unit, and null where the two dimensions differ; rows whose value
    states no quantity, or in a spelling that names no unit, are kept with a null number or canon.
    Rows of other parameters are left out.  Null, empty and very long texts are values like any.
    Repeated rows stay; extra columns are ignored.
    """
    declared = declared_units(params)
    rows = rows.select(F.col(key).alias("key"), F.col(code).alias("code"), *(F.col(v).alias(f"v{i}") for i, v in enumerate(values))).join(small(declared.select("code", F.col("unit").alias("own"))), "code")
    long = rows.select("key", "code", "own", F.explode(F.array(*(F.struct(F.lit(v).alias("field"), F.col(f"v{i}").cast("string").alias("value")) for i, v in enumerate(values)))).alias("x")).select("key", "code", "own", "x.field", "x.value")
    # the generator keeps the optimizer from repeating the parse for every use of its result
    nothing = F.struct(F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("unit"))
    long = long.select("key", "code", "own", "field", F.inline(F.array(F.coalesce(stated(F.col("value")), nothing)))).withColumn("unit", F.when(F.col("number").isNotNull(), F.col("unit")))
    long = cut_lineage(long)
    aliases = alias_dictionary(long.select("unit").distinct().unionByName(declared.select("unit")).distinct(), units)
    aliases = cut_lineage(aliases)
    of = units.select("canon", "dimension", "si_factor").dropDuplicates(["canon"])
    named = small(cut_lineage(aliases.join(small(of), "canon")))
    target = named.select(F.col("unit").alias("own"), F.col("canon").alias("param_unit"), F.col("dimension").alias("param_dimension"), F.col("si_factor").alias("param_factor"))
    long = long.join(target, "own", "left").join(named, "unit", "left")
    bare = F.col("unit") == ""
    canon, dimension, factor = (F.when(bare, F.col(p)).otherwise(F.col(c)) for p, c in (("param_unit", "canon"), ("param_dimension", "dimension"), ("param_factor", "si_factor")))
    si = F.col("number") * factor
    return long.select("key", "code", "field", "number", canon.alias("canon"), dimension.alias("dimension"), si.alias("amount_si"), F.when(dimension == F.col("param_dimension"), si / F.col("param_factor")).alias("amount"), "param_unit")


def same_amount_other_unit(amounts_: DataFrame, a: str, b: str, within: float = 0.005) -> DataFrame:
    """key of the rows whose two value columns state equal amounts (within a share of the larger) of the parameter's dimension in two different units."""
    x = amounts_.where(F.col("amount").isNotNull() & F.col("canon").isNotNull())
    pick = [F.max(F.when(F.col("field") == f, F.struct("amount", "canon"))).alias(n) for f, n in ((a, "a"), (b, "b"))]
    x = x.groupBy("key").agg(*pick).where("a is not null and b is not null and a.canon <> b.canon")
    return x.where(F.abs(F.col("a.amount") - F.col("b.amount")) <= within * F.greatest(F.abs("a.amount"), F.abs("b.amount"))).select("key")
