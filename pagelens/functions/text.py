"""Scalar text functions as column expressions (TXT-01 to TXT-22)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of one shape in the two alphabets, for ciphers and for labels.
FOLD_LATIN = ("АВЕКМНОРСТУХ", "ABEKMHOPCTYX")
FOLD_LABEL = ("ABCEHKMOPTXaceopx", "АВСЕНКМОПТХасеопх")
FOLD_CODE = ("АВЕКМНОРСТУХЅІЈ", "ABEKMHOPCTYXSIJ")
FOLD_MARK = ("ABCEHKMOPTXY", "АВСЕНКМОРТХУ")
# Kinds of dash and of blank in rule codes.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2043\u2212\ufe58\ufe63\uff0d"
CODE_BLANKS = " \t\n\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u202f\u205f\u2060\u3000\ufeff"
# Cyrillic section names of rule codes and the catalogue's own.
SECTIONS = {
    "СПЗУ": "SPZU", "ИОС1": "IOS1", "ИОС2": "IOS2", "ИОС3": "IOS3", "ИОС4": "IOS4", "ИОС5": "IOS5", "ПОС": "POS", "ПОД": "POD",
    "ООС": "OOS", "ППМ": "PPM", "ОДИ": "ODI", "ПЗ": "PZ", "АР": "AR", "КР": "KR", "ЗУ": "ZU", "СМ": "SM",
}
BLANKS = "  "
#: Greatest span of a range of system marks.
MARK_SPAN = 12
# A number in a text, a cited standard, a mark with its index, a section of engineering systems, a copy's number and a revision mark in a file name.
NUMBER = "(?<![0-9])(\\d+(?:[   ]\\d{3})*(?:[.,]\\d+)?)(?![0-9])"
STANDARD = r"(?iu)(сп|снип|гост)\s*(\d+(?:[.\-]\d+)*)"
MARK_TAIL = r"^([A-ZА-ЯЁ]{2,8})(\d+(?:\.\d+)*)$"
COPY_SUFFIX = r"\s*\(\d{1,2}\)\s*$"
REVISION_MARK = r"(?iu)(?:^|[\s._\-])(изм|корр?|ред)(?:[\s._\-]*(\d{1,2}))?(?!\d)"
# System marks, as a head letter or two and one or two numbers.
MARK_HEAD = "(ПЕ|ВЕ|ПД|ДУ|П|В)"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Composed form; Spark has no built-in for it.  Text already composed is best left out of this."""
    return s.str.normalize("NFC")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Composed form of compatibility characters."""
    return s.str.normalize("NFKC")


def _squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, f"[\\s{BLANKS}]+", " "))


def fold_label(col: Column, compose: bool = False) -> Column:
    """TXT-01: lower case, raised 2 of a square metre on the line, one blank between words."""
    col = F.lower(nfc(col) if compose else col)
    return _squeeze(F.regexp_replace(col, "([мm])²", "$12"))


def key_field(col: Column, compose: bool = False) -> Column:
    """TXT-02: as fold_label, but case is kept."""
    return _squeeze(nfc(col) if compose else col)


def ocr_text(col: Column, compose: bool = False) -> Column:
    """TXT-03."""
    return _squeeze(nfc(col) if compose else col)


def localize_decimal(col: Column) -> Column:
    """TXT-05: digits with a point as the decimal sign, or null where the notation is ambiguous or broken.

    With both signs the last one is decimal and the other must part groups of three; one point
    before three digits after a single digit other than 0 is ambiguous; several of a kind part
    groups of three; a single comma is decimal.
    """
    dots, commas = (F.length(col) - F.length(F.translate(col, c, "")) for c in ".,")
    plain = col.rlike(r"^[+-]?\d+$")
    return (
        F.when(plain, col)
        .when((dots > 0) & (commas > 0) & col.rlike(r"^[+-]?\d{1,3}(?:\.\d{3})+,\d+$"), F.translate(F.translate(col, ".", ""), ",", "."))
        .when((dots > 0) & (commas > 0) & col.rlike(r"^[+-]?\d{1,3}(?:,\d{3})+\.\d+$"), F.translate(col, ",", ""))
        .when((dots > 0) & (commas > 0), F.lit(None).cast("string"))
        .when((dots == 1) & col.rlike(r"^[+-]?[1-9]\.\d{3}$"), F.lit(None).cast("string"))
        .when((dots == 1) & col.rlike(r"^[+-]?\d+\.\d+$"), col)
        .when((dots > 1) & col.rlike(r"^[+-]?\d{1,3}(?:\.\d{3})+$"), F.translate(col, ".", ""))
        .when((commas == 1) & col.rlike(r"^[+-]?\d+,\d+$"), F.translate(col, ",", "."))
        .when((commas > 1) & col.rlike(r"^[+-]?\d{1,3}(?:,\d{3})+$"), F.translate(col, ",", ""))
    )


def number_steps(col: Column, steps: Column) -> Column:
    """TXT-04: the named steps in their fixed order; blanks always go; no steps mean nfc, collapse_spaces and decimal_comma.

    strip_unit drops a square metre at the end, multiply_dimensions turns 500×300 into 150000.
    A null from localize_decimal stays null.
    """
    steps = F.when(F.size(F.coalesce(steps, F.array().cast("array<string>"))) == 0, F.array(F.lit("collapse_spaces"), F.lit("decimal_comma"))).otherwise(steps)
    col = F.when(F.array_contains(steps, "strip_unit"), F.regexp_replace(col, r"(?iu)(?:м²|м2|m2|м\^2)\s*$", "")).otherwise(col)
    col = F.regexp_replace(col, f"[\\s{BLANKS}]+", "")
    sides = r"^(\d+(?:[.,]\d+)?)[×xх](\d+(?:[.,]\d+)?)$"
    a, b = (F.translate(F.regexp_extract(col, sides, i), ",", ".").try_cast("double") for i in (1, 2))
    area = F.when(a * b == F.floor(a * b), F.floor(a * b).cast("bigint").cast("string")).otherwise((a * b).cast("string"))
    col = F.when(F.array_contains(steps, "multiply_dimensions") & col.rlike(sides), area).when(F.array_contains(steps, "decimal_comma"), localize_decimal(col)).otherwise(col)
    return F.when(F.array_contains(steps, "upper"), F.upper(col)).otherwise(col)


def parse_number(col: Column) -> Column:
    """TXT-06: the number written, or null."""
    return localize_decimal(F.regexp_replace(col, f"[\\s{BLANKS}]+", "")).try_cast("double")


def fold_homoglyphs(col: Column) -> Column:
    """TXT-07: upper case, the twelve Cyrillic letters of Latin shape made Latin."""
    return F.translate(F.upper(col), *FOLD_LATIN)


def label_text(col: Column, compose: bool = False) -> Column:
    """TXT-08: Latin look-alikes made Cyrillic for room labels, case kept; P stands for П here."""
    return F.regexp_replace(F.translate(nfc(col) if compose else col, *FOLD_LABEL), r"(?U)^\s+|\s+$", "")


def bind(value: Column, then) -> Column:
    """then(value) with value computed once, however often `then` names it and wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), then), 1)


_CODE = r"^([A-ZА-ЯЁ0-9]+(?:-[A-ZА-ЯЁ0-9]+)*)-(\d+)$"


def _padded(code: Column) -> Column:
    number = F.regexp_replace(F.regexp_extract(code, _CODE, 2), r"^0+(?=\d)", "")
    return F.when(code.rlike(_CODE), F.concat_ws("-", F.regexp_extract(code, _CODE, 1), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))).otherwise(code)


def _folded(code: Column) -> Column:
    return bind(F.translate(code, *FOLD_CODE), lambda out: F.when(out.rlike("^[A-Z0-9-]+$"), _padded(out)).otherwise(code))


def _named(code: Column) -> Column:
    """With the catalogue's name of a Cyrillic section."""
    sections = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    return bind(F.try_element_at(sections, F.regexp_extract(code, _CODE, 1)), lambda s: F.when(s.isNull(), code).otherwise(F.concat_ws("-", s, F.regexp_extract(code, _CODE, 2))))


def rule_code(col: Column, known: Column | None = None, compat: bool = False) -> Column:
    """TXT-09: section and number of three digits at least, without blanks, with plain dashes, in capitals.

    A Cyrillic section name becomes the catalogue's; Cyrillic look-alikes become Latin only if the
    whole code is then ASCII.  With the array of known codes it is the first of the plain, the
    renamed, the folded and the renamed and folded form that is known, else the renamed one.
    Full-width forms are taken as usual ones; compat=True takes all compatibility forms so.
    """
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if chr(c) not in DASHES)
    plain = "".join(chr(ord(c) - 0xFEE0) for c in wide)
    text = nfkc(col) if compat else F.translate(col, wide, plain)
    text = bind(F.upper(F.translate(F.translate(text, DASHES, "-" * len(DASHES)), CODE_BLANKS, "")), _padded)
    if known is None:
        return bind(text, lambda t: bind(_named(t), _folded))
    forms = bind(text, lambda t: F.array(t, _named(t), _folded(t), bind(_named(t), _folded)))
    return bind(forms, lambda f: F.coalesce(F.try_element_at(F.filter(f, lambda x: F.array_contains(known, x)), F.lit(1)), F.get(f, F.lit(1))))


def display_code(col: Column) -> Column:
    """TXT-09: the short form of a code: AR-014 is AR-14."""
    return bind(rule_code(col), lambda c: F.when(c.rlike(_CODE), F.concat_ws("-", F.regexp_extract(c, _CODE, 1), F.regexp_replace(F.regexp_extract(c, _CODE, 2), r"^0+(?=\d)", ""))).otherwise(c))


def enum_value(col: Column) -> Column:
    """TXT-10: a class mark and its number stand together."""
    return F.regexp_replace(_squeeze(F.upper(col)), r"^([A-ZА-ЯЁ]+)\s+([0-9+])", "$1$2")


def mark_tokens(col: Column) -> Column:
    """TXT-11: the cipher, its parts, and of a part like ОВ2.1 also ОВ, ОВ2 and ОВ2.1; distinct, sorted; none for an empty cipher."""

    def grow(part: Column) -> Column:
        base, tail = F.regexp_extract(part, MARK_TAIL, 1), F.split(F.regexp_extract(part, MARK_TAIL, 2), r"\.")
        upto = F.transform(F.sequence(F.lit(1), F.size(tail)), lambda n: F.concat(base, F.array_join(F.slice(tail, 1, n), ".")))
        return F.when(part.rlike(MARK_TAIL), F.concat(F.array(part, base), upto)).otherwise(F.array(part))

    whole = F.translate(F.upper(col), "_", "-")
    parts = F.concat(F.array(whole), F.flatten(F.transform(F.split(whole, "[-/]"), grow)))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: F.length(p) > 0)))


# Marks with their Latin name, words that stand for a mark, marks whose index may be left off.
KIND_LATIN = {
    "ПЗ": "PZ", "АР": "AR", "КР": "KR", "ИД": "ID", "ОВ": "OV", "КЖ": "KJ", "ОД": "OD", "ПЗУ": "PZU", "ИОС": "IOS", "ИОС4": "IOS4",
    "ПОС": "POS", "ПОД": "POD", "ЗУ": "ZU", "ППМ": "PPM", "ОДИ": "ODI", "ООС": "OOS", "СПЗУ": "SPZU",
}
KIND_WORDS = {
    "ОТОПЛЕНИЕ": "ОВ", "ВЕНТИЛЯЦИЯ": "ОВ", "ОВИК": "ОВ", "HVAC": "ОВ", "HEATING": "ОВ", "VENTILATION": "ОВ", "АРХИТЕКТУРА": "АР",
    "АРХИТЕКТУРНЫЕ": "АР", "ARCHITECTURE": "АР", "КОНСТРУКЦИИ": "КР", "STRUCTURES": "КР", "ВОДОСНАБЖЕНИЕ": "ИОС2", "КАНАЛИЗАЦИЯ": "ИОС3",
    "ВОДООТВЕДЕНИЕ": "ИОС3", "ЭЛЕКТРОСНАБЖЕНИЕ": "ИОС1", "ЭЛЕКТРООБОРУДОВАНИЕ": "ИОС1", "ЭОМ": "ИОС1", "ВК": "ИОС2", "СЛАБОТОЧНЫЕ": "ИОС5",
    "ГЕНПЛАН": "ПЗУ",
}
INDEX_BASES = ("ОВ", "АР", "КР", "КЖ", "ПЗ", "ПЗУ", "ПОС", "ПОД")


def kind_aliases(col: Column) -> Column:
    """TXT-12: a kind, its mark without an index, the mark that it stands for, and their Latin names; distinct, sorted; none for a blank or null one."""
    latin, words = (F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) for table in (KIND_LATIN, KIND_WORDS))
    whole = F.translate(F.upper(F.trim(col)), " ", "")
    base = F.regexp_extract(whole, MARK_TAIL, 1)
    own = F.array_compact(F.array(F.nullif(whole, F.lit("")), F.when(base.isin(*INDEX_BASES), base)))
    named = F.concat(own, F.array_compact(F.transform(own, lambda k: F.try_element_at(words, k))))
    return F.array_sort(F.array_distinct(F.coalesce(F.concat(named, F.array_compact(F.transform(named, lambda k: F.try_element_at(latin, k)))), F.array().cast("array<string>"))))


def wanted_kinds(section: Column, kinds: Column) -> Column:
    """TXT-12: the kinds that a rule asks for, by its section and the kinds that it names; ИОС4 is also ИОС5.4."""
    systems = F.regexp_extract(F.upper(F.trim(section)), "^ИОС([1-5])$", 1)
    more = F.array_compact(F.array(F.when(F.length(systems) > 0, F.concat(F.lit("ИОС5."), systems))))
    listed = F.flatten(F.transform(F.coalesce(kinds, F.array().cast("array<string>")), kind_aliases))
    return F.array_sort(F.array_distinct(F.concat(kind_aliases(section), more, listed)))


def page_kinds(code: Column, discipline: Column) -> Column:
    """TXT-12: the kinds of a document, by its cipher and discipline."""
    return F.array_sort(F.array_union(F.coalesce(mark_tokens(code), F.array().cast("array<string>")), kind_aliases(discipline)))


def _one_mark(part: Column) -> Column:
    """The marks that one word stands for; none if it is no mark."""
    none = F.array().cast("array<string>")
    spread = rf"^{MARK_HEAD}(\d{{1,2}})\.(\d{{1,2}})[-–](?:{MARK_HEAD}(\d{{1,2}})\.)?(\d{{1,2}})$"
    listed = rf"^{MARK_HEAD}(\d{{1,2}})\.(\d{{1,2}}(?:,\d{{1,2}})+)$"
    single = rf"^{MARK_HEAD}(\d{{1,2}}(?:\.\d{{1,2}})?)?$"
    g = [F.regexp_extract(part, spread, i) for i in range(7)]
    lo, hi = g[3].try_cast("int"), g[6].try_cast("int")
    same = (F.length(g[4]) == 0) | ((g[4] == g[1]) & (g[5] == g[2]))
    fits = part.rlike(spread) & same & (hi > lo) & (hi - lo <= MARK_SPAN)
    steps = F.sequence(F.when(fits, lo).otherwise(0), F.when(fits, hi).otherwise(0))
    number = F.regexp_extract(part, single, 2)
    bare = F.when(F.length(number) > 0, ~(number.startswith("0") & ~number.contains("."))).otherwise(F.regexp_extract(part, single, 1).isin("ВЕ", "ПЕ"))
    return (
        F.when(fits, F.transform(steps, lambda n: F.concat(g[1], g[2], F.lit("."), n.cast("string"))))
        .when(part.rlike(spread), none)
        .when(part.rlike(listed), F.transform(F.split(F.regexp_extract(part, listed, 3), ","), lambda n: F.concat(F.regexp_extract(part, listed, 1), F.regexp_extract(part, listed, 2), F.lit("."), n.try_cast("int").cast("string"))))
        .when(part.rlike(single) & bare, F.array(F.concat(F.regexp_extract(part, single, 1), number)))
        .otherwise(none)
    )


def system_marks(col: Column) -> Column:
    """TXT-13: the system marks of a label: П1.1-1.4 is none, П1.1-4 four (a span of at most twelve), В2.7,8,9 three, a slash parts alternatives; in order, distinct."""
    text = F.regexp_replace(F.translate(F.upper(label_text(col)), *FOLD_MARK), r"\s*([,–-])\s*", "$1")
    words = F.transform(F.split(text, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"^[ .:;,\]|\[()]+|[ .:;,\]|\[()]+$", ""))
    parts = F.flatten(F.transform(words, lambda w: F.split(w, r"[/\\]")))

    def marks(part: Column) -> Column:
        pieces = F.filter(F.split(part, ","), lambda x: F.length(x) > 0)
        each = F.transform(pieces, _one_mark)
        return F.when((F.size(pieces) > 1) & F.forall(each, lambda m: F.size(m) > 0), F.flatten(each)).otherwise(_one_mark(part))

    return F.array_distinct(F.flatten(F.transform(parts, marks)))


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.translate(name, "\\", "/"), "^.*/", ""), r"\.[^.]*$", ""), COPY_SUFFIX, "")


def volume_key(name: Column) -> Column:
    """TXT-14: stem of a file name without a copy's number and revision marks, lower case letters and digits only."""
    return F.regexp_replace(F.lower(F.regexp_replace(_stem(name), REVISION_MARK, " ")), "[^0-9a-zа-яё]", "")


def name_mark(name: Column, revision: Column | None = None, kind: Column | None = None) -> Column:
    """TXT-15: struct(kind, number) of the revision: change, correction, mixed or none.

    A revision of digits on the title wins over the name; its kind is a correction unless the title
    says change.  Marks of both kinds in a name are mixed; a name without any is revision 0.
    """
    none = F.lit(None).cast("string")
    revision, kind = none if revision is None else F.trim(revision), none if kind is None else kind
    marks = F.regexp_extract_all(_stem(name), F.lit(REVISION_MARK), 1)
    folded = F.array_distinct(F.transform(marks, lambda m: F.when(F.lower(m) == "изм", "change").otherwise("correction")))
    number = F.try_element_at(F.filter(F.regexp_extract_all(_stem(name), F.lit(REVISION_MARK), 2), lambda n: F.length(n) > 0), F.lit(1)).try_cast("int")
    titled = F.coalesce(revision.rlike(r"^\d+$"), F.lit(False))
    own = F.when(titled, F.when(kind.isin("change", "correction"), kind).otherwise("correction")).when(F.size(folded) > 1, "mixed").when(F.size(folded) == 1, folded[0]).otherwise("none")
    n = F.when(titled, revision.try_cast("int")).when(F.size(folded) > 1, F.lit(None)).when(F.size(folded) == 1, number).when(F.length(F.trim(name)) > 0, 0)
    return F.struct(own.alias("kind"), n.cast("int").alias("number"))


def comparison_key(*parts: Column) -> Column:
    """TXT-16: SHA-256 of the parts joined by a zero character; null if any part is null or empty."""
    joined = F.concat(*[x for i, p in enumerate(parts) for x in ([F.lit("\u0000")] if i else []) + [p]])
    whole = parts[0].isNotNull() & (F.length(parts[0]) > 0)
    for p in parts[1:]:
        whole = whole & p.isNotNull() & (F.length(p) > 0)
    return F.when(whole, F.sha2(joined, 256))


def canonical_digest(**fields: Column) -> Column:
    """TXT-17: SHA-256 of the fields as JSON, sorted by name."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


@F.pandas_udf(T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())]))
def _as_characters(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Each word of the two texts as one character, equal words as equal ones."""

    def one(x: str | None, y: str | None) -> tuple[str | None, str | None]:
        if x is None or y is None:
            return None, None
        known: dict[str, str] = {}
        for w in (*x.split(), *y.split()):
            known.setdefault(w, chr(len(known) + (0x21 if len(known) < 0xD000 else 0x1000)))  # past the surrogates
        return "".join(map(known.__getitem__, x.split())), "".join(map(known.__getitem__, y.split()))

    return pd.DataFrame([one(x, y) for x, y in zip(a, b)], columns=["a", "b"], dtype=object)


def token_distance(a: Column, b: Column) -> Column:
    """TXT-18: edit distance in words.  For characters use F.levenshtein, which also compares the words here, each as one character."""
    x = _as_characters(a, b)
    return F.levenshtein(x["a"], x["b"])


def numbers_in_text(col: Column) -> Column:
    """TXT-19: the numbers of a text as written, in order."""
    return F.regexp_extract_all(col, F.lit(NUMBER), 1)


def standards_cited(col: Column) -> Column:
    """TXT-20: kind and number of the standards that a text names; distinct, sorted."""
    kinds, numbers = (F.regexp_extract_all(col, F.lit(STANDARD), i) for i in (1, 2))
    return F.array_sort(F.array_distinct(F.zip_with(kinds, numbers, lambda k, n: F.concat_ws(" ", F.lower(k), F.translate(n, "-", ".")))))


def standards_differ(a: Column, b: Column) -> Column:
    """TXT-20: both cite standards and share none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def context_fold(col: Column) -> Column:
    """TXT-21: Latin look-alikes made Cyrillic in words that have Cyrillic letters or stand beside one that has."""
    words = F.split(col, " ")
    cyrillic = F.transform(words, lambda w: w.rlike("[А-Яа-яЁё]"))
    before, after = F.concat(F.array(F.lit(False)), cyrillic), F.concat(F.slice(cyrillic, 2, F.greatest(F.size(words), F.lit(1))), F.array(F.lit(False)))
    near = F.zip_with(F.zip_with(cyrillic, F.slice(before, 1, F.size(words)), lambda a, b: a | b), after, lambda a, b: a | b)
    return F.array_join(F.zip_with(words, near, lambda w, n: F.when(n, F.translate(w, "ABEKMHOPCTYXaeopcyx", "АВЕКМНОРСТУХаеорсух")).otherwise(w)), " ")


def stage_token(stage: Column, name: Column, first_page: Column) -> Column:
    """TXT-22: PD, RD or ID from a stage field; MIXED is RD by a mark in the name, ID by the words of an as-built act, else null."""
    s = F.regexp_replace(F.upper(F.regexp_replace(stage, r"\s+", "")), r"^.*[_-]", "")
    s = F.translate(s, "ПРИД", "PRID")
    mixed = F.when(F.lower(name).rlike(r"(?:^|[\s_-])(?:рд|rd)(?:$|[\s_.-])"), "RD").when(F.lower(first_page).contains("аоср"), "ID")
    return F.when(s.isin("PD", "RD", "ID"), s).when(s == "MIXED", mixed)
