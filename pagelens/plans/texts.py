"""Queries of the text, measure and comparator operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import measure, text
from pagelens.operators import comparators
from pagelens.session import table

# Rules of the comparator queries: code, operator, value, min_value, max_value, tolerance_abs, tolerance_rel, rounding, values, trigger.
RULES = [
    ("D1", "delta", None, None, None, 100.0, None, "half_up", None, None),
    ("D2", "delta", None, None, None, None, 0.05, "floor", None, "уменьшение площади"),
    ("O1", "ge", None, None, None, None, None, "none", None, None),
    ("O2", "lt", 50000.0, None, None, None, None, "none", None, None),
    ("R1", "range", None, 20000.0, 60000.0, None, None, "none", None, None),
    ("S1", "in_set", None, None, None, None, None, "none", ["A", "n"], None),
    ("C1", "class_not_lower", None, None, None, None, None, "none", ["A", "N", "R"], None),
    ("X1", "nonsense", None, None, None, None, None, "none", None, None),
]
RULE_TYPE = "code string, operator string, value double, min_value double, max_value double, tolerance_abs double, tolerance_rel double, rounding string, values array<string>, trigger string"


def txt_fold_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "public_checks").groupBy(text.fold_label(F.col("location")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def txt_homoglyphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("id", text.fold_homoglyphs(F.col("document_code")).alias("folded"), text.label_text(F.col("document_code")).alias("label")).distinct()


def txt_rule_codes(spark: SparkSession, d: str) -> DataFrame:
    """Every code as it is, with a long dash, in small letters and with Cyrillic look-alikes, and codes of Cyrillic sections: the canonical and the short form."""
    c = table(spark, d, "public_checks").select(F.col("parameter_code").alias("c")).where("c is not null").distinct()
    forms = F.array(F.col("c"), F.translate("c", "-", "–"), F.lower("c"), F.translate("c", "AEHKOPTBCMX", "АЕНКОРТВСМХ"), F.concat(F.lit(" "), F.translate("c", "-", "\u2011")))
    named = spark.createDataFrame([(x,) for x in ("СМ-132", "АР–041", "ООС-98", "пз-1", "РZ-001", "ИОС4-7", "ЩЩ-5", "KR-1234", "nonsense")], "raw string")
    raw = c.select(F.explode(forms).alias("raw")).unionByName(named)
    return raw.select("raw", text.rule_code(F.col("raw")).alias("code"), text.display_code(F.col("raw")).alias("short"))


def txt_mark_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("id", F.explode(text.mark_tokens(F.col("document_code"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def txt_parse_number(spark: SparkSession, d: str) -> DataFrame:
    v = F.regexp_replace("pd_value", "[^0-9.,]", "")
    return table(spark, d, "public_checks").select("check_id", text.parse_number(v).alias("number")).distinct()


def txt_comparison_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "public_checks").select("check_id", text.comparison_key(F.col("object_id"), F.col("parameter_code"), F.col("check_id")).alias("key")).distinct()


def txt_name_marks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select(text.name_mark(F.col("file_path"), F.col("revision")).alias("m")).groupBy("m.kind", "m.number").agg(F.count(F.lit(1)).alias("n"))


def txt_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = text.numbers_in_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.size(n), F.lit(0)).alias("n"), F.try_element_at(n, F.lit(-1)).alias("last"))


def txt_standards(spark: SparkSession, d: str) -> DataFrame:
    """Standards named in texts made of the parts, and whether they differ from those of another text; the documents name none."""
    said = text.standards_cited(F.concat(F.lit("по СП "), "p_size", F.lit("-13330 и ГОСТ"), F.col("p_partkey") % 100))
    return table(spark, d, "part").select("p_partkey", F.array_join(said, ", ").alias("standards"), text.standards_differ(said, F.array(F.lit("сп 1.13330"))).alias("differ"))


def txt_system_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks of labels made of the parts: a range, a single mark, a list, an alternative, and words that are none."""
    n = F.col("p_size") % 9 + 1
    label = F.concat(F.lit("B"), n, F.lit(".1 - 4, П"), "p_size", F.lit(" ДУ2.1,"), n, F.lit("/ВЕ (лист) "), n, F.lit("x5"))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.system_marks(label), " ").alias("marks"))


def txt_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Whether a file is of a kind that each section asks for."""
    want = table(spark, d, "params").where("section is not null").select("section").distinct().withColumn("wanted", text.wanted_kinds(F.col("section"), F.array(F.lit("отопление"), F.lit("ИОС4"))))
    own = table(spark, d, "files").select("discipline").distinct().withColumn("own", text.page_kinds(F.lit("АБ1-ОВ2.1"), F.col("discipline")))
    pairs = own.withColumn("_one", F.lit(1)).join(F.broadcast(want.withColumn("_one", F.lit(1))), "_one")
    return pairs.select("discipline", "section", F.array_join("own", " ").alias("own"), F.array_join("wanted", " ").alias("wanted"), F.arrays_overlap("own", "wanted").alias("meets"))


def txt_stage_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Stages as folders spell them, and mixed ones by the file's name."""
    spelled = F.when(F.col("doc_stage") == "PD", "стадия_ПД").when(F.col("doc_stage") == "RD", " rd ").otherwise("MIXED")
    name = F.when(F.col("doc_stage") == "ID", F.concat(F.lit("том РД."), F.col("id"))).otherwise(F.col("id"))
    return table(spark, d, "files").groupBy("doc_stage", text.stage_token(spelled, name, F.lit("")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def txt_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("id", text.canonical_digest(stage=F.col("doc_stage"), id=F.col("id"), object=F.col("object_id")).alias("digest")).distinct()


def txt_context_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "public_checks").select("check_id", text.context_fold(F.col("location")).alias("folded")).distinct()


def txt_token_distance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "public_checks").select("check_id", text.token_distance(F.col("pd_value"), F.col("rd_value")).alias("words"), F.levenshtein("pd_value", "rd_value").alias("chars")).distinct()


def mth_quantize(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_extendedprice") * F.col("l_discount") * F.col("l_tax")
    q = {m: measure.quantize(x, F.lit(m)) for m in ("half_up", "floor", "ceil")}
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(*(F.round(F.sum(c), 2).alias(m) for m, c in q.items()))


def mth_wilson(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "public_checks").groupBy("criticality", "location_type").agg(F.count_if(F.col("violation_label") == "VIOLATION_PRESENT").alias("k"), F.count(F.lit(1)).alias("n"))
    w = measure.wilson(F.col("k"), F.col("n"))
    return g.select("criticality", "location_type", "k", "n", *(F.round(w[c], 9).alias(c) for c in ("rate", "low", "high")))


def mth_unit_scale(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "measure_units")
    every = u.agg(F.collect_set("canon").alias("all")).withColumn("_one", F.lit(1))  # a table of fixed size
    pairs = u.select(F.col("canon").alias("unit"), F.lit(1).alias("_one")).join(every, "_one").select("unit", F.explode("all").alias("target"))
    return measure.to_unit(pairs.select("unit", "target").withColumn("value", F.lit(2.5)), "value", "unit", "target", u).select("unit", "target", "scaled", "unit_conflict")


def mth_drawing_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Occupancy of objects' files over months and disciplines, PD against RD."""
    f = table(spark, d, "files").select("object_id", "doc_stage", *((F.conv(F.substring(F.md5("id"), at, 4), 16, 10).cast("double") / 65536).alias(c) for at, c in ((1, "x"), (5, "y")))).distinct()
    c = measure.grid_cells(f, ["object_id", "doc_stage"], least=10)
    a, b = (c.where(F.col("doc_stage") == s).select("object_id", F.col("cells").alias(s)) for s in ("PD", "RD"))
    return a.join(b, "object_id").select("object_id", measure.jaccard(F.col("PD"), F.col("RD")).alias("jaccard"))


def _stage_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Per part the greatest price of returned and of kept lines, as the two stages of one parameter."""
    li = table(spark, d, "lineitem")
    price = lambda f: F.max(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice")))
    return li.groupBy("l_partkey").agg(price("N").alias("expected"), price("R").alias("actual"), F.min("l_returnflag").alias("expected_text"), F.max("l_returnflag").alias("actual_text"))


def cmp_rules(spark: SparkSession, d: str) -> DataFrame:
    """All comparators over all parts at once: rules × pairs, eight rules."""
    names = [x.split(":")[0].split()[0] for x in RULE_TYPE.split(", ")]
    kinds = dict(x.split(" ") for x in RULE_TYPE.split(", "))
    literal = lambda v, k: (F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).cast(k)
    rules = F.array(*(F.struct(F.lit(r[0]).alias("code"), F.struct(*(literal(v, kinds[n]).alias(n) for n, v in zip(names[1:], r[1:]))).alias("rule")) for r in RULES))
    x = _stage_pairs(spark, d).withColumn("x", F.explode(rules)).select("*", "x.code", "x.rule")
    c = comparators.compare(F.col("rule"), F.col("expected"), F.col("actual"), F.col("expected_text"), F.col("actual_text"))
    return x.select("l_partkey", "code", c.alias("c")).select("l_partkey", "code", "c.status", F.round("c.delta", 4).alias("delta"), "c.error_reason")


def cmp_text(spark: SparkSession, d: str) -> DataFrame:
    rule = F.struct(F.lit("eq").alias("operator"))
    return table(spark, d, "public_checks").select("check_id", comparators.compare_text(rule, F.col("pd_value"), F.col("rd_value"))["status"].alias("status"), comparators.compare_presence(F.col("id_value").isNotNull())["status"].alias("presence")).distinct()


def cmp_class_ladder(spark: SparkSession, d: str) -> DataFrame:
    ladder = F.array(*map(F.lit, ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]))
    c = comparators.compare_class(F.struct(ladder.alias("values")), F.lit("3-MEDIUM"), F.col("o_orderpriority"))
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority"), c["status"].alias("status"), c["delta"].alias("steps"), c["error_reason"].alias("error")).agg(F.count(F.lit(1)).alias("n"))


_FUNCS = (txt_fold_label, txt_homoglyphs, txt_rule_codes, txt_mark_tokens, txt_parse_number, txt_comparison_key, txt_name_marks, txt_numbers, txt_standards, txt_system_marks, txt_kinds, txt_stage_tokens, txt_digest, txt_context_fold, txt_token_distance, mth_quantize, mth_wilson, mth_unit_scale, mth_drawing_jaccard, cmp_rules, cmp_text, cmp_class_ladder)
QUERIES = {f.__name__: f for f in _FUNCS}

_LOCAL = r"""CASE WHEN regexp_full_match(v, '\d+') THEN v
  WHEN regexp_full_match(v, '\d{1,3}(\.\d{3})+,\d+') THEN replace(replace(v, '.', ''), ',', '.')
  WHEN regexp_full_match(v, '\d{1,3}(,\d{3})+\.\d+') THEN replace(v, ',', '')
  WHEN contains(v, '.') AND contains(v, ',') THEN NULL
  WHEN regexp_full_match(v, '[1-9]\.\d{3}') THEN NULL
  WHEN regexp_full_match(v, '\d+\.\d+') THEN v
  WHEN regexp_full_match(v, '\d{1,3}(\.\d{3}){2,}') THEN replace(v, '.', '')
  WHEN regexp_full_match(v, '\d+,\d+') THEN replace(v, ',', '.')
  WHEN regexp_full_match(v, '\d{1,3}(,\d{3}){2,}') THEN replace(v, ',', '') END"""

_Q = "SELECT l_returnflag, l_linestatus, CAST(l_extendedprice * l_discount * l_tax AS VARCHAR)::DECIMAL(38,18) AS x FROM lineitem"

SQL = {
    "txt_fold_label": r"SELECT trim(regexp_replace(regexp_replace(lower(location), '([мm])²', '\12', 'g'), '[ \t\n\x0b\f\r\x{a0}\x{202f}]+', ' ', 'g')) AS label, count(*) AS n FROM public_checks GROUP BY 1",
    "txt_homoglyphs": "SELECT DISTINCT id, translate(upper(document_code), 'АВЕКМНОРСТУХ', 'ABEKMHOPCTYX') AS folded, trim(translate(document_code, 'ABCEHKMOPTXaceopx', 'АВСЕНКМОПТХасеопх'), chr(32) || chr(160) || chr(9) || chr(8201) || chr(8239)) AS label FROM files",
    "txt_rule_codes": r"""
        WITH c AS (SELECT DISTINCT parameter_code AS code FROM public_checks WHERE parameter_code IS NOT NULL),
        r AS (SELECT unnest([code, replace(code, '-', '–'), lower(code), translate(code, 'AEHKOPTBCMX', 'АЕНКОРТВСМХ'), ' ' || replace(code, '-', chr(8209))]) AS raw, code FROM c)
        SELECT raw, code, regexp_replace(code, '-0*([0-9]+)$', '-\1') AS short FROM r
        UNION ALL VALUES ('СМ-132', 'SM-132', 'SM-132'), ('АР–041', 'AR-041', 'AR-41'), ('ООС-98', 'OOS-098', 'OOS-98'), ('пз-1', 'PZ-001', 'PZ-1'), ('РZ-001', 'PZ-001', 'PZ-1'),
          ('ИОС4-7', 'IOS4-007', 'IOS4-7'), ('ЩЩ-5', 'ЩЩ-005', 'ЩЩ-5'), ('KR-1234', 'KR-1234', 'KR-1234'), ('nonsense', 'NONSENSE', 'NONSENSE')""",
    "txt_mark_tokens": r"""
        WITH f AS (SELECT row_number() OVER () AS r, replace(upper(document_code), '_', '-') AS w FROM files WHERE document_code IS NOT NULL),
        p AS (SELECT r, unnest(string_split_regex(w, '[-/]')) AS part FROM f),
        t AS (SELECT r, part, regexp_extract(part, '^([A-ZА-ЯЁ]+)', 1) AS base, string_split(regexp_extract(part, '([0-9.]+)$', 1), '.') AS tail FROM p WHERE regexp_full_match(part, '[A-ZА-ЯЁ]{2,8}[0-9]+([.][0-9]+)*')),
        a AS (SELECT r, w AS token FROM f UNION SELECT r, part FROM p UNION SELECT r, base FROM t UNION SELECT r, unnest(list_transform(range(1, len(tail) + 1), lambda n: base || array_to_string(tail[1:n], '.'))) FROM t)
        SELECT token, count(*) AS n FROM a WHERE token <> '' GROUP BY token""",
    "txt_name_marks": r"""
        WITH s AS (SELECT trim(revision) AS rev, regexp_replace(regexp_replace(file_path, '^.*/', ''), '[.][^.]*$', '') AS stem FROM files),
        m AS (SELECT *, lower(regexp_extract(stem, '(?i)(^|[\s._-])(изм|корр?|ред)', 2)) AS mark, TRY_CAST(regexp_extract(stem, '(?i)(^|[\s._-])(изм|корр?|ред)[\s._-]*([0-9]{1,2})', 3) AS INTEGER) AS num FROM s),
        k AS (SELECT CASE WHEN regexp_full_match(rev, '[0-9]+') THEN 'correction' WHEN mark = 'изм' THEN 'change' WHEN mark <> '' THEN 'correction' ELSE 'none' END AS kind, CASE WHEN regexp_full_match(rev, '[0-9]+') THEN rev::INTEGER WHEN mark <> '' THEN num WHEN stem IS NOT NULL THEN 0 END AS number FROM m)
        SELECT kind, number, count(*) AS n FROM k GROUP BY ALL""",
    "txt_numbers": r"WITH n AS (SELECT doc_id, regexp_extract_all(text, '([0-9]+(?:[ \x{a0}\x{202f}][0-9]{3})*(?:[.,][0-9]+)?)(?:[^0-9]|$)', 1) AS l FROM documents) SELECT doc_id, coalesce(len(l), 0)::INTEGER AS n, l[-1] AS last FROM n",
    "txt_standards": "SELECT p_partkey, 'гост ' || (p_partkey % 100) || ', сп ' || p_size || '.13330' AS standards, p_size <> 1 AS differ FROM part",
    "txt_system_marks": """
        WITH p AS (SELECT p_partkey, p_size, p_size % 9 + 1 AS n FROM part)
        SELECT p_partkey, array_to_string(list_filter(['В' || n || '.1', 'В' || n || '.2', 'В' || n || '.3', 'В' || n || '.4', 'П' || p_size, 'ДУ2.1', CASE WHEN n <> 1 THEN 'ДУ2.' || n END, 'ВЕ'], lambda x: x IS NOT NULL), ' ') AS marks FROM p""",
    "txt_kinds": """
        WITH l(k, latin) AS (VALUES ('ПЗ', 'PZ'), ('АР', 'AR'), ('КР', 'KR'), ('ИД', 'ID'), ('ОВ', 'OV'), ('КЖ', 'KJ'), ('ОД', 'OD'), ('ПЗУ', 'PZU'), ('ИОС', 'IOS'), ('ПОС', 'POS'), ('ПОД', 'POD'), ('ЗУ', 'ZU'), ('ППМ', 'PPM'), ('ОДИ', 'ODI'), ('ООС', 'OOS'), ('СПЗУ', 'SPZU')),
        words(k, mark) AS (VALUES ('ВК', 'ИОС2'), ('ЭОМ', 'ИОС1')),
        kind AS (SELECT k AS raw, k AS token FROM (SELECT DISTINCT section AS k FROM params UNION SELECT DISTINCT discipline FROM files) WHERE k IS NOT NULL),
        alias AS (SELECT * FROM kind UNION SELECT raw, mark FROM kind JOIN words ON words.k = token UNION SELECT raw, latin FROM kind JOIN l ON l.k = token),
        own AS (SELECT discipline, list_sort(list_distinct(['АБ', 'АБ1', 'АБ1-ОВ2.1', 'ОВ', 'ОВ2', 'ОВ2.1'] || coalesce(list(token) FILTER (token IS NOT NULL), []))) AS own FROM (SELECT DISTINCT discipline FROM files) f LEFT JOIN alias ON raw = discipline GROUP BY 1),
        want AS (SELECT section, list_sort(list_distinct(['ОТОПЛЕНИЕ', 'ОВ', 'OV', 'ИОС4', 'IOS4'] || list(token))) AS wanted FROM (SELECT DISTINCT section FROM params WHERE section IS NOT NULL) p JOIN alias ON raw = section GROUP BY 1)
        SELECT discipline, section, array_to_string(own, ' ') AS own, array_to_string(wanted, ' ') AS wanted, list_has_any(own, wanted) AS meets FROM own CROSS JOIN want""",
    "txt_stage_tokens": "SELECT doc_stage, CASE WHEN doc_stage = 'PD' THEN 'PD' ELSE 'RD' END AS stage, count(*) AS n FROM files GROUP BY ALL",
    "txt_digest": """SELECT DISTINCT id, sha256('{"id":"' || id || '","object":"' || object_id || '","stage":"' || doc_stage || '"}') AS digest FROM files""",
    "txt_context_fold": r"""
        WITH w AS (SELECT DISTINCT check_id, string_split(location, ' ') AS w FROM public_checks)
        SELECT DISTINCT check_id, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN regexp_matches(array_to_string(w[greatest(i - 1, 1):i + 1], ' '), '[А-Яа-яЁё]') THEN translate(w[i], 'ABEKMHOPCTYXaeopcyx', 'АВЕКМНОРСТУХаеорсух') ELSE w[i] END), ' ') AS folded FROM w""",
    "txt_token_distance": r"""
        WITH s AS (SELECT DISTINCT check_id, pd_value AS a, rd_value AS b FROM public_checks),
        w AS (SELECT *, list_filter(string_split_regex(a, '[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '') AS wa, list_filter(string_split_regex(b, '[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '') AS wb, string_split(a, '') AS ca, string_split(b, '') AS cb FROM s),
        d AS (SELECT *, list_distinct(wa || wb) AS dw, list_distinct(ca || cb) AS dc FROM w)
        SELECT check_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN levenshtein(array_to_string(list_transform(wa, lambda x: chr((33 + list_position(dw, x))::INTEGER)), ''), array_to_string(list_transform(wb, lambda x: chr((33 + list_position(dw, x))::INTEGER)), '')) END AS words,
          CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN levenshtein(array_to_string(list_transform(ca, lambda x: chr((33 + list_position(dc, x))::INTEGER)), ''), array_to_string(list_transform(cb, lambda x: chr((33 + list_position(dc, x))::INTEGER)), '')) END AS chars FROM d""",
    "mth_drawing_jaccard": """
        WITH f AS (SELECT DISTINCT object_id, doc_stage, id, ('0x' || substr(md5(id), 1, 4))::INTEGER / 65536 AS x, ('0x' || substr(md5(id), 5, 4))::INTEGER / 65536 AS y FROM files),
        g AS (SELECT object_id, doc_stage, count(*) AS n, list(DISTINCT (floor(y * 16) * 16 + floor(x * 16))::INTEGER) FILTER (y < 0.7) AS cells FROM f GROUP BY ALL HAVING count(*) >= 10)
        SELECT a.object_id, len(list_intersect(a.cells, b.cells)) / len(list_distinct(a.cells || b.cells)) AS jaccard FROM g a JOIN g b ON a.object_id = b.object_id AND a.doc_stage = 'PD' AND b.doc_stage = 'RD'""",
    "txt_parse_number": f"SELECT DISTINCT check_id, TRY_CAST({_LOCAL} AS DOUBLE) AS number FROM (SELECT check_id, regexp_replace(pd_value, '[^0-9.,]', '', 'g') AS v FROM public_checks)",
    "txt_comparison_key": "SELECT DISTINCT check_id, CASE WHEN object_id <> '' AND parameter_code <> '' AND check_id <> '' THEN sha256(object_id || chr(0) || parameter_code || chr(0) || check_id) END AS key FROM public_checks",
    "mth_quantize": f"SELECT l_returnflag, l_linestatus, round(sum(round(x, 4)::DOUBLE), 2) AS half_up, round(sum(floor(x * 10000)::DOUBLE / 10000), 2) AS floor, round(sum(ceil(x * 10000)::DOUBLE / 10000), 2) AS ceil FROM ({_Q}) GROUP BY ALL",
    "mth_wilson": """
        WITH g AS (SELECT criticality, location_type, count(*) FILTER (violation_label = 'VIOLATION_PRESENT') AS k, count(*) AS n FROM public_checks GROUP BY ALL),
        h AS (SELECT *, k / n AS p, 1 + 3.8416 / n AS d FROM g)
        SELECT criticality, location_type, k, n, round(p, 9) AS rate,
          round(greatest(0, (p + 3.8416 / (2 * n)) / d - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / d), 9) AS low,
          round(least(1, (p + 3.8416 / (2 * n)) / d + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / d), 9) AS high FROM h""",
    "mth_unit_scale": """
        SELECT a.canon AS unit, b.canon AS target, CASE WHEN a.dimension = b.dimension THEN 2.5 * a.si_factor / b.si_factor ELSE 2.5 END AS scaled,
          a.dimension <> b.dimension AND (a.dimension IN ('power', 'pressure', 'flow', 'ratio') OR b.dimension IN ('power', 'pressure', 'flow', 'ratio')) AS unit_conflict
        FROM measure_units a CROSS JOIN measure_units b""",
    "cmp_rules": """
        WITH p AS (SELECT l_partkey, max(l_extendedprice) FILTER (l_returnflag = 'N') AS e, max(l_extendedprice) FILTER (l_returnflag = 'R') AS a, min(l_returnflag) AS et, max(l_returnflag) AS act FROM lineitem GROUP BY 1),
        s AS (SELECT *, round(a - e, 4) AS d FROM p)
        SELECT l_partkey, 'D1' AS code, CASE WHEN e IS NULL AND a IS NULL OR abs(d) <= 100 THEN 'AUTO_NO_DIFFERENCE' ELSE 'CANDIDATE' END AS status, d AS delta, NULL AS error_reason FROM s
        UNION ALL SELECT l_partkey, 'D2', CASE WHEN e IS NULL AND a IS NULL OR abs(d) / greatest(abs(e), abs(a)) <= 0.05 OR d >= 0 THEN 'AUTO_NO_DIFFERENCE' ELSE 'CANDIDATE' END, d, NULL FROM s
        UNION ALL SELECT l_partkey, 'O1', CASE WHEN a >= e THEN 'AUTO_NO_DIFFERENCE' ELSE 'CANDIDATE' END, d, NULL FROM s
        UNION ALL SELECT l_partkey, 'O2', CASE WHEN a < 50000 THEN 'AUTO_NO_DIFFERENCE' ELSE 'CANDIDATE' END, round(a - 50000, 4), NULL FROM s
        UNION ALL SELECT l_partkey, 'R1', CASE WHEN a BETWEEN 20000 AND 60000 THEN 'AUTO_NO_DIFFERENCE' ELSE 'CANDIDATE' END, NULL, NULL FROM s
        UNION ALL SELECT l_partkey, 'S1', CASE WHEN act IN ('A', 'N') THEN 'AUTO_NO_DIFFERENCE' ELSE 'CANDIDATE' END, NULL, NULL FROM s
        UNION ALL SELECT l_partkey, 'C1', 'AUTO_NO_DIFFERENCE', strpos('ANR', act) - strpos('ANR', et), NULL FROM s
        UNION ALL SELECT l_partkey, 'X1', NULL, NULL, 'unknown operator' FROM s""",
    "cmp_text": "SELECT DISTINCT check_id, CASE WHEN pd_value = rd_value THEN 'AUTO_NO_DIFFERENCE' ELSE 'CANDIDATE' END AS status, CASE WHEN id_value IS NOT NULL THEN 'AUTO_NO_DIFFERENCE' ELSE 'MISSING_EVIDENCE' END AS presence FROM public_checks",
    "cmp_class_ladder": """
        WITH r AS (SELECT o_orderpriority AS priority, list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) - 3 AS k FROM orders)
        SELECT priority, CASE WHEN k >= 0 THEN 'AUTO_NO_DIFFERENCE' WHEN k < 0 THEN 'CANDIDATE' END AS status, k::DOUBLE AS steps, CASE WHEN k IS NULL THEN 'unknown class' END AS error, count(*) AS n FROM r GROUP BY ALL""",
}
