"""Values read from token tables (EXT-01 to EXT-16, CMP-11 to CMP-16).

A token is a row (file_id, page, ix, text, x0, y0, x1, y1), ix being its place in reading order;
rules are rows (code, anchors, regex, tolerance ...).  Anchors are looked for page by page, a page
being a bounded group; see `anchors` for what is read beside them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.measure import box_iou, jaccard, parallel_pairs, width_mm
from pagelens.functions.text import enum_value, fold_label, parse_number, system_marks
from pagelens.operators import anchors as pages
from pagelens.session import small

PLACE = ["file_id", "page"]
#: Lower edge of the part of a page above the stamp.
STAMP_TOP = 0.70
#: Pages of one stage in a tile of page pairs.
TILE = 4000


def tokens_of_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """file_id, page, ix, text, x0, y0, x1, y1 of plain text: words in order, lines as rows of a page (SRC-06, SRC-07 geometry)."""
    lines = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("file_id"), F.posexplode(F.split(text, r"\r?\n")).alias("row", "line"))
    words = lines.select("file_id", "row", F.posexplode(F.split(F.trim(F.regexp_replace("line", r"(?U)\s+", " ")), " ")).alias("col", "text")).where("text <> ''")
    y, x = F.least(F.col("row"), F.lit(40)) * 0.02, F.least(F.col("col"), F.lit(40)) * 0.02
    return words.select("file_id", F.lit(1).alias("page"), (F.col("row").cast("bigint") * 1_000_000 + F.col("col")).alias("ix"), "text", x.alias("x0"), y.alias("y0"), (x + 0.02).alias("x1"), (y + 0.02).alias("y1"))


def _rules(rules: DataFrame) -> list[pages.Rule]:
    """The rules, a list of fixed size, as plain values; number_regex, unit, steps and norms may be left out."""
    known = [c for c in ("code", "anchors", "number_regex", "unit", "steps", "norms") if c in rules.columns]
    return [pages.rule(**r.asDict()) for r in rules.select(*known).collect()]


#: Blanks of any kind between words, as (?U)\s has them.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def text_pages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """file_id, page, body of plain texts: a page each, whose lines are its rows.

    Such pages need not be cut into tokens and gathered again: the readers below take them whole
    where they lie, without a shuffle.
    """
    return docs.where(F.col(text).isNotNull()).select(F.col(key).alias("file_id"), F.lit(1).alias("page"), F.col(text).alias("body"))


def _by_page(tokens: DataFrame, rules: list[pages.Rule], columns: str, found) -> DataFrame:
    """file_id, page and what found(page, places, rule, start, end) gives for each anchor span; pages that name no anchor are passed over.

    tokens: a token table, brought together by page, or text_pages.
    """
    whole = "body" in tokens.columns
    t = tokens.select(*PLACE, "body") if whole else tokens.select(*PLACE, "ix", "text", "y0", "y1").where("text is not null")
    kinds = dict(t.dtypes)
    names = [*PLACE, "code", "start", "end", *(c.strip().split()[0] for c in columns.split(";"))]
    schema = ", ".join([f"file_id {kinds['file_id']}", f"page {kinds['page']}", "code string", "start bigint", "end bigint", *(c.strip() for c in columns.split(";"))])

    def one(key: tuple, rows: list[tuple]) -> list[tuple]:
        page = pages.Page([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])
        said = " ".join(f for f in page.folded if f)
        out = []
        for r in rules:
            if any(a in said for a in r.anchors):
                for start, end in pages.spans(page.folded, r.anchors):
                    hit = found(page, [x[0] for x in rows], r, start, end)
                    if hit is not None:
                        out.append((*key, r.code, rows[start][0], rows[end][0], *hit))
        return out

    def named(body: str) -> bool:
        said = pages.fold_once(body)
        return any(a in said for r in rules for a in r.anchors)

    def lines(body: str) -> list[tuple]:
        return [(row * 1_000_000 + col, word, float(row), row + 1.0) for row, line in enumerate(re.split(r"\r?\n", body)) for col, word in enumerate(w for w in _BLANKS.split(line) if w)]

    def walk_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for f, p, body in zip(b["file_id"], b["page"], b["body"]) if named(body) for x in one((f, p), lines(body))], columns=names)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, out = None, [], []
        for b in batches:
            for f, p, *token in zip(b["file_id"], b["page"], b["ix"], b["text"], b["y0"], b["y1"]):
                if (f, p) != key:
                    if rows:
                        out += one(key, rows)
                    key, rows = (f, p), []
                rows.append(tuple(token))
            yield pd.DataFrame(out, columns=names)
            out = []
        if rows:
            yield pd.DataFrame(one(key, rows), columns=names)

    return t.mapInPandas(walk_whole, schema) if whole else t.repartition(*PLACE).sortWithinPartitions(*PLACE, "ix").mapInPandas(walk, schema)


def anchor_spans(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """EXT-01: file_id, page, code, start, end, after: for each token the shortest span of at most eight from it whose folded text contains an anchor, and the text of the tokens after it.

    rules: code, anchors (array).  `after` is of the twelve tokens that follow, those on the row of the span's end if any are.
    """

    def after(page: pages.Page, places: list[int], r: pages.Rule, start: int, end: int) -> tuple:
        rest = range(end + 1, min(len(places), end + 1 + pages.AFTER_WORDS))
        return (" ".join(page.words[i] for i in [j for j in rest if page.overlap(end, j)] or rest),)

    return _by_page(tokens, _rules(rules), "after string", after)


def extract_numbers(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """EXT-02: code, file_id, value, last_value, page, start, confidence: of each rule and file the best-placed number beside an anchor.

    rules: code, anchors, and where needed number_regex, unit (values are brought to it, those of
    another dimension passed over), steps of the notation and norms.  Read are the plain numbers
    after the anchor on its row, else the nearest one before it on its row, else bracketed ones
    (notes) after it; where nothing stands after it on the row, the next twelve tokens.  The first
    and the last number are two reads; where they differ the confidence is .40, else .99.  Of
    several anchors the one whose number is on its row, no note, under no foreign norm, not zero,
    nearest, and on a numbered row wins.
    """

    def best(page: pages.Page, places: list[int], r: pages.Rule, start: int, end: int) -> tuple | None:
        hit = page.best_number(start, end, r)
        return hit and (*hit[0], hit[1], hit[2])

    marks = ["off_row", "note", "foreign", "zero", "distance", "unnumbered"]
    s = _by_page(tokens, _rules(rules), "off_row boolean; note boolean; foreign boolean; zero boolean; distance int; unnumbered boolean; value double; last_value double", best)
    agree = F.col("value") == F.col("last_value")
    r = F.min_by(F.struct("value", "last_value", "page", "start", F.when(agree, 0.99).otherwise(0.40).alias("confidence")), F.struct(*marks, "page", "end", "start"))
    return s.groupBy("code", "file_id").agg(r.alias("r")).select("code", "file_id", "r.*")


def extract_text(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """EXT-03, EXT-04: code, file_id, value, agree: what the rule's regex finds after the file's first anchor; the first and last match must agree.

    rules: code, anchors, regex; a rule without regex reads nothing.
    """
    first = anchor_spans(tokens, rules).groupBy("code", "file_id").agg(F.min_by("after", F.struct("page", "start")).alias("said"))
    j = first.join(small(rules.where("regex is not null").select("code", "regex")), "code")
    j = j.withColumn("found", F.transform(F.regexp_extract_all("said", F.concat(F.lit("(?iu)"), "regex"), F.lit(0)), enum_value)).where(F.size("found") > 0)
    return j.select("code", "file_id", F.get("found", F.lit(0)).alias("value"), (F.get("found", F.lit(0)) == F.try_element_at("found", F.lit(-1))).alias("agree"))


def extract_presence(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """EXT-05: code, file_id, page, start of the first anchor."""
    return anchor_spans(tokens, rules).groupBy("code", "file_id").agg(F.min(F.struct("page", "start")).alias("r")).select("code", "file_id", "r.*")


def element_table(tokens: DataFrame) -> DataFrame:
    """EXT-06: file_id, page, mark, value, error: rows of marks with one number each.

    Tokens join the row whose first token they overlap in height, which depends on order, so each
    page is walked in one piece; a page is a bounded group.  Several numbers or none in a row of
    marks, and a repeated mark, are errors.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {"page": None, "row": 0, "top": None}
        for b in batches:
            ids = []
            for f, p, y0, y1 in zip(b["file_id"], b["page"], b["y0"], b["y1"]):
                if state["page"] != (f, p):
                    state.update(page=(f, p), row=0, top=(y0, y1))
                elif not (y0 < state["top"][1] and state["top"][0] < y1):
                    state.update(row=state["row"] + 1, top=(y0, y1))
                ids.append(state["row"])
            yield b.assign(row=ids)

    t = tokens.where(~F.col("text").contains(":")).select(*PLACE, "ix", "text", "y0", "y1")
    kinds = dict(t.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in t.columns), "row int"])
    t = t.repartition(*PLACE).sortWithinPartitions(*PLACE, "ix").mapInPandas(rows, schema)
    g = t.groupBy(*PLACE, "row").agg(F.array_sort(F.collect_list(F.struct("ix", "text"))).alias("w"))
    said = F.transform("w", lambda x: x["text"])
    marks = F.flatten(F.transform(F.filter(said, lambda x: F.upper(x).rlike(r"^[A-ZА-ЯЁ]+\d[\d.,\-/A-ZА-ЯЁ]*$")), system_marks))
    numbers = F.filter(said, lambda x: x.rlike(r"^\d+(?:[.,]\d+)?$"))
    g = g.withColumn("marks", marks).withColumn("numbers", numbers).where(F.size("marks") > 0)
    e = g.select(*PLACE, F.explode("marks").alias("mark"), F.when(F.size("numbers") == 1, parse_number(F.get("numbers", F.lit(0)))).alias("value"))
    return e.groupBy("file_id", "mark").agg(F.min("page").alias("page"), F.count(F.lit(1)).alias("n"), F.max("value").alias("v")).select("file_id", "page", "mark", F.when(F.col("n") == 1, F.col("v")).alias("value"), F.when(F.col("n") > 1, "repeated mark").when(F.col("v").isNull(), "number").alias("error"))


def multi_field(tokens: DataFrame, units: DataFrame) -> DataFrame:
    """EXT-07: code, file_id, unit, value, reason: for each unit of a rule (`a / b`) its one number.

    units: code, unit (text with slashes).  A unit found more or less than once is a reason.
    """
    u = units.select("code", F.posexplode(F.split("unit", r"\s*/\s*")).alias("place", "unit")).withColumn("key", fold_label(F.col("unit")))
    w = Window.partitionBy(*PLACE).orderBy("ix")
    t = tokens.select("file_id", F.lag("text").over(w).alias("before"), fold_label(F.col("text")).alias("key")).withColumn("value", parse_number(F.col("before"))).where("value is not null")
    hits = t.join(small(u), "key").groupBy("code", "file_id", "place", "unit").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("v"))
    files = hits.select("code", "file_id").distinct()
    every = files.join(small(u.select("code", "place", "unit")), "code")
    r = every.join(hits, ["code", "file_id", "place", "unit"], "left")
    return r.select("code", "file_id", "place", "unit", F.when(F.col("n") == 1, F.col("v")).alias("value"), F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").alias("reason"))


def drawing_scale(tokens: DataFrame) -> DataFrame:
    """EXT-10: file_id, page, scale: 1:N in the stamp of the first page that has one."""
    t = tokens.where(F.col("y0") >= STAMP_TOP).withColumn("scale", F.regexp_extract("text", r"^1\s*:\s*(\d+)$", 1).try_cast("int")).where("scale is not null")
    return t.groupBy("file_id").agg(F.min_by(F.struct("page", "scale"), F.struct("page", "ix")).alias("r")).select("file_id", "r.*")


def contour_area(rectangles: DataFrame, min_side: float = 20, most_of_page: float = 0.9) -> DataFrame:
    """EXT-09: file_id, page, area_m2 where exactly one rectangle (width, height in points; page_width, page_height, scale) qualifies."""
    r = rectangles.where((F.least("width", "height") >= min_side) & (F.col("width") * F.col("height") <= most_of_page * F.col("page_width") * F.col("page_height")))
    side = lambda c: F.col(c) * (25.4 / 72) * F.col("scale") / 1000
    return r.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n"), F.max(side("width") * side("height")).alias("area_m2")).where("n = 1").drop("n")


def dual_read(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """EXT-12: keys, value, agree: the value of two independent reads where they agree within the tolerance, else null."""
    j = a.select(*keys, F.col("value").alias("a")).join(b.select(*keys, F.col("value").alias("b")), keys, "full_outer")
    agree = F.abs(F.col("a") - F.col("b")) <= tolerance
    return j.select(*keys, F.when(agree, F.col("a")).alias("value"), F.coalesce(agree, F.lit(False)).alias("agree"))


def geometry_fallback(misses: DataFrame, tokens: DataFrame, rules: DataFrame, reach: float = 0.06) -> DataFrame:
    """EXT-11: for (code, file_id) without a value the nearest number within reach of a word of five letters or more of an anchor; the rest needs a measurement.

    Words and numbers of a page meet in cells of the width of the reach.
    """
    words = rules.select("code", F.explode("anchors").alias("a")).select("code", F.explode(F.split(fold_label(F.col("a")), " ")).alias("word")).where(F.length("word") >= 5).distinct()
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    t = tokens.select(*PLACE, "ix", "text", cx.alias("x"), cy.alias("y"), F.floor(cx / reach).alias("gx"), F.floor(cy / reach).alias("gy"))
    at = t.withColumn("word", fold_label(F.col("text"))).join(small(words), "word").join(misses.select("code", "file_id"), ["code", "file_id"], "left_semi")
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    at = at.select("code", *PLACE, F.col("x").alias("ax"), F.col("y").alias("ay"), "gx", "gy", F.explode(near).alias("d")).select("code", *PLACE, "ax", "ay", (F.col("gx") + F.col("d.i")).alias("gx"), (F.col("gy") + F.col("d.j")).alias("gy"))
    numbers = t.withColumn("value", parse_number(F.col("text"))).where("value is not null").select(*PLACE, "ix", "x", "y", "gx", "gy", "value")
    d = F.sqrt(F.pow(F.col("x") - F.col("ax"), 2) + F.pow(F.col("y") - F.col("ay"), 2))
    hit = at.join(numbers, [*PLACE, "gx", "gy"]).withColumn("d", d).where(F.col("d") <= reach).groupBy("code", "file_id").agg(F.min_by("value", F.struct("d", "page", "ix")).alias("value"))
    return misses.select("code", "file_id").join(hit, ["code", "file_id"], "left").select("code", "file_id", "value", F.when(F.col("value").isNull(), "MEASUREMENT_REQUIRED").otherwise("PRINTED").alias("source"))


def provision_hits(pd_texts: DataFrame, rd_sheets: DataFrame, stop: tuple[str, ...] = ("предусмотрен", "проектом")) -> DataFrame:
    """EXT-13: object_id, room, promise: what the design provides for a room and no working sheet of that room names.

    pd_texts, rd_sheets: object_id, text.  Stems are the first letters of the words of four letters or more.
    """
    clause = r"(?iu)пом\.?\s*(?:№\s*)?([0-9А-Яа-я.,\s]*?\d[0-9А-Яа-я.,\s]*?)\s+предусмотрен\w*\s+([^.;()]+)"
    found = pd_texts.select("object_id", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(clause), 1).alias("rooms"), F.regexp_extract_all("text", F.lit(clause), 2).alias("promise"))).alias("c"))
    rooms = found.select("object_id", F.explode(F.regexp_extract_all("c.rooms", F.lit(r"(\d+[а-я]?)"), 1)).alias("room"), F.trim("c.promise").alias("promise")).groupBy("object_id", "room").agg(F.min("promise").alias("promise"))
    stems = rooms.select("object_id", "room", F.explode(F.regexp_extract_all(F.lower("promise"), F.lit(r"([а-яё]{4,})"), 1)).alias("word")).where(~F.col("word").isin(*stop)).select("object_id", "room", F.left("word", F.lit(5)).alias("stem"))
    said = rd_sheets.select("object_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\w.,])(\d+[а-я]?)(?![\w,])"), 1))).alias("room"), F.array_distinct(F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"([а-яё]{4,})"), 1), lambda w: F.left(w, F.lit(5)))).alias("stems"))
    on_sheet = rooms.join(said.select("object_id", "room").distinct(), ["object_id", "room"], "left_semi")
    kept = stems.join(said.select("object_id", "room", F.explode("stems").alias("stem")).distinct(), ["object_id", "room", "stem"], "left_semi").select("object_id", "room").distinct()
    return on_sheet.join(kept, ["object_id", "room"], "left_anti")


def bind_nearest(features: DataFrame, rooms: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """EXT-15: keys, feature, room: each feature (feature, x, y) goes to the nearest room (room, x, y) within the radius; a tie of different rooms to none.

    Both sides meet in cells of the radius' width.
    """
    cell = lambda c, off: F.floor(F.col(c) / radius) + off
    near = F.explode(F.array(*(F.struct((cell("x", i)).alias("gx"), (cell("y", j)).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("g")
    f = features.select(*keys, "feature", F.col("x").alias("fx"), F.col("y").alias("fy"), near).select(*keys, "feature", "fx", "fy", "g.gx", "g.gy")
    r = rooms.select(*keys, "room", "x", "y", cell("x", 0).alias("gx"), cell("y", 0).alias("gy"))
    d = F.round(F.sqrt(F.pow(F.col("x") - F.col("fx"), 2) + F.pow(F.col("y") - F.col("fy"), 2)), 9)
    p = f.join(r, [*keys, "gx", "gy"]).withColumn("d", d).where(F.col("d") <= radius)
    g = p.groupBy(*keys, "feature", "fx", "fy", "d").agg(F.min("room").alias("room"), F.countDistinct("room").alias("n"))
    best = g.groupBy(*keys, "feature", "fx", "fy").agg(F.min_by(F.struct("room", "n", "d"), "d").alias("b"))
    return best.where("b.n = 1").select(*keys, "feature", F.col("b.room").alias("room"), F.col("b.d").alias("d"))


def element_match(pd_marks: DataFrame, rd_marks: DataFrame, keys: list[str]) -> DataFrame:
    """EXT-16: keys, matched, total, status of the marks (mark, box) of two stages; a repeated mark is an annotation conflict."""

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.groupBy(*keys, "mark").agg(F.count(F.lit(1)).alias(f"n_{s}"), F.min("box").alias(f"box_{s}"))

    j = side(pd_marks, "pd").join(side(rd_marks, "rd"), [*keys, "mark"], "full_outer")
    hit = F.coalesce(box_iou(F.col("box_pd"), F.col("box_rd")) >= 0.5, F.lit(False)) & F.col("n_pd").isNotNull() & F.col("n_rd").isNotNull()
    g = j.groupBy(*keys).agg(F.count_if(hit).alias("matched"), F.count(F.lit(1)).alias("total"), F.bool_or((F.coalesce("n_pd", F.lit(0)) > 1) | (F.coalesce("n_rd", F.lit(0)) > 1)).alias("twice"))
    return g.select(*keys, "matched", "total", F.when(F.col("twice"), "ANNOTATION_CONFLICT").when(F.col("matched") == F.col("total"), "MATCH").otherwise("PARTIAL_MATCH").alias("status"))


def align(a: DataFrame, b: DataFrame, keys: list[str], part: str, tolerance: float) -> DataFrame:
    """CMP-11, CMP-12: keys, status, part, expected, actual: two tables or field lists with the same parts; the first difference, else the first part.

    Unequal sets of parts can't be compared.
    """
    j = a.select(*keys, part, F.col("value").alias("expected")).join(b.select(*keys, part, F.col("value").alias("actual")), [*keys, part], "full_outer")
    bad = F.coalesce(F.abs(F.col("actual") - F.col("expected")) > tolerance, F.lit(True))
    g = j.groupBy(*keys).agg(F.bool_or(F.col("expected").isNull() | F.col("actual").isNull()).alias("uneven"), F.bool_or(bad).alias("differs"), F.min_by(F.struct(part, "expected", "actual"), F.struct(~bad, part)).alias("r"))
    return g.select(*keys, F.when(F.col("uneven"), "CLARIFICATION_REQUIRED").when(F.col("differs"), "CANDIDATE").otherwise("AUTO_NO_DIFFERENCE").alias("status"), "r.*")


def page_pairs(pd_pages: DataFrame, rd_pages: DataFrame, keys: list[str], least: float = 0.5, digits: int | None = None) -> DataFrame:
    """CMP-13: pairs of pages of two stages whose room sets (page, rooms) overlap; pages meet through the rooms that they share.

    Two sets with the overlap asked for share one of the rarest rooms of each, namely of the
    (1 - least) * size + 1 rarest, so pages meet through these alone and not through a room that
    stands on every page; two sets that share several of them meet in the rarest.  Pages of equal sets
    go as one row with a list of pages, and pairs are unfolded after the last shuffle, so what is
    shuffled follows the pages and not their pairs.  A room of many pages is a grid of tiles.
    digits: places to which the overlap is rounded, once for two sets.
    """
    wide = 4 * int(pd_pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of our own, as few bytes become many rows
    one = lambda df, s: df.select(*keys, F.col("page").alias(f"{s}_page"), F.array_sort(F.array_distinct("rooms")).alias(f"{s}_rooms"))
    a, b = one(pd_pages, "pd"), one(rd_pages, "rd")
    sets = lambda df, s: df.groupBy(*keys, f"{s}_rooms").agg(F.count(F.lit(1)).alias(f"{s}_n")).select(*keys, f"{s}_rooms", f"{s}_n", F.explode(f"{s}_rooms").alias("room"))
    n = sets(a, "pd").select(*keys, "room", "pd_n", F.lit(0).alias("rd_n")).unionByName(sets(b, "rd").select(*keys, "room", F.lit(0).alias("pd_n"), "rd_n"))
    tiles = lambda c: F.greatest(F.lit(1), F.ceil(F.sum(c) / TILE)).cast("int").alias(c[:2])
    n = n.groupBy(*keys, "room").agg((F.sum("pd_n") + F.sum("rd_n")).alias("n"), tiles("pd_n"), tiles("rd_n"))

    def rarest(df: DataFrame, s: str, other: str, most: int) -> DataFrame:
        rooms = f"{s}_rooms"
        r = sets(df, s).join(n, [*keys, "room"]).groupBy(*keys, rooms, f"{s}_n").agg(F.array_sort(F.collect_list(F.struct("n", "room", "pd", "rd"))).alias("r"))
        part = F.pmod(F.xxhash64(f"{s}_page"), F.ceil(F.col(f"{s}_n") / most)).alias("part")
        g = df.join(r, [*keys, rooms]).groupBy(*keys, rooms, part).agg(F.collect_list(f"{s}_page").alias(f"{s}_pages"), F.any_value("r").alias("r"))
        k = F.size("r") - F.ceil(F.size("r") * F.lit(least) - 1e-9).cast("int") + 1
        g = g.select(*keys, rooms, f"{s}_pages", "part", "r", F.posexplode(F.slice("r", 1, k)).alias("i", "x"))
        before = F.transform(F.slice("r", F.lit(1), F.col("i")), lambda x: x["room"]).alias(f"{s}_before")
        tile = F.pmod(F.xxhash64(rooms, "part"), F.col(f"x.{s}")).cast("int").alias(f"{s}_tile")
        return g.select(*keys, rooms, f"{s}_pages", before, "x.room", tile, F.explode(F.sequence(F.lit(0), F.col(f"x.{other}") - 1)).alias(f"{other}_tile")).repartition(wide, *meet)

    meet = [*keys, "room", "pd_tile", "rd_tile"]
    j = rarest(a, "pd", "rd", 64).join(rarest(b, "rd", "pd", 1024), meet).where(~F.arrays_overlap("pd_before", "rd_before"))
    j = j.withColumn("overlap", jaccard(F.col("pd_rooms"), F.col("rd_rooms"))).where(F.col("overlap") >= least)
    j = j.select(*keys, "pd_pages", "rd_pages", "overlap" if digits is None else F.round("overlap", digits).alias("overlap"))
    return j.select(*keys, F.explode("pd_pages").alias("pd_page"), "rd_pages", "overlap").select(*keys, "pd_page", F.explode("rd_pages").alias("rd_page"), "overlap")


def room_diff(pd_rooms: DataFrame, rd_rooms: DataFrame, keys: list[str], most: int = 12) -> DataFrame:
    """CMP-13: keys, room, verdict from the features of a pair's rooms (room, feature or null).

    A feature missing in RD is a candidate; one only in RD, or a room on one side only, a suspicion;
    pairs with more than `most` differences abstain.
    """

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.groupBy(*keys, "room").agg(F.bool_or(F.col("feature").isNotNull()).alias(f"{s}_has"))

    j = side(pd_rooms, "pd").join(side(rd_rooms, "rd"), [*keys, "room"], "full_outer")
    v = F.when(F.col("pd_has").isNull() | F.col("rd_has").isNull(), "suspicion").when(F.col("pd_has") & ~F.col("rd_has"), "candidate").when(~F.col("pd_has") & F.col("rd_has"), "suspicion").otherwise("match")
    j = j.withColumn("verdict", v)
    n = j.groupBy(*keys).agg(F.count_if(F.col("verdict") != "match").alias("n"))
    return j.join(n, keys).select(*keys, "room", F.when((F.col("n") > most) & (F.col("verdict") != "match"), "abstain").otherwise(F.col("verdict")).alias("verdict"))


def across_sheets(pd_rooms: DataFrame, rd_rooms: DataFrame, settled: DataFrame, keys: list[str]) -> DataFrame:
    """CMP-15: keys, room, verdict of the rooms that stand on sheets of both stages and that no pair of sheets has settled; a feature (null for none) on any sheet counts."""

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.groupBy(*keys, "room").agg(F.bool_or(F.col("feature").isNotNull()).alias(s))

    j = side(pd_rooms, "p").join(side(rd_rooms, "r"), [*keys, "room"]).join(settled.select(*keys, "room").distinct(), [*keys, "room"], "left_anti")
    return j.select(*keys, "room", F.when(F.col("p") & ~F.col("r"), "candidate").when(F.col("r") & ~F.col("p"), "suspicion").otherwise("match").alias("verdict"))


def collapse_rooms(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """CMP-14: one verdict per room: abstain wins; several positive kinds, or one beside a match, abstain."""
    g = diffs.groupBy(*keys, "room").agg(F.collect_set("verdict").alias("v"))
    positive = F.filter("v", lambda x: x.isin("candidate", "suspicion"))
    verdict = F.when(F.array_contains("v", "abstain") | (F.size(positive) > 1) | ((F.size(positive) == 1) & F.array_contains("v", "match")), "abstain").otherwise(F.array_max("v"))
    return g.select(*keys, "room", verdict.alias("verdict"))


def room_status(verdict: Column, has_pd: Column, has_rd: Column) -> Column:
    """CMP-16."""
    return F.when(~has_pd | ~has_rd, "ABSTAIN").when(verdict == "candidate", "CANDIDATE").when(verdict == "suspicion", "SUSPICION").when(verdict == "match", "AUTO_NO_DIFFERENCE").otherwise("ABSTAIN")


def duct_width(segments: DataFrame, scales: DataFrame, labels: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """EXT-08: file_id, page, width_mm, agrees: where a page has exactly one parallel pair, its width at the drawing's scale; the label printed on the page must agree.

    segments as for parallel_pairs, scales: file_id, scale; labels: file_id, page, label_mm.  A page
    of several pairs, without scale or without label has a null width.
    """
    pairs = parallel_pairs(segments, PLACE).groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("gap"))
    said = labels.groupBy(*PLACE).agg(F.min("label_mm").alias("label_mm"))
    j = pairs.join(scales.select("file_id", "scale"), "file_id", "left").join(said, PLACE, "left").withColumn("mm", width_mm(F.col("gap"), F.col("scale")))
    agrees = (F.col("n") == 1) & (F.abs(F.col("mm") - F.col("label_mm")) <= tolerance * F.col("label_mm"))
    return j.select(*PLACE, F.when(agrees, F.col("mm")).alias("width_mm"), F.coalesce(agrees, F.lit(False)).alias("agrees"))


CIPHER = r"([А-ЯA-Z]{1,6}\d*(?:-\d+)*-(?:П|Р|И|ПД|РД|ИД)-[А-ЯЁ]{1,4}\d*(?:\.\d+)*)"


def passports(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """EXT-14, REV-01 to REV-03: file_id, cipher, ambiguous, sheet, stage, approved_on, approval, confidence from the stamp of the first page.

    tokens: the token table; names: file_id, name.  The cipher is the designation that stands most
    often in the stamp (none if two do); a stage in the stamp that differs from the one in the file's
    name leaves the stage open; approval needs its word and a person's name in the stamp; the
    confidence is the share of cipher, sheet and stage that were read.
    """
    stamp = tokens.where((F.col("page") == 1) & (F.col("y0") >= STAMP_TOP))
    n = stamp.select("file_id", F.regexp_extract(F.upper("text"), CIPHER, 1).alias("cipher")).where("cipher <> ''").groupBy("file_id", "cipher").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("file_id").agg(F.max(F.struct("n", "cipher")).alias("b"), F.collect_list("n").alias("all"))
    cipher = best.select("file_id", F.when(F.size(F.filter("all", lambda x: x == F.col("b.n"))) == 1, F.col("b.cipher")).alias("cipher"), (F.size(F.filter("all", lambda x: x == F.col("b.n"))) > 1).alias("ambiguous"))
    said = stamp.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "text"))), lambda t: t["text"]), " ").alias("said"))
    date = F.try_to_date(F.regexp_extract("said", r"(\d{2}\.\d{2}\.\d{4})", 1), "dd.MM.yyyy")
    in_stamp = F.coalesce(*[F.when(F.col("said").rlike(rf"(?iu)стадия\s+{s}(?![А-Яа-яЁё])"), v) for s, v in (("П", "PD"), ("Р", "RD"), ("И", "ID"))])
    in_name = F.coalesce(*[F.when(F.col("name").rlike(rf"(?iu)(?:^|[-_ /])(?:{a}|{v})(?:[-_ /.]|$)"), v) for a, v in (("ПД", "PD"), ("РД", "RD"), ("ИД", "ID"))])
    person = F.col("said").rlike(r"[А-ЯЁ][а-яё]+\s+[А-ЯЁ]\.\s*[А-ЯЁ]\.|[А-ЯЁ]\.\s*[А-ЯЁ]\.\s*[А-ЯЁ][а-яё]+")
    approval = F.when(F.col("said").rlike("(?iu)утвержд") & person, "APPROVED").otherwise("UNKNOWN")
    stage = F.when(in_stamp.isNull() | in_name.isNull() | (in_stamp == in_name), F.coalesce(in_stamp, in_name))
    sheet = F.nullif(F.regexp_extract("said", r"(?iu)лист\s+(\d+)", 1), F.lit("")).try_cast("int")
    j = names.select("file_id", "name").join(cipher, "file_id", "left").join(said, "file_id", "left").select("file_id", "cipher", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), sheet.alias("sheet"), stage.alias("stage"), date.alias("approved_on"), approval.alias("approval"))
    return j.withColumn("confidence", F.size(F.array_compact(F.array(F.col("cipher"), F.col("sheet").cast("string"), F.col("stage")))) / 3.0)
