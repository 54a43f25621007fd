"""Text operators against plain Python and the tokenizers library."""

import itertools
import random
import unicodedata

import numpy as np
import pytest

from tests.oracle import oracle_rows, rows

canon = pytest.importorskip("pagelens.llm.canon")
packing = pytest.importorskip("pagelens.llm.packing")
readability = pytest.importorskip("pagelens.llm.readability")
T = pytest.importorskip("pagelens.llm.tokenizer")
queries = pytest.importorskip("pagelens.llm.queries")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, testdata, name):
    df = queries.QUERIES[name](spark, testdata)
    cols, expected = oracle_rows(testdata, queries.SQL[name])
    assert sorted(df.columns) == cols and rows(df) == expected


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.SQL.keys()))
def test_query_runs(spark, testdata, name):
    assert queries.QUERIES[name](spark, testdata).count() > 0


SAME = [
    ("Этаж 4, секция А", "Этaж 4, cекция A"),
    ("ёлка", "ёлка"),
    ("ёлка", "ëлка"),
    ("Ёж", "Ëж"),
    ("АР-1", "﻿АР‐1 "),
    ("АР-1", "ＡＰ‑１"),
    ("тамбур", "там​б­ур"),
    ("й", "й"),
]
DIFFERENT = [("м2", "м²"), ("А1", "а1"), ("А 1", "А1"), ("А1", "А1."), ("339А", "339α"), ("м8", "μ8"), ("а  б", "а б")]


def test_canonical(spark):
    values = [None, "", "   ", "​", "x" * 70_000 + "​", *itertools.chain(*SAME, *DIFFERENT)]
    df = spark.createDataFrame([(i, v, "other") for i, v in enumerate(values)], "i int, value string, canonical string")
    got = {r.value: r.canonical for r in canon.canonicalize(df).collect()}
    assert got[None] is None and got[""] == got["   "] == got["​"] == "" and got["x" * 70_000 + "​"] == "х" * 0 + "x" * 70_000
    for a, b in SAME:
        assert got[a] == got[b], (a, b)
    for a, b in DIFFERENT:
        assert got[a] != got[b], (a, b)
    assert all(unicodedata.is_normalized("NFC", v) for v in got.values() if v)


def test_fast_form_is_the_full_form():
    import duckdb

    rng = random.Random(8)
    parts = ["а", "б", "А", "ё", "Ё", "й", "Y", "y", "a", "B", "1", " ", "-", "‐", "²", "№", "—", "(", "\\", "[", "]", "^", "`", "{", "~", "\u200b", "\u0308", "Ｂ", "0", ",", "У", "у", "и", "\u0306", "І", "\u3000"]
    values = ["".join(rng.choice(parts[: rng.choice([6, 20, len(parts)])]) for _ in range(rng.randint(0, 8))) for _ in range(5000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?::VARCHAR[]) AS v", [values])
    assert con.sql(f"SELECT count(*) FROM ({canon.canonical_query('t', 'v')}) a JOIN ({canon.canonical_query('t', 'v', False)}) b ON a.v = b.v AND a.canonical <> b.canonical").fetchall() == [(0,)]


def test_fast_form_of_every_allowed_character():
    """Each character that the fast test lets pass, alone and beside a letter that only Cyrillic has."""
    import duckdb

    plain = [chr(c) for c in [*range(0x20, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F), *range(0x410, 0x450), 0x401, 0x451, *map(ord, "№²³—‰")]]
    values = [v for c in plain for v in (c, f"{c}б", f"Щ{c}", f"б{c}б", f" {c}{c}ж ")]
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?::VARCHAR[]) AS v", [values])
    assert con.sql(f"SELECT count(*) FROM ({canon.canonical_query('t', 'v')}) a JOIN ({canon.canonical_query('t', 'v', False)}) b ON a.v = b.v AND a.canonical <> b.canonical").fetchall() == [(0,)]


def test_equal_in_print(spark):
    r = [("f", "g", "1", "А1"), ("f", "g", "2", "A1"), ("f", "g", "3", "А1"), ("f", "g", "3", "А1"), ("f", "h", "4", "A1"), ("e", "g", "5", "A1"), ("f", "g", "6", None), ("f", None, "7", "A1"), ("f", "g", None, "A1"), ("f", "g", "8", "А1​")]
    df = spark.createDataFrame(r, "field string, grp string, key string, value string")
    got = {tuple(x) for x in canon.equal_in_print(df).collect()}
    assert got == {tuple(x) for x in canon.equal_in_print(df, hot_rows=1).collect()}
    assert [(r.n_strings, r.n_records) for r in canon.print_classes(df).collect()] == [(3, 4)]
    assert got == {("f", "1", "2"), ("f", "2", "3"), ("f", "1", "8"), ("f", "2", "8"), ("f", "3", "8")}
    assert canon.equal_in_print(spark.createDataFrame([], "field string, grp string, key string, value string")).count() == 0


@pytest.fixture(scope="module")
def vocab():
    return T.vocabulary("byte_bpe_50k")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


PARTS = ["a", "b", "e", " ", "  ", "\n", "'s", "'ll", "'", "!", "1", "23", "я", "ё", "жы", " the", "ing", " ", " ", "😀", "́", "\x1c", "\t", "--", "==", "<|endoftext|>", "。", "中文"]


def test_encoding_equals_library(vocab, library):
    rng = random.Random(1)
    enc = T.Encoder([vocab])
    for _ in range(1500):
        s = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(enc(s), dtype="<i4").tolist() == library(s), repr(s)


def test_streaming_equals_library(vocab, library):
    rng = random.Random(2)
    for parts in (["a", "b"], ["ab", "ba", "aab"], ["я", "а"], ["!", "'", "-"], [" "], ["1", "0"], ["the", "ing", " ", "\n"], ["=", "-", "'s"], PARTS):
        for n in (3, 700, 6000):
            s = "".join(rng.choice(parts) for _ in range(n))
            assert T.stream(vocab, s, rng.choice([1, 7, 1000])) == library(s)


def test_streaming_memory(vocab):
    e, held = T.StreamingEncoder(T._Kept([vocab], T._packed)), 0
    for _ in range(400):
        e.feed("abcd" * 100)
        held = max(held, len(e.text) + len(e.tails[0].open))
    e.finish()
    assert held < 3 * vocab.lookahead + 1000


def test_counts_of_several_vocabularies(vocab):
    """One pass for both gives what each gives alone, runs that stream included."""
    other = T.vocabulary("byte_bpe_multi_50k")
    enc = T.Encoder([vocab, other], count=True)
    rng = random.Random(7)
    texts = [None, "", *("".join(rng.choice(PARTS) for _ in range(n)) for n in (1, 50, 3000)), "ab" * 20_000, "я" * 30_000 + " конец", " " * 40_000]
    for t in texts:
        assert enc.counts(t) == [len(T.stream(v, t or "")) for v in (vocab, other)]


def test_decoder(vocab):
    text = "жёлтый 😀 ́中文"
    d = T.StreamingDecoder(vocab)
    assert "".join(d.feed([i]) for i in T.stream(vocab, text)) + d.finish() == text


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, " ", "a"), (4, "дом " * 15000, "a"), (4, "x", "a"), (None, "y", "a")], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, len(r.ids)) for r in T.encode(df, "byte_bpe_50k").collect()]
    assert {(1, 0), (2, 0), (3, 1), (4, 1), (None, 1)} <= set(got) and len(got) == 6
    assert T.encode(df.limit(0), "byte_bpe_50k").count() == 0


def least_bins(sizes, capacity):
    """Fewest containers, by search."""
    sizes = sorted((s for s in sizes if s), reverse=True)
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for room in {b for b in bins if b >= sizes[i]}:
            rest = list(bins)
            rest.remove(room)
            go(i + 1, [*rest, room - sizes[i]])
        go(i + 1, [*bins, capacity - sizes[i]])

    go(0, [])
    return best


def test_bound_and_packing_by_search():
    rng = random.Random(3)
    for _ in range(250):
        capacity = rng.randint(4, 30)
        sizes = np.array([rng.randint(0, capacity) for _ in range(rng.randint(0, 8))])
        least = least_bins(sizes.tolist(), capacity)
        bins, used = packing.best_fit_decreasing(sizes, capacity)
        assert packing.lower_bound(sizes, capacity) <= least <= max(1, len(used))
        assert all(sizes[bins == b].sum() == used[b] <= capacity for b in range(len(used)))


@pytest.mark.parametrize("part_items", [50, 40_000])
def test_pack(spark, part_items):
    rng = random.Random(5)
    sizes = [(i, "t", rng.choice([0, 1, 5, 30, 64, 65, 200, rng.randint(1, 60)])) for i in range(800)]
    df = spark.createDataFrame(sizes, "doc_id bigint, tokenizer string, n_tokens bigint")
    targets = spark.createDataFrame([(1, "t", 64), (2, "t", 10), (3, "other", 5), (4, "t", None)], "target_id int, tokenizer string, capacity int")
    packed = packing.pack(packing.items(df, targets), part_items=part_items)
    got = packed.collect()
    for target, capacity in ((1, 64), (2, 10)):
        mine = [r for r in got if r.target_id == target]
        filled, per_doc = {}, {}
        for r in mine:
            filled[r.container_id] = filled.get(r.container_id, 0) + r.n_tokens
            per_doc.setdefault(r.doc_id, []).append(r.n_tokens)
        assert max(filled.values()) <= capacity
        assert {d: sum(v) for d, v in per_doc.items()} == {d: n for d, _, n in sizes}
        assert all(len(v) == max(1, -(-sum(v) // capacity)) for v in per_doc.values())
    reports = {r.target_id: r for r in packing.report(packed).collect()}
    assert set(reports) == {1, 2} and all(r.bound <= r.containers <= r.bound * 1.02 + 1 for r in reports.values())
    assert packing.pack(packing.items(df.limit(0), targets)).count() == 0


def test_bounds_decide_what_is_packed_again(spark, monkeypatch):
    """Coarse items fill no container: no task gets more than its share, certified partitions keep their containers, the exchange saves some."""
    rng = random.Random(6)
    sizes = [(i, "t", rng.randint(19, 38)) for i in range(3000)] + [(i, "u", 33) for i in range(3000, 3400)]
    df = spark.createDataFrame(sizes, "doc_id bigint, tokenizer string, n_tokens bigint")
    targets = spark.createDataFrame([(1, "t", 64), (2, "u", 64)], "target_id int, tokenizer string, capacity int")
    seen, pack_parts = [], packing._pack_parts
    monkeypatch.setattr(packing, "_pack_parts", lambda rows: seen.append(pack_parts(rows)) or seen[-1])
    got = packing.pack(packing.items(df, targets), part_items=40).collect()
    rounds = [r.collect() for r in seen]
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((i, n) for i, _, n in sizes)
    filled, tasks = {}, {}
    for r in got:
        filled[r.target_id, r.container_id] = filled.get((r.target_id, r.container_id), 0) + r.n_tokens
    assert max(filled.values()) <= 64
    for k, rows_ in enumerate(rounds):
        for r in rows_:
            tasks[k, r.target_id, r.part] = tasks.get((k, r.target_id, r.part), 0) + 1
    assert max(tasks.values()) < 3 * 40
    first = {(r.target_id, r.part): (r.bins, r.bound) for r in rounds[0]}
    assert any(b > w for b, w in first.values())
    # one item to a container is certified at once, so the second target takes no part in the exchange
    assert len(rounds) > 2 and all(r.target_id == 1 for rows_ in rounds[1:-1] for r in rows_)
    certified = {p for (t, p), (b, w) in first.items() if t == 1 and b == w}
    again = {r.doc_id for r in rounds[1]}
    assert not again & {r.doc_id for r in rounds[0] if r.target_id == 1 and r.part in certified}
    containers = sum(1 for t, _ in filled if t == 1)
    assert containers < sum(b for (t, _), (b, _) in first.items() if t == 1)


def test_pack_repeated_rows_share_no_task(spark):
    """A document that stands in a third of the rows is spread like any others."""
    df = spark.createDataFrame([(7, "t", 3)] * 400 + [(i, "t", 5) for i in range(100)], "doc_id bigint, tokenizer string, n_tokens bigint")
    targets = spark.createDataFrame([(1, "t", 16)], "target_id int, tokenizer string, capacity int")
    got = packing.pack(packing.items(df, targets), part_items=50).collect()
    assert len(got) == 500 and len({r.container_id.rsplit("-", 1)[0] for r in got if r.doc_id == 7}) > 3


def test_reading_level_on_held_out_passages(spark, testdata):
    """Neighbouring everyday grades differ by how many additions their sentences have, which few sentences can't tell; README has the figures."""
    from pagelens.session import table

    passages = table(spark, testdata, "graded_passages").orderBy("passage_id").collect()
    graded, right, near, exact, levels = 0, 0, 0, 0, set()
    for fold in (0, 1):
        train = spark.createDataFrame([r for r in passages if r.passage_id % 2 == fold])
        formula = readability.train(table(spark, testdata, "documents"), train)
        held = spark.createDataFrame([(r.passage_id, r.text) for r in passages if r.passage_id % 2 != fold], "doc_id int, text string")
        got = {r.doc_id: r for r in readability.reading_level(held, formula).collect()}
        for r in passages:
            if r.passage_id % 2 != fold:
                graded += 1
                right += got[r.passage_id].demanding == (r.grade >= 4)
                near += abs(got[r.passage_id].level - r.grade) <= 1
                exact += got[r.passage_id].level == r.grade
                levels.add(got[r.passage_id].level)
    assert right / graded > 0.97 and near / graded > 0.97 and exact / graded > 0.55 and levels == {1, 2, 3, 4, 5}


def test_every_document_is_counted(spark):
    """Documents without seed words count in the frequencies too, blank ones don't."""
    df = spark.createDataFrame([("alpha beta",), ("alpha",), (None,), (" ",), ("",)], "text string")
    got = {r.word: tuple(r[1:]) for r in readability.word_frequencies(df, readability.seeds([])).collect()}
    assert got[""] == (0, 0, 0, 2) and got["alpha"] == (0, 0, 0, 2) and got["beta"] == (0, 0, 0, 1)
    formula = readability.train(df, spark.createDataFrame([], "grade int, text string"))
    assert [r.n_sentences for r in readability.reading_level(df.selectExpr("text", "1 as doc_id"), formula).collect()][2:] == [0, 0, 0]


def test_reading_level_odd_texts(spark, testdata):
    from pagelens.session import table

    formula = readability.train(table(spark, testdata, "documents"), table(spark, testdata, "graded_passages"))
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "1 | АС-298 | 2532,5 | м\n2 | КР-416 | 3340,4 | шт.", "x"), (5, "Мы красим воду. " * 4000, "x")], "doc_id bigint, text string, level string")
    got = {r.doc_id: (r.n_sentences, r.demanding) for r in readability.reading_level(df, formula).collect()}
    assert got[1] == got[2] == got[3] == got[4] == (0, None) and got[5][1] is False
