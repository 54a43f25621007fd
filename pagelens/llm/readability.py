"""Reading level by a familiar-word formula: share of words outside a high-frequency list, and average sentence length.

The list comes from the document frequencies of the whole corpus.  Frequency alone does not part
everyday words from specialist ones here, since specialist texts are as common as notices; so each
document is counted in one of four classes, by the words that it shares with the graded passages
(plain, office, specialist, or undecided), and a frequent word is familiar if it is more frequent
in the first two together than in the third, and plain if more so in the first than in the second.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.session import cut_lineage

#: Least share of all documents for a word of the list; words below it (names, damaged words) count neither way.
#: It bounds the list: at most (mean distinct words of a document) / MIN_SHARE words.
MIN_SHARE, MIN_DOCUMENTS = 5e-4, 2
#: Graded passages read at most, the first in order of grade and text; they fit the seed words, the formula and its cut points.
MAX_PASSAGES = 20_000
#: First grade that counts as demanding.
DEMANDING = 4
#: Share of unfamiliar words above which a sentence is demanding.
DEMANDING_SHARE = 0.5
#: Chunks remembered by one pass; emptied when full.
KEPT = 300_000
#: Log ratio of passage frequencies from which a word is a seed; seed words that place a document.
SEED_RATIO, SEED_WORDS = 1.0, 3
#: Grades above which words are no longer plain.
PLAIN = 2
#: Weight of the pull to 0 in the fits, and for the length where it decides on the side: chains of everyday clauses are long and notes of
#: calculations short, so that length is the weaker witness there.
RIDGE, RIDGE_LENGTH = 0.01, 1.0
#: Classes in which documents are counted.
CLASSES = ("plain", "office", "high", "other")

WORD = re.compile(r"[^\W\d_]+")
UNSEEN = re.compile("[­​‌‍⁠﻿]")
BROKEN = re.compile(r"(?<=\w)[ \t]*-[ \t]*\r?\n[ \t]*(?=\w)")
STOP = re.compile(r"[.!?…][\"'»”)\]]*$")


def words_of(chunk: str) -> tuple[str, ...]:
    """Words of two letters or more of a chunk without blanks, in lower case."""
    return tuple(w for w in WORD.findall(UNSEEN.sub("", chunk).lower()) if len(w) > 1)


def mended(text: str) -> str:
    """Words parted by a hyphen at the end of a line are joined."""
    return BROKEN.sub("", text) if "-\n" in text or "-\r" in text or "- \n" in text else text


class _Words(dict):
    def __missing__(self, chunk: str) -> tuple[str, ...]:
        if len(self) >= KEPT:
            self.clear()
        w = self[chunk] = words_of(chunk)
        return w


def distinct_words(text: str, words: _Words) -> set[str]:
    return set(itertools.chain.from_iterable(map(words.__getitem__, set(mended(text).split()))))


@dataclass(frozen=True)
class Seeds:
    plain: frozenset[str]
    office: frozenset[str]
    everyday: frozenset[str]
    specialist: frozenset[str]

    def place(self, words: set[str]) -> str:
        """Class of a document with these words."""
        low, high = len(words & self.everyday), len(words & self.specialist)
        if low + high < SEED_WORDS:
            return "other"
        if low <= high:
            return "high"
        return "plain" if len(words & self.plain) >= len(words & self.office) else "office"


def leaning(a: list[set[str]], b: list[set[str]]) -> tuple[frozenset[str], frozenset[str]]:
    """Words clearly more frequent in the texts of a than in those of b, and the other way round; words of one text only are left out."""
    in_a, in_b = Counter(w for ws in a for w in ws), Counter(w for ws in b for w in ws)
    ratio = {w: np.log((in_a[w] / max(1, len(a)) + 0.005) / (in_b[w] / max(1, len(b)) + 0.005)) for w in in_a.keys() | in_b.keys() if in_a[w] + in_b[w] > 1}
    return frozenset(w for w, r in ratio.items() if r > SEED_RATIO), frozenset(w for w, r in ratio.items() if r < -SEED_RATIO)


def seeds(passages: list[tuple[int, str]]) -> Seeds:
    """Words of the graded passages that lean clearly to plain, office or demanding grades."""
    words = _Words()
    said = [(grade, distinct_words(text, words)) for grade, text in passages]
    below = [(g, ws) for g, ws in said if g < DEMANDING]
    everyday, specialist = leaning([ws for _, ws in below], [ws for g, ws in said if g >= DEMANDING])
    plain, office = leaning([ws for g, ws in below if g <= PLAIN], [ws for g, ws in below if g > PLAIN])
    return Seeds(plain, office, everyday, specialist)


def word_frequencies(documents: DataFrame, seed: Seeds, text: str = "text") -> DataFrame:
    """word, plain, office, high, other: documents with the word, of each class.

    Every document with a text is counted, in `other` if its seed words don't place it.  The word
    '' carries the numbers of documents.  Each partition counts for itself before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        words, counts = _Words(), {c: Counter() for c in CLASSES}

        def out() -> pd.DataFrame:
            every = list(set().union(*counts.values()))
            pdf = pd.DataFrame({"word": every} | {c: [n[w] for w in every] for c, n in counts.items()})
            for n in counts.values():
                n.clear()
            return pdf

        for b in batches:
            for t in b["text"]:
                if t and t.strip():
                    ws = distinct_words(t, words)
                    counts[seed.place(ws)].update(ws | {""})
            if sum(map(len, counts.values())) > 2_000_000:
                yield out()
        if any(counts.values()):
            yield out()

    counted = documents.select(F.col(text).cast("string").alias("text")).mapInPandas(run, "word string, " + ", ".join(f"{c} bigint" for c in CLASSES))
    return counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in CLASSES))


@dataclass(frozen=True)
class Formula:
    """Word lists; score = weights over (1, share of words that are not plain, share of unfamiliar words, log words per sentence);
    cuts between neighbouring grades on it; and the weights of (share of hard sentences - 1/2, log words per sentence - usual_length) that say whether a text is demanding."""

    familiar: frozenset[str]
    unfamiliar: frozenset[str]
    plain: frozenset[str]
    weights: tuple[float, ...] = (1.0, 1.0, 3.0, 0.0)
    cuts: tuple[float, ...] = (1.5, 2.5, 3.5, 4.5)
    side: tuple[float, float] = (1.0, 0.0)
    usual_length: float = 0.0


class _Marks(dict):
    """Chunk to (long words, familiar, unfamiliar, plain, words, whether a sentence ends)."""

    def __init__(self, formula: Formula) -> None:
        self.formula = formula

    def __missing__(self, chunk: str) -> tuple[int, int, int, int, int, bool]:
        if len(self) >= KEPT:
            self.clear()
        ws, f = words_of(chunk), self.formula
        m = self[chunk] = (sum(len(w) > 2 for w in ws), sum(w in f.familiar for w in ws), sum(w in f.unfamiliar for w in ws), sum(w in f.plain for w in ws), len(ws), STOP.search(chunk) is not None)
        return m


@dataclass
class Said:
    """Of a text's sentences: how many, their words, their summed shares of unfamiliar and of not plain words, and how many are hard or easy."""

    n: int = 0
    words: int = 0
    unfamiliar: float = 0.0
    not_plain: float = 0.0
    hard: int = 0
    easy: int = 0

    @property
    def length(self) -> float:
        return self.words / self.n

    @property
    def hard_share(self) -> float:
        return self.hard / max(1, self.hard + self.easy)

    def features(self) -> tuple[float, ...]:
        return (1.0, self.not_plain / self.n, self.unfamiliar / self.n, float(np.log(max(1.0, self.length))))


def sentences(text: str, marks: _Marks) -> Said:
    """What the sentences of a text say of it.

    A sentence ends at a full stop, question or exclamation mark, or with a line whose next one
    does not go on in lower case; it has at least two words of three letters or more, which rows of
    lists and forms have not, and at least one word that the lists know.
    """
    said = Said()
    long = fam = unf = own = n = 0

    def close() -> None:
        nonlocal long, fam, unf, own, n
        if long > 1 and fam + unf:
            share = unf / (fam + unf)
            said.n += 1
            said.words += n
            said.unfamiliar += share
            said.not_plain += 1 - own / (fam + unf)
            said.hard += share > DEMANDING_SHARE
            said.easy += share < DEMANDING_SHARE
        long = fam = unf = own = n = 0

    for line in mended(text).splitlines():
        chunks = line.split()
        if not chunks:
            continue
        if n and not chunks[0][0].islower():
            close()
        for a, b, c, d, e, stop in map(marks.__getitem__, chunks):
            long += a
            fam += b
            unf += c
            own += d
            n += e
            if stop:
                close()
    close()
    return said


def logistic(x: np.ndarray, y: np.ndarray, pull: tuple[float, ...]) -> np.ndarray:
    """Weights of a logistic regression, each with its pull to 0, by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + np.array(pull) * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def cut_point(score: np.ndarray, grade: np.ndarray, below: int, usual: float) -> float:
    """The score that best parts grade `below` from the next; the middle of the widest best gap, `usual` where one of the two is missing."""
    a, b = score[grade == below], score[grade == below + 1]
    if not len(a) or not len(b):
        return usual
    at = np.unique(np.concatenate([a, b]))
    mids = (at[1:] + at[:-1]) / 2 if len(at) > 1 else at
    wrong = [(a > m).sum() / len(a) + (b <= m).sum() / len(b) for m in mids]
    best = min(wrong)
    return float(max((hi - lo, (hi + lo) / 2) for lo, hi, w in zip(at, at[1:] if len(at) > 1 else at, wrong) if w == best)[1])


def fit(passages: list[tuple[int, str]], frequencies: list[tuple], seed: Seeds) -> Formula:
    """The lists from the document frequencies; score, cut points and side from the graded passages."""
    of = {w: n for w, *n in frequencies}
    n_plain, n_office, n_high, _ = (max(1, n) for n in of.pop("", (0, 0, 0, 0)))
    low = {w: (a + b) / (n_plain + n_office) > c / n_high for w, (a, b, c, _) in of.items()}
    familiar = {w for w, yes in low.items() if yes}
    unfamiliar = of.keys() - familiar
    plain = {w for w in familiar if of[w][0] / n_plain > of[w][1] / n_office}
    plain |= (seed.plain & seed.everyday) - of.keys()
    familiar |= seed.everyday - unfamiliar
    unfamiliar = unfamiliar | (seed.specialist - familiar)
    lists = Formula(frozenset(familiar), frozenset(unfamiliar), frozenset(plain))
    marks = _Marks(lists)
    said = [(g, x) for g, x in ((g, sentences(t, marks)) for g, t in passages) if x.n]
    if not said:
        return lists
    grade, x = np.array([g for g, _ in said]), np.array([s.features() for _, s in said])
    weights = np.linalg.solve(x.T @ x + RIDGE * np.eye(4), x.T @ grade)
    score = x @ weights
    cuts = tuple(cut_point(score, grade, g, g + 0.5) for g in range(1, 5))
    usual = float(x[:, 3].mean())
    side = logistic(np.array([(s.hard_share - 0.5, f[3] - usual) for (_, s), f in zip(said, x)]), (grade >= DEMANDING).astype(float), (RIDGE, RIDGE_LENGTH))
    side = tuple(map(float, side)) if side[0] > 0 else lists.side
    return Formula(lists.familiar, lists.unfamiliar, lists.plain, tuple(map(float, weights)), cuts, side, usual)


def train(documents: DataFrame, passages: DataFrame, text: str = "text") -> Formula:
    """Lists and formula from all documents and the graded passages (grade, text; at most MAX_PASSAGES of them)."""
    graded = [(r["grade"], r["text"]) for r in passages.where("grade is not null and text is not null").select("grade", "text").orderBy("grade", "text").limit(MAX_PASSAGES).collect()]
    seed = seeds(graded)
    counts = cut_lineage(word_frequencies(documents, seed, text))  # counted once, read twice
    whole = sum(F.col(c) for c in CLASSES)
    n = counts.where("word = ''").agg(F.coalesce(F.sum(whole), F.lit(0))).first()[0]
    frequent = counts.where((whole >= max(MIN_DOCUMENTS, MIN_SHARE * n)) | (F.col("word") == ""))
    return fit(graded, [tuple(r) for r in frequent.select("word", *CLASSES).collect()], seed)


SCHEMA = "n_sentences int, words_per_sentence double, unfamiliar_share double, demanding_share double, score double, level int, demanding boolean"


def measure(text: str | None, formula: Formula, marks: _Marks) -> tuple:
    said = sentences(text, marks) if text else Said()
    if not said.n:
        return (0, None, None, None, None, None, None)
    x = said.features()
    demanding = said.hard > said.easy and formula.side[0] * (said.hard_share - 0.5) + formula.side[1] * (x[3] - formula.usual_length) > 0
    score = sum(w * v for w, v in zip(formula.weights, x))
    grades = range(DEMANDING, 5) if demanding else range(1, DEMANDING - 1)
    level = grades.start + sum(score > formula.cuts[g - 1] for g in grades)
    return (said.n, said.length, x[2], said.hard_share, score, level, bool(demanding))


def reading_level(documents: DataFrame, formula: Formula, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_sentences, words_per_sentence, unfamiliar_share, demanding_share, score, level, demanding; one row per document.

    score weighs the share of words that are not plain, the share of unfamiliar ones and the
    average sentence length.  demanding_share is the share of the sentences in which unfamiliar
    words outnumber familiar ones, sentences with as many of either left aside; demanding says
    whether that is the bulk of them, more being asked of texts with shorter sentences than usual
    or longer ones, whichever way the passages lean.  level is the grade between whose cut points the score lies, on that
    side of the scale.  Null, empty and blank texts and texts without sentences have n_sentences 0
    and null elsewhere.  Texts are read whole; the language column is not used, since it is not reliable.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    names = ["key", *(c.split()[0] for c in SCHEMA.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = _Marks(formula)
        for b in batches:
            out = [measure(t, formula, marks) for t in b["text"]]
            pdf = pd.DataFrame(out, columns=names[1:])
            pdf.insert(0, "key", b["key"].to_numpy())
            yield pdf

    return rows.mapInPandas(run, f"key {dict(rows.dtypes)['key']}, {SCHEMA}").withColumnRenamed("key", key)
