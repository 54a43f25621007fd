"""Anchors and the numbers beside them on one page, in plain Python (EXT-01, EXT-02); `extract` runs this over the pages of a token table."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

from pagelens.functions.text import NUMBER

#: A number that is no part of a word or a unit.
FIGURE = "(?<![A-Za-zА-Яа-яЁё])" + NUMBER
#: Words of the longest anchor, and after an anchor that may hold its value where its row holds none.
ANCHOR_WORDS, AFTER_WORDS = 8, 12
DEFAULT_STEPS = ("nfc", "collapse_spaces", "decimal_comma", "strip_unit")
# Dimension and size of each unit, and its spellings.
UNITS = {
    "мм": ("length", 0.001), "см": ("length", 0.01), "м": ("length", 1.0), "мм2": ("area", 1e-6), "см2": ("area", 1e-4), "м2": ("area", 1.0),
    "мм3": ("volume", 1e-9), "см3": ("volume", 1e-6), "м3": ("volume", 1.0), "тыс.м2": ("area", 1000.0), "тыс.м3": ("volume", 1000.0),
    "Вт": ("power", 1.0), "кВт": ("power", 1e3), "МВт": ("power", 1e6), "Па": ("pressure", 1.0), "кПа": ("pressure", 1e3), "МПа": ("pressure", 1e6),
    "м3/ч": ("flow", 1.0 / 3600.0), "л/с": ("flow", 0.001), "м3/сут": ("flow", 1.0 / 86400.0), "%": ("ratio", 0.01), "‰": ("ratio", 0.001),
}
EXACT = {
    "Вт": "Вт", "вт": "Вт", "W": "Вт", "w": "Вт", "кВт": "кВт", "квт": "кВт", "kW": "кВт", "kw": "кВт", "МВт": "МВт", "MW": "МВт",
    "Па": "Па", "па": "Па", "Pa": "Па", "кПа": "кПа", "кпа": "кПа", "kPa": "кПа", "МПа": "МПа", "MPa": "МПа",
    "м3/ч": "м3/ч", "М3/ч": "м3/ч", "m3/h": "м3/ч", "л/с": "л/с", "l/s": "л/с", "м3/сут": "м3/сут", "%": "%", "‰": "‰", "промилле": "‰",
    "кв.м": "м2", "кв.м2": "м2", "куб.м": "м3", "куб.м3": "м3", "тыс.м2": "тыс.м2", "тыс.м3": "тыс.м3", "тыс.куб.м": "тыс.м3", "тыс.кв.м": "тыс.м2",
}
# Longer prefixes first: мм2 is not to be read as мм.
PREFIXES = tuple((a + n, c + n) for n in ("3", "2", "") for a, c in (("мм", "мм"), ("mm", "мм"), ("см", "см"), ("cm", "см"), ("м", "м"), ("m", "м")))
ALIASES = {a: c for a, c in PREFIXES if a != c}
EXCLUSIVE = {"power", "pressure", "flow", "ratio"}
ROW_NUMBER = re.compile(r"\d{1,2}\.")
NORM = re.compile(r"(сп|снип|гост)\s*(\d+(?:[.\-]\d+)*)", re.IGNORECASE)


def fold_once(text: str) -> str:
    """TXT-01 of one string."""
    folded = unicodedata.normalize("NFC", text).casefold().replace("м²", "м2").replace("m²", "m2")
    return re.sub(r"\s+", " ", folded).strip()


#: The same for words, which recur.
fold = lru_cache(maxsize=50_000)(fold_once)


@dataclass(frozen=True)
class Rule:
    code: str
    anchors: tuple[str, ...]
    pattern: str = FIGURE
    unit: str | None = None
    steps: tuple[str, ...] = DEFAULT_STEPS
    norms: frozenset[tuple[str, str]] = field(default_factory=frozenset)


def standards(text: str) -> frozenset[tuple[str, str]]:
    return frozenset((kind.casefold(), number.replace("-", ".")) for kind, number in NORM.findall(fold(text)))


def rule(code: str, anchors: Iterable[str], number_regex: str | None = None, unit: str | None = None, steps: Iterable[str] | None = None, norms: Iterable[str] | None = None) -> Rule:
    named = tuple(steps or ())
    steps = named + tuple(s for s in ("decimal_comma", "strip_unit") if s not in named) if named else DEFAULT_STEPS
    return Rule(code, tuple(fold(a) for a in anchors or () if a is not None), number_regex or FIGURE, unit if unit and unit.strip() else None, steps, standards(" ".join(n for n in norms or () if n)))


def spans(folded: list[str], anchors: tuple[str, ...]) -> list[tuple[int, int]]:
    """For each token the end of the shortest span of at most ANCHOR_WORDS from it whose folded text contains an anchor."""
    best: dict[int, int] = {}
    if all(folded) and all(anchors):
        text = " ".join(folded)
        offsets, at = [], 0
        for i, f in enumerate(folded):
            offsets += [i] * (len(f) + 1)
        for a in anchors:
            at = text.find(a)
            while at >= 0:
                first, last = offsets[at], offsets[at + len(a) - 1]
                for start in range(max(0, last - ANCHOR_WORDS + 1), first + 1):
                    best[start] = min(last, best.get(start, last))
                at = text.find(a, at + 1)
    else:
        for start in range(len(folded)):
            for end in range(start, min(len(folded), start + ANCHOR_WORDS)):
                said = fold(" ".join(folded[start : end + 1]))
                if any(a in said for a in anchors):
                    best[start] = end
                    break
    return sorted(best.items())


def _bare(text: str) -> str:
    return fold(text).replace("²", "2").replace("³", "3").replace(" ", "").strip(".,;:)")


def _exact(text: str) -> str | None:
    return EXACT.get(unicodedata.normalize("NFKC", text).strip().replace(" ", "").strip(".,;:)"))


def _unit(raw: str) -> str | None:
    known = _exact(raw)
    bare = _bare(raw)
    if known or not raw or "/" in bare:
        return known
    for prefix, canon in PREFIXES:
        rest = bare[len(prefix) :]
        if bare.startswith(prefix) and not (rest and (rest[0].isalnum() or rest[0] == "/")):
            return canon
    return None


def _unit_of_words(words: list[str]) -> str | None:
    """«тыс. м2», «кв. м» and «куб. м» are one unit each."""
    if not words:
        return None
    head = _bare(words[0]).rstrip(".")
    if len(words) > 1 and head in ("тыс", "тысяч"):
        return {"м2": "тыс.м2", "м3": "тыс.м3"}.get(_unit(words[1]))
    if len(words) > 1 and head in ("кв", "куб") and _unit(words[1]) == "м":
        return {"кв": "м2", "куб": "м3"}[head]
    return _unit(words[0])


def unit_of_match(text: str, match: re.Match[str]) -> str | None:
    """The unit in the match, right after it, or right before it."""
    tail = re.sub(r"^[\d.,]+", "", unicodedata.normalize("NFKC", match.group(0)).strip().replace(" ", "").strip(".,;:)"))
    found = (_unit(tail) if tail else None) or _unit_of_words(text[match.end() :].split(maxsplit=3)[:3])
    if found:
        return found
    before = text[: match.start()].split()[-2:]
    if len(before) == 2 and _bare(before[0]).rstrip(".") in ("тыс", "тысяч", "кв", "куб"):
        found = _unit_of_words(before)
    return found or (_unit(before[-1]) if before else None)


def canonical(label: str | None) -> tuple[str, str] | None:
    """Dimension and name of a unit, or null."""
    known = _exact(label or "")
    bare = _bare(label or "")
    name = known or (None if "/" in bare else ALIASES.get(bare, bare))
    return (UNITS[name][0], name) if name in UNITS else None


def number(raw: str, steps: tuple[str, ...]) -> float | None:
    """The number written, after the rule's steps; null where it is ambiguous or none."""
    s = unicodedata.normalize("NFC", raw) if "nfc" in steps else raw
    s = re.sub(r"(?i)(?:м²|м2|m2|м\^2)\s*$", "", s).strip() if "strip_unit" in steps else s
    s = re.sub(r"\s+", "", s) if "collapse_spaces" in steps else re.sub("[   ]", "", s)
    if "decimal_comma" in steps and not re.fullmatch(r"\d*", s):
        dots, commas = s.count("."), s.count(",")
        if dots and commas:
            point, group = (",", ".") if s.rfind(",") > s.rfind(".") else (".", ",")
            whole, part = s.rsplit(point, 1)
            if not part.isdigit() or (group in whole and not re.fullmatch(rf"\d{{1,3}}(?:{re.escape(group)}\d{{3}})+", whole)) or not whole.replace(group, "").isdigit():
                return None
            s = f"{whole.replace(group, '')}.{part}"
        elif dots == 1:
            if re.fullmatch(r"[1-9]\.\d{3}", s):
                return None
        elif commas == 1:
            s = s.replace(",", ".")
        elif dots or commas:
            if not re.fullmatch(r"\d{1,3}(?:[.,]\d{3})+", s):
                return None
            s = re.sub("[.,]", "", s)
    if "multiply_dimensions" in steps and (sides := re.match(r"^(\d+(?:\.\d+)?)[×xх](\d+(?:\.\d+)?)$", s)):
        return float(sides[1]) * float(sides[2])
    try:
        return float(s)
    except ValueError:
        return None


_compiled = lru_cache(re.compile)


def _notes(words: list[str]) -> list[bool]:
    """Whether each word stands in brackets."""
    depth, notes = 0, []
    for w in words:
        notes.append(depth > 0 or "(" in w)
        depth = max(0, depth + w.count("(") - w.count(")"))
    return notes


def reads(words: list[str], r: Rule, at_end: bool) -> list[tuple[float, str, bool, int, int]]:
    """value, text, note, distance, place of each number of the words; what stands in brackets is a note."""
    text = " ".join(words)
    matches = list(_compiled(r.pattern).finditer(text))
    if not matches:
        return []
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    notes, out, target = _notes(words) if "(" in text else None, [], canonical(r.unit)
    for m in matches:
        i = bisect_right(starts, m.start()) - 1
        if m.start() >= starts[i] + len(words[i]) or ROW_NUMBER.fullmatch(words[i].strip()):
            continue
        raw = next((g for g in m.groups() if g), m.group(0))
        value = number(raw, r.steps)
        source = canonical(unit_of_match(text, m)) if target else None
        if value is None or (source and target and source[0] != target[0] and EXCLUSIVE & {source[0], target[0]}):
            continue
        if source and target and source[0] == target[0] and source[1] != target[1]:
            value = value * UNITS[source[1]][1] / UNITS[target[1]][1]
        out.append((value, raw, notes is not None and notes[i], len(words) - 1 - i if at_end else i, i))
    return out


class Page:
    """The tokens of one page in reading order."""

    def __init__(self, words: list[str], tops: list[float], bottoms: list[float]):
        self.words, self.tops, self.bottoms = words, tops, bottoms
        self.folded = [fold(w) for w in words]
        self.rows: dict[tuple[float, float], list[int]] = {}
        self.right: dict[tuple[int, str], list] = {}

    def overlap(self, i: int, j: int) -> bool:
        return self.tops[i] < self.bottoms[j] and self.tops[j] < self.bottoms[i]

    def row(self, i: int) -> list[int]:
        """Places of the tokens on the row of token i, itself included."""
        key = (self.tops[i], self.bottoms[i])
        if key not in self.rows:
            top, bottom = key
            self.rows[key] = [j for j, (t, b) in enumerate(zip(self.tops, self.bottoms)) if top < b and t < bottom]
        return self.rows[key]

    def best_number(self, start: int, end: int, r: Rule) -> tuple | None:
        """rank, value, last value of the number that belongs to the anchor start..end: on its row after it, else the nearest before it, else a note after it;
        on the following tokens only where nothing stands after it on the row."""
        row = self.row(end)
        before, after = slice(0, bisect_left(row, start)), slice(bisect_right(row, end), None)
        said = lambda places: [self.words[j] for j in places]
        if (end, r.code) not in self.right:  # the same for all spans that end here
            self.right[end, r.code] = reads(said(row[after]), r, False)
        right = self.right[end, r.code]
        plain = [x for x in right if not x[2]]
        note_only, off_row, rest = False, False, None
        if plain:
            chosen = plain
        elif left := [x for x in reads(said(row[before]), r, True) if not x[2]]:
            chosen = [min(left, key=lambda x: (x[3], x[1]))]
        elif right:
            chosen, note_only = right, True
        elif not row[after]:
            rest = [j for j in range(end + 1, min(len(self.words), end + 1 + AFTER_WORDS)) if not self.overlap(end, j)]
            chosen, off_row = reads(said(rest), r, False), True
        else:
            return None
        if not chosen:
            return None
        cited = standards(" ".join(said(row[before] + row[after] if rest is None else rest))) if r.norms else frozenset()
        numbered = start > 0 and self.overlap(start - 1, start) and ROW_NUMBER.fullmatch(self.words[start - 1].strip()) is not None
        rank = (off_row, note_only, bool(cited) and r.norms.isdisjoint(cited), chosen[0][0] == 0.0, chosen[0][3], not numbered)
        return rank, chosen[0][0], chosen[-1][0]
