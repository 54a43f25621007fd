"""Encoding of a corpus with a public tokenizer as a bounded-lookahead streaming transducer.

Every text goes through StreamingEncoder slice by slice.  Its state is the text that the split
pattern can't cut yet and, of a piece that goes on, the bytes whose tokens a later byte could
still change.  A token is emitted once it is stable: its piece has ended, or the merge list's
sufficient lookahead lies behind it.  Pieces are merged here, by rank; a table of fixed size
remembers what they gave.
"""

from __future__ import annotations

import base64
import codecs
import functools
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; None takes the installed package public_tokenizers.
VOCABULARIES: str | None = None
#: Pieces remembered by one encoder, and bytes of the longest of them; the table is emptied when full.
KEPT, KEPT_BYTES = 250_000, 64
#: Characters handed to the encoder at once.
SLICE = 1 << 14
#: Characters after a piece that decide where it ends: the longest contraction of the split pattern.
PIECE_LOOKAHEAD = 3
#: Bytes from which a piece is merged by a heap rather than by looking through all its pairs.
HEAPED = 48
#: Values of a result batch.
BATCH_VALUES = 4_000_000


def vocabulary_path(name: str, folder: str | None = None) -> str:
    if folder or VOCABULARIES:
        return f"{folder or VOCABULARIES}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_pairs(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The two parts that each token of more than one byte is merged from, in order of rank."""
    out = []
    for token, rank in sorted(((t, r) for t, r in ranks.items() if len(t) > 1), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def sufficient_lookahead(pairs: list[tuple[bytes, bytes]]) -> int:
    """Bytes behind a token after which no later byte can change it.

    A later byte reaches back only through a chain of merges of ever smaller rank, each of which
    takes the end of what the one before it needs on its right: the left part of the next merge is
    a node on the right edge of the right part's derivation.  The longest such chain, measured in
    the bytes of the right parts, is found in one pass over the merges in order of rank.
    """
    right_of = {u + v: v for u, v in pairs}
    reach: dict[bytes, int] = {}
    most = 0
    for u, v in pairs:
        needs, node = 0, v
        while node is not None:
            needs = max(needs, reach.get(node, 0))
            node = right_of.get(node)
        here = len(v) + needs
        reach[u] = max(reach.get(u, 0), here)
        most = max(most, here)
    return most


class Vocabulary:
    """A byte-level BPE vocabulary: split pattern, ranks, and their sufficient lookahead."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex

        self.ranks = read_ranks(path)
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.token_bytes = {i: b for b, i in self.ranks.items()}

    @functools.cached_property
    def lookahead(self) -> int:
        return sufficient_lookahead(merge_pairs(self.ranks))

    def kind(self, ch: str) -> str:
        """A character of the same class of the split pattern that begins no contraction."""
        import regex

        return "a" if regex.match(r"\p{L}", ch) else "1" if regex.match(r"\p{N}", ch) else " " if regex.match(r"\s", ch) else "!"

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: of all neighbours the pair of least rank, the leftmost of equals, becomes one, until no pair has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > HEAPED:
            return self._merge_heaped(piece)
        get, none = ranks.get, len(ranks)
        at = list(range(len(piece) + 1))  # where the parts begin
        of = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]  # rank of each part with the next
        while of:
            least = min(of)
            if least == none:
                break
            i = of.index(least)
            del at[i + 1], of[i]
            if i < len(of):
                of[i] = get(piece[at[i] : at[i + 2]], none)
            if i:
                of[i - 1] = get(piece[at[i - 1] : at[i + 1]], none)
        return [ranks[piece[x:y]] for x, y in zip(at, at[1:])]

    def _merge_heaped(self, piece: bytes) -> list[int]:
        """The same for long pieces: pairs wait in a heap, the parts are a linked list by their first bytes."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part [i, end[i]), and the first byte of the one before it
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if gone[i] or j >= n or end[j] != stop:  # one of the two parts is another by now
                continue
            end[i], gone[j] = stop, 1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i:
                h = before[i]
                if (r := ranks.get(piece[h:stop])) is not None:
                    heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out


@functools.lru_cache(maxsize=4)
def vocabulary(name: str, folder: str | None = None) -> Vocabulary:
    return Vocabulary(vocabulary_path(f"{name}.tiktoken", folder))


class _Kept(dict):
    """Piece to what `of` makes of its ids in each vocabulary; bounded."""

    def __init__(self, vocabs: list[Vocabulary], of: Callable[[list[list[int]]], object]) -> None:
        self.vocabs, self.of = vocabs, of

    def __missing__(self, piece: str):
        data = piece.encode("utf-8", "replace")
        value = self.of([v.merge(data) for v in self.vocabs])
        if len(data) <= KEPT_BYTES:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = value
        return value


def _packed(ids: list[list[int]]) -> bytes:
    return np.asarray(ids[0], dtype="<i4").tobytes()


#: Bits of one vocabulary's count where the counts of several are summed as one number.
COUNT_BITS = 31


def _counted(ids: list[list[int]]) -> int:
    return sum(len(x) << (COUNT_BITS * i) for i, x in enumerate(ids))


class _Tail:
    """The bytes of a piece that goes on, as far as a vocabulary's tokens for them may still change."""

    def __init__(self, vocab: Vocabulary, lookahead: int) -> None:
        self.v, self.lookahead, self.open = vocab, lookahead, b""

    def stable(self, data: bytes, ended: bool) -> list[int]:
        """The ids that are stable with data added: all at the piece's end, else those with the lookahead behind them."""
        self.open += data
        if ended:
            piece, self.open = self.open, b""
            return self.v.merge(piece) if piece else []
        if len(self.open) <= 2 * self.lookahead:
            return []
        ids, end, limit = [], 0, len(self.open) - self.lookahead
        for i in self.v.merge(self.open):
            n = len(self.v.token_bytes[i])
            if end + n > limit:
                break
            ids.append(i)
            end += n
        self.open = self.open[end:]
        return ids


class StreamingEncoder:
    """feed() takes text in any slices and gives what `kept` makes of the ids that no later text can change; finish() gives the rest.

    Held back are at most the lookahead of the split pattern, that of the merges, and one token.
    Several vocabularies share one pass, since they share the split pattern.
    """

    def __init__(self, kept: _Kept, lookaheads: list[int] | None = None) -> None:
        self.kept, self.pieces = kept, kept.vocabs[0].pieces
        self.tails = [_Tail(v, n) for v, n in zip(kept.vocabs, lookaheads or [v.lookahead for v in kept.vocabs])]
        self.long = 2 * max(t.lookahead for t in self.tails) + PIECE_LOOKAHEAD
        self.text, self.going = "", False

    def _stable(self, text: str, ended: bool) -> object:
        self.going, data = not ended, text.encode("utf-8", "replace")
        return self.kept.of([t.stable(data, ended) for t in self.tails])

    def feed(self, text: str, last: bool = False) -> list:
        self.text += text
        out: list = []
        done = 0
        if self.going:
            # the piece is a run of letters, digits, marks or blanks; it goes on as far as the same run does
            limit = len(self.text) - (0 if last else PIECE_LOOKAHEAD)
            done = max(0, self.pieces.match(self.kind + self.text).end() - 1)
            if done >= limit and not last:
                done = max(0, limit)
                out = [self._stable(self.text[:done], False)]
                self.text = self.text[done:]
                return out
            out = [self._stable(self.text[:done], True)]
        # every character belongs to a piece, so the pieces say where each of them ends
        pieces, held = self.pieces.findall(self.text, done), 0
        while pieces and held < PIECE_LOOKAHEAD and not last:
            held += len(pieces.pop())
        out += map(self.kept.__getitem__, pieces)
        self.text = self.text[len(self.text) - held :] if held else ""
        if held > self.long and (first := self.pieces.match(self.text).end()) > self.long:
            keep = first - PIECE_LOOKAHEAD
            self.kind = self.kept.vocabs[0].kind(self.text[keep - 1])
            out.append(self._stable(self.text[:keep], False))
            self.text = self.text[keep:]
        return out

    def finish(self) -> list:
        return [*self.feed("", last=True), self._stable("", True)]


class StreamingDecoder:
    """Ids to text, token by token: bytes that don't yet make up a character wait for the next token."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.v = vocab
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join(map(self.v.token_bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def stream(vocab: Vocabulary, text: str, slice_: int = SLICE) -> list[int]:
    """The ids of a text fed in slices."""
    e = StreamingEncoder(_Kept([vocab], _packed))
    out = [x for i in range(0, len(text), slice_) for x in e.feed(text[i : i + slice_])]
    return np.frombuffer(b"".join(out + e.finish()), dtype="<i4").tolist()


class Encoder:
    """Packed ids of whole texts, or their numbers in each of several vocabularies that share the split pattern."""

    def __init__(self, vocabs: list[Vocabulary], count: bool = False, lookaheads: list[int] | None = None) -> None:
        self.kept = _Kept(vocabs, _counted if count else _packed)
        self.lookaheads = lookaheads or [v.lookahead for v in vocabs]

    def parts(self, text: str | None) -> list:
        if not text:
            return []
        e, out = StreamingEncoder(self.kept, self.lookaheads), []
        for i in range(0, len(text), SLICE):
            out += e.feed(text[i : i + SLICE], i + SLICE >= len(text))
        if e.going:
            out.append(e._stable("", True))
        return out

    def __call__(self, text: str | None) -> bytes:
        return b"".join(self.parts(text))

    def counts(self, text: str | None) -> list[int]:
        n, k = sum(self.parts(text)), len(self.kept.vocabs)
        return [(n >> (COUNT_BITS * i)) & ((1 << COUNT_BITS) - 1) if i < k - 1 else n >> (COUNT_BITS * i) for i in range(k)]


@functools.lru_cache(maxsize=8)
def _encoder(names: tuple[str, ...], folder: str | None, count: bool, lookaheads: tuple[int, ...]) -> Encoder:
    return Encoder([vocabulary(n, folder) for n in names], count, list(lookaheads))


def encode(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """key, ids: the token ids of each row's text, without special tokens; null and empty texts have an empty list.

    One row per row of the input; strings of special tokens in a text are ordinary text.  Texts
    of any length are encoded whole.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    lookahead = vocabulary(tokenizer, folder).lookahead  # of the merge list, found once, by the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder((tokenizer,), folder, False, (lookahead,))
        for batch in batches:
            keys, at, packed, total = batch.column("key"), 0, [], 0
            for i, t in enumerate(batch.column("text").to_pylist()):
                packed.append(enc(t))
                total += len(packed[-1])
                if total >= 4 * BATCH_VALUES or i == len(keys) - 1:
                    ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype="int32")
                    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
                    yield pa.RecordBatch.from_arrays([keys.slice(at, len(packed)), pa.ListArray.from_arrays(pa.array(ends), values)], ["key", "ids"])
                    at, packed, total = i + 1, [], 0

    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(documents: DataFrame, tokenizers: list[str], key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """key, tokenizer, n_tokens: the length of each text in tokens of each tokenizer; 0 for null and empty texts."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    names, lookaheads = tuple(tokenizers), tuple(vocabulary(t, folder).lookahead for t in tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(names, folder, True, lookaheads) if names else None
        for batch in batches:
            counts = [enc.counts(t) for t in batch.column("text").to_pylist()] if names else []
            for i, name in enumerate(names):
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([name] * len(counts), pa.string()), pa.array([c[i] for c in counts], pa.int64())], ["key", "tokenizer", "n_tokens"])

    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(run, f"key {kind}, tokenizer string, n_tokens bigint").withColumnRenamed("key", key)


def decode(encoded: DataFrame, tokenizer: str, key: str = "doc_id", folder: str | None = None) -> DataFrame:
    """key, text: the text of each list of ids; '' for an empty or null list."""
    rows = encoded.select(F.col(key).alias("key"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer, folder)
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                d = StreamingDecoder(vocab)
                texts.append(d.feed(ids or ()) + d.finish())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
