"""SentencePiece encoding and decoding by streaming Viterbi.

The lattice of a text has a node at each code point and an arc for each piece.
The encoder keeps a window of nodes as long as the longest piece: a node's best
arc, and its path's score, depend on that window only.  Whenever the paths of
all nodes in the window run back to one boundary, the ids up to it are final
and leave; memory doesn't depend on the text's length.

Two neighbouring characters that no piece holds side by side are such a
boundary whatever the paths are: all of them converge there.  A text is cut at
the boundaries that a pattern can find (before a space, around a line's end,
between a word and the stop after it), and the lattices of many cuts advance
together, one code point a step, in numpy arrays (``Lattices``).  A cut of more
than ``ROW`` code points streams alone (``PieceModel.stream``), committing
whenever paths converge.  Ids of cuts are remembered in a bounded memo, which
changes nothing but time.

For a unigram model a path's score is the sum of its pieces' scores.  For a BPE
model a path is admissible when each piece and the next stay apart under the
model's merges (then it is the model's own segmentation, which is unique), so
ids equal those of the model's reference encoder.  A code point that no piece
covers becomes its UTF-8 byte pieces, or the unknown id where there are none.

Defined results: null and empty text give no ids; spaces become the space mark
and a mark is put before the text where the model says so; other normalisation
rules than "identity" are refused, as are models of other kinds.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import rows_of
from .words import Numbers, chunks

SPACE = "▁"
#: Cuts of texts a worker remembers, in each of two generations.
MEMO = 150_000
#: Most code points of a cut that advances with others, and how many do.
ROW, ROWS = 64, 8192
#: Pairs of pieces whose verdict a worker remembers (some 50 MB).
PAIRS = 700_000
#: Code points of text whose cuts are looked up together.
TOGETHER = 1 << 19
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_STOPS = ".,;:!?"

_UNKNOWN_COST = -10.0


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol-buffer message: (number, value)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


class Lattices:
    """The lattices of many short texts at once."""

    def __init__(self, model: PieceModel):
        self.model = model
        prefixes = {"": 0}
        for piece in model.ids:
            for k in range(1, len(piece) + 1):
                prefixes.setdefault(piece[:k], len(prefixes))
        steps = [(prefixes[p[:-1]] << 21 | ord(p[-1]), n) for p, n in prefixes.items() if p]
        self.trie = Numbers()
        self.trie.put(np.array([k for k, _ in steps], dtype=np.int64), np.array([n for _, n in steps], dtype=np.int32))
        self.piece_at = np.array([model.ids.get(p, -1) for p in prefixes], dtype=np.int32)
        self.scores = np.array(model.scores)
        self.pairs = Numbers()

    def fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether pieces stay apart under the merges; each pair is judged once."""
        key = (before.astype(np.int64) + 1) << 20 | piece
        known = self.pairs.get(key)
        if (known < 0).any():
            if self.pairs.count > PAIRS:
                self.pairs = Numbers()
            new = np.unique(key[known < 0])
            self.pairs.put(new, np.array([self.model.apart((k >> 20) - 1, k & 0xFFFFF) for k in new.tolist()], dtype=np.int32))
            known = self.pairs.get(key)
        return known > 0

    def arcs(self, points: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """All pieces from each place of ``points``, by length: places and pieces."""
        at, node, places, pieces = np.arange(len(points)), np.zeros(len(points), dtype=np.int64), [], []
        for k in range(self.model.longest):
            inside = at + k < ends[at]
            at, node = at[inside], node[inside]
            node = self.trie.get(node << 21 | points[at + k]).astype(np.int64)
            at, node = at[node >= 0], node[node >= 0]
            piece = self.piece_at[node]
            places.append(at[piece >= 0])
            pieces.append(piece[piece >= 0])
        return places, pieces

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """Ids of each text; None where a code point has no piece of its own."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        row = np.repeat(np.arange(len(texts)), sizes)
        ends = np.repeat(np.cumsum(sizes), sizes)
        places, pieces = self.arcs(points, ends)
        bare = np.ones(len(points), dtype=bool)
        bare[places[0]] = False
        # a node before each code point and one after the last; arcs by the step at which they end, the longest first
        start = np.concatenate(places[::-1])
        length = np.repeat(np.arange(len(places), 0, -1), [len(p) for p in places[::-1]])
        piece = np.concatenate(pieces[::-1])
        begin = np.cumsum(sizes) - sizes
        step = (start + length - begin[row[start]]).astype(np.uint16)
        order = np.argsort(step, kind="stable")
        bounds = np.searchsorted(step[order], np.arange(1, int(sizes.max(initial=0)) + 2))
        first, last = (start + row[start])[order], (start + length + row[start])[order]
        piece = piece[order]
        n = len(points) + len(texts)
        root = begin + np.arange(len(texts))
        came, by, best = np.full(n, -1, dtype=np.int64), np.full(n, -2, dtype=np.int64), np.full(n, -np.inf)
        by[root], best[root] = -1, 0.0
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            some = np.arange(a, b)[by[first[a:b]] > -2]
            if self.model.is_bpe:
                some = some[self.fits(by[first[some]], piece[some])]
            else:
                score = best[first[some]] + self.scores[piece[some]]
                np.maximum.at(best, last[some], score)
                some = some[score == best[last[some]]]
            some = some[::-1]  # of several arcs to one node the longest is written last
            came[last[some]], by[last[some]] = first[some], piece[some]
        # back from each text's last node
        at, texts_at, found, of = root + sizes, np.arange(len(texts)), [], []
        lost = np.zeros(len(texts), dtype=bool)
        lost[row[bare]] = True
        on = ~lost & (sizes > 0)
        at, texts_at = at[on], texts_at[on]
        while len(at):
            found.append(by[at])
            of.append(texts_at)
            at = came[at]
            on = at != root[texts_at]
            at, texts_at = at[on], texts_at[on]
        ids, of = (np.concatenate(x[::-1]) if x else np.empty(0, dtype=np.int64) for x in (found, of))
        order = np.argsort(of, kind="stable")
        packed = ids[order].astype("<i4").tobytes()
        cuts = 4 * np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(texts)))))
        return [None if z else packed[a:b] for z, a, b in zip(lost.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class PieceModel:
    """Pieces, scores and rules of a ``.model`` file."""

    NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.is_bpe, self.prefix, rule, squeeze = False, True, "identity", False
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, self.NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
                if kind not in (1, 2):
                    raise ValueError(f"model type {kind} is neither unigram nor BPE")
                self.is_bpe = kind == 2
            elif number == 3:
                told = dict(_fields(value))
                rule, self.prefix, squeeze = told.get(1, b"identity").decode() or "identity", bool(told.get(3, 1)), bool(told.get(4, 1))
        if rule != "identity" or squeeze:
            raise ValueError(f"normalisation {rule!r} (extra spaces removed: {squeeze}) isn't supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (self.NORMAL, self.USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == self.BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == self.UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.raw = [bytes([int(p[3:5], 16)]) if k == self.BYTE else b"" if k == self.CONTROL else " ⁇ ".encode() if k == self.UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self._histories: dict[int, tuple[list[str], list[str], list[float]] | None] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}  # the memo before it was full

    @cached_property
    def lattices(self) -> Lattices:
        return Lattices(self)

    @cached_property
    def cuts(self) -> re.Pattern | None:
        """Cuts of a text at places that no piece runs across, or None where pieces leave no such place."""
        inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}  # neighbours within a piece
        if any(b == SPACE != a for a, b in inside):
            return None
        line = "\n" if not any("\n" in x for x in inside) else ""
        letter = re.compile(f"[{_LETTERS}]")
        stops = "".join(c for c in _STOPS if not any(x[1] == c and letter.match(x[0]) for x in inside))
        word = rf"{SPACE}*[{_LETTERS}]+(?=[{SPACE}{line}{stops}]|\Z)"
        rest = rf"{SPACE}*[^{SPACE}{line}]+"
        return re.compile("|".join([word, rest, *([line] if line else []), f"{SPACE}+"]))

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            return cls(f.read())

    # -- BPE: do two pieces stay apart?

    def history(self, piece: int) -> tuple[list[str], list[str], list[float]] | None:
        """First and last part of a piece's text before each of its merges, and the score of that merge; None if they don't make the piece."""
        if piece not in self._histories:
            parts, first, last, scores = list(self.pieces[piece]), [], [], []
            while True:
                best, at = -np.inf, -1
                for i in range(len(parts) - 1):
                    k = self.ids.get(parts[i] + parts[i + 1])
                    if k is not None and self.scores[k] > best:
                        best, at = self.scores[k], i
                first.append(parts[0])
                last.append(parts[-1])
                scores.append(best)
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._histories[piece] = (first, last, scores) if len(parts) == 1 else None
        return self._histories[piece]

    def apart(self, a: int, b: int) -> bool:
        """Piece a before piece b is what the merges make of their text (a < 0: b alone).

        The merges within both go on as if the other weren't there, the best
        score first and the left one among equals, until a merge across their
        border would come before the next of either.
        """
        right = self.history(b)
        if a < 0 or right is None:
            return right is not None
        left = self.history(a)
        if left is None:
            return False
        ids, scores, i, j = self.ids, self.scores, 0, 0
        while True:
            over = ids.get(left[1][i] + right[0][j])
            if over is not None and scores[over] > left[2][i] and scores[over] >= right[2][j]:
                return False
            if left[2][i] == right[2][j] == -np.inf:
                return True
            if left[2][i] >= right[2][j]:
                i += 1
            else:
                j += 1

    # -- the lattice

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of ``text`` (already with space marks), in final pieces as paths converge."""
        ids, longest, scores, judged = self.ids, self.longest, self.scores, self._apart
        best: dict[int, tuple[float, int, int]] = {0: (0.0, -1, -1)}  # node -> score, start of its arc, id (-1: none or unknown)
        done = 0

        def back(node: int) -> list[int]:
            """Nodes of a path, last first, down to ``done``."""
            path = [node]
            while path[-1] > done:
                path.append(best[path[-1]][1])
            return path

        def ids_of(path: list[int]) -> list[int]:
            out: list[int] = []
            for start, end in zip(path[:0:-1], path[-2::-1], strict=True):
                piece = best[end][2]
                out += [piece] if piece >= 0 else self.fallback(text[start:end])
            return out

        for end in range(1, len(text) + 1):
            found = None
            for start in range(max(done, end - longest), end):
                if start not in best:
                    continue
                piece = ids.get(text[start:end])
                if piece is None:
                    continue
                score, _, before = best[start]
                if self.is_bpe:
                    if (before, piece) not in judged:
                        if len(judged) > 2_000_000:
                            judged.clear()
                        judged[before, piece] = self.apart(before, piece)
                    if judged[before, piece]:
                        found = (0.0, start, piece)
                        break
                elif found is None or score + scores[piece] > found[0]:
                    found = (score + scores[piece], start, piece)
            if found is None and text[end - 1] not in ids and end - 1 in best:
                found = (best[end - 1][0] + _UNKNOWN_COST, end - 1, -1)
            if found is not None:
                best[end] = found
            if end - done >= 2 * longest:
                paths = [back(n) for n in range(end - longest + 1, end + 1) if n in best]
                common = set(paths[0]).intersection(*paths[1:])
                upto = max(common)
                if upto > done:
                    yield ids_of(paths[0][paths[0].index(upto) :])
                    done = upto
                    best = {n: v for n, v in best.items() if n >= done}
        if len(text) > done:
            yield ids_of(back(len(text)))

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    # -- texts

    def stream_ids(self, text: str) -> bytes:
        return np.array([i for some in self.stream(text) for i in some], dtype="<i4").tobytes()

    def learn(self, cuts: set[str]) -> None:
        """Bring the ids of all these cuts into the memo."""
        new, rows = {}, []
        for cut in cuts:
            if cut not in self._memo:
                if cut in self._older:
                    new[cut] = self._older[cut]
                elif len(cut) > ROW:
                    new[cut] = self.stream_ids(cut)
                else:
                    rows.append(cut)
        rows.sort(key=len)  # those that end at one step are side by side
        for first in range(0, len(rows), ROWS):
            some = rows[first : first + ROWS]
            for cut, ids in zip(some, self.lattices.encode(some), strict=True):
                new[cut] = self.stream_ids(cut) if ids is None else ids
        if len(self._memo) + len(new) > MEMO:
            self._memo, self._older = {}, self._memo
            new |= {cut: self._older[cut] for cut in cuts if cut in self._older}
        self._memo.update(new)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit integers, one after the other."""
        if self.cuts is None:
            yield from (self.stream_ids(self.marked(t)) for t in texts)
            return
        for a, b in chunks([len(t) for t in texts], TOGETHER):
            if len(texts[a]) > TOGETHER:  # a chunk of its own: its cuts a part at a time
                cut, out = (m[0] for m in self.cuts.finditer(self.marked(texts[a]))), []
                while some := list(islice(cut, TOGETHER // 8)):
                    self.learn(set(some))
                    out.append(b"".join(map(self._memo.__getitem__, some)))
                yield b"".join(out)
                continue
            cut = [self.cuts.findall(self.marked(t)) for t in texts[a:b]]
            self.learn(set().union(*cut))
            yield from (b"".join(map(self._memo.__getitem__, c)) for c in cut)

    def marked(self, text: str) -> str:
        """The text with space marks."""
        text = text.replace(" ", SPACE)
        return SPACE + text if self.prefix and text else text

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids])
        if self.prefix and text.startswith(b" "):
            text = text[1:]
        return text.decode(errors="replace")


_loaded: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    if path not in _loaded:
        _loaded[path] = PieceModel.load(path)
    return _loaded[path]


Batches = Iterator[pa.RecordBatch]


def encoding(model_path: str) -> Callable[[Batches], Batches]:
    """A pass over batches (id, text) that makes them (id, ids); ``model_path`` is read where it runs."""

    def encode(batches: Batches) -> Batches:
        model = _model(model_path)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                packed = list(model.encode_all([t or "" for t in part.column(1).to_pylist()]))
                offsets = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    return encode


def decoding(model_path: str) -> Callable[[Batches], Batches]:
    """A pass over batches (id, ids) that makes them (id, ids, text)."""

    def decode(batches: Batches) -> Batches:
        model = _model(model_path)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                values, offsets = rows_of(part.column(1), np.int32)
                texts = [model.decode(values[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string())], names=["id", "ids", "text"])

    return decode


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``ids`` (array of int).  ``model_path`` is read on every executor."""
    id_type = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(encoding(model_path), f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: id, ``ids`` and the ``text`` they stand for (null ids: empty)."""
    id_type = encoded.schema[id_col].dataType.simpleString()
    own = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return own.mapInArrow(decoding(model_path), f"id {id_type}, ids array<int>, text string").toDF(id_col, "ids", "text")
