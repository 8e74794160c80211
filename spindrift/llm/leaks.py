"""Held-out passages that turn up in a corpus, whole or in part, not always letter by letter.

Texts are folded to letters and digits of any script, so that layout, case, punctuation, accents and markup don't matter. Each
passage is cut into windows of ``WINDOW`` characters; all of them are patterns of a Wu-Manber search: a shift table over
hashed blocks of ``BLOCK`` characters skips what no pattern can end in, suffix and prefix blocks select the patterns to try, and
direct comparison of the letters confirms. The search runs over many lanes of a text at once, one array step moving all
cursors. Where a document holds some windows of a passage, the passage is laid along the diagonals they lie on, and the
words inside stretches that it follows closely are counted. A window that many passages share counts for each of them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, BLOCK = 12, 4
#: Windows that must lie on about one diagonal to count, and the part of a passage's patterns that must count in all, before
#: the passage is laid along a document. A copy of half a passage with every tenth word changed keeps about a quarter.
CHAIN, SEEN_PART = 3, 0.12
#: Letters that edits may shift a stretch by; length of the grams compared along a diagonal and of the least run of them; how
#: much of a window of so many letters must be held where a stretch follows the passage closely.
DRIFT, GRAM, RUN, SMOOTH, CLOSE = 20, 5, 10, 61, 0.72
#: Part of a passage's words that a document must give.
COVERED = 0.5
#: Folded characters searched at once, and characters of a lane.
CHUNK, LANE = 4_000_000, 512
#: Test items, and characters of their passages, searched for in one pass over the corpus; pairs of a window in a document and a
#: passage laid out at once, unless a document has more.
ITEMS, PASSAGES, PAIRS = 20_000, 20_000_000, 4_000_000

_DROP = bytes(b for b in range(256) if not (48 <= b <= 57 or 97 <= b <= 122))
_CODE = np.zeros(128, np.uint8)
_CODE[48:58] = np.arange(1, 11)
_CODE[97:123] = np.arange(11, 37)
_BASE = 37
_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&#?[A-Za-z0-9]{1,8};")
_OTHER = re.compile(r"[^\W\x00-\x7f]")
_NO_LETTER = re.compile(r"[\W_]+")
#: Scripts that put no blanks between words; each of their letters counts as a word.
_UNSPACED = "\u0e00-\u0edf\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
#: Letters that look like Latin ones, and the micro sign's letter.
_ALIKE = str.maketrans("\u0430\u0435\u0456\u0458\u043e\u0440\u0441\u0443\u0445\u0455\u03bc\u03bf", "aeijopcyxsuo")


def fold(text: str) -> bytes | str:
    """The letters and digits of a text, lower case, without accents and markup: bytes where all are ASCII, else a text."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).casefold().translate(_ALIKE)
        if _OTHER.search(text):
            return _NO_LETTER.sub("", text)
    return text.lower().encode("ascii", "ignore").translate(None, _DROP)


def letters(folded: bytes | str) -> np.ndarray:
    """A folded text as numbers: 1..36 for ASCII digits and letters, larger ones for all others."""
    if isinstance(folded, bytes):
        return _CODE[np.frombuffer(folded, np.uint8)].astype(np.uint32)
    points = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CODE[np.minimum(points, 127)], points)


def codes(letter: np.ndarray) -> np.ndarray:
    """Letters as codes below ``_BASE`` for the shift table; other than ASCII ones share codes by hash. 0 stays 0."""
    return np.where(letter < _BASE, letter, letter * np.uint32(2654435761) % np.uint32(_BASE - 1) + np.uint32(1)).astype(np.uint8)


def word_places(text: str) -> np.ndarray:
    """The middle of each word of a text in its folded form."""
    text = unicodedata.normalize("NFKC", _MARKUP.sub(" ", text))
    at, out = 0, []
    for word in _WORD.findall(text):
        n = len(fold(word))
        if n:
            out.append(at + n // 2)
        at += n
    return np.array(out, np.int64)


class Patterns:
    """Equal-length patterns with the tables of a Wu-Manber search."""

    def __init__(self, patterns: np.ndarray) -> None:
        self.letters = patterns.reshape(-1, WINDOW)
        blocks = self._blocks(codes(self.letters), np.arange(WINDOW - BLOCK + 1))
        self.shift = np.full(_BASE**BLOCK, WINDOW - BLOCK + 1, np.uint8)
        for j in range(WINDOW - BLOCK + 1):  # later blocks lie nearer the end and shift less
            self.shift[blocks[:, j]] = WINDOW - BLOCK - j
        self.key = blocks[:, -1].astype(np.int64) * _BASE**BLOCK + blocks[:, 0]
        self.order = np.argsort(self.key, kind="stable")
        self.key = self.key[self.order]

    @staticmethod
    def _blocks(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(code), len(starts)), np.int32)
        for i in range(BLOCK):
            out = out * _BASE + code[:, starts + i]
        return out

    def search(self, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of every occurrence in a text of letters (0 separates documents)."""
        text = codes(letter)
        n = len(text)
        if n < WINDOW:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pos = np.arange(WINDOW - 1, n, LANE, dtype=np.int64)
        end = np.minimum(pos + LANE, n)
        found = []
        while len(pos):
            code = text[pos - 3].astype(np.int32)
            for i in (2, 1, 0):
                code = code * _BASE + text[pos - i]
            step = self.shift[code]
            zero = step == 0
            if zero.any():
                found.append(pos[zero])
            pos = pos + np.maximum(step, 1)
            live = pos < end
            if not live.all():
                pos, end = pos[live], end[live]
        starts = (np.concatenate(found) if found else np.empty(0, np.int64)) - (WINDOW - 1)
        prefix, suffix = text[starts].astype(np.int64), text[starts + WINDOW - BLOCK].astype(np.int64)
        for i in range(1, BLOCK):
            prefix = prefix * _BASE + text[starts + i]
            suffix = suffix * _BASE + text[starts + WINDOW - BLOCK + i]
        key = suffix * _BASE**BLOCK + prefix
        first, last = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        some = last > first
        starts, first, count = starts[some], first[some], (last - first)[some]
        each = np.repeat(np.arange(len(starts)), count)
        which = self.order[np.repeat(first, count) + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)]
        at = starts[each]
        same = (letter[at[:, None] + np.arange(WINDOW)] == self.letters[which]).all(axis=1)
        return at[same], which[same]


@dataclass
class Passage:
    item: int
    letters: np.ndarray
    words: np.ndarray


class Matcher:
    """Finds the passages a batch of documents gives."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.passages = []
        number: dict[bytes, int] = {}
        posts: list[list[tuple[int, int]]] = []
        n_patterns = []
        for item, text in items:
            own = letters(fold(text))
            if len(own) < WINDOW:
                continue
            starts = sorted({*range(0, len(own) - WINDOW, WINDOW), len(own) - WINDOW})
            for at in starts:
                i = number.setdefault(own[at : at + WINDOW].tobytes(), len(number))
                if i == len(posts):
                    posts.append([])
                posts[i].append((len(self.passages), at))
            self.passages.append(Passage(item, own, word_places(text)))
            n_patterns.append(len(starts))
        self.patterns = Patterns(np.frombuffer(b"".join(number), np.uint32)) if number else None
        self.post_first = np.cumsum([0, *map(len, posts)])
        flat = np.array([x for post in posts for x in post], np.int64).reshape(-1, 2)
        self.post_passage, self.post_at = flat[:, 0], flat[:, 1]
        n = np.array(n_patterns, np.int64)
        self.chain = np.minimum(CHAIN, n)
        self.least = np.maximum(self.chain, np.ceil(SEEN_PART * n).astype(np.int64))

    def find(self, texts: list[bytes | str]) -> list[tuple[int, int, float]]:
        """(index of the text, item, part of the passage's words) for every passage a text gives at least ``COVERED`` of."""
        if self.patterns is None or not texts:
            return []
        parts = [letters(t) for t in texts]
        gap = np.zeros(1, np.uint32)
        text = np.concatenate([x for part in parts for x in (part, gap)])
        begins = np.cumsum([0, *(len(t) + 1 for t in parts)])
        at, pattern = self.patterns.search(text)
        order = np.argsort(at, kind="stable")
        at, pattern = at[order], pattern[order]
        count = np.diff(self.post_first)[pattern]
        doc = np.searchsorted(begins, at, "right") - 1
        # whole documents at a time, so that windows many passages share don't pile up
        laid = np.cumsum(count)
        ends = np.flatnonzero(np.diff(doc, append=-1)) + 1
        out: list[tuple[int, int, float]] = []
        first = 0
        while first < len(at):
            reach = np.searchsorted(laid[ends - 1], (laid[first - 1] if first else 0) + PAIRS, "right")
            last = int(ends[max(reach - 1, np.searchsorted(ends, first, "right"))])
            out += self._find(text, begins, at[first:last], pattern[first:last], count[first:last], doc[first:last])
            first = last
        return out

    def _find(self, text: np.ndarray, begins: np.ndarray, at: np.ndarray, pattern: np.ndarray, count: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, float]]:
        each = np.repeat(np.arange(len(at)), count)
        post = np.repeat(self.post_first[:-1][pattern], count) + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
        passage, inside = self.post_passage[post], self.post_at[post]
        diagonal, doc = at[each] - inside, doc[each]
        # only pairs with as many windows as a passage must show
        pair = doc * len(self.passages) + passage
        found, which, n = np.unique(pair, return_inverse=True, return_counts=True)
        enough = (n >= self.least[found % len(self.passages)])[which]
        passage, doc, diagonal = passage[enough], doc[enough], diagonal[enough]
        order = np.lexsort((diagonal, passage, doc))
        passage, doc, diagonal = passage[order], doc[order], diagonal[order]
        pair = doc * len(self.passages) + passage
        if not len(pair):
            return []
        # chains: hits of a pair on about one diagonal
        first = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(diagonal, prepend=-(10**15)) > DRIFT))
        hits = np.diff(np.append(first, len(pair)))
        good = hits >= self.chain[passage[first]]
        first, hits = first[good], hits[good]
        out = []
        groups = np.flatnonzero(np.diff(pair[first], prepend=-1))
        for g, h in zip(groups, np.append(groups, len(first))[1:], strict=True):
            at = first[g]
            if hits[g:h].sum() >= self.least[passage[at]]:
                p, d = self.passages[passage[at]], doc[at]
                bands = [(int(diagonal[f] - begins[d]), int(diagonal[f + n - 1] - begins[d])) for f, n in zip(first[g:h], hits[g:h], strict=True)]
                part = self._covered(p, text[begins[d] : begins[d + 1] - 1], bands)
                if part >= COVERED:
                    out.append((int(d), p.item, part))
        return out

    @staticmethod
    def _covered(p: Passage, text: np.ndarray, bands: list[tuple[int, int]]) -> float:
        """The part of the passage's words inside stretches that follow it closely, along bands of diagonals."""
        grams = _grams(p.letters)
        inside = np.zeros(len(p.letters), bool)
        for first, last in bands:
            low, high = first - DRIFT, last + DRIFT
            a, b = max(0, low), min(len(text), high + len(p.letters))
            padded = np.zeros(high - low + len(p.letters), np.uint32)
            padded[a - low : b - low] = text[a:b]
            along = np.lib.stride_tricks.sliding_window_view(_grams(padded), len(grams))
            same = (along == grams).any(axis=0)
            held = np.zeros(len(p.letters) + 1, np.int32)
            np.add.at(held, np.flatnonzero(same), 1)
            np.add.at(held, np.flatnonzero(same) + GRAM, -1)
            held = _long_runs(np.cumsum(held[:-1]) > 0)
            # a stretch: everything in a window that is mostly held
            total = np.concatenate([[0], np.cumsum(held)])
            width = min(SMOOTH, len(held))
            close = np.flatnonzero(total[width:] - total[:-width] >= CLOSE * width)
            mark = np.zeros(len(held) + 1, np.int32)
            np.add.at(mark, close, 1)
            np.add.at(mark, close + width, -1)
            near = np.cumsum(mark[:-1]) > 0
            # a window's rim counts only where letters near it are held
            rim = np.convolve(held, np.ones(2 * RUN + 1), "same") > 0
            inside |= near & rim
        return float(inside[p.words].mean()) if len(p.words) else 0.0


def _long_runs(held: np.ndarray) -> np.ndarray:
    """``held`` without runs shorter than ``RUN``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]])))
    out = np.zeros(len(held) + 1, np.int32)
    for sign, side in ((1, edge[::2]), (-1, edge[1::2])):
        out[side[edge[1::2] - edge[::2] >= RUN]] += sign
    return np.cumsum(out[:-1]) > 0


def _grams(letter: np.ndarray) -> np.ndarray:
    """A hash of each ``GRAM`` letters, without collisions among ASCII ones."""
    out = letter[: len(letter) - GRAM + 1].astype(np.uint64)
    for i in range(1, GRAM):
        out = out * np.uint64(1_000_003) + letter[i : len(letter) - GRAM + 1 + i]
    return out


def _search(tables: Broadcast):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher: Matcher = tables.value
        ids: list[int] = []
        texts: list[bytes | str] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = matcher.find(texts)
            out = [pa.array([ids[i] for i, _, _ in found], pa.int64()), pa.array([k for _, k, _ in found], pa.int64()), pa.array([c for _, _, c in found], pa.float64())]
            return pa.RecordBatch.from_arrays(out, names=["doc_id", "item_id", "part"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid:
                    folded = fold(text.as_py())
                    if len(folded) >= WINDOW:
                        ids.append(i)
                        texts.append(folded)
                        size += len(folded)
                        if size >= CHUNK:
                            yield flush()
                            ids, texts, size = [], [], 0
        if ids:
            yield flush()

    return task


def leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, item_id, part): each document with each item of whose passage's words it gives at least ``COVERED``.

    * Null ids or texts, and texts of under ``WINDOW`` letters and digits, give nothing; so do such passages. Letters of all scripts
      count; where a script has no blanks between words, each letter is a word.
    * Repeated documents or items each count, once per (doc_id, item_id), with the largest part.
    * Whole texts are searched, whatever their length; a stretch may cross any layout. Other columns are ignored.

    The items' tables are built once and broadcast, in blocks of at most ``ITEMS`` items and about ``PASSAGES`` characters; each
    block is a pass over the corpus, and the driver holds one at a time. No row of the corpus is shuffled before the found pairs are.
    """
    wanted = items.select(items[item_id].cast("bigint").alias("i"), items[passage].alias("p")).dropna()
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("p")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.n // ITEMS), -(-size.chars // PASSAGES))
    context = documents.sparkSession.sparkContext
    corpus = documents.select(documents[doc_id].cast("bigint").alias("d"), documents[text].alias("t")).where("d IS NOT NULL AND t IS NOT NULL")
    out = None
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).orderBy("i", "p").collect()
        tables = context.broadcast(Matcher([(r.i, r.p) for r in rows]))
        part = corpus.mapInArrow(_search(tables), "doc_id bigint, item_id bigint, part double")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("part").alias("part"))
