"""Passages of held-out items that were printed on pages of a corpus, found through an FM-index of each shard of pages.

Folding: pages (in reading order, without heads) and passages become streams of symbols in which what scanning does
leaves no trace: letters lose case and accents and ligatures come apart, all that is no letter or digit goes (so blanks
and broken words do not matter), and letters that are read for each other share a symbol. Letters of other scripts share
the same symbols by their code.

Each task cuts its pages into shards of up to two million symbols, builds a shard's FM-index, and searches all passages
in it at once: from every ``stride``-th symbol of a passage a match grows to the left until it is rare in the shard, and
the occurrences that part from it on the way are kept too. The hits are located by sampled suffix positions and gathered
per page and item. Where they cover enough, the pieces in which page and passage agree are joined to spans in the order
of reading (of a page without boxes, both as scanned and as guessed); between two pieces a few symbols may be misread, or whole lines of the page (an advert, a heading, a line of
another column, of any number) may stand. A span counts by the words that lie wholly in it. Spans of a page that
overlap are merged.

The passages are a fixed table, held to MOST_SYMBOLS and broadcast; pages never meet in a shuffle. Null and blank texts
and passages match nothing; repeated rows are found again and reported once; empty tables give empty results. A page
longer than a shard is cut into pieces that overlap by more than any span.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from beatloom.llm.fmindex import LIMIT, FMIndex
from beatloom.llm.pages import Reading, read_pages

# The classes of characters that scans read for each other, and characters that stand for two.
CLASSES = ("ec", "irl1", "ao0", "nu", "tf", "s5", "gq", "bh", "vy", "j", "k", "p", "x", "z", "2", "3", "4", "6", "7", "8", "9")
PAIRS = {"d": "cl", "m": "rn", "w": "vv", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "cl", "þ": "p", "ſ": "s"}

SYMBOLS = len(CLASSES) + 1
SHARD = 1_900_000
LEAST_WORDS = 16
OVERLAP = 16_384
NEWLINE = 255
#: The passages' stream may have this many symbols; beyond it they are no fixed small table and are not broadcast.
MOST_SYMBOLS = 50_000_000


@dataclass(frozen=True)
class Search:
    """What is looked at more closely; see EXACT for the setting that leaves nothing out.

    stride: a match is grown from every ``stride``-th symbol of a passage.
    seed, most, few: a match has at least ``seed`` symbols; it grows until it has ``few`` occurrences or ``most`` symbols.
    gather: symbols of a passage that the hits on a page must cover before the page is compared with it.
    first_look: words in a row that the diagonals of the hits must give before all diagonals of the page are looked at.
    rest: symbols in a row that page and passage must share on one of those.
    near, sure: pieces are joined over whole lines of the page up to ``near`` symbols further down; over more, if what goes
    before and what follows has ``sure`` symbols each, which is more than phrases that a long page may hold anyway.
    """

    stride: int = 8
    seed: int = 24
    most: int = 48
    few: int = 4
    gather: int = 40
    first_look: int = 9
    rest: int = 12
    near: int = 1_200
    sure: int = 52


USUAL = Search()
EXACT = Search(stride=1, seed=12, most=12, few=0, gather=12, first_look=0, near=1 << 40)


def _symbols_of(ch: str, symbol: dict[str, int]) -> list[int]:
    """The symbols of one character: none for signs, up to three for ligatures."""
    plain = [c for c in unicodedata.normalize("NFKD", ch.lower()) if not unicodedata.combining(c)]
    spelled = "".join(PAIRS.get(c, c) for c in plain)
    return [symbol.get(c, 1 + ord(c) % len(CLASSES)) for c in spelled if c.isalnum()][:3]


def _tables() -> np.ndarray:
    """Symbols of each character code up to U+FFFF, one row for each (0: none)."""
    symbol = {ch: i + 1 for i, group in enumerate(CLASSES) for ch in group}
    table = np.zeros((0x10000, 3), np.uint8)
    for code in range(0x10000):
        found = _symbols_of(chr(code), symbol) if not 0xD800 <= code < 0xE000 else []
        table[code, : len(found)] = found
    table[10, 0] = NEWLINE
    return table


TABLE = _tables()


def _codes(text: str) -> np.ndarray:
    """Character codes; what lies beyond U+FFFF (and signs no text should have) comes as the code it stands for, or as none."""
    if text and max(text) > "\uffff":
        text = "".join(c if c <= "\uffff" else (unicodedata.normalize("NFKC", c)[:1] if unicodedata.normalize("NFKC", c) <= "\uffff" else "\u3400" if c.isalnum() else " ") for c in text)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fold(text: str) -> np.ndarray:
    """Symbols of a text; NEWLINE stays between lines."""
    three = TABLE[_codes(text)].ravel()
    return three[three > 0]


def places(text: str) -> np.ndarray:
    """For each symbol of a folded line the place of its character in it."""
    codes = _codes(text)
    return np.repeat(np.arange(len(codes)), (TABLE[codes] > 0).sum(axis=1))


@dataclass
class Passages:
    """All passages as one stream with separators, and the place of each word in it."""

    ids: np.ndarray
    stream: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    word_start: list[list[int]]
    word_stop: list[list[int]]
    number: list[list[bool]]
    ends: np.ndarray
    owner: np.ndarray
    all_starts: np.ndarray
    all_stops: np.ndarray


def fold_passages(rows: list[tuple[int, str | None]], search: Search = USUAL) -> Passages:
    ids, parts, start, stop, word_start, word_stop, number, ends, owner = [], [np.zeros(1, np.uint8)], [], [], [], [], [], [], []
    at = 1
    for item, passage in rows:
        if item is None or not passage or not passage.strip():
            continue
        spelled = [(fold(w), any(ch.isdigit() for ch in w)) for w in passage.split()]
        spelled = [(w, digits) for w, digits in spelled if len(w)]
        words = [w for w, _ in spelled]
        if not words:
            continue
        edge = at + np.r_[0, np.cumsum([len(w) for w in words])]
        ids.append(item)
        start.append(at)
        stop.append(int(edge[-1]))
        word_start.append(edge[:-1].tolist())
        word_stop.append(edge[1:].tolist())
        number.append([digits for _, digits in spelled])
        parts += [*words, np.zeros(1, np.uint8)]
        own = np.unique(np.r_[np.arange(at + search.seed, int(edge[-1]) + 1, search.stride), int(edge[-1])])
        own = own[own - at >= search.seed]
        ends.append(own)
        owner.append(np.full(len(own), len(ids) - 1))
        at = int(edge[-1]) + 1
    none = np.zeros(0, np.int64)
    return Passages(np.array(ids, np.int64), np.concatenate(parts), np.array(start, np.int64), np.array(stop, np.int64), word_start, word_stop, number, np.concatenate(ends) if ends else none, np.concatenate(owner) if owner else none, np.array([x for w in word_start for x in w], np.int64), np.array([x for w in word_stop for x in w], np.int64))


@dataclass
class Page:
    """A folded page, or a piece of a long one that starts at symbol ``at``.

    ``starts``: where its lines start in ``symbols``; ``lines`` and ``number``: the lines in reading order and their
    numbers in ``text``, the page as scanned.
    """

    row: int
    symbols: np.ndarray
    starts: np.ndarray
    lines: list[str]
    number: np.ndarray
    text: str = ""
    at: int = 0


@dataclass
class Shard:
    """Folded pages one after the other: symbols, starts of lines, the pages and their bounds."""

    text: np.ndarray
    lines: np.ndarray
    pages: list[Page]
    start: np.ndarray
    stop: np.ndarray


def fold_pages(read: Reading) -> list[Page]:
    if not read.lines:
        return []
    both = fold("\n".join(read.lines) + "\n")
    ends = np.flatnonzero(both == NEWLINE)
    line_start = np.r_[0, ends[:-1] + 1] - np.arange(len(ends))
    total = len(both) - len(ends)
    symbols = both[both != NEWLINE]
    first = np.flatnonzero(np.r_[True, read.reading[1:] != read.reading[:-1]])
    out = []
    for k, a in enumerate(first):
        b = first[k + 1] if k + 1 < len(first) else len(read.lines)
        lo, hi = line_start[a], line_start[b] if b < len(read.lines) else total
        row = int(read.row[a])
        out.append(Page(row, symbols[lo:hi], line_start[a:b] - lo, read.lines[a:b], read.number[a:b], read.texts[row]))
    return out


def _cut(page: Page) -> Iterator[Page]:
    if len(page.symbols) <= SHARD:
        yield page
        return
    for at in range(0, len(page.symbols) - OVERLAP, SHARD - OVERLAP):
        inside = page.starts[(page.starts >= at) & (page.starts < at + SHARD)] - at
        yield replace(page, symbols=page.symbols[at : at + SHARD], starts=inside, at=at)


def shards(pages: Iterator[Page]) -> Iterator[Shard]:
    held: list[Page] = []
    size = 1

    def build() -> Shard:
        zero = np.zeros(1, np.uint8)
        parts: list[np.ndarray] = [zero]
        at, starts, stops, lines = 1, [], [], []
        for page in held:
            parts += [page.symbols, zero]
            starts.append(at)
            stops.append(at + len(page.symbols))
            lines.append(page.starts + at)
            lines.append(np.array([at + len(page.symbols)]))
            at += len(page.symbols) + 1
        return Shard(np.concatenate(parts), np.unique(np.concatenate(lines)), held, np.array(starts), np.array(stops))

    for page in pages:
        for piece in _cut(page):
            if held and size + len(piece.symbols) + 1 >= LIMIT - 2:
                yield build()
                held, size = [], 1
            held.append(piece)
            size += len(piece.symbols) + 1
    if held:
        yield build()


def find_hits(shard: Shard, passages: Passages, search: Search = USUAL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Located matches: page, passage, end in the passage stream, and end minus page position (the diagonal); with lengths."""
    index = FMIndex(shard.text, SYMBOLS)
    which, length, lo, hi = index.longest(passages.stream, passages.ends, search.seed, search.most, search.few, dropped=True)
    many = hi - lo
    rows = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    place = index.locate(rows)
    which, length = np.repeat(which, many), np.repeat(length, many)
    page = np.searchsorted(shard.start, place, side="right") - 1
    end = passages.ends[which]
    return page, passages.owner[which], end, length, place + length - end


@dataclass
class Pairs:
    """Pairs of page and passage to be compared, and their pieces, those of a pair one after the other.

    A piece is a stretch of the passage that agrees with the page on a diagonal: first, last + 1, diagonal.
    """

    page: np.ndarray
    item: np.ndarray
    first: np.ndarray
    last: np.ndarray
    diagonal: np.ndarray
    begin: np.ndarray
    stop: np.ndarray
    most_words: np.ndarray

    def pieces(self, n: int) -> list[tuple[int, int, int]]:
        a, b = self.begin[n], self.stop[n]
        return list(zip(self.first[a:b].tolist(), self.last[a:b].tolist(), self.diagonal[a:b].tolist()))


def candidates(page: np.ndarray, item: np.ndarray, end: np.ndarray, length: np.ndarray, diagonal: np.ndarray, gather: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of page and passage whose hits cover at least ``gather`` symbols of the passage: page, item; pair and diagonal of each hit."""
    if not len(page):
        return page, item, page, diagonal
    order = np.lexsort((end, item, page))
    page, item, end, length, diagonal = page[order], item[order], end[order], length[order], diagonal[order]
    new = np.r_[True, (page[1:] != page[:-1]) | (item[1:] != item[:-1])]
    before = np.r_[0, end[:-1]]
    fresh = np.where(new, length, end - np.maximum(end - length, before))
    at = np.flatnonzero(new)
    enough = np.add.reduceat(fresh, at) >= gather
    pair = np.cumsum(enough) - 1
    many = np.diff(np.r_[at, len(page)])
    kept = np.repeat(enough, many)
    return page[at[enough]], item[at[enough]], np.repeat(pair, many)[kept], diagonal[kept]


def _agreements(shard: Shard, passages: Passages, page: np.ndarray, item: np.ndarray, pair: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces on the given diagonals and two on either side of them: pair, first, last + 1, diagonal.

    An agreement is a run of at least 8 equal symbols; runs of one diagonal with no more than 2 unequal symbols between
    are one. Diagonals of many pairs are compared at once.
    """
    far = 1 << 27
    key = np.unique(((pair.astype(np.int64) << 28) + diagonal + far)[:, None] + np.arange(-2, 3)[None, :])
    pair, d = key >> 28, (key & ((1 << 28) - 1)) - far
    of = item[pair]
    a = np.maximum(passages.start[of], shard.start[page[pair]] - d)
    b = np.minimum(passages.stop[of], shard.stop[page[pair]] - d)
    rows = np.flatnonzero(b - a >= 8)
    rows = rows[np.argsort(of[rows], kind="stable")]
    sizes = passages.stop - passages.start
    pad = int(sizes.max(initial=0)) + 1
    text = np.concatenate([np.zeros(pad, np.uint8), shard.text, np.zeros(pad, np.uint8)])
    found: list[tuple[np.ndarray, ...]] = []
    lo = 0
    while lo < len(rows):
        i = of[rows[lo]]
        start, n = int(passages.start[i]), int(sizes[i])
        hi = min(int(np.searchsorted(of[rows], i, side="right")), lo + max(1, 4_000_000 // n))
        mine = rows[lo:hi]
        same = np.zeros((len(mine), n + 2), bool)
        windows = np.lib.stride_tricks.sliding_window_view(text, n)
        np.equal(windows[d[mine] + start + pad], passages.stream[start : start + n], out=same[:, 1:-1])
        over = np.flatnonzero((a[mine] > start) | (b[mine] < start + n))
        place = np.arange(start, start + n)
        same[over, 1:-1] &= (place >= a[mine][over, None]) & (place < b[mine][over, None])
        edge = np.flatnonzero(same[:, 1:] != same[:, :-1])
        first, last = edge[::2], edge[1::2]
        keep = last - first >= 8
        first, last = first[keep], last[keep]
        if len(first):
            row = first // (n + 1)
            opens = np.r_[True, (row[1:] != row[:-1]) | (first[1:] - last[:-1] > 2)]
            shuts = np.r_[opens[1:], True]
            row = row[opens]
            found.append((pair[mine[row]], first[opens] % (n + 1) + start, last[shuts] % (n + 1) + start, d[mine[row]]))
        lo = hi
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (none, none, none, none)


def compare(shard: Shard, passages: Passages, page: np.ndarray, item: np.ndarray, pair: np.ndarray, diagonal: np.ndarray, least: int) -> Pairs:
    """The pieces of all pairs that may be in a span of ``least`` words, and the most words in a row that each could hold.

    Joined pieces lie within 4 symbols of each other in the passage, so a span lies in one island of such pieces.
    """
    of, first, last, d = _agreements(shard, passages, page, item, pair, diagonal)
    order = np.lexsort((d, last, first, of))
    of, first, last, d = of[order], first[order], last[order], d[order]
    most = np.zeros(len(page), np.int64)
    if len(of):
        # Passages of different pairs are moved apart, so one running maximum serves all.
        apart = of * (int(passages.stop.max()) + 8)
        reach = np.maximum.accumulate(last + apart)
        new = np.r_[True, first[1:] + apart[1:] > reach[:-1] + 4]
        at = np.flatnonzero(new)
        whole = reach[np.r_[at[1:], len(of)] - 1] - apart[at]
        words = np.searchsorted(passages.all_stops, whole, side="right") - np.searchsorted(passages.all_starts, first[at], side="left")
        np.maximum.at(most, of[at], words)
        kept = np.repeat(words >= least, np.diff(np.r_[at, len(of)]))
        of, first, last, d = of[kept], first[kept], last[kept], d[kept]
    many = np.bincount(of, minlength=len(page))
    stop = np.cumsum(many)
    return Pairs(page, item, first, last, d, stop - many, stop, most)


def _joins(p: tuple[int, int, int], q: tuple[int, int, int], lines: list[int]) -> int | None:
    """How many symbols further down the page piece ``q`` goes on where ``p`` ends: None if it does not.

    It does after a few misread symbols, or after whole lines in between.
    """
    if q[0] < p[0] or q[1] <= p[1] or q[0] - p[1] > 4:
        return None
    shift = q[2] - p[2]
    if -3 <= shift <= 3:
        return shift
    # A cut in the passage at which the page's line ends under p and a line starts under q.
    lo, hi = min(q[0], p[1]) - 3, max(q[0], p[1]) + 3
    for k in range(bisect_left(lines, lo + p[2]), bisect_left(lines, hi + p[2] + 1)):
        if _is_line(lines, lines[k] + shift):
            return shift
    return None


def _is_line(lines: list[int], place: int) -> bool:
    k = bisect_left(lines, place)
    return k < len(lines) and lines[k] == place


@dataclass
class Span:
    """Joined pieces: from ``first`` to before ``last`` in the passage stream, and which pieces."""

    first: int
    last: int
    pieces: list[tuple[int, int, int]]


def spans(pieces: list[tuple[int, int, int]], lines: list[int], search: Search = USUAL) -> list[Span]:
    """For each piece the span that ends with it and starts furthest back: any piece before it may be joined to it.

    Of a far join, ``held`` counts the symbols since the join before.
    """
    first = [p[0] for p in pieces]
    held = [p[1] - p[0] for p in pieces]
    back = [-1] * len(pieces)
    stops = np.array([p[1] for p in pieces])
    for n, q in enumerate(pieces):
        # Of many pieces, only those that end where q may go on are looked at.
        before = range(n) if n < 16 else np.flatnonzero((stops[:n] >= q[0] - 4) & (stops[:n] < q[1])).tolist()
        for m in before:
            if first[m] < first[n] and (shift := _joins(pieces[m], q, lines)) is not None:
                close = -3 <= shift <= search.near
                if close or (shift > 0 and held[m] >= search.sure and q[1] - q[0] >= search.sure):
                    first[n], back[n] = first[m], m
                    held[n] = held[m] + q[1] - pieces[m][1] if close else q[1] - q[0]
    out = []
    for n, q in enumerate(pieces):
        chain, m = [], n
        while m >= 0:
            chain.append(pieces[m])
            m = back[m]
        out.append(Span(first[n], q[1], chain[::-1]))
    return out


def words_inside(passages: Passages, item: int, first: int, last: int) -> int:
    """Words of the passage that lie wholly between two positions."""
    a = bisect_left(passages.word_start[item], first)
    b = bisect_left(passages.word_stop[item], last + 1)
    return max(0, b - a)


def _words_kept(passages: Passages, item: int, first: int, last: int, pieces: list[tuple[int, int, int]], text: np.ndarray, lines: list[int]) -> int:
    """The most words in a row inside a span of which the page has most symbols, and of numbers all.

    A number counts only where one piece holds it with two symbols on either side, or with the start or end of a line
    there, so "13" is not found in "3".
    """
    equal = np.zeros(last - first, bool)
    for f, e, d in pieces:
        f, e = max(f, first), min(e, last)
        if e > f:
            equal[f - first : e - first] |= passages.stream[f:e] == text[f + d : e + d]

    def same_number(lo: int, hi: int) -> bool:
        for f, e, d in pieces:
            if f <= lo and hi <= e and (passages.stream[lo:hi] == text[lo + d : hi + d]).all():
                before = f <= lo - 2 or lo <= first or _is_line(lines, lo + d)
                after = hi + 2 <= e or hi >= last or _is_line(lines, hi + d)
                if before and after:
                    return True
        return False

    best = run = 0
    a, b = bisect_left(passages.word_start[item], first), bisect_left(passages.word_stop[item], last + 1)
    for w in range(a, b):
        lo, hi = passages.word_start[item][w], passages.word_stop[item][w]
        good = same_number(lo, hi) if passages.number[item][w] else 2 * int(equal[lo - first : hi - first].sum()) >= hi - lo
        run = run + 1 if good else 0
        best = max(best, run)
    return best


class NearDiagonals:
    """Diagonals on which passage and page share ``k`` symbols in a row."""

    def __init__(self, shard: Shard, passages: Passages, k: int) -> None:
        self.shard, self.passages, self.k = shard, passages, k
        self.text = self._runs(shard.text)
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _runs(self, x: np.ndarray) -> np.ndarray:
        """Each place's ``k`` symbols as one number."""
        n = max(0, len(x) - self.k + 1)
        out = np.zeros(n, np.int64)
        for i in range(self.k):
            out *= SYMBOLS
            out += x[i : i + n]
        return out

    def of(self, page: int, item: int) -> np.ndarray:
        start, stop = int(self.passages.start[item]), int(self.passages.stop[item])
        low, high = int(self.shard.start[page]), int(self.shard.stop[page])
        if stop - start < self.k or high - low < self.k:
            return np.zeros(0, np.int64)
        if item not in self.sorted:
            p = self._runs(self.passages.stream[start:stop])
            order = np.argsort(p, kind="stable")
            self.sorted[item] = p[order], order
        p, order = self.sorted[item]
        t = self.text[low : high - self.k + 1]
        a, b = np.searchsorted(p, t, side="left"), np.searchsorted(p, t, side="right")
        place = np.flatnonzero(b > a)
        many = (b - a)[place]
        which = order[np.repeat(a[place], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        return np.unique(np.repeat(place, many) + low - (which + start))


def _on_page(page: Page, pieces: list[tuple[int, int, int]], base: int) -> list[tuple[int, int]]:
    """Where the pieces of a span stand in the page's text as scanned: (start, stop) in characters, one for each line.

    ``base`` is where the page starts in its shard. What was misread between two pieces belongs to the span.
    """
    runs: list[list[int]] = []
    for n, (f, e, d) in enumerate(pieces):
        if n and abs(d - pieces[n - 1][2]) <= 3:
            runs[-1][1] = max(runs[-1][1], e + d)
        else:
            runs.append([f + d, e + d])
    stops = np.cumsum([len(fold(line)) for line in page.lines])
    lengths = [len(line) + 1 for line in page.text.split("\n")]
    head = np.cumsum(lengths) - lengths
    out = []
    for lo, hi in runs:
        lo, hi = lo - base + page.at, hi - base + page.at
        for i in range(int(np.searchsorted(stops, lo, side="right")), len(stops)):
            begin = int(stops[i - 1]) if i else 0
            if begin >= hi:
                break
            place = places(page.lines[i])[max(lo - begin, 0) : hi - begin]
            if len(place):
                at = int(head[page.number[i]])
                out.append((at + int(place[0]), at + int(place[-1]) + 1))
    return sorted(out)


def merged(found: list[tuple[int, int]], text: str) -> list[tuple[int, int]]:
    """Stretches of a text that overlap, or have no letter or digit between them, as one."""
    out: list[list[int]] = []
    for start, stop in sorted(found):
        if out and (start <= out[-1][1] or not any(c.isalnum() for c in text[out[-1][1] : start])):
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def leaks(shard: Shard, passages: Passages, least: int = LEAST_WORDS, search: Search = USUAL) -> Iterator[tuple[Page, int, int, list[tuple[int, int]]]]:
    """Page, passage, number of words in a row and merged spans of each pair with at least ``least`` words in a row.

    A first look joins the pieces on the diagonals of the hits. Where it finds a span of some words, a second one takes
    in every diagonal of the page on which some symbols agree, so a short rest beyond an advert is not lost.
    """
    page, item, pair, diagonal = candidates(*find_hits(shard, passages, search), search.gather)
    again: list[int] = []
    first_look = compare(shard, passages, page, item, pair, diagonal, min(least, search.first_look))
    for n in np.flatnonzero(first_look.most_words >= min(least, search.first_look)).tolist():
        found, best = _judge(shard, passages, first_look, n, least, search)
        if found:
            yield found
        elif search.first_look <= best < least:
            again.append(n)
    if not again:
        return
    chosen = np.array(again)
    begin, end = np.searchsorted(pair, chosen, side="left"), np.searchsorted(pair, chosen, side="right")
    near = NearDiagonals(shard, passages, search.rest)
    wide = [np.r_[diagonal[a:b], near.of(int(page[n]), int(item[n]))] for n, a, b in zip(again, begin, end)]
    of = np.repeat(np.arange(len(again)), [len(w) for w in wide])
    second_look = compare(shard, passages, page[chosen], item[chosen], of, np.concatenate(wide), least)
    for n in np.flatnonzero(second_look.most_words >= least).tolist():
        found, _ = _judge(shard, passages, second_look, n, least, search)
        if found:
            yield found


def _judge(shard: Shard, passages: Passages, pairs: Pairs, n: int, least: int, search: Search) -> tuple[tuple[Page, int, int, list[tuple[int, int]]] | None, int]:
    """What leaks says of one pair (None below ``least``), and the most words in a row that its spans hold."""
    at, item, pieces = int(pairs.page[n]), int(pairs.item[n]), pairs.pieces(n)
    page, low, high = shard.pages[at], int(shard.start[at]), int(shard.stop[at])
    lines = shard.lines[np.searchsorted(shard.lines, low) : np.searchsorted(shard.lines, high, side="right")].tolist()
    found = [(s, words_inside(passages, item, s.first, s.last)) for s in spans(pieces, lines, search)]
    best = max((w for _, w in found), default=0)
    if best < least:
        return None, best
    good = [(s, _words_kept(passages, item, s.first, s.last, pieces, shard.text, lines)) for s, w in found if w >= least]
    kept = max(k for _, k in good)
    if kept < least:
        return None, least
    stands = [x for s, k in good if k >= least for x in _on_page(page, s.pieces, low)]
    return (page, item, kept, merged(stands, page.text)), best


def leaked_items(pages: DataFrame, key: str, text: str, boxes: str, items: DataFrame, item_key: str, passage: str, least: int = LEAST_WORDS, search: Search = USUAL) -> DataFrame:
    """One row for each page and item with at least ``least`` consecutive words: ``key``, ``item_key``, ``n_words``, ``spans``.

    ``spans`` are the stretches of the page's text, as characters from ``start`` to before ``stop``, that hold them.
    ``items`` is the evaluation set, small whatever the corpus (hundreds to thousands of passages); it is broadcast, and
    a ValueError is raised where it has more than MOST_SYMBOLS characters.
    """
    size = items.agg(F.sum(F.length(passage))).first()[0] or 0
    if size > MOST_SYMBOLS:
        raise ValueError(f"{size} characters of passages are too many to broadcast; search for them in parts")
    rows = [(r[0], r[1]) for r in items.select(item_key, passage).collect()]
    shared = pages.sparkSession.sparkContext.broadcast(fold_passages(rows, search))
    span = T.ArrayType(T.StructType().add("start", "long").add("stop", "long"))
    schema = pages.select(key).schema.add(item_key, items.schema[item_key].dataType).add("n_words", "long").add("spans", span)
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = shared.value
        if not len(passages.ids):
            return
        keys: list[object] = []

        def folded() -> Iterator[Page]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1_000):
                    batch = whole.slice(at, 1_000)
                    base = len(keys)
                    keys.extend(batch.column(0).to_pylist())
                    for page in fold_pages(read_pages(batch, text, boxes, both=True)):
                        page.row += base
                        yield page

        for shard in shards(folded()):
            found = list(leaks(shard, passages, least, search))
            if found:
                columns = [[keys[f[0].row] for f in found], [passages.ids[f[1]] for f in found], [f[2] for f in found], [[{"start": a, "stop": b} for a, b in f[3]] for f in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

    found = pages.select(key, text, boxes).where(F.col(text).isNotNull()).mapInArrow(run, schema)
    return found.groupBy(key, item_key).agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def removal_spans(found: DataFrame, key: str) -> DataFrame:
    """The stretches to take out of each page, those of all items merged: ``key``, ``start``, ``stop`` (characters)."""
    each = found.select(key, F.explode("spans").alias("__s")).select(key, "__s.*")
    order = Window.partitionBy(key).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = each.withColumn("__new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    numbered = opened.withColumn("__n", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "__n").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select(key, "start", "stop")
