"""Held-out passages in a corpus, by greedy string tiling.

The passages are few and known, the corpus is large: the passages become an index of short word patterns (three words in a row, or three of four), which
every task holds; pages stream through it without a shuffle. Shared patterns are seeds (found by rolling hashes of word ids over whole batches);
seeds on one diagonal of a page line and a passage make a tile; tiles at line ends are linked to tiles at line starts that go on in the passage, and pairs of
page and passage whose linked tiles may hold a leak are tiled: tiles are extended word by word, over misread letters and, at line ends, over hyphens
and over lines of other columns or adverts; the longest tile is marked, then the longest of what is left unmarked, and so on down to a least length.
A page leaks a passage if one tile covers enough consecutive words, or if all tiles together cover enough of the passage, in whatever order.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.session import spread

#: Consecutive passage words that make a leak, and the share of them that may be misread.
MIN_WORDS, MISREAD = 15, 0.25
#: Least words of a tile that counts as covered, and the share of a passage that such tiles must cover to make a leak in any order.
MIN_TILE, MIN_COVERAGE = 8, 0.5
#: Words in seeds that linked tiles must hold for a leak of MIN_WORDS (the rest may be misread, cut by line ends or beside a misread word), a tile by itself one more,
#: and words between a tile and the line's end or start over which it is linked.
SEED_WORDS, EDGE = 6, 3
#: Passages of one index; larger sets are searched in several passes of this many, so that no task holds more.
INDEX_ITEMS = 5_000
_PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_EDGES = ".,;:!?\"'()[]{}*-¬=_«»„“”‚‘’|<>/\\^`+"
_GAP = re.compile(r" \| |\s{3,}")
_LINE, _NONE = -2, -1
_CACHE = 400_000
#: Words that are searched for seeds at once, which bounds memory; longer pages are cut at lines, longer lines at words, with overlaps that no tile or link exceeds.
BATCH_WORDS, PIECE_WORDS, PIECE_OVERLAP = 30_000, 4_000, 64


def clean(token: str) -> str:
    return token.strip(_EDGES).lower()


def words_of(text: str) -> list[str]:
    return [w for w in map(clean, text.split()) if w]


def lines_of(text: str) -> list[str]:
    """Lines of a page; a line that holds several columns gives one each."""
    if " | " in text or "   " in text:
        return [p for line in text.split("\n") for p in _GAP.split(line)]
    return text.split("\n")


@dataclass
class Index:
    """Word ids and pattern occurrences of all passages."""

    ids: list[int]
    passages: list[list[str]]
    vocabulary: dict[str, int]
    keys: list[np.ndarray] = field(default_factory=list)  # per pattern: sorted distinct keys
    first: list[np.ndarray] = field(default_factory=list)  # per pattern: first occurrence of each key, and one end
    items: list[np.ndarray] = field(default_factory=list)
    places: list[np.ndarray] = field(default_factory=list)
    filters: list[np.ndarray] = field(default_factory=list)
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # word ids of all passages
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of each passage, and one end

    @staticmethod
    def build(rows: Sequence[tuple[int, str | None]]) -> Index:
        passages = [words_of(t or "") for _, t in rows]
        vocabulary: dict[str, int] = {}
        for p in passages:
            for w in p:
                vocabulary.setdefault(w, len(vocabulary))
        out = Index([i for i, _ in rows], passages, vocabulary)
        out.words = np.array([vocabulary[w] for p in passages for w in p], np.int64)
        out.starts = np.concatenate(([0], np.cumsum([len(p) for p in passages]))).astype(np.int64)
        size = max(1, len(vocabulary))
        for pattern in _PATTERNS:
            keys, items, places = [], [], []
            for i, p in enumerate(passages):
                w = np.array([vocabulary[x] for x in p], np.int64)
                n = len(w) - pattern[2]
                if n > 0:
                    keys.append(_roll(w, pattern, size)[:n])
                    items.append(np.full(n, i, np.int64))
                    places.append(np.arange(n))
            k = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            order = np.argsort(k, kind="stable")
            distinct, first = np.unique(k[order], return_index=True)
            bits = np.zeros(1 << 20, bool)
            bits[_slot(distinct)] = True
            out.keys.append(distinct)
            out.first.append(np.append(first, len(k)))
            out.items.append(np.concatenate(items)[order] if items else k)
            out.places.append(np.concatenate(places)[order] if places else k)
            out.filters.append(bits)
        return out


def _roll(w: np.ndarray, pattern: tuple[int, int, int], size: int) -> np.ndarray:
    n = len(w) - pattern[2]
    a, b, c = (w[o : o + n] for o in pattern)
    return (a * size + b) * size + c


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


class _Clean(dict):
    """Raw token to word, remembered."""

    def __missing__(self, token: str) -> str:
        if len(self) > _CACHE:
            self.clear()
        found = self[token] = clean(token)
        return found


class _Ids(dict):
    """Raw token to word id, remembered."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary, self.words = vocabulary, _Clean()

    def __missing__(self, token: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        found = self[token] = self.vocabulary.get(self.words[token], _NONE)
        return found


Piece = tuple[int, int, int, int, list[str]]  # page, line, words of the line before it, words of the line, words


def pieces(pages: list[list[list[str]]]) -> Iterator[list[Piece]]:
    """The lines of all pages in batches of about BATCH_WORDS words. A page may go on in the next batch; its tiles are linked when all are there."""
    batch: list[Piece] = []
    size = 0
    for p, lines in enumerate(pages):
        for k, tokens in enumerate(lines):
            for a in range(0, max(1, len(tokens) - PIECE_OVERLAP), PIECE_WORDS - PIECE_OVERLAP):
                part = tokens if len(tokens) <= PIECE_WORDS else tokens[a : a + PIECE_WORDS]
                if size and size + len(part) > BATCH_WORDS:
                    yield batch
                    batch, size = [], 0
                batch.append((p, k, a, len(tokens), part))
                size += len(part)
                if part is tokens:
                    break
    if batch:
        yield batch


@dataclass
class Tiles:
    """Tiles of a page line and a passage: words ``word``.. of line ``line`` are the passage's from ``place`` on, ``length`` of them."""

    page: np.ndarray
    item: np.ndarray
    line: np.ndarray
    word: np.ndarray
    place: np.ndarray
    length: np.ndarray
    after: np.ndarray  # words of the line behind it
    opens: np.ndarray  # whether the words before it in the line may be the passage's, misread; likewise those behind it
    ends: np.ndarray

    def where(self, rows: np.ndarray) -> Tiles:
        return Tiles(*[x[rows] for x in vars(self).values()])

    @staticmethod
    def together(parts: list[Tiles]) -> Tiles:
        return Tiles(*[np.concatenate(x) for x in zip(*[vars(t).values() for t in parts], strict=True)])


def tiles_of(index: Index, batch: list[Piece], ids: _Ids) -> Tiles | None:
    """All tiles of a batch, if any."""
    flat: list[int] = []
    starts: list[int] = []  # of lines
    page_of_line: list[int] = []
    line_in_page: list[int] = []
    word_in_line: list[int] = []
    words_of_line: list[int] = []
    for p, k, a, n, tokens in batch:
        if len(tokens) > 2:
            starts.append(len(flat))
            page_of_line.append(p)
            line_in_page.append(k)
            word_in_line.append(a)
            words_of_line.append(n)
            flat += [ids[t] for t in tokens]
            flat.append(_LINE)
    w = np.array([*flat, _LINE, _LINE, _LINE], np.int64)
    at, item, place, span = [], [], [], []
    size = max(1, len(index.vocabulary))
    ok = w >= 0
    for j, pattern in enumerate(_PATTERNS):
        n = len(w) - pattern[2]
        good = ok[:n].copy()
        for o in pattern[1:]:
            good &= ok[o : o + n]
        for o in set(range(pattern[2])).difference(pattern):
            good &= w[o : o + n] == _NONE  # a misread word; a word of the passages there is another word
        g = np.flatnonzero(good)
        if not len(g) or not len(index.keys[j]):
            continue
        k = _roll(w, pattern, size)[g]
        passed = index.filters[j][_slot(k)]
        g, k = g[passed], k[passed]
        spot = np.minimum(np.searchsorted(index.keys[j], k), len(index.keys[j]) - 1)
        hit = index.keys[j][spot] == k
        g, spot = g[hit], spot[hit]
        count = index.first[j][spot + 1] - index.first[j][spot]
        occurrence = np.repeat(index.first[j][spot] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        at.append(np.repeat(g, count))
        item.append(index.items[j][occurrence])
        place.append(index.places[j][occurrence])
        span.append(np.full(len(occurrence), pattern[2] + 1))
    if not at or not sum(map(len, at)):
        return None
    at, item, place, span = (np.concatenate(x) for x in (at, item, place, span))
    begin = np.array(starts)
    line = np.searchsorted(begin, at, "right") - 1
    page = np.array(page_of_line)[line]
    # a tile: seeds of one (page, item, line, diagonal)
    begin_at = begin[line]
    diagonal = place - (at - begin_at)
    order = np.lexsort((place, diagonal, item, line))
    line, item, diagonal, place, span, at = line[order], item[order], diagonal[order], place[order], span[order], at[order]
    new = (line[1:] != line[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1])
    head = np.flatnonzero(np.concatenate(([True], new)))
    length = np.maximum.reduceat(place + span, head) - place[head]
    line, item, at, place = line[head], item[head], at[head], place[head]
    word = at - begin[line] + np.array(word_in_line)[line]
    after = np.array(words_of_line)[line] - word - length
    opens = _fits(w, at, -1, word, index, item, place)
    ends = _fits(w, at + length - 1, 1, after, index, item, place + length - 1)
    return Tiles(np.array(page_of_line)[line], item, np.array(line_in_page)[line], word, place, length, after, opens, ends)


def _fits(w: np.ndarray, at: np.ndarray, step: int, room: np.ndarray, index: Index, item: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether at most EDGE words are between a tile and the edge of its line, and all but the last, which may be a part of a word, are the passage's or may be misread."""
    good = room <= EDGE
    for k in range(1, EDGE):
        rows = np.flatnonzero(good & (room > k))
        word, spot = w[at[rows] + step * k], index.starts[item[rows]] + place[rows] + step * k
        inside = (spot >= index.starts[item[rows]]) & (spot < index.starts[item[rows] + 1])
        same = word == index.words[np.clip(spot, 0, max(len(index.words) - 1, 0))]
        good[rows] = (word == _NONE) | (same & inside)
    return good


def chains(pair: np.ndarray, tiles: Tiles, size: int) -> np.ndarray:
    """Words in seeds of the longest chain that each tile is in. A tile near the end of its line goes on in a tile near the start of any line of the page
    (columns may be scanned in any order) if the words between them, misread or cut by a hyphen, are as many as the passage has there, give or take one."""
    opens, ends = np.flatnonzero(tiles.opens), np.flatnonzero(tiles.ends)
    starts = pair * size + tiles.place - tiles.word
    keys, of_start = np.unique(starts[opens], return_inverse=True)
    stops = pair * size + tiles.place + tiles.length + tiles.after
    src, dst = [], []
    for o in (-1, 0, 1) if len(keys) else ():
        wanted = stops[ends] + o
        spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[spot] == wanted
        src.append(ends[hit])
        dst.append(spot[hit])
    if not src or not sum(map(len, src)):
        return tiles.length
    src, dst = np.concatenate(src), np.concatenate(dst)
    by_dst, by_src = np.argsort(dst, kind="stable"), np.argsort(src, kind="stable")
    to, to_head = np.unique(dst[by_dst], return_index=True)
    come, come_head = np.unique(src[by_src], return_index=True)
    before, behind = tiles.length.copy(), tiles.length.copy()
    for _ in range(size):  # places rise along a chain, so it ends
        best = np.zeros(len(keys), np.int64)
        best[to] = np.maximum.reduceat(before[src[by_dst]], to_head)
        longer = tiles.length[opens] + best[of_start]
        rest = np.zeros(len(keys), np.int64)
        np.maximum.at(rest, of_start, behind[opens])
        on = tiles.length[come] + np.maximum.reduceat(rest[dst[by_src]], come_head)
        if (before[opens] == longer).all() and (behind[come] == on).all():
            break
        before[opens], behind[come] = longer, on
    return before + behind - tiles.length


Seed = tuple[int, int, int, bool]  # line, word in line, word in passage, whether to grow it in any case


def candidates(index: Index, tiles: Tiles) -> dict[tuple[int, int], list[Seed]]:
    """Seeds, longest chains first, of every (page, item) that may hold a leak, from all tiles of the pages: those with a chain of SEED_WORDS, or whose chains may
    cover the share MIN_COVERAGE of the passage. Other seeds of such a pair are to be grown only if there is a leak."""
    lengths = np.array([len(p) for p in index.passages], np.int64)
    size = int(lengths.max(initial=0)) + 2 * EDGE + 4
    size += int(tiles.word[tiles.word <= EDGE].max(initial=0))
    pair = tiles.page * len(index.ids) + tiles.item
    chain = chains(pair, tiles, size)
    kept = np.flatnonzero(chain >= MIN_TILE - EDGE)
    t, pair, chain = tiles.where(kept), pair[kept], chain[kept]
    if not len(kept):
        return {}
    cell = np.repeat(pair * size + t.place - np.concatenate(([0], np.cumsum(t.length)[:-1])), t.length) + np.arange(t.length.sum())
    pairs, covered = np.unique(np.unique(cell) // size, return_counts=True)
    enough = covered >= MIN_COVERAGE * (1 - MISREAD / 2) * lengths[pairs % len(index.ids)]
    long = np.zeros(len(pairs), bool)
    of = np.searchsorted(pairs, pair)
    # a tile with other words on both sides cannot grow over its line, so it must hold the exact words of a leak by itself, but for one at either end
    able = (chain > SEED_WORDS) & (t.opens | t.ends | (t.length >= MIN_WORDS * (1 - MISREAD) - 2))
    able |= (chain == SEED_WORDS) & (chain > t.length)  # the least number is enough for linked tiles only
    long[of[able]] = True
    rows = np.flatnonzero((long | enough)[of])
    rows = rows[np.lexsort((t.word[rows], t.line[rows], -chain[rows], pair[rows]))]
    first = able | enough[of]
    out: dict[tuple[int, int], list[Seed]] = {}
    for p, i, *seed in zip(*[c[rows].tolist() for c in (t.page, t.item, t.line, t.word, t.place, first)], strict=True):
        out.setdefault((p, i), []).append(tuple(seed))
    return out


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance, or most+1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0], low = row[0], i, i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
            low = min(low, row[j])
        if low > most:
            return most + 1
    return row[-1]


def _most(n: int) -> int:
    """Edits in a misread word of n letters."""
    return 1 if n <= 4 else 2 if n <= 7 else 3


class Matcher:
    """Whether a page word is a passage word: 1 exactly, 2 with misread letters, 0 not. Words of the passages that differ are other words."""

    def __init__(self, index: Index) -> None:
        self.vocabulary, self.known, self.letters = index.vocabulary, {}, {}

    def mask(self, word: str) -> int:
        """The letters of a word as bits: every edit changes two at most."""
        got = self.letters.get(word)
        if got is None:
            if len(self.letters) > _CACHE:
                self.letters.clear()
            got = 0
            for c in word:
                got |= 1 << (ord(c) % 61)
            self.letters[word] = got
        return got

    def __call__(self, word: str, wanted: str) -> int:
        if word == wanted:
            return 1
        if not word or word in self.vocabulary:
            return 0
        n = len(wanted)
        most = _most(n)
        if not -most <= len(word) - n <= most or (self.mask(word) ^ self.mask(wanted)).bit_count() > 2 * most:
            return 0
        got = self.known.get((word, wanted))
        if got is None:
            if len(self.known) > _CACHE:
                self.known.clear()
            got = self.known[word, wanted] = 2 if _distance(word, wanted, most) <= min(most, n - 1 if n > 1 else 1) else 0
        return got


Spelling = tuple[str, int, int, list[int]]  # text, letters, which letters as bits, lines


class Page:
    """The cleaned lines of a page, and how they open and close: by which words, and of these by which that are in no passage, so that they may be misread ones."""

    def __init__(self, lines: list[list[str]], ids: _Ids, match: Matcher) -> None:
        vocabulary, self.match = ids.vocabulary, match
        self.lines = [list(filter(None, map(ids.words.__getitem__, line))) for line in lines]
        self.heads: dict[str, list[int]] = defaultdict(list)
        self.tails: dict[str, list[int]] = defaultdict(list)
        joined: dict[str, list[int]] = defaultdict(list)
        for k, ws in enumerate(self.lines):
            if ws:
                self.heads[ws[0]].append(k)
                self.tails[ws[-1]].append(k)
                if len(ws) > 1 and ws[1] not in vocabulary:
                    joined[ws[0] + ws[1]].append(k)
        self.all_heads, self.all_tails, self.joined = map(self._spellings, (self.heads, self.tails, joined))
        self.odd_heads, self.odd_tails = ([s for s in some if s[0] not in vocabulary] for some in (self.all_heads, self.all_tails))
        self.known: dict[tuple[int, str], list[int]] = {}

    def _spellings(self, words: dict[str, list[int]]) -> list[Spelling]:
        return [(w, len(w), self.match.mask(w), ns) for w, ns in words.items()]

    def like(self, some: list[Spelling], wanted: str, before: str = "", behind: str = "") -> list[int]:
        """Lines of the spellings that match the wanted word, with a part of it put before or behind them. A spelling that is too short or long or has too many
        other letters is passed over at once."""
        size, most, letters = len(wanted) - len(before) - len(behind), _most(len(wanted)), self.match.mask(wanted)
        part = self.match.mask(before + behind) if before or behind else 0
        out: list[int] = []
        for text, n, mask, lines in some:
            if -most <= n - size <= most and ((mask | part) ^ letters).bit_count() <= 2 * most and self.match(before + text + behind, wanted):
                out += lines
        return out

    def opening(self, wanted: str) -> list[int]:
        """Lines that open with a word, misread or in two parts; remembered for all passages."""
        got = self.known.get((0, wanted))
        if got is None:
            got = self.known[0, wanted] = [*self.heads.get(wanted, ()), *self.like(self.odd_heads, wanted), *self.like(self.joined, wanted)]
        return got

    def opening_with_both(self, words: str) -> list[int]:
        """Lines that open with two words run together."""
        got = self.known.get((1, words))
        if got is None:
            got = self.known[1, words] = self.like([s for s in self.odd_heads if s[1] > 3], words)
        return got

    def closing(self, wanted: str) -> list[int]:
        got = self.known.get((2, wanted))
        if got is None:
            got = self.known[2, wanted] = [*self.tails.get(wanted, ()), *self.like(self.odd_tails, wanted)]
        return got


State = tuple[int, str | None]  # next word of the passage, and the part of it that the line before holds
Covered = dict[int, tuple[int, int, int]]  # word of the passage: how it matches, line, word in line


@dataclass
class Run:
    """Words of one line that go on in the passage, the state after them if the line is at its end, and the best rest of the way with its sums."""

    line: int
    words: Covered
    state: State | None
    rest: Run | None = None
    exact: int = 0
    misread: int = 0

    def value(self) -> tuple[float, int, int]:
        return self.exact + min(self.misread, self.exact * MISREAD / (1 - MISREAD)), -self.misread, -self.line


class Way:
    """The best way on in the passage from the end of a line over any lines of the page (or back from its start), the best a state. Columns may be scanned in
    any order, so a line may go on in an earlier one; the passage's words are in order, so no line is used twice for the same words."""

    def __init__(self, page: Page, passage: list[str], match: Matcher, forward: bool) -> None:
        self.page, self.passage, self.match, self.forward = page, passage, match, forward
        self.runs: dict[State, list[Run]] = {}
        self.best: dict[State, Run | None] = {}

    def step(self, ws: Sequence[str], i: int, j: int) -> tuple[int, int, int]:
        """Words of the page and of the passage that match at (i, j), and how."""
        match, passage = self.match, self.passage
        m = match(ws[i], passage[j])
        if m:
            return 1, 1, m
        if j + 1 < len(passage) and len(ws[i]) > 3 and match(ws[i], passage[j] + passage[j + 1]):
            return 1, 2, 2
        if i + 1 < len(ws) and ws[i + 1] not in match.vocabulary and match(ws[i] + ws[i + 1], passage[j]):
            return 2, 1, 2
        return 0, 0, 0

    def run_on(self, line: int, i: int, j: int, words: Covered) -> tuple[int, int]:
        ws = self.page.lines[line]
        while i < len(ws) and j < len(self.passage):
            a, b, m = self.step(ws, i, j)
            if not a:
                break
            for x in range(j, j + b):
                words[x] = m, line, i
            i, j = i + a, j + b
        return i, j

    def run_back(self, line: int, i: int, j: int, words: Covered) -> tuple[int, int]:
        ws = self.page.lines[line]
        while i >= 0 and j >= 0:
            m = self.match(ws[i], self.passage[j])
            if not m:
                break
            words[j] = m, line, i
            i, j = i - 1, j - 1
        return i, j

    def after(self, line: int, i: int, j: int) -> State | None:
        """The state behind (before) the words of a line, if it is at its end (start): its last (first) word may be a part of the next one."""
        if not 0 <= j < len(self.passage):
            return None
        ws = self.page.lines[line]
        edge = len(ws) - 1 if self.forward else 0
        if i == edge and (not self.forward or len(ws[i]) < len(self.passage[j])):
            return j, ws[i]
        return None if 0 <= i < len(ws) else (j, None)

    def lines(self, state: State) -> list[int]:
        j, cut = state
        wanted, page = self.passage[j], self.page
        if cut is None:
            if not self.forward:
                return sorted(page.closing(wanted))
            found = page.opening(wanted)
            if j + 1 < len(self.passage):
                found = found + page.opening_with_both(wanted + self.passage[j + 1])
            return sorted(set(found))
        # a part of a word must be like the passage's word there
        part = wanted[: len(cut)] if self.forward else wanted[-len(cut) :]
        most = _most(len(cut))
        if cut != part and ((self.match.mask(cut) ^ self.match.mask(part)).bit_count() > 2 * most or _distance(cut, part, most) > most):
            return []
        if self.forward:
            return sorted(page.like(page.all_heads, wanted, before=cut))
        return sorted(page.like([s for s in page.all_tails if s[1] < len(wanted)], wanted, behind=cut))

    def runs_of(self, state: State) -> list[Run]:
        j, cut = state
        out = []
        for n in self.lines(state):
            ws, words = self.page.lines[n], {}
            if self.forward:
                if cut is not None:
                    words[j] = self.match(cut + ws[0], self.passage[j]), n, 0
                i, y = self.run_on(n, cut is not None, j + (cut is not None), words)
            else:
                if cut is not None:
                    words[j] = self.match(ws[-1] + cut, self.passage[j]), n, len(ws) - 1
                i, y = self.run_back(n, len(ws) - 1 - (cut is not None), j - (cut is not None), words)
            out.append(Run(n, words, self.after(n, i, y)))
        return out

    def on(self, state: State | None) -> Run | None:
        """The best run of a line after (before) the state, with its rest. Of equal ones the first line's."""
        if state is None:
            return None
        todo = [state]
        while todo:
            s = todo[-1]
            if s not in self.runs:
                self.runs[s] = self.runs_of(s)
            need = {r.state for r in self.runs[s] if r.state is not None and r.state not in self.best} if s not in self.best else ()
            if need:
                todo += need
                continue
            todo.pop()
            if s not in self.best:
                for r in self.runs[s]:
                    r.rest = self.best[r.state] if r.state is not None else None
                    r.misread = sum(m == 2 for m, _, _ in r.words.values()) + (r.rest.misread if r.rest else 0)
                    r.exact = sum(m == 1 for m, _, _ in r.words.values()) + (r.rest.exact if r.rest else 0)
                self.best[s] = max(self.runs[s], key=Run.value, default=None)
        return self.best[state]


def grown(page: Page, passage: list[str], on: Way, back: Way, line: int, word: int, place: int) -> Covered:
    """The passage words around a seed that the page holds one after the other; empty if the seed's place holds no word."""
    ws = page.lines[line]
    word = min(word, len(ws) - 1)
    if word < 0 or ws[word] != passage[place]:  # tokens without letters shift the place in the line
        near = [i for i in range(len(ws)) if ws[i] == passage[place]]
        if not near:
            return {}
        word = min(near, key=lambda i: abs(i - word))
    words: Covered = {}
    i, j = on.run_on(line, word, place, words)
    x, y = back.run_back(line, word - 1, place - 1, words)
    for way, state in ((on, on.after(line, i, j)), (back, back.after(line, x, y))):
        r = way.on(state)
        while r is not None:
            words.update(r.words)
            r = r.rest
    return words


def tile(page: Page, passage: list[str], seeds: list[Seed], match: Matcher) -> tuple[int, int]:
    """The most consecutive passage words of a tile, of which at most MISREAD are misread, and the passage words that tiles of MIN_TILE or more words cover,
    the longest marked first, none using a word of the page or of the passage twice."""
    on, back = Way(page, passage, match, True), Way(page, passage, match, False)
    done: set[tuple[int, int, int]] = set()
    queue: list[tuple[int, int, list[tuple[int, int, int, int]]]] = []

    def push(words: list[tuple[int, int, int, int]]) -> None:
        """Adds the longest clear stretch of consecutive words."""
        a, b = _clear([m == 2 for _, m, _, _ in words])
        if b > a:
            heapq.heappush(queue, (a - b, words[a][0], words[a:b]))

    for line, word, place, first in seeds:
        if (line, word, place) in done:
            continue
        if not first and (not queue or -queue[0][0] < MIN_WORDS):
            break
        words = grown(page, passage, on, back, line, word, place)
        done.add((line, word, place))
        done.update((k, i, x) for x, (_, k, i) in words.items())
        for stretch in _stretches([(x, *words[x]) for x in sorted(words)]):
            push(stretch)
    longest = -queue[0][0] if queue else 0
    on_page: set[tuple[int, int]] = set()
    on_passage: set[int] = set()
    while queue and -queue[0][0] >= MIN_TILE:
        words = heapq.heappop(queue)[2]
        free = [w for w in words if w[0] not in on_passage and w[2:] not in on_page]
        if len(free) == len(words):
            on_passage.update(w[0] for w in words)
            on_page.update(w[2:] for w in words)
        else:
            for stretch in _stretches(free):
                push(stretch)
    return longest, len(on_passage)


def _stretches(words: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int, int, int]]]:
    """Cut where the passage's words are not consecutive."""
    out: list[list[tuple[int, int, int, int]]] = []
    for w in words:
        if out and out[-1][-1][0] == w[0] - 1:
            out[-1].append(w)
        else:
            out.append([w])
    return out


def _clear(misread: list[bool]) -> tuple[int, int]:
    """The first of the longest stretches with at most MISREAD of its words misread, from, to."""
    n, bad = len(misread), sum(misread)
    if bad <= MISREAD * n:
        return 0, n
    upto = np.concatenate(([0], np.cumsum(misread)))
    for size in range(n - 1, 0, -1):
        good = np.flatnonzero(upto[size:] - upto[:-size] <= MISREAD * size)
        if len(good):
            return int(good[0]), int(good[0]) + size
    return 0, 0


def leaks(run: int, covered: int, length: int) -> bool:
    return run >= MIN_WORDS or (length >= MIN_WORDS and covered >= max(MIN_WORDS, MIN_COVERAGE * length))


def token_lines(text: str) -> list[list[str]]:
    """Raw tokens of each line. Consecutive lines too short for a pattern are taken as one line, so that one word a line is searched as well."""
    out: list[list[str]] = []
    short = False
    for line in lines_of(text):
        tokens = line.split()
        if not tokens:
            continue
        if len(tokens) < len(_PATTERNS[0]):
            if short:
                out[-1] += tokens
                continue
            short = True
        else:
            short = False
        out.append(tokens)
    return out


def tilings(index: Index, texts: list[str | None], ids: _Ids, match: Matcher) -> list[tuple[int, int, int, int]]:
    """(text number, item number, most consecutive words, words covered by all tiles) of every leak."""
    pages = [token_lines(t) if t else [] for t in texts]
    out: list[tuple[int, int, int, int]] = []

    def grow(tiles: Tiles) -> None:
        last: tuple[int, Page] | None = None
        for (p, i), seeds in candidates(index, tiles).items():
            if last is None or last[0] != p:
                last = p, Page(pages[p], ids, match)
            run, covered = tile(last[1], index.passages[i], seeds, match)
            if leaks(run, covered, len(index.passages[i])):
                out.append((p, i, run, covered))

    rest: list[Tiles] = []  # of pages that may go on in the next batch
    for batch in pieces(pages):
        found = tiles_of(index, batch, ids)
        if found is not None:
            rest.append(found)
        if rest and rest[0].page.min() < batch[-1][0]:
            tiles = Tiles.together(rest)
            grow(tiles.where(tiles.page < batch[-1][0]))
            left = tiles.where(tiles.page == batch[-1][0])
            rest = [left] if len(left.page) else []
    if rest:
        grow(Tiles.together(rest))
    return out


def leaked(pages: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, passage: Column) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered) of every page that holds at least MIN_WORDS consecutive words of a passage, or at least MIN_COVERAGE of all its words in
    tiles of MIN_TILE or more: the most consecutive words, and the words of the passage that all tiles cover, in any order.

    Case, punctuation and hyphenation do not matter; lines of other columns or adverts may come between, and a line may go on in any other line of the
    page, as columns may be scanned out of order. Null or empty texts and passages shorter than MIN_WORDS leak nothing; a page that is listed twice is
    reported twice. Narrow: no shuffle; texts are read whole, a batch at a time.
    """
    rows = [(r[0], r[1]) for r in items.select(item_id.alias("i"), passage.cast("string").alias("p")).orderBy("i").toLocalIterator()]
    source = spread(pages.select(doc_id.alias("doc_id"), text.cast("string").alias("_text")))
    kind = source.schema["doc_id"].dataType.simpleString()
    kind_i = items.select(item_id.alias("i")).schema["i"].dataType.simpleString()
    found = None
    for a in range(0, max(1, len(rows)), INDEX_ITEMS):
        index = Index.build(rows[a : a + INDEX_ITEMS])

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            ids, match = _Ids(index.vocabulary), Matcher(index)
            for batch in batches:
                docs = batch.column("doc_id")
                for b in range(0, batch.num_rows, 2000):
                    hits = tilings(index, batch.column("_text").slice(b, 2000).to_pylist(), ids, match)
                    if hits:
                        at = pa.array([b + p for p, _, _, _ in hits], pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [docs.take(at), pa.array([index.ids[i] for _, i, _, _ in hits], pa.int64()), *[pa.array([h[k] for h in hits], pa.int32()) for k in (2, 3)]],
                            names=["doc_id", "item_id", "n_words", "n_covered"],
                        )

        part = source.mapInArrow(run, f"doc_id {kind}, item_id bigint, n_words int, n_covered int").withColumn("item_id", F.col("item_id").cast(kind_i))
        found = part if found is None else found.unionByName(part)
    return found
