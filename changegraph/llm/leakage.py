"""Held-out test items that turn up in training text: a generalised suffix automaton over the items' words.

Items and documents are brought to the same words (markup, entities, letter look-alikes, case, accents and layout don't count;
in scripts written without blanks every character is a word). The automaton of all items reads a document word by word and
always knows the longest run of words that ends here and stands in some item; the states linked to its state name all items
that the last RUN words stand in. Each run of at least RUN words of a document and an item that can't be continued is a piece
of evidence, whatever other items hold. Evidence for one item is gathered on its diagonal (place in the document less place in
the item), and where it covers enough of the item, the item's words are aligned with the words around, now with tolerance for
misspelt and exchanged words. A document is reported with an item if at least the share COVERAGE of the item's words stands
there in order, or LONG words of it stand there letter by letter, once for each place: all windows of diagonals with enough
evidence are aligned, those with most first.

The items are data the caller states to be bounded, and MOST_WORDS is checked; beyond BLOCK_WORDS words they are read in
blocks, each an automaton of its own over all documents, so no broadcast grows with them.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from heapq import heapify, heappop, heappush
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 3  # words in a piece of evidence
EVIDENCE = 0.12  # share of an item's words that evidence must cover before the alignment
COVERAGE = 0.5
SLACK = 0.35  # of an item's length: how far words may be moved, and the text be longer than the item
LONG = 50  # words letter by letter that give an item away, however long it is
BLOCK_WORDS = 300_000
MOST_WORDS = 30_000_000

#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухівкмнтѕјԁһԛԝαεοριυνκτβ", "aeopcyxibkmhtsjdhqwaeopiuvktb")
_TAG = re.compile(r"</?[a-z][^<>\n]{0,80}>", re.I)
_INVISIBLE = re.compile("[­​-‏⁠-⁤︀-️﻿]")
_ACCENT = re.compile("[̀-ͯ]")
#: Thai to Khmer, Chinese and Japanese: every character is a word.
_SINGLE = r"฀-໿က-႟ក-៿぀-ヿㇰ-ㇿ㐀-鿿豈-﫿\U00020000-\U0003ffff"
#: Beyond Latin, Greek and Cyrillic letters: marks that belong to words, and scripts without blanks.
_OTHER_SCRIPT = re.compile("[\u0483-\u0489\u0590-\u1dff\u2c00-\ufdff\ufe20-\uffff\U00010000-\U0010ffff]")
_PLAIN_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = regex.compile(rf"[[\p{{L}}\p{{N}}\p{{M}}]&&[{_SINGLE}]]|[[\p{{L}}\p{{N}}\p{{M}}]--[{_SINGLE}]]+", regex.V1)


def words(text: str | None) -> list[str]:
    """The words of a text as they are compared, in any script."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub("", text)
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    text = _ACCENT.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)))
    text = unicodedata.normalize("NFC", text).casefold().translate(LOOKALIKES)
    return (_WORD if _OTHER_SCRIPT.search(text) else _PLAIN_WORD).findall(text)


class Automaton:
    """Generalised suffix automaton of word sequences, with the places where each state's runs end."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.vocabulary: dict[str, int] = {}
        self.items = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for _, ws in items]
        self.words = [ws for _, ws in items]
        self.keys = [k for k, _ in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for i, ids in enumerate(self.items):
            last = 0
            for at, w in enumerate(ids):
                last = self._extend(last, w)
                self.ends[last].append((i, at))
        self.linked: list[list[int]] = [[] for _ in self.link]
        for s in range(1, len(self.link)):
            self.linked[self.link[s]].append(s)
        self.following: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.stops: dict[tuple[int, int | None], tuple[list[tuple[int, int]], list[int]]] = {}
        self.spelling = Spelling(self.vocabulary)

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.link) - 1

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def places(self, state: int) -> Iterator[tuple[int, int]]:
        """(item, place of the last word) wherever a state's runs stand: its own ends and those of all states linked to it."""
        todo = [state]
        while todo:
            s = todo.pop()
            yield from self.ends[s]
            todo.extend(self.linked[s])

    def after(self, state: int) -> dict[int, list[tuple[int, int]]]:
        """The places of a state's runs by the word that follows them in the item, -1 at the item's end; kept once looked up."""
        found = self.following.get(state)
        if found is None:
            found = self.following[state] = {}
            for i, end in self.places(state):
                item = self.items[i]
                found.setdefault(item[end + 1] if end + 1 < len(item) else -1, []).append((i, end))
        return found

    def longest(self, ids: list[int | None]) -> list[tuple[int, int]]:
        """(state, length) for each word: the longest run of words that ends there and stands in some item."""
        nexts, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for w in ids:
            if w is None:
                state = n = 0
            else:
                to = nexts[state].get(w)
                if to is None:
                    while state and to is None:
                        state = link[state]
                        to = nexts[state].get(w)
                    n = length[state]
                state, n = (0, 0) if to is None else (to, n + 1)
            out.append((state, n))
        return out

    def stopping(self, state: int, w: int | None) -> tuple[list[tuple[int, int]], list[int]]:
        """(places, their items) of a state's runs that the word w doesn't continue; kept once looked up, for each word that follows some."""
        groups = self.after(state)
        key = (state, w if w in groups else None)
        found = self.stops.get(key)
        if found is None:
            places = [p for following, ps in groups.items() if following != w for p in ps]
            found = self.stops[key] = places, [i for i, _ in places]
        return found

    def ends_of_runs(self, ids: list[int | None], least: int) -> list[tuple[int, int, int, int | None]]:
        """(last word, length of the longest run, state of its last `least` words, next word) wherever a run of at least `least` words
        ends in the document: `longest`, where it is long enough."""
        nexts, link, length = self.next, self.link, self.length
        out, state, n, size = [], 0, 0, len(ids)
        for last, w in enumerate(ids):
            if w is None:
                state = n = 0
                continue
            after = nexts[state]
            while state and w not in after:
                state = link[state]
                n = length[state]
                after = nexts[state]
            if w not in after:
                n = 0
                continue
            state = after[w]
            n += 1
            if n >= least:
                s = state
                while length[link[s]] >= least:  # to the state of the last `least` words: every place where they stand
                    s = link[s]
                out.append((last, n, s, ids[last + 1] if last + 1 < size else None))
        return out

    def pieces(self, ids: list[int | None], least: int, only: set[int] | None = None, ends: list | None = None) -> Iterator[tuple[int, int, int, int]]:
        """(item, place in the document less place in the item, first word of the item, words) of each run of at least `least`
        words that the document and the item have in common and that neither its next nor its previous word continues.

        What an item gets doesn't depend on the other items: a shorter run of it inside a longer one of another item counts too.
        only: the items that are asked for; ends: ends_of_runs, where known."""
        items = self.items
        for last, n, state, w in self.ends_of_runs(ids, least) if ends is None else ends:
            for i, end in self.stopping(state, w)[0]:
                if only is not None and i not in only:
                    continue
                item = items[i]
                most, k = min(n, end + 1), least  # no run that ends here is longer than n
                while k < most and item[end - k] == ids[last - k]:
                    k += 1
                yield i, last - end, end - k + 1, k

    def likely(self, ends: list[tuple[int, int, int, int | None]], share: float, long: int) -> set[int]:
        """The items whose pieces may cover the share of them, or `long` words: by the lengths of the longest runs, which no piece exceeds."""
        held: dict[int, list[int]] = {}  # items by length
        for _, n, state, w in ends:
            held.setdefault(n, []).extend(self.stopping(state, w)[1])
        total: Counter[int] = Counter()
        found: set[int] = set()
        for n, of in held.items():
            counts = Counter(of)
            if n >= long:
                found.update(counts)
            for i, c in counts.items():
                total[i] += n * c
        found.update(i for i, n in total.items() if n >= share * len(self.items[i]))
        return found


_DIGITS = re.compile(r"\d+")
#: Words of so many letters or more are compared as they are.
PLAIN = 40


def alike(a: str, b: str) -> bool:
    """The same word but for a slip: one letter more, less or other, or two neighbours exchanged, in a word of four letters or more.

    Two words that both hold digits must hold the same ones: another number is another word."""
    if a == b:
        return True
    if not (a.isalpha() or b.isalpha()) and _DIGITS.findall(a) != _DIGITS.findall(b):
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or len(a) < 4 and len(b) < 5:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def _without_one(w: str) -> set[str]:
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


class Spelling:
    """Which words of a vocabulary a word may stand for; what has been looked up is kept, up to a bound."""

    def __init__(self, vocabulary: dict[str, int], most: int = 200_000):
        self.near: dict[str, list[str]] = defaultdict(list)
        self.vocabulary = vocabulary
        for w in vocabulary:
            if len(w) < PLAIN:
                for x in _without_one(w):
                    self.near[x].append(w)
        self.known: dict[str, frozenset[str]] = {}
        self.most = most

    def of(self, w: str) -> frozenset[str]:
        found = self.known.get(w)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            if len(w) < PLAIN:
                found = frozenset(v for x in _without_one(w) for v in self.near.get(x, ()) if alike(w, v))
            else:
                found = frozenset([w] if w in self.vocabulary else ())
            self.known[w] = found
        return found


def _common(masks: list[int], size: int) -> list[int]:
    """Length of the longest common subsequence of the item with text[: t + 1], for each t. masks[t]: the places of the item where text[t] may stand."""
    every = (1 << size) - 1
    v, out = every, []
    for m in masks:
        u = v & m
        v = ((v + u) | (v - u)) & every
        out.append(size - v.bit_count())
    return out


def aligned(item: list[str], text: list[str], spelling: Spelling, least: float = 1) -> tuple[int, int, int]:
    """(words in common in order, first and last place in text) of a longest alignment that ends earliest, and of those begins latest.

    (0, -1, -1) if there are fewer than `least` words in common."""
    places: dict[str, int] = defaultdict(int)
    for k, w in enumerate(item):
        places[w] |= 1 << k
    masks, every = [], 0
    for t in text:
        m = 0
        for w in spelling.of(t):
            m |= places.get(w, 0)
        masks.append(m)
        every |= m
    size = len(item)
    if every.bit_count() < least:
        return 0, -1, -1
    forth = _common(masks, size)
    n = forth[-1] if forth else 0
    if n < max(1, least):
        return 0, -1, -1
    last = forth.index(n)
    back = [int(f"{m:0{size}b}"[::-1], 2) for m in reversed(masks[: last + 1])]
    return n, last - _common(back, size).index(n), last


def leaks(automaton: Automaton, ws: list[str]) -> list[tuple[int, int, int, int, float]]:
    """(item key, first word, last word, words in common, coverage) for every place where the words hold an item, or LONG words of it letter by letter."""
    ids = list(map(automaton.vocabulary.get, ws))
    ends = automaton.ends_of_runs(ids, RUN)
    likely = automaton.likely(ends, EVIDENCE, LONG)
    if not likely:
        return []
    evidence: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for i, d, first, n in automaton.pieces(ids, RUN, likely, ends):
        evidence[i].append((d, first, n))  # diagonal, first word of the item, words
    found = []
    for i, pieces in evidence.items():
        size = len(automaton.items[i])
        enough = sum(n for _, _, n in pieces) >= EVIDENCE * size and _words_of((d + first, n) for d, first, n in pieces) >= EVIDENCE * size
        spans = list(_spans(automaton.words[i], ws, pieces, automaton.spelling)) if enough else []
        for d, first, n in sorted((p for p in pieces if p[2] >= LONG), key=lambda p: -p[2]):
            if all(d + first + n <= a or b < d + first for a, b, _ in spans):
                spans.append((d + first, d + first + n - 1, n))
        found.extend((automaton.keys[i], first, last, common, common / size) for first, last, common in spans)
    return found


def _words_of(runs: Iterable[tuple[int, int]]) -> int:
    """How many words lie in at least one of the runs, (first word, words)."""
    n = beyond = 0
    for first, k in sorted(runs):
        n += max(0, first + k - max(first, beyond))
        beyond = max(beyond, first + k)
    return n


def _spans(item: list[str], ws: list[str], pieces: list[tuple[int, int, int]], spelling: Spelling) -> Iterator[tuple[int, int, int]]:
    """(first word, last word, words in common) of each place where the words hold the item, the one with most evidence first.

    Words of one span count for no other one. pieces: (diagonal, first word of the item, words)."""
    size = len(item)
    reach = max(4, int(SLACK * size))
    pieces = sorted(pieces)
    diagonals = [d for d, _, _ in pieces]
    upto = [0, *accumulate(n for _, _, n in pieces)]
    tried = [False] * len(pieces)
    taken: set[int] = set()

    def covered(k: int, beyond: int) -> int:
        """Words of the item that stand in the window's pieces."""
        places: set[int] = set()
        for j in range(k, beyond):
            if not tried[j]:
                d, first, n = pieces[j]
                places.update(range(first, first + n) if not taken else (p for p in range(first, first + n) if d + p not in taken))
        return len(places)

    windows = []
    for k, d in enumerate(diagonals):
        if k and diagonals[k - 1] == d:
            continue
        beyond = bisect_left(diagonals, d + reach + 1)
        if upto[beyond] - upto[k] >= EVIDENCE * size and (n := covered(k, beyond)) >= EVIDENCE * size:
            windows.append((-n, d, k, beyond))
    heapify(windows)
    while windows:
        n, d, k, beyond = heappop(windows)
        now = covered(k, beyond)
        if now < EVIDENCE * size:
            continue
        if now < -n:  # others have taken of it
            heappush(windows, (-now, d, k, beyond))
            continue
        span = _span(item, ws, d - reach, d + size + 2 * reach, reach, taken, spelling)
        if span:
            yield span
            taken.update(range(span[0], span[1] + 1))
            heappush(windows, (n, d, k, beyond))
        else:  # the text read holds all that a place on one of these diagonals can hold
            tried[k:beyond] = [True] * (beyond - k)


def _span(item: list[str], ws: list[str], low: int, high: int, reach: int, taken: set[int], spelling: Spelling) -> tuple[int, int, int] | None:
    """(first word, last word, words in common) of the item in ws[low:high], less the words taken; None if too little of it stands there, or too loosely."""
    size = len(item)
    longest = size + 2 * reach

    def read(low: int, high: int) -> tuple[int, int, int]:
        low = max(0, low)
        text = ws[low : max(low, high)]
        if taken:
            text = ["" if at in taken else w for at, w in enumerate(text, low)]
        common, first, last = aligned(item, text, spelling, COVERAGE * size)
        return common, low + first, low + last

    def close(got: tuple[int, int, int]) -> bool:
        return got[0] > 0 and got[2] - got[1] < longest

    best = read(low, high)
    if not best[0]:
        return None
    if not close(best):  # single words far off may have joined in: without either end
        best = max((x for x in (read(low, low + longest), read(high - longest, high)) if close(x)), default=None)
        if best is None:
            return None
    if best[0] < size:  # the text may have been cut within the item
        _, first, last = best
        best = max((x for x in (best, read(first, first + longest), read(last + 1 - longest, last + 1)) if close(x)), key=lambda x: x[0])
    common, first, last = best
    return first, last, common


@lru_cache(maxsize=2)
def _automaton(items: tuple[tuple[int, str], ...]) -> Automaton:
    return Automaton([(k, words(t)) for k, t in items])


COLUMNS = [("item", pa.int64()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("common", pa.int32()), ("coverage", pa.float64())]


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """key, item, first_word, last_word, common, coverage: each item that a document holds, how much of it, and where; a row for each place.

    A place holds the share COVERAGE of an item or LONG words of it letter by letter. item_key must be an integer. Null and empty
    texts on either side hold nothing and are held by nothing; items without words never leak; repeated documents and items are
    each reported. Texts are read whole. More than MOST_WORDS words of items are refused: such a set is no test set."""
    known = items.select(F.col(item_key).cast("bigint").alias("k"), F.col(item_text).alias("t")).dropna()
    total = known.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    if total > MOST_WORDS:
        raise ValueError(f"{total} words of items; at most {MOST_WORDS} can be looked for")
    blocks = max(1, -(-total // BLOCK_WORDS))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, item bigint, first_word int, last_word int, common int, coverage double"
    context, parts = docs.sparkSession.sparkContext, []
    for b in range(blocks):
        mine = tuple(sorted((r["k"], r["t"]) for r in known.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).collect()))
        parts.append(docs.select(key, text).mapInArrow(_reader(key, context.broadcast(mine)), schema))
    return reduce(DataFrame.unionByName, parts)


def _reader(key: str, items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(items.value)
        for batch in batches:
            rows, source = [], []
            for i, t in enumerate(batch.column(1)):
                found = leaks(automaton, words(t.as_py()))
                rows.extend(found)
                source.extend([i] * len(found))
            columns = list(zip(*rows)) if rows else [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(columns, COLUMNS))], names=[key, *(n for n, _ in COLUMNS)])

    return run


_CHUNK = re.compile(r"\S+")
#: Blanks in what may be a tag don't part its chunk; for the words it makes no difference.
_MAYBE_TAG = re.compile(r"(?:<|&(?:amp;)*lt;)/?[a-z][^\n]{0,120}?(?:>|&(?:amp;)*gt;)", re.I)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the chunks (text between blanks) whose words lie in one of the spans of words."""
    out, at, n = [], 0, 0
    for m in _CHUNK.finditer(_MAYBE_TAG.sub(lambda m: re.sub(r"\s", "_", m.group()), text)):
        k = len(words(m.group()))
        if any(a < n + max(k, 1) and n <= b for a, b in spans):
            out.append(text[at : m.start()])
            at = m.end()
        n += k
    return "".join([*out, text[at:]])


def remove_leaks(docs: DataFrame, key: str, text: str, found: DataFrame, coverage: float = COVERAGE, length: int = LONG) -> DataFrame:
    """key, text: documents with leaks, less the spans that exceed a limit, of coverage or of words in common; other documents are not returned.

    Spans are counted in words as compared; markup between two words of a span goes with it."""
    spans = found.filter((F.col("coverage") >= coverage) | (F.col("common") >= length)).groupBy(key).agg(F.collect_set(F.struct("first_word", "last_word")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cleaned = [_without(t.as_py() or "", [tuple(s.values()) for s in x.as_py()]) for t, x in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cleaned, pa.string())], names=[key, text])

    return docs.select(key, text).join(spans, key).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, `{text}` string")
