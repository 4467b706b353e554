"""The language of each document and of each stretch of a mixed one, by bit-sliced Bloom filters of character n-grams.

One filter row holds a bit per language. The rows an n-gram hashes to, combined with AND, tell at once all languages that
contain it; per sentence and language these bits are counted and corrected for the filter's false positives.
Sentences then choose their languages together: the sum of counts less a price per change of language is maximal.

The filters are learned from a bounded sample of labelled documents, about SAMPLE of each label. As labels may be
wrong and texts mixed, an n-gram belongs to a language only if its rate among that language's sentences is not far below its
highest rate, and the filters are learned a second time without the sentences that they place elsewhere. Rates are
aggregates over the sample on the executors; what reaches the driver is the n-grams with their languages, the filters' size.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changegraph.session import Stash

SAMPLE = 400  # documents of a label that are learned from, about
SIZES = (3, 4)  # characters of an n-gram
RATIO = 0.2  # of an n-gram's highest rate, for it to belong to another language too
PRICE = 8.0  # n-grams that a change of language must gain
SHORT, SENTENCES = 40, 2  # a stretch has at least so many characters or sentences
CHUNK = 400_000  # characters looked at together
KNOWN = 0.3  # of a stretch's n-grams, that its language must contain
UNKNOWN = "und"  # the language of a stretch that no language learned knows so much of

#: The two-letter codes of ISO 639-1.
CODES = """aa ab ae af ak am an ar as av ay az ba be bg bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu
fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr
ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps
pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve
vi vo wa wo xh yi yo za zh zu""".split()

#: Other spellings of some languages; callers with others pass their own.
NAMES = {
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "español", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français"),
    "it": ("it", "ita", "italian", "italiano"),
    "ja": ("ja", "jpn", "jp", "japanese", "日本語"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "pl": ("pl", "pol", "polish", "polski"),
    "pt": ("pt", "por", "portuguese", "português"),
    "ru": ("ru", "rus", "russian", "русский"),
}


def label_code(label: Column | str, names: dict[str, tuple[str, ...]] = NAMES) -> Column:
    """The two-letter code that a label names in whatever spelling, region or script aside; null if it names no language.

    A code of ISO 639-1 stands for itself; names adds other spellings, and codes of other lengths."""
    known = {c: c for c in CODES} | {n: code for code, spelt in names.items() for n in (code, *spelt)}
    found = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.get(F.transform(F.array(F.lower(F.regexp_extract(label, r"^\s*([^\s_\-]*)", 1))), lambda x: found[x]), 0)


#: A fence that isn't closed goes to the end of its paragraph if it begins a line; else its marks alone are blanked.
_FENCE = re.compile(r"```.*?```|^```(?:(?!\n[ \t]*\n).)*|```|`[^`\n]*`", re.S | re.M)
#: In scripts written without blanks (Thai to Khmer, Chinese and Japanese with their punctuation and wide forms) a path ends where they begin.
_PATH = r"[^\s\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff]"
_MARKUP = re.compile(rf"<[^<>\n]{{1,80}}>|{_PATH}*[/_\\{{}}@#=|]{_PATH}*|https?:{_PATH}+")
_ACCENT = re.compile("[̀-ͯ]")
_SENTENCE = re.compile(r"[^.!?…。！？\n]+[.!?…。！？]*")


def _blank(m: re.Match) -> str:
    return " " * len(m.group())


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, letters to compare) of each sentence with letters; begin and end are places in the text.

    Code, paths and markup are blanked, so they belong to the text around them. Accents and case don't count."""
    t = text
    if "`" in t:
        t = _FENCE.sub(_blank, t)
    t = _MARKUP.sub(_blank, t)
    out = []
    for m in _SENTENCE.finditer(t):
        s = m.group().strip()
        if s:
            s = s.lower()
            if not s.isascii():
                s = _ACCENT.sub("", unicodedata.normalize("NFKD", s))
            out.append((m.start(), m.end(), s))
    return out


_LETTER = np.zeros(128, bool)
_LETTER[ord("a") : ord("z") + 1] = True


def grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, part) of the n-grams of each part, blanks for what is no letter; n-grams don't cross parts, nor hold only blanks."""
    points = np.frombuffer((" \n ".join(parts)).encode("utf-32-le", "replace"), np.uint32)
    cut = points == 10
    part = np.cumsum(cut, dtype=np.int32)
    low = points < 128
    codes = np.where(low & ~_LETTER[np.minimum(points, 127)], np.uint32(32), points)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    cut, part = np.concatenate([[False], cut, [False]]), np.concatenate([[0], part, [part[-1] if len(part) else 0]]).astype(np.int32)
    hashes, of = [], []
    blank = codes == 32
    for n in SIZES:
        if len(codes) < n:
            continue
        m = len(codes) - n + 1
        h = np.full(m, n, np.uint64)
        bad = np.zeros(m, bool)
        for k in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ codes[k : k + m]
            bad |= cut[k : k + m]
        bad |= blank[: m] & blank[1 : m + 1]
        bad |= blank[n - 2 : n - 2 + m] & blank[n - 1 : n - 1 + m]
        keep = ~bad
        h = h[keep]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes.append(h ^ (h >> np.uint64(32)))
        of.append(part[:m][keep])
    return (np.concatenate(hashes), np.concatenate(of)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int32))


@dataclass
class Filters:
    languages: list[str]
    rows: list[np.ndarray]  # a bit per language, 64 languages to an array
    false: np.ndarray  # false positive rate per language

    @staticmethod
    def of(languages: list[str], known: np.ndarray, masks: list[np.ndarray]) -> Filters:
        """From n-grams and, 64 languages at a time, the bits of the languages each belongs to; the size follows from their number."""
        size = 1 << max(12, int(np.ceil(np.log2(8 * max(1, len(known))))))
        most, rows = np.uint64(size - 1), []
        for m in masks:
            row = np.zeros(size, np.uint16 if len(languages) <= 16 else np.uint64)
            for at in (known & most, (known >> np.uint64(32)) & most):
                np.bitwise_or.at(row, at, m.astype(row.dtype))
            rows.append(row)
        bit = lambda k: (rows[k // 64] >> rows[0].dtype.type(k % 64)) & rows[0].dtype.type(1)
        fill = np.array([bit(k).mean() for k in range(len(languages))])
        return Filters(languages, rows, np.minimum(fill**2, 0.9))

    def counts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected number of n-grams of each part that each language contains: parts x languages; and n-grams of each part."""
        out, total = np.zeros((len(parts), len(self.languages))), np.zeros(len(parts))
        at = 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (size == 0 or size + len(parts[end]) <= CHUNK):
                size += len(parts[end])
                end += 1
            hashes, of = grams(parts[at:end])
            n = total[at:end] = np.bincount(of, minlength=end - at)
            for w, rows in enumerate(self.rows):
                most, kind = np.uint64(len(rows) - 1), rows.dtype.type
                masks = rows[hashes & most] & rows[(hashes >> np.uint64(32)) & most]
                for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                    hits = np.bincount(of[(masks >> kind(k % 64)) & kind(1) == 1], minlength=end - at)
                    out[at:end, k] = np.maximum(hits - n * self.false[k], 0) / (1 - self.false[k])
            at = end
        return out, total


def _sentence_grams(languages: list[str], first) -> Callable:
    """For mapInArrow: (gram, lang, n), in how many sentences of a language's texts an n-gram occurs; gram is null for all sentences.

    With a broadcast of filters, only the sentences that these place in the language of the label count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, labels = [], []
            for code, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = [s for _, _, s in sentences(text)]
                parts.extend(got)
                labels.extend([languages.index(code)] * len(got))
            labels = np.array(labels, np.int64)
            if first is not None and parts:
                right = first.value.counts(parts)[0].argmax(axis=1) == labels
                parts, labels = [p for p, r in zip(parts, right) if r], labels[right]
            at = 0
            while at < len(parts):
                end, size = at, 0
                while end < len(parts) and (size == 0 or size + len(parts[end]) <= CHUNK):
                    size += len(parts[end])
                    end += 1
                hashes, of = grams(parts[at:end])
                once = np.unique(hashes ^ (of.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]
                hashes, lang = hashes[once], labels[at:end][of[once]]
                for k in np.unique(labels[at:end]):
                    known, n = np.unique(hashes[lang == k], return_counts=True)
                    known, n = pa.array(known.view(np.int64)), pa.array(n, pa.int64())
                    every = pa.array([None], pa.int64()), pa.array([int((labels[at:end] == k).sum())], pa.int64())
                    known, n = pa.concat_arrays([known, every[0]]), pa.concat_arrays([n, every[1]])
                    yield pa.RecordBatch.from_arrays([known, pa.array(np.full(len(known), k), pa.int32()), n], names=["gram", "lang", "n"])
                at = end

    return run


def _learn(stash: Stash, languages: list[str], sample: DataFrame, first=None) -> Filters:
    found = sample.select("code", "text").mapInArrow(_sentence_grams(languages, first), "gram bigint, lang int, n bigint")
    counts = stash.put(found.groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    every = {r["lang"]: r["n"] for r in counts.filter("gram is null").collect()}  # a row per language
    if not every:
        return Filters.of(languages, np.empty(0, np.uint64), [np.empty(0, np.uint64)] * -(-len(languages) // 64))
    rate = F.col("n") / F.create_map(*[F.lit(x) for pair in sorted(every.items()) for x in pair])[F.col("lang")]
    rated = counts.filter("gram is not null and n >= 2").groupBy("gram").agg(F.collect_list(F.struct("lang", rate.alias("rate"))).alias("of"))  # as many as there are languages
    member = F.filter("of", lambda x: x["rate"] >= RATIO * F.array_max(F.transform("of", lambda y: y["rate"])))

    def bits(w: int) -> Column:
        """Of the languages 64 w, 64 w + 1, ... those that an n-gram belongs to."""
        mine = F.filter(member, lambda x: F.floor(x["lang"] / 64) == w)
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x["lang"] % 64))).alias(f"m{w}")

    words = [bits(w) for w in range(-(-len(languages) // 64))]
    t = rated.select("gram", *words).toArrow()
    stash.drop(counts)
    view = lambda c: t.column(c).to_numpy().view(np.uint64)
    return Filters.of(languages, view("gram"), [view(f"m{w}") for w in range(len(words))])


def shares(counts: dict[str, int], most: int = SAMPLE) -> dict[str, int]:
    """Label -> the largest 64-bit hash that is learned from, so that about `most` of the label's rows are, however many there are."""
    return {code: min((1 << 63) - 1, (most << 64) // n - (1 << 63)) for code, n in counts.items()}


def learn(docs: DataFrame, key: str, text: str, label: str, names: dict[str, tuple[str, ...]] = NAMES, most: int = SAMPLE) -> Filters:
    """Filters from about `most` documents of each language that labels name, chosen by a hash of the key; all where there are fewer.

    Null texts and labels teach nothing; without any, no language is known."""
    stash = Stash(docs.sparkSession)
    coded = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), label_code(label, names).alias("code"))
    counts = {r["code"]: r["count"] for r in coded.select("code").dropna().groupBy("code").count().collect()}  # a row per language
    languages = sorted(counts)
    if not languages:
        return Filters([], [], np.zeros(0))
    upto = F.create_map(*[F.lit(x) for code, h in sorted(shares(counts, most).items()) for x in (code, h)])
    sample = stash.put(coded.filter("code is not null and text is not null").filter(F.xxhash64("k") <= upto[F.col("code")]).select("code", "text"))
    first = _learn(stash, languages, sample)
    shipped = docs.sparkSession.sparkContext.broadcast(first)
    second = _learn(stash, languages, sample, shipped)
    stash.clear()
    return second if any(r.any() for r in second.rows) else first


def _chosen(counts: np.ndarray) -> list[int]:
    """Language of each sentence: the most n-grams less PRICE for each change."""
    best, back = counts[0].copy(), []
    for row in counts[1:]:
        top = int(best.argmax())
        change = best[top] - PRICE > best
        back.append(np.where(change, top, np.arange(len(best))))
        best = np.where(change, best[top] - PRICE, best) + row
    at = [int(best.argmax())]
    for b in reversed(back):
        at.append(int(b[at[-1]]))
    return at[::-1]


def stretches(spans: list[tuple[int, int, str]], counts: np.ndarray, total: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(language, begin, end, confidence) of the stretches of a text, each in another language than the one before; -1 is no known language.

    Stretches too short to be one join the neighbour that their n-grams speak for. total: n-grams of each sentence."""
    if not total.any():
        return []
    none = counts.shape[1]  # no known language is one more, which contains the share KNOWN of all n-grams
    counts = np.column_stack([counts, KNOWN * total])
    tops = counts.argmax(axis=1)
    chosen = [int(tops[0])] * len(tops) if (tops == tops[0]).all() else _chosen(counts)
    runs = [[k, list(g)] for k, g in groupby(range(len(chosen)), key=chosen.__getitem__)]

    def short(run: list) -> bool:
        i = run[1]
        return len(i) < SENTENCES and sum(len(spans[j][2]) for j in i) < SHORT

    while len(runs) > 1 and any(map(short, runs)):
        at = min((x for x in range(len(runs)) if short(runs[x])), key=lambda x: sum(len(spans[j][2]) for j in runs[x][1]))
        near = [x for x in (at - 1, at + 1) if 0 <= x < len(runs)]
        to = max(near, key=lambda x: counts[runs[at][1], runs[x][0]].sum())
        runs[at][0] = runs[to][0]
        merged: list = []
        for k, i in runs:
            if merged and merged[-1][0] == k:
                merged[-1][1] += i
            else:
                merged.append([k, i])
        runs = merged
    out = []
    for k, i in runs:
        sums = counts[i].sum(axis=0)[:none]
        weights = np.exp(np.maximum(sums - sums.max(initial=0), -50))
        out.append((k, spans[i[0]][0], spans[i[-1]][1], float(weights[k] / weights.sum())) if k < none else (-1, spans[i[0]][0], spans[i[-1]][1], 0.0))
    return out


COLUMNS = [("seg_no", pa.int32()), ("seg_lang", pa.string()), ("confidence", pa.float64()), ("begin", pa.int32()), ("end", pa.int32())]


def find_languages(docs: DataFrame, key: str, text: str, filters: Filters) -> DataFrame:
    """key, seg_no, seg_lang, confidence, begin, end, n_segs: the stretches of each text in reading order.

    A stretch of whose n-grams its language knows less than KNOWN is in language UNKNOWN, with confidence 0. Null and empty texts,
    and texts without any n-gram, give no row. Texts are read whole."""
    shipped = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shipped.value
        for batch in batches:
            spans = [sentences(t.as_py()) if t.is_valid else [] for t in batch.column(1)]
            counts, total = f.counts([s for x in spans for _, _, s in x])
            source, rows, n_segs, at = [], [], [], 0
            for i, x in enumerate(spans):
                found = stretches(x, counts[at : at + len(x)], total[at : at + len(x)])
                at += len(x)
                source.extend([i] * len(found))
                n_segs.extend([len(found)] * len(found))
                rows.extend((n, f.languages[k] if k >= 0 else UNKNOWN, c, b, e) for n, (k, b, e, c) in enumerate(found))
            columns = list(zip(*rows)) if rows else [()] * len(COLUMNS)
            arrays = [batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(columns, COLUMNS)), pa.array(n_segs, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, *(n for n, _ in COLUMNS), "n_segs"])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, seg_no int, seg_lang string, confidence double, begin int, end int, n_segs int"
    return docs.select(key, text).mapInArrow(run, schema)
