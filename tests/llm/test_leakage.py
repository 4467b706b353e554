from __future__ import annotations

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from changegraph.llm import leakage as L

WORDS = "amber basin cedar delta ember fjord grove haven inlet jetty kiln lemon mango noble ocean prism quilt river sable tulip umber vivid willow xenon yield zephyr".split()


def text(rnd, n):
    return [rnd.choice(WORDS) + rnd.choice(["", "s", "ly", "ing"]) for _ in range(n)]


def test_normalised_words():
    assert L.words("Ｔhe  **bоld** &lt;em&gt;café&lt;/em&gt;, on-\n * call​ ﬁne `x_y`") == ["the", "bold", "cafe", "on", "call", "fine", "x", "y"]
    assert L.words(None) == L.words("") == L.words(" \n.") == []


@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=30))
def test_automaton_finds_longest_runs(items, doc):
    a = L.Automaton([(i, ws) for i, ws in enumerate(items)])
    got = a.longest([a.vocabulary.get(w) for w in doc])
    known = {tuple(ws[i:j]) for ws in items for i in range(len(ws)) for j in range(i + 1, len(ws) + 1)}
    longest = [max((n for n in range(at + 2) if n == 0 or tuple(doc[at + 1 - n : at + 1]) in known)) for at in range(len(doc))]
    assert [n for _, n in got] == longest
    for end, (state, n) in enumerate(got):
        run = doc[end - n + 1 : end + 1]
        places = {(i, at) for i, ws in enumerate(items) for at in range(n - 1, len(ws)) if ws[at - n + 1 : at + 1] == run}
        if n:
            assert sorted(a.places(state)) == sorted(places)
            assert sorted(x for xs in a.after(state).values() for x in xs) == sorted(places)


@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.lists(st.sampled_from("abcd"), max_size=16))
def test_alignment_is_longest_common_subsequence(item, doc):
    n, first, last = L.aligned(item, doc, L.Spelling({w: 0 for w in item}))
    table = [[0] * (len(item) + 1) for _ in range(len(doc) + 1)]
    for i, d in enumerate(doc):
        for j, w in enumerate(item):
            table[i + 1][j + 1] = table[i][j] + 1 if d == w else max(table[i][j + 1], table[i + 1][j])
    assert n == table[-1][-1]
    if n:
        assert 0 <= first <= last < len(doc)


def test_alike():
    assert L.alike("screen", "sceren") and L.alike("screen", "screeen") and L.alike("screen", "scren") and L.alike("screen", "scroen")
    assert not L.alike("no", "on") and not L.alike("screen", "scare") and not L.alike("the", "then") and not L.alike("abcd", "badc")


def test_numbers_are_no_slips():
    assert not L.alike("2018", "2019") and not L.alike("12345", "12346") and not L.alike("step12", "step13")
    assert L.alike("scr3en", "screen") and L.alike("step12", "setp12")


def test_long_words():
    w = "x" * 39 + "yz" * 30
    s = L.Spelling({w: 0, "short": 1})
    assert s.of(w) == {w} and s.of(w + "a") == frozenset() and s.of("shrt") == {"short"}


def test_other_scripts(spark):
    items = ["次の手順では変更の前にすべての記録を確認してから保存します", "Каждый шаг проверяет запись до того, как изменение будет сохранено в журнале, и сообщает об ошибке", "प्रत्येक चरण परिवर्तन से पहले अभिलेख की जाँच करता है और त्रुटि की सूचना देता है", "각 단계는 변경 전에 기록을 확인하고 오류를 보고한 다음 저장합니다"]
    assert len(L.words(items[0])) == len(items[0]) and len(L.words(items[1])) == 16 and len(L.words(items[2])) == 16
    docs = [(k, f"before {t[: 2 * len(t) // 3]} after") for k, t in enumerate(items)] + [(9, "手順を読む。Запись и журнал.")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = L.find_leaks(d, "doc_id", "text", i, "item_id", "text")
    assert {(r["doc_id"], r["item"]) for r in got.collect()} == {(k, k) for k in range(4)}


def test_a_long_part_of_a_longer_item(spark):
    item = [f"w{k}word" for k in range(1000)]
    docs = [(0, " ".join(["a", "b", *item[300:360], "c"])), (1, " ".join(["a", *item[300:340], "c"]))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = L.find_leaks(d, "doc_id", "text", i, "item_id", "text")
    assert [(r["doc_id"], r["first_word"], r["last_word"], r["common"]) for r in got.collect()] == [(0, 2, 61, 60)]
    assert [r["text"].split() for r in L.remove_leaks(d, "doc_id", "text", got).collect()] == [["a", "b", "c"]]
    assert L.remove_leaks(d, "doc_id", "text", got, length=61).count() == 0


def test_tags_with_blanks_do_not_shift_what_is_removed():
    item = [f"w{k}" for k in range(30)]
    text = 'keep <em class="a b">this</em> &lt;i id="c d"&gt;too ' + " ".join(item) + " and the end"
    (span,) = [(f, l) for _, f, l, _, _ in L.leaks(L.Automaton([(0, item)]), L.words(text))]
    assert L._without(text, [span]).split() == ["keep", "<em", 'class="a', 'b">this</em>', "&lt;i", 'id="c', 'd"&gt;too', "and", "the", "end"]


def test_one_word_repeated():
    import time

    begun = time.time()
    a = L.Automaton([(0, ["same"] * 100_000), (1, ["same"] * 5 + ["other"] * 5)])
    assert len(a.link) < 200_100 and time.time() - begun < 30
    found = L.leaks(a, ["before", *["same"] * 5, *["other"] * 5, "after"])
    assert [f[:4] for f in found] == [(1, 1, 10, 10)]


def test_too_many_items(spark, monkeypatch):
    d, i, _ = frames(spark)
    monkeypatch.setattr(L, "MOST_WORDS", 10)
    with pytest.raises(ValueError, match="words of items"):
        L.find_leaks(d, "doc_id", "text", i, "item_id", "text")


def cases():
    rnd = random.Random(5)
    opening = text(rnd, 8)
    items = [(i, " ".join(opening + text(rnd, 40 + i)).capitalize()) for i in range(6)]
    fill = lambda n: " ".join(text(rnd, n))
    whole = items[0][1].upper().replace(" ", "\n> ")
    half = " ".join(items[1][1].split()[15:])
    slips = " ".join(w if k % 5 else (w[1] + w[0] + w[2:]) for k, w in enumerate(items[2][1].split()))
    quarter = " ".join(items[3][1].split()[: len(items[3][1].split()) // 4])
    scattered = (" " + fill(30) + " ").join(items[4][1].split()[k : k + 4] and " ".join(items[4][1].split()[k : k + 4]) for k in range(0, 44, 4))
    docs = [(0, fill(20) + ". " + whole + " " + fill(9)), (1, half), (2, slips), (3, quarter + " " + fill(50)), (4, scattered), (5, " ".join(opening)), (6, None), (7, ""), (8, items[5][1] + " " + items[0][1]), (9, fill(200_000) + " " + items[3][1])]
    return items, docs, {(0, 0), (1, 1), (2, 2), (8, 5), (8, 0), (9, 3)}


def frames(spark):
    items, docs, want = cases()
    d = spark.createDataFrame([(k, t, "x", 0.5) for k, t in docs], "doc_id long, text string, item string, coverage double")
    return d, spark.createDataFrame([*items, (90, None), (91, ""), (None, "some words here")], "item_id long, text string"), want


def test_found_whole_half_and_with_slips(spark):
    d, i, want = frames(spark)
    got = L.find_leaks(d, "doc_id", "text", i, "item_id", "text")
    assert {(r["doc_id"], r["item"]) for r in got.collect()} == want


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_WORDS", 60)
    d, i, want = frames(spark)
    got = L.find_leaks(d, "doc_id", "text", i, "item_id", "text")
    assert {(r["doc_id"], r["item"]) for r in got.collect()} == want


def test_spans_are_removed(spark):
    d, i, want = frames(spark)
    got = L.find_leaks(d, "doc_id", "text", i, "item_id", "text").cache()
    clean = {r["doc_id"]: r["text"] for r in L.remove_leaks(d, "doc_id", "text", got).collect()}
    assert set(clean) == {k for k, _ in want}
    again = L.find_leaks(spark.createDataFrame(list(clean.items()), "doc_id long, text string"), "doc_id", "text", i, "item_id", "text")
    assert again.count() == 0
    assert L.remove_leaks(d, "doc_id", "text", got, coverage=1.1, length=1000).count() == 0


def test_empty_sides(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    assert L.find_leaks(none, "doc_id", "text", items, "item_id", "text").count() == 0
    assert L.find_leaks(one, "doc_id", "text", items, "item_id", "text").count() == 0


@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(1, 3))
def test_pieces_are_each_items_own(items, doc, least):
    a = L.Automaton([(i, ws) for i, ws in enumerate(items)])
    same = lambda ws, p, t: 0 <= p < len(ws) and 0 <= t < len(doc) and ws[p] == doc[t]
    want = []
    for i, ws in enumerate(items):
        for p in range(len(ws)):
            for t in range(len(doc)):
                n = next(k for k in range(len(ws) + 1) if not same(ws, p + k, t + k))
                if n >= least and not same(ws, p - 1, t - 1):
                    want.append((i, t - p, p, n))
    assert sorted(a.pieces([a.vocabulary.get(w) for w in doc], least)) == sorted(want)


def nested():
    rnd = random.Random(8)
    a = [f"{w}{k}" for k, w in enumerate(text(rnd, 30))]
    items = [(0, " ".join(a)), (1, " ".join(a[5:15])), (2, " ".join(a[:12])), (3, " ".join(a[20:])), (4, " ".join([*a[:3], *text(rnd, 30)]))]
    return items, [(0, "before it " + " ".join(a) + " and after"), (1, "only " + " ".join(a[5:15]) + " here")]


def test_items_inside_items(spark, monkeypatch):
    items, docs = nested()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(0, 0, 2, 31), (0, 1, 7, 16), (0, 2, 2, 13), (0, 3, 22, 31), (1, 1, 1, 10), (1, 2, 1, 7)}
    for most in (L.BLOCK_WORDS, 40, 8):
        monkeypatch.setattr(L, "BLOCK_WORDS", most)
        got = L.find_leaks(d, "doc_id", "text", i, "item_id", "text").collect()
        assert {(r["doc_id"], r["item"], r["first_word"], r["last_word"]) for r in got} == want and len(got) == len(want)


def copies():
    rnd = random.Random(9)
    item = [f"{w}{k}" for k, w in enumerate(text(rnd, 40))]
    fill = lambda n: [f"{w}x" for w in text(rnd, n)]
    slips = [w if k % 4 < 3 or k > 36 else w[1] + w[0] + w[2:] for k, w in enumerate(item)]
    rare = [w if k % 7 < 3 else f"{w}q{k}" if k % 7 == 6 else w[1:] for k, w in enumerate(item)]
    other = [*item[:20], *fill(2), *item[22:]]
    docs = [
        (0, [*item, *fill(500), *item]),  # two copies far apart
        (1, [*item, *item, *slips]),  # next to each other
        (2, [*fill(9), *item[:19], *fill(300), *rare]),  # the opening quoted, the copy later
        (3, [*item[:24], *fill(12), *item]),  # part of it just before the whole
        (4, [*fill(5), *other, *fill(60), *slips, *fill(3), *item[:18]]),
    ]
    want = {
        (0, 0, 39), (0, 540, 579),
        (1, 0, 39), (1, 40, 79), (1, 80, 119),
        (2, 328, 367),
        (3, 0, 23), (3, 36, 75),
        (4, 5, 44), (4, 105, 144),
    }
    return item, docs, want


def test_every_copy_is_found_and_removed(spark):
    item, docs, want = copies()
    d = spark.createDataFrame([(k, " ".join(ws)) for k, ws in docs], "doc_id long, text string")
    i = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = L.find_leaks(d, "doc_id", "text", i, "item_id", "text").cache()
    rows = got.collect()
    assert {(r["doc_id"], r["first_word"], r["last_word"]) for r in rows} == want and len(rows) == len(want)
    clean = L.remove_leaks(d, "doc_id", "text", got)
    assert clean.count() == len(docs) and L.find_leaks(clean, "doc_id", "text", i, "item_id", "text").count() == 0


def test_single_words_far_off_do_not_lose_a_copy():
    item = [f"w{k}word" for k in range(40)]
    a = L.Automaton([(0, item)])
    doc = [item[0], *["other"] * 13, *["gone"] * 3, *item[3:36], *["gone"] * 3, *["other"] * 19, item[39], *["other"] * 9]
    ((key, first, last, common, _),) = L.leaks(a, doc)
    assert key == 0 and first <= 17 and last >= 49 and common >= 33
