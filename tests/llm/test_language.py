from __future__ import annotations

import random

import numpy as np
import pytest

from changegraph.llm import language as L

SAMPLES = {
    "de": "der die das und nicht wird prüfung größer änderung zwischen eintrag schritt über jede".split(),
    "en": "the of and not will check larger change between entry step over every which".split(),
    "fr": "le la les et pas sera vérification plus grand changement entre entrée étape sur chaque".split(),
    "ru": "этот шаг запись проверка больше изменение между каждый не будет над который".split(),
    "ja": "この 手順 は 次の 確認 を 行います 変更 が 大きい 場合 に 記録 します".split(),
}


def sentence(rnd, code, n=9):
    ws = [rnd.choice(SAMPLES[code]) for _ in range(n)]
    return ("".join(ws) + "。") if code == "ja" else " ".join(ws).capitalize() + "."


def make(seed=1, per=60):
    rnd = random.Random(seed)
    docs = [(c, " ".join(sentence(rnd, c) for _ in range(rnd.randrange(2, 6)))) for c in SAMPLES for _ in range(per)]
    return [(rnd.choice(sorted(SAMPLES)) if rnd.random() < 0.1 else c, t) for c, t in docs]  # a tenth of labels are wrong


def learned(spark, samples, **more):
    df = spark.createDataFrame([(i, t, c) for i, (c, t) in enumerate(samples)], "k long, text string, lang string")
    return L.learn(df, "k", "text", "lang", **more)


@pytest.fixture(scope="module")
def filters(spark):
    return learned(spark, make())


def found(filters, text):
    spans = L.sentences(text)
    return [filters.languages[k] if k >= 0 else "und" for k, *_ in L.stretches(spans, *filters.counts([s for *_, s in spans]))]


def test_held_out_texts(filters):
    rnd = random.Random(2)
    for c in SAMPLES:
        for _ in range(20):
            assert found(filters, sentence(rnd, c) + " " + sentence(rnd, c)) == [c]
            assert found(filters, sentence(rnd, c).upper()) == [c]


def test_stretches_in_reading_order(filters):
    rnd = random.Random(3)
    two = lambda c: f"{sentence(rnd, c)} {sentence(rnd, c)}"
    assert found(filters, f"{two('de')}\n\n{two('en')} {two('ja')}\n---\n> {two('ru')}") == ["de", "en", "ja", "ru"]
    quoted = f"{sentence(rnd, 'en')} “{SAMPLES['de'][0]} {SAMPLES['de'][6]}” {sentence(rnd, 'en')}"
    assert found(filters, quoted) == ["en"]
    code = f"{two('fr')}\n```\nthe_check = of(every, step)\n```\n{two('fr')} (`the/check/of/every.py:step`)."
    assert found(filters, code) == ["fr"]


def test_no_language(filters):
    for t in ("", "   ", "12 34 :: 56", "```\nfor x in y\n```"):
        assert found(filters, t) == []
    for t in ("αβγ δεζ", "αβγ δεζ. ηθι κλμ."):
        assert found(filters, t) == ["und"]


def test_a_language_not_learned_is_unknown_beside_others(filters):
    rnd = random.Random(4)
    greek = "το βήμα ελέγχει κάθε εγγραφή πριν από την αλλαγή. η αλλαγή γράφεται μετά."
    assert found(filters, f"{sentence(rnd, 'de')} {sentence(rnd, 'de')}\n\n{greek}") == ["de", "und"]


def test_nothing_labelled(spark):
    none = L.learn(spark.createDataFrame([(1, "some text", None)], "k long, text string, lang string"), "k", "text", "lang")
    assert found(none, "some text") == ["und"] and found(none, "") == []


def test_a_share_of_any_number_of_documents():
    for n in (1, 399, 400, 401, 10**6, 5 * 10**8, 10**13):
        upto = L.shares({"en": n})["en"]
        assert -(1 << 63) < upto < 1 << 63 and abs((upto + (1 << 63)) * n / 2**64 - min(n, 400)) < 1


def test_more_than_64_languages(spark):
    rnd = random.Random(6)
    codes = L.CODES[:70]
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = {c: ["".join(rnd.choice(letters) for _ in range(6)) for _ in range(12)] for c in codes}
    text = lambda c: " ".join(rnd.choice(vocabulary[c]) for _ in range(12)) + "."
    f = learned(spark, [(c, text(c) + " " + text(c)) for c in codes for _ in range(6)])
    assert f.languages == sorted(codes) and len(f.rows) == 2
    assert all(found(f, text(c) + " " + text(c)) == [c] for c in codes)


def test_other_names(spark):
    names = {"gsw": ("swiss german",), "en": ("anglais",)}
    df = spark.createDataFrame([(x,) for x in ("gsw", "anglais", "sv", "English")], "l string")
    assert [r[0] for r in df.select(L.label_code("l", names)).collect()] == ["gsw", "en", "sv", None]


def test_counts_don_t_depend_on_chunks(filters, monkeypatch):
    parts = [s for _, t in make(5, 10) for *_, s in L.sentences(t)]
    one = filters.counts(parts)
    monkeypatch.setattr(L, "CHUNK", 50)
    assert np.allclose(one[0], filters.counts(parts)[0]) and np.allclose(one[1], filters.counts(parts)[1])


def test_filters_hold_all_languages_of_a_gram():
    gram = lambda t: np.unique(L.grams([t])[0])
    a, b = np.union1d(gram("same"), gram("xyz")), np.union1d(gram("same"), gram("uvw"))
    known = np.union1d(a, b)
    f = L.Filters.of(["a", "b"], known, [(np.isin(known, a) + 2 * np.isin(known, b)).astype(np.uint64)])
    assert f.counts(["same"])[0].min() > 3
    assert f.counts(["uvw"])[0].argmax() == 1


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("de", "German", " EN_gb", "pt-BR", "deu", "unknown", "", None, "xx", "mul", "n/a")], "l string")
    assert [r[0] for r in df.select(L.label_code("l")).collect()] == ["de", "de", "en", "pt", "de", None, None, None, None, None, None]


def test_in_spark(spark):
    docs = [(i, t, c, 1, "x") for i, (c, t) in enumerate(make(7, 40))] + [(900, None, "de", 1, ""), (901, "", None, 1, ""), (902, " ".join(t for _, t in make(8, 150)[:150]), "de", 1, "")]
    df = spark.createDataFrame(docs, "k long, text string, lang string, seg_no int, end string")
    filters = L.learn(df, "k", "text", "lang")
    rows = L.find_languages(df, "k", "text", filters).collect()
    by = {r["k"]: r for r in rows if r["n_segs"] == 1}
    truth = {i: c for i, c in enumerate(c for c in SAMPLES for _ in range(40))}
    assert sum(by[i]["seg_lang"] == c for i, c in truth.items() if i in by) / len(truth) > 0.98
    assert not {900, 901} & {r["k"] for r in rows} and 902 in {r["k"] for r in rows}
    assert L.find_languages(df.limit(0), "k", "text", filters).count() == 0
    assert L.learn(df.limit(0), "k", "text", "lang").languages == []


def test_blanked_without_the_text_around():
    letters = lambda t: ["".join(x.split()) for _, _, x in L.sentences(t)]
    assert letters("この手順はsrc/app.pyを呼ひ出す。次にhttps://a.example/b?c=dて結果を確認して保存する。") == ["この手順はを呼ひ出す。", "次にて結果を確認して保存する。"]
    assert letters("See große/prüfung.py and a_b now.") == ["seeandnow."]
    assert letters("First one. ``` Second one.\nThird one.") == ["firstone.", "secondone.", "thirdone."]
    assert letters("First one.\n```sh\nrun it\n\nLast one.") == ["firstone.", "lastone."]
    assert letters("First one.\n```sh\nrun it\n\nmore\n``` Last `x y` one.") == ["firstone.", "lastone."]
