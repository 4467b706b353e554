from __future__ import annotations

import random
import time
from collections import Counter

from changegraph.llm.term_frequency import mark, term_frequency


def test_counts(spark):
    rnd = random.Random(4)
    records = [[rnd.choice(["a", "b", "", None, "hot", "hot"]) for _ in range(rnd.randrange(6))] for _ in range(200)] + [None]
    df = spark.createDataFrame([(r, "x", 1) for r in records], "t array<string>, term string, records int")
    occurrences = Counter(x for r in records if r for x in r if x is not None)
    held = Counter(x for r in records if r for x in set(r) if x is not None)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in term_frequency(df, "t").collect()}
    assert got == {k: (occurrences[k], held[k]) for k in held}


def test_marks_and_empty(spark):
    df = spark.createDataFrame([("one", 1, 1), ("some", 9, 3), ("many", 9, 5)], "term string, occurrences long, records long")
    assert {r["term"]: r["mark"] for r in mark(df, 1000, common=1 / 200).collect()} == {"one": "rare", "some": None, "many": "common"}
    assert term_frequency(spark.createDataFrame([], "t array<string>"), "t").count() == 0


def test_a_record_of_a_million_terms(spark):
    df = spark.range(1).selectExpr("transform(sequence(1, 1000000), x -> cast(x % 400000 as string)) as t")
    begun = time.time()
    got = term_frequency(df, "t").groupBy("occurrences", "records").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(3, 1): 200_000, (2, 1): 200_000} and time.time() - begun < 60
