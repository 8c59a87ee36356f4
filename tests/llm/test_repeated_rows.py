"""Rows that repeat thousands of times, ids and all, cost what they are, not their square."""

from __future__ import annotations

import random

from hearthline.llm import repeats, substring_dedup, suffix_dedup

rnd = random.Random(4)
word = lambda: "".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 9)))


def test_spans_of_repeated_rows_stay_few(spark):
    """5,000 equal rows with an id, 5,000 without: each row gets its own spans, none twice, and all of it goes."""
    passage = [" ".join(word() for _ in range(90)) for _ in range(6)]
    text = " ".join(f"{p} {word()} {word()}" for p in passage)
    other = " ".join(f"{word()} {p}" for p in passage[::-1])
    rows = [(7, text)] * 5000 + [(None, text)] * 5000 + [(8, other), (9, "nothing repeats here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).cache()
    rows = suffix_dedup.keyed(docs)
    spans = suffix_dedup.repeated_spans(rows, 400)
    longest = repeats.with_spans(rows, spans).selectExpr("max(size(starts)) n").first()["n"]
    assert longest <= 100
    for found, size in ((suffix_dedup.remove_repeats(docs), "n_bytes"), (substring_dedup.remove_repeats(docs), "n_words")):
        got = found.groupBy("doc_id", size, "n_removed").count().collect()
        counts = {r["doc_id"]: (r["count"], r[size] == r["n_removed"]) for r in got}
        assert counts[7] == (5000, True) and counts[None] == (5000, True) and counts[8][0] == counts[9][0] == 1 and not counts[9][1]
