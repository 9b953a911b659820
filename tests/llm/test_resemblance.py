"""Near duplicates of the pipeline against brute-force Jaccard."""

import random

import corpus_pipeline
from signalloom.llm import resemblance

WORDS = [f"w{i}" for i in range(300)]


def near_copies():
    rng = random.Random(11)
    base = [[rng.choice(WORDS) for _ in range(rng.randint(80, 160))] for _ in range(40)]
    line = [rng.choice(WORDS) for _ in range(40)]
    texts = [" ".join(words + line) for words in base]
    for words in base[:30] + [base[0]] * 25:
        copy = words + line
        for at in rng.sample(range(len(copy)), rng.choice((1, 2, 3, 8))):
            copy = [*copy[:at], f"new{rng.randrange(10**6)}", *copy[at + 1 :]]
        texts.append(" ".join(copy))
    return [*enumerate(texts + [None, "", "one", "One", "one two"] + texts[3:5])]


def test_all_near_copies_and_no_others(spark):
    rows = near_copies()
    want, pairs = resemblance.brute_force(rows, 5, 0.8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in resemblance.near_duplicates(docs).collect()}
    assert pairs > 60 and got == want
    assert resemblance.near_duplicates(docs.limit(0)).count() == 0
    kept = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    assert kept == {i for i, low in want.items() if i == low}


def test_pivot_rounds_change_nothing(spark, monkeypatch):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(resemblance, "CROSS_PER_ROW", 0)
    got = {r.doc_id: r.component_id for r in resemblance.near_duplicates(docs, radius=0).collect()}
    assert got == resemblance.brute_force(rows, 5, 0.8)[0]


def test_hot_shingles_change_nothing(spark, monkeypatch):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(resemblance, "HOT", 3)
    got = {r.doc_id: r.component_id for r in resemblance.near_duplicates(docs, radius=0).collect()}
    assert got == resemblance.brute_force(rows, 5, 0.8)[0]


def test_each_row_is_judged_by_its_own_text(spark):
    x, y = " ".join(WORDS[:40]), " ".join(WORDS[50:90])
    rows = [(5, x, 1), (5, y, 2), (3, y, 3), (3, y, 4), (None, x, 5), (None, "alone " * 9, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    kept = resemblance.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "alone " * 9), (3, y), (5, x)]
    assert resemblance.drop_near_duplicates(docs.limit(0)).count() == 0


def test_small_groups_of_near_copies_cost_their_size(spark, monkeypatch):
    rng, rows, pairs, write = random.Random(5), [], [], resemblance.materialize
    for g in range(12):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(14):
            copy = list(base)
            copy[rng.randrange(120)] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))

    def counted(df, name):
        out = write(df, name)
        pairs.extend([out.count()] if name == "pairs" else [])
        return out

    monkeypatch.setattr(resemblance, "materialize", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in resemblance.near_duplicates(docs, radius=0).collect()}
    assert got == {i: i - i % 14 for i in range(len(rows))}
    assert sum(pairs) < 3 * len(rows)  # all pairs are 6.5 a row


def test_only_what_a_result_reads_stays_on_disk(spark):
    import os
    import re

    from signalloom.llm import common, substring

    def left(make):
        root = common.scratch_root(spark).removeprefix("file://")
        before = set(os.listdir(root))
        out = make(spark.createDataFrame(near_copies(), "doc_id long, text string"))
        return {re.sub(r"-[0-9a-f]{32}$", "", x) for x in set(os.listdir(root)) - before}, out

    names, kept = left(resemblance.drop_near_duplicates)
    assert {"signatures", "gone"} <= names and not names & {"nodes", "sets", "pairs", "held", "mixed", "members", "groups"}
    assert kept.count() > 0
    names, cut = left(substring.cut_repeats)
    assert names == {"spans"} and cut.count() == len(near_copies())


def test_texts_of_one_template_are_not_compared_in_pairs(spark, monkeypatch):
    """They share many sketched shingles and none of their rarest ones, so their pairs do not go with the square."""
    rng, rows, pairs, write = random.Random(8), [], [], resemblance.materialize
    form = [f"t{i}" for i in range(90)]
    for i in range(160):
        rows.append((i, " ".join(form + [f"own{rng.randrange(10**6)}" for _ in range(60)])))
    rows.append((160, rows[7][1] + " more"))

    def counted(df, name):
        out = write(df, name)
        pairs.extend([out.count()] if name == "pairs" else [])
        return out

    monkeypatch.setattr(resemblance, "materialize", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in resemblance.near_duplicates(docs, radius=0).collect()}
    assert got == {i: 7 if i == 160 else i for i in range(161)}
    assert sum(pairs) < 10 * len(rows)  # all pairs are 80 a row
