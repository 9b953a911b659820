"""A labelled text longer than the training budget."""

import random
import zlib

from pyspark.sql import functions as F

from signalloom.llm import quality, toxicity


def test_one_long_text_does_not_switch_the_classifier_off(spark):
    rng = random.Random(9)
    docs, truth = [], {}
    for i in range(400):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randint(10, 60))]
        truth[i] = int(rng.random() < 0.3)
        for _ in range(3 * truth[i]):
            words.insert(rng.randrange(len(words)), rng.choice(["horrible", "dreadful", "ghastly"]))
        docs.append((i, " ".join(words)))
    seen = spark.range(400).where(~quality.held_out(F.col("id")) & (F.pmod(F.xxhash64("id", F.lit("part")), F.lit(3)) < 2))
    first = seen.orderBy(F.xxhash64("id")).first().id
    docs[first] = (first, docs[first][1] * 2000)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")
    model = toxicity.fit(frame, labels, "toxic", sample_chars=100_000)
    held = [r for r in toxicity.score(frame, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held) / len(held) >= 0.9


def test_texts_share_the_budget(spark):
    texts = ["x" * n for n in (10, 500, 3000, 40_000)] + ["".join(chr(97 + i % 26) for i in range(90_000))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.text for r in toxicity._within(rows, 20_000).collect()]
    assert got[:3] == texts[:3] and sum(map(len, got)) <= 20_100 and min(map(len, got[3:])) > 7000
    assert [r.text for r in toxicity._within(rows, 10**6).collect()] == texts
