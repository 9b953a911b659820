"""The pipeline's stages on a small corpus, each against what its operator is for."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from signalloom.llm import registry, simhash

WORDS = [f"w{i}" for i in range(400)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [say(rng.randint(60, 150)) for _ in range(480)]
    junk = range(0, 480, 6)
    for i in junk:
        texts[i] = " ".join(f"{w}###" for w in texts[i].split())
    texts[50] = texts[49]
    passage, item = say(70), say(20)
    texts[61], texts[62] = f"{say(80)} {passage} {say(30)}", f"{say(20)} {passage} {say(90)}"
    texts[71] = f"{say(30)} {item} {say(40)}"
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(500, None, None, None, None), (None, say(50), "en", "s", 9)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i not in junk), 0) for i in range(480)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, set(junk), passage


def test_stages(spark, corpus, byte_bpe):
    path, texts, junk, passage = corpus
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), COLUMNS)
        kept.append({r.doc_id: r for r in docs.collect()})
    ids = [{i for i in x if i is not None and i < 480} for x in kept]
    assert not junk & ids[0] and len(ids[0]) >= 390
    assert ids[0] - ids[1] == {50}
    groups = simhash.brute_force([(i, texts[i]) for i in ids[0]], corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.RADIUS)
    assert ids[1] == {i for i, low in groups.items() if i == low}
    assert passage in kept[2][61].text and passage not in kept[2][62].text and kept[2][62].n_chars == len(kept[2][62].text)
    assert all(kept[2][i].text == texts[i] for i in ids[2] - {62})
    assert ids[2] - ids[3] == {71} and None in kept[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    reference = Tokenizer.from_file(byte_bpe)
    for r in last:
        want = reference.encode(kept[3][r.doc_id].text or "", add_special_tokens=False).ids
        assert list(r.token_ids) == want
        assert r.decoded_sha256 == hashlib.sha256((kept[3][r.doc_id].text or "").encode()).hexdigest()


def test_run_equals_its_stages(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0])
    assert got.count() == len({r.doc_id for r in got.collect()}) > 380
    assert "pipeline" in registry.queries()
