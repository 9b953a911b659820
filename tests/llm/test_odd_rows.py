"""Long texts, repeated and null ids, other id types, clashing columns, and brute-force versions of what SQL cannot say."""

import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from signalloom.llm import decontaminate, quality, substring, tokenfile, toxicity, urlfilter, warc

WORDS = [f"w{i}" for i in range(200)]


def said(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_contamination_of_a_long_text_without_broadcast(spark):
    rng = random.Random(1)
    long, item = said(rng, 20_000), said(rng, 20)
    docs = [(1, f"{long} {item} {said(rng, 50)}"), (2, long), (3, item), (None, item)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    began = time.time()
    found = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(df, bench, 13, 0).collect()}
    assert time.time() - began < 60
    assert found == {1: (20_070, 20, ["1"]), 2: (20_000, 0, []), 3: (20, 20, ["1"]), None: (20, 20, ["1"])}


def test_decontamination_judges_each_row_by_its_own_text(spark):
    rng = random.Random(2)
    item, clean = said(rng, 20), said(rng, 30)
    rows = [(5, item, 1), (5, clean, 2), (None, item, 3), (None, clean, 4), (None, None, 5), (6, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.key for r in kept.collect()) == [2, 4, 5, 6]
    assert decontaminate.drop_contaminated(df.limit(0), bench).count() == 0


def test_substring_of_string_ids_and_clashing_columns(spark):
    rng = random.Random(3)
    passage = said(rng, 30)
    rows = [("b", f"{said(rng, 9)} {passage}", 1), ("a", f"{passage} {said(rng, 9)}", 2), (None, passage, 3), ("c", None, 4), ("c", "", 5)]
    df = spark.createDataFrame(rows, "doc_id string, text string, spans int")
    cut = substring.cut_repeats(df, 13)
    got = {(r.doc_id, r.spans): r.text for r in cut.collect()}
    assert cut.columns == df.columns
    assert got == {("b", 1): rows[0][1][: -len(passage) - 1], ("a", 2): rows[1][1], (None, 3): passage, ("c", 4): None, ("c", 5): ""}


@pytest.mark.parametrize("window", [2, 13])
def test_substring_of_periodic_texts(spark, window):
    rows = [(i, t) for i, t in enumerate(["a " * 90, "a b " * 40, "b a " * 40 + "c", "a " * 300 + "b", "x " + "a b " * 7, " ".join("abcab" * 9)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = substring.brute_force(rows, window)
    for r in substring.remove_repeats(docs, window).collect():
        assert r.kept_text == b" ".join(want[r.doc_id]).decode()


def test_warc_of_large_payloads_and_clashing_columns(spark, tmp_path):
    rng = random.Random(4)
    large = "".join(chr(rng.randrange(32, 1000)) for _ in range(300_000))
    rows = [(1, "u", large, 7), (2, "u", large, 7), (2, "u", "s", 7), (2, "u", "s", 7), (None, None, large, 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, bytes int")
    folder = f"file://{tmp_path}/warc"
    got = warc.read_warc(warc.write_warc(df, folder), folder, with_payload=True).collect()
    body = large.encode()
    assert len(body) > 4 * warc.READ_BYTES and len(got) == 5
    assert {(r.page_id, r.record_type, r.refers_to, bytes(r.payload)) for r in got} == {
        (1, "revisit", 2, b""), (2, "response", None, body), (2, "response", None, b"s"), (None, "response", None, body)
    }
    assert {r.payload_digest for r in got if r.page_id == 1} == {hashlib.sha1(body).hexdigest()}


def test_token_files_of_repeated_and_null_ids(spark, word_bpe, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_ROWS", 3)
    rng = random.Random(5)
    rows = [(None, said(rng, 3)) for _ in range(9)] + [(7, said(rng, i % 4)) for i in range(30)] + [(i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokenizer = tokenfile.PieceTokenizer(word_bpe)
    want = sorted((-1 if i is None else i, zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, tokenizer.encode_batch([t for _, t in rows], 2), strict=True))
    for name, docs, expected in (("some", df, want), ("none", df.limit(0), [])):
        path = f"file://{tmp_path}/{name}"
        tokenfile.write_tokens(tokenfile.encode_tokens(tokenfile.in_ranges(docs), word_bpe, 2), path)
        got = sorted(tokenfile.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.start)
        assert [-1 if r.doc_id is None else r.doc_id for r in got] == [i for i, _ in expected]
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == expected
        ends = np.cumsum([r.n_tokens for r in got])
        assert all(r.start == end - r.n_tokens and len(r.token_ids) == r.n_tokens for r, end in zip(got, ends, strict=True))


def test_mined_rules_are_all_itemsets_that_qualify(spark):
    rng = random.Random(8)
    urls = [f"http://{rng.choice('abc')}.{rng.choice('xy')}/{rng.choice('pq')}/{rng.choice('rs')}" for _ in range(300)]
    block = lambda u: "//a.x/" in u or u.endswith("/q/s")
    df = spark.createDataFrame([(u, "block" if block(u) else "allow", i) for i, u in enumerate(urls)], "url string, label string, has int")
    rules = {frozenset(r.antecedent): r.confidence for r in urlfilter.mine(df, 0.02, 0.9, least_rows=5).collect()}
    tokens = {r.url: frozenset(r.t) for r in df.select("url", urlfilter.tokens(F.col("url")).alias("t")).distinct().collect()}
    good = {}
    for items in {frozenset(s) for t in tokens.values() for k in range(1, len(t) + 1) for s in itertools.combinations(t, k)}:
        meant = [block(u) for u in urls if items <= tokens[u]]
        if sum(meant) >= 0.02 * len(urls) and sum(meant) / len(meant) >= 0.9:
            good[items] = sum(meant) / len(meant)
    want = {s: c for s, c in good.items() if not any(good.get(s - {x}, -1) >= c for x in s)}
    assert rules == pytest.approx(want) and len(want) > 1


def test_url_filter_of_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "http://a.org/es/1", 0)] * 3 + [(None, None, 0), (None, "http://b.org/en/1", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, host int")
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, [("block", "org/es/")]).collect()), key=str)
    assert got == [(0, "", "", None, "allow"), (0, "b.org", "/en/1", None, "allow")] + [(1, "a.org", "/es/1", "org/es/", "block")] * 3


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(80)]
    y = np.where(np.array([(r < 12).sum() for r in rows]) + rng.normal(size=80) > 3.5, 1.0, -1.0)
    ratios = rng.normal(size=40)
    w, bias = quality.descend(rows, y, ratios, 1.0, 4000)
    x = np.zeros((80, 41))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / np.sqrt(len(r))
    x[:, 40] = 1
    cost = np.where(y > 0, 80 / (y > 0).sum() / 2, 80 / (y < 0).sum() / 2)
    primal = lambda v: v @ v / 2 + (cost * np.maximum(1 - y * (x @ v), 0)).sum()
    found, v, step = np.append(w, bias), np.zeros(41), 0.05
    best = primal(v)
    for k in range(20_000):  # a plain subgradient descent on the dense problem
        slack = 1 - y * (x @ v) > 0
        v = v - step / np.sqrt(k + 1) * (v - ((cost * y * slack)[:, None] * x).sum(axis=0))
        best = min(best, primal(v))
    assert primal(found) <= best * 1.001 + 1e-6


def test_toxicity_scores_equal_a_direct_scorer(spark):
    rng = random.Random(6)
    rows = [(i, said(rng, rng.randint(5, 90)) + (" horrible dreadful" * 3 if i % 3 == 0 else "")) for i in range(300)] + [(301, None), (302, said(rng, 30_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, "toxic")
    plain, both = toxicity._compressor(model.ordinary).compress, toxicity._compressor(model.toxic + model.ordinary).compress
    for r in toxicity.score(df, model).collect():
        data = (dict(rows)[r.doc_id] or "").lower().encode()
        starts = [0, *range(toxicity.STRIDE, len(data) - (toxicity.WINDOW - toxicity.STRIDE), toxicity.STRIDE)]
        saved = sorted((len(plain(data[a : a + toxicity.WINDOW])) - len(both(data[a : a + toxicity.WINDOW])) for a in starts), reverse=True)
        x = (np.array([saved[0], sum(saved) / len(saved), saved[1] if len(saved) > 1 else 0]) - model.center) / model.scale
        assert r.score == pytest.approx(1 / (1 + np.exp(-(x @ model.weights + model.bias))))


def test_stages_of_an_empty_table_and_clashing_columns(spark, tmp_path):
    rng = random.Random(7)
    columns = "doc_id long, text string, lang string, source string, n_chars long, key int, node int, label int, h int"
    rows = [(i, said(rng, 60), "en", "s", 1, 1, 1, 1, 1) for i in range(40)] + [(None, None, None, None, None, None, None, None, None)]
    path = str(tmp_path)
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, said(rng, 15))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    df = spark.createDataFrame(rows, columns)
    for docs in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            out = stage(spark, docs, path)
            assert out.columns == docs.columns and out.count() == docs.count()
        assert corpus_pipeline.STAGES[0][1](spark, docs, path).columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() == docs.count()
