"""Inputs made to break an operator: patterned words, hosts of many labels, columns with our own names."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from signalloom.llm import decontaminate, resemblance, substring, urlfilter, wordhash


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


PAIRS = [(a, a.translate(str.maketrans("ab", "ba"))) for a in map(thue_morse, (256, 512, 1024, 2048, 4096))]


@pytest.mark.parametrize("pair", range(len(PAIRS)))
def test_patterned_words_have_hashes_of_their_own(pair):
    assert all(len(set(family.tolist())) == 2 for family in wordhash.hashes(pa.array(PAIRS[pair])))


def test_patterned_runs_of_words_have_hashes_of_their_own():
    for a, b in PAIRS:
        for family, h in enumerate(wordhash.hashes(pa.array([*a, *b]))):
            n = len(a)
            found = wordhash.Sums(h, family).runs(np.array([0, n]), np.array([n, 2 * n]))
            assert found[0] != found[1]


def test_equal_runs_have_equal_hashes_wherever_they_stand():
    rng = random.Random(1)
    words = [rng.choice("abcde") for _ in range(400)]
    for family, h in enumerate(wordhash.hashes(pa.array(words))):
        sums = wordhash.Sums(h, family)
        for n in (1, 2, 3, 7, 13, 50):
            start = np.arange(len(words) - n + 1)
            got = sums.runs(start, start + n)
            assert (got == sums.every(n)).all()
            seen = {}
            for i, x in enumerate(got.tolist()):
                assert seen.setdefault(tuple(words[i : i + n]), x) == x
            assert len(set(seen.values())) == len(seen)
        mixed = sums.runs(np.array([0, 5, 7]), np.array([0, 9, 107]))
        assert mixed[1] == sums.every(4)[5] and mixed[2] == sums.every(100)[7]


def test_words_that_a_polynomial_takes_for_equal_are_kept(spark):
    a, b = PAIRS[2]
    same = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{same} {a}"), (2, f"{same} {b}"), (3, f"{same} {a}")]
    got = {r.doc_id: r.n_removed for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 13).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_hosts_of_many_labels_are_mined_in_time(spark):
    deep = ".".join(f"l{i}" for i in range(40)) + ".org"
    rows = [(f"http://h{i % 9}.net/de/{i}", "allow") for i in range(100)] + [(f"http://{deep}/x{i}", "block") for i in range(10)]
    df = spark.createDataFrame(rows, "url string, label string")
    began = time.time()
    rules = urlfilter.mine(df).collect()
    assert time.time() - began < 60
    assert len(rules) == 1 and len(rules[0].antecedent) == 41 and "host:l39.org" in rules[0].antecedent
    fired = {r.url for r in urlfilter.apply_rules(df, urlfilter.mine(df)).collect()}
    assert fired == {u for u, label in rows if label == "block"}


def test_items_are_told_apart_by_pages_without_a_label(spark):
    rows = [(f"http://bad.org/es/{i}", "block") for i in range(20)] + [(f"http://h{i}.net/de/{i}", "allow") for i in range(20)]
    known = spark.createDataFrame(rows, "url string, label string")
    rest = spark.createDataFrame([(f"http://other{i}.com/es/{i}",) for i in range(40)], "url string")
    with_rest = {tuple(r.antecedent) for r in urlfilter.mine(known, background=rest).collect()}
    assert with_rest == {("host:bad.org", "host:org")}
    assert {tuple(r.antecedent) for r in urlfilter.mine(known).collect()} == {("host:bad.org", "host:org", "path:es")}


CLASHING = "doc_id long, text string, n_chars long, __key long, __row long, __s string, __fp long, __packed int, __of int, key string, packed int, `a.b` int"


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, len(t), 77, 78, "s", 79, 80, 81, "k", 82, 83) for i, t in enumerate(texts)], CLASHING)


def test_columns_of_any_name_come_through_the_stages(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(f"v{rng.randrange(500)}" for _ in range(n))
    long, item = say(80), say(20)
    docs = clashing(spark, [long, f"{long} x", f"{say(30)} {long}", item, say(60)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rest = (77, 78, "s", 79, 80, 81, "k", 82, 83)
    kept = resemblance.drop_near_duplicates(docs)
    clean = decontaminate.drop_contaminated(docs, bench)
    cut = substring.cut_repeats(docs)
    for out, ids in ((kept, {0, 2, 3, 4}), (clean, {0, 1, 2, 4}), (cut, {0, 1, 2, 3, 4})):
        assert out.columns == docs.columns and out.schema["__row"].dataType == docs.schema["__row"].dataType
        got = out.collect()
        assert {r.doc_id for r in got} == ids and {tuple(r)[3:] for r in got} == {rest}
    assert {r.doc_id: len(r.text) == r.n_chars for r in cut.collect()} == dict.fromkeys(range(5), True)


def test_letters_whose_lower_case_is_far_away_and_selective_reads(spark, word_bpe, tmp_path):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from signalloom.llm import tokenfile

    texts = [f"A{chr(i)}b {chr(i)} 1{chr(i)}" for i in range(1, 0x260)] + [None, "", "İ", "<|endoftext|> x", "a\x1cb", "漢字 é", "x" * 300_000]
    reference = Tokenizer.from_file(word_bpe)
    reference.no_truncation()
    docs = spark.createDataFrame([(i, t, 5, "f") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, file string")
    coded = tokenfile.encode_tokens(tokenfile.in_ranges(docs), word_bpe, 2)
    got = {r.doc_id: list(r.token_ids) for r in coded.collect()}
    assert got == {i: [*reference.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    path = f"file://{tmp_path}/tokens"
    tokenfile.write_tokens(coded, path)
    some = spark.read.parquet(path).where("doc_id between 10 and 12").select("doc_id", "n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan and "token_ids" not in plan.split("ReadSchema")[1]
    assert {r.doc_id: r.n_tokens for r in some.collect()} == {i: len(got[i]) for i in (10, 11, 12)}
    import glob

    import pyarrow.parquet as pq

    meta = [pq.ParquetFile(f).metadata.row_group(0).column(0) for f in glob.glob(f"{tmp_path}/tokens/*.parquet") if pq.ParquetFile(f).metadata.num_row_groups]
    assert meta and all(c.has_column_index and c.has_offset_index for c in meta)
    assert tokenfile.read_tokens(spark, path).agg(F.max("start")).first()[0] == sum(len(x) for i, x in got.items() if i < len(texts) - 1)
