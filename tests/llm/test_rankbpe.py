"""BPE by ranks against the library that made the vocabulary's kind, and the perfect hash against a dictionary."""

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from signalloom.llm import rankbpe, registry

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(3)
    letters = "abcdeé ßñ漢字かな 한국어 עברית ́🙂👩‍👩‍👧 \x1c\x85 '’0½²٣\n\t"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return [None, "", " ", "\n\n  x", "don't we'll I'D 's", "<|endoftext|> is text", "�﻿", "a" * 3000, "ab " * 20_000, *made]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300, 5000])
def test_each_key_has_a_slot_of_its_own(n):
    keys = [f"key {i}".encode() for i in range(n)]
    found = rankbpe.MinimalPerfectHash(keys)
    assert sorted(found.slots(keys).tolist()) == list(range(n))
    others = found.slots([b"", b"other"]) if n else np.zeros(0)
    assert ((others >= 0) & (others < max(n, 1))).all()


def test_first_tier_finds_every_entry_and_nothing_else():
    coder = rankbpe.load(PATH)
    entries = [t for t in coder.text if t]
    assert [coder.text[i] for i in coder.find(entries)] == entries
    assert set(coder.find([b"\xff\xfe\xfd", b"zzzzqqqq", b""])) == {-1}


def test_second_tier_equals_repeated_search_of_the_lowest_rank():
    coder, rng = rankbpe.load(PATH), random.Random(8)
    ids = {t: i for i, t in enumerate(coder.text) if t}
    for _ in range(400):
        piece = bytes(rng.choice(b"aeioutnrs \xc3\xa9\xe6") for _ in range(rng.randint(1, 25)))
        parts = [bytes([b]) for b in piece]
        while True:
            ranks = [(ids[a + b], at) for at, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids]
            if not ranks:
                break
            _, at = min(ranks)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert coder.merge(piece) == [ids[p] for p in parts]


def test_a_very_long_word_is_encoded_in_time(reference):
    rng = random.Random(2)
    word = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    began = time.time()
    ids = rankbpe.load(PATH).encode_batch([word])[0].tolist()
    assert time.time() - began < 20
    assert ids == reference.encode_ordinary(word)


def test_equals_the_library_and_decodes_back(spark, reference):
    rows = list(enumerate(odd_texts())) + [(None, "no id"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, n_tokens int, code string")
    coded = rankbpe.encode(docs, PATH)
    got = sorted((str(r.doc_id), r.n_tokens, list(r.token_ids)) for r in coded.collect())
    want = sorted((str(i), len(x), x) for i, x in ((i, reference.encode_ordinary(t or "")) for i, t in rows))
    assert got == want
    back = {r.doc_id: bytes(r.decoded) for r in rankbpe.decode(coded.where("doc_id > 5"), PATH).collect()}
    assert back == {i: (t or "").encode() for i, t in rows if i is not None and i > 5}
    for r in rankbpe.digests(docs, PATH).where("doc_id > 5").collect():
        ids = np.array(reference.encode_ordinary(rows[r.doc_id][1] or ""), "<u4")
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id][1] or "").encode()).hexdigest()
    assert rankbpe.digests(docs.limit(0), PATH).count() == 0


def test_another_pattern_and_another_kind_of_file(spark, tmp_path):
    coder = rankbpe.RankBPE(PATH, r"\S+|\s+")
    assert coder.decode(coder.encode_batch(["one two"])[0]) == b"one two"
    (tmp_path / "short").write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        rankbpe.RankBPE(str(tmp_path / "short"))


def test_query(spark):
    got = registry.queries()["op13_rank_bpe"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == 200
