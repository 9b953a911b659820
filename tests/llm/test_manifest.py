"""The Merkle manifest against a plain recursive one, with ties, nulls, sparse ids and arrays of several passes."""

import hashlib
import random
import zlib

import pytest

from signalloom.llm import manifest, registry

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, slot int, own int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row, more=0):
    doc, source, lang, n, text = row
    return h(*map(field, (doc, source, lang, n if n is None else n + more, text)))


def tree(level):
    """(root, path of each leaf): a path has the sibling of each level or None, and whether it stands left."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, a in enumerate(at):
            other = a ^ 1
            paths[i].append((level[other] if other < len(level) else None, bool(a & 1)))
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [a >> 1 for a in at]
    return level[0], paths


def fold(x, path):
    for other, left in path:
        x = h(x) if other is None else h(other, x) if left else h(x, other)
    return x


def brute_force(rows):
    """Sorted rows of the query's result."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own, tops = {}, []
    for g in order:
        ids = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, paths = tree([leaf(r) for r in ids])
        own[g] = top, list(zip(ids, paths))
        tops.append(top)
    if not tops:
        return []
    root, over = tree(tops)
    out = []
    for g, rest in zip(order, over):
        for r, path in own[g][1]:
            full = path + rest
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = fold(leaf(r, int(hit)), full)
            out.append((r[0], leaf(r), own[g][0], root, h(*(x for x, _ in full if x)), folded, folded == root))
    return sorted(out, key=str)


def documents(n, langs, ids):
    rng = random.Random(n)
    return [(i, rng.choice(["a", None]), rng.choice(langs), rng.choice([None, 5, 70]), rng.choice([None, "", f"é {i} text", "same"])) for i in ids]


CASES = {
    "dense": documents(300, ["de", "en", None], range(300)),
    "one group": documents(5, ["en"], range(5)),
    "one row": documents(1, ["en"], [7]),
    "sparse": documents(90, ["en", "Z", "é"], [(-1) ** k * (k * 7919) ** 3 for k in range(90)]),
    "ties": documents(60, ["en", None], [k % 4 for k in range(40)] + [None] * 20) + [(3, None, "en", None, "same")] * 3,
    "ends": documents(9, ["en"], [-(1 << 63), (1 << 63) - 1, 0, -1, 63, 64, -64, -65, 1 << 40]),
}


def run(spark, tmp_path, rows, monkeypatch, slot_bits=10, run_bits=9):
    monkeypatch.setattr(manifest, "SLOT_BITS", slot_bits)
    monkeypatch.setattr(manifest, "RUN_BITS", run_bits)
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["op12_merkle_manifest"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize(("case", "slot_bits", "run_bits"), [*((c, 10, 9) for c in CASES), ("dense", 2, 1), ("ties", 2, 9)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, case, slot_bits, run_bits):
    assert run(spark, tmp_path, CASES[case], monkeypatch, slot_bits, run_bits) == brute_force(CASES[case])


def test_a_group_of_just_a_full_array_and_one_more(spark, tmp_path, monkeypatch):
    rows = [(i, "s", "en" if i < 16 else "fr", 1, "t") for i in range(33)]
    assert run(spark, tmp_path, rows, monkeypatch, 2, 3) == brute_force(rows)


def test_empty(spark, tmp_path, monkeypatch):
    assert run(spark, tmp_path, [], monkeypatch) == []


def test_tampering_is_found_and_nothing_else(spark, tmp_path, monkeypatch):
    rows = [(i, "s", "en", 4, "text") for i in range(200)]
    for r in run(spark, tmp_path, rows, monkeypatch):
        assert r[6] == (zlib.crc32(str(r[0]).encode()) % 7 != 0)


def test_general_fields(spark):
    docs = spark.createDataFrame([(2, "x", 1.5), (1, "x", None), (3, None, 2.0)], "k int, side string, v double")
    got = {r.k: r for r in manifest.build(docs, ["v"], "side", "k").collect()}
    a, b, c = h("-"), h("3:1.5"), h("3:2.0")
    assert {k: r.subroot for k, r in got.items()} == {1: h(a, b), 2: h(a, b), 3: c}
    assert {r.root for r in got.values()} == {h(c, h(a, b))}
    assert [tuple(s) for s in got[1].path] == [(b, False), (c, True)]
