"""The ten operators against brute force, round trips and held-out labels, with odd rows and empty tables."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from signalloom.llm import ann, bpe, decontaminate, graph, quality, simhash, substring, tokenfile, toxicity, urlfilter, warc

DOCS = "doc_id long, text string, fp long, n string"
WORDS = [f"w{i}" for i in range(60)]


def texts(seed=1, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 90))) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n:
        words = rng.choice(base).split()
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "changed"
        out.append(("extra " if rng.random() < 0.3 else "") + " ".join(words))
    return out + [None, "", "  \t\n", "one", "One two", "A b C", "word " * 5000]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts()))


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 6), (6, 5), (9, 9), (3, 1), (2, 1), *((i, i + 1) for i in range(100, 160))]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5} | {i: 100 for i in range(100, 161)}
    assert got == want
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("words", "radius", "limit"), [(3, 2, 1024), (3, 2, 2), (5, 3, 1024)])
def test_simhash_equals_brute_force(spark, rows, words, radius, limit):
    rng = random.Random(5)
    got = simhash.near_duplicates(frame(spark, rows + rows[:3]), words, radius, limit).collect()
    assert len(got) == len(rows) + 3 and rng
    assert {r.doc_id: r.component_id for r in got} == simhash.brute_force(rows, words, radius)
    assert simhash.near_duplicates(frame(spark, []), words, radius).count() == 0


def test_bk_forest_finds_all_near_codes():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 30, np.uint64)
    codes = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 60, 6)]))
    bucket = (np.arange(len(codes)) % 3).astype(np.int64)
    found = set()
    for q, n in simhash.BKForest(codes, bucket).within(np.arange(len(codes)), 2):
        found |= set(zip(q.tolist(), n.tolist(), strict=True))
    want = {(i, j) for i in range(len(codes)) for j in range(len(codes)) if bucket[i] == bucket[j] and int(codes[i] ^ codes[j]).bit_count() <= 2}
    assert found == want


def test_fingerprint_by_definition():
    import xxhash

    words = "a b c a b c x".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), seed=42) for i in range(5)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 5)
    assert simhash.fingerprint("A b\tC a B c x ", 3) % (1 << 64) == want
    assert simhash.fingerprint(None, 3) == simhash.fingerprint(" \n", 3) == 0


@pytest.mark.parametrize("window", [13, 5, 50])
def test_substring_equals_brute_force(spark, rows, window):
    got = substring.remove_repeats(frame(spark, rows + rows[5:7]), window).collect()
    assert len(got) == len(rows) + 2
    want = substring.brute_force(rows, window)
    for r in got:
        assert r.kept_text == b" ".join(want[r.doc_id]).decode()
        assert r.n_words - r.n_removed == len(want[r.doc_id])
    assert substring.remove_repeats(frame(spark, []), window).count() == 0


def test_substring_leaves_rows_without_id_and_cuts_in_place(spark, rows):
    docs = frame(spark, [*rows, (None, rows[3][1])])
    got = {r.doc_id: r for r in substring.cut_repeats(docs, 13).collect()}
    assert docs.columns == list(substring.cut_repeats(docs, 13).columns)
    assert got[None].text == rows[3][1] and got[0].text == rows[0][1]


def contaminated_brute(docs, items, window):
    def words(t):
        out, w = [], ""
        for c in (t or ""):
            c = c.lower() if "A" <= c <= "Z" else c
            if c.isascii() and not c.isdigit() and not "a" <= c <= "z":
                out, w = (out + [w] if w else out), ""
            else:
                w += c
        return out + [w] if w else out

    result = {}
    for d, t in docs:
        mine, hit, found = words(t), set(), set()
        for item, it in items:
            ws = words(it)
            n = min(window, len(ws))
            for i in range(len(ws) - n + 1) if n else ():
                for at in range(len(mine) - n + 1):
                    if mine[at : at + n] == ws[i : i + n]:
                        hit |= set(range(at, at + n))
                        found.add(str(item))
        result[d] = (len(mine), len(hit), sorted(found))
    return result


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(n))) for i, n in enumerate([20, 13, 14, 5, 1, 0, 30])]
    items += [(7, None), (8, items[0][1]), (9, "École ÜBER-Straße 12")]
    docs = [(i, " ".join(rng.choice(WORDS[:40]) for _ in range(60))) for i in range(8)]
    docs += [(10 + i, f"start, {t}! End; {t}" if t else t) for i, (_, t) in enumerate(items)]
    docs += [(30, items[0][1].upper()), (31, None), (32, ""), (33, "über straße école über straße 12 École ÜBER Straße 12")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for few in (100_000, 0):
        got = decontaminate.contamination(frame(spark, docs), bench, 13, few).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == contaminated_brute(docs, items, 13)
        assert len(got) == len(docs)
    kept = decontaminate.drop_contaminated(frame(spark, docs), bench)
    assert kept.columns == ["doc_id", "text", "fp", "n"]
    assert decontaminate.contamination(frame(spark, docs), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0


def test_warc_round_trip(spark, tmp_path):
    long = "x" * 1200
    pages = [(1, "http://a/", long), (2, None, long), (3, "http://c/\r\nX: y", "é" * 700), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (9, "u", long), (None, "u", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write_warc(df, folder, archive_bytes=500)
    got = {r.page_id: r for r in warc.read_warc(manifest, folder, with_payload=True).collect()}
    assert len(got) == len(pages) == manifest.groupBy().sum("records").first()[0]
    for page, _, html in pages:
        body = (html or "").encode()
        assert got[page].payload_bytes == len(body) and got[page].payload_digest == hashlib.sha1(body).hexdigest()
        assert bytes(got[page].payload) == (b"" if page in (1, 2) else body)
    assert {p: r.refers_to for p, r in got.items() if r.record_type == "revisit"} == {1: 9, 2: 9}
    assert warc.read_warc(warc.write_warc(df.limit(0), folder), folder).count() == 0


def test_warc_reader_refuses_damage():
    good = warc.make_record(1, "u", "hello", None, "2024-01-01T00:00:00Z")
    assert [r["payload"] for r in warc.read_records(io.BytesIO(good * 3))] == [b"hello"] * 3
    raw = zlib.decompress(good, 31)
    pack = lambda b: (lambda c: c.compress(b) + c.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    for bad in (pack(raw.replace(b"hello", b"hallo")), pack(raw[:-1]), good[:-5], pack(b"WARC/1.1\r\nbroken\r\n\r\n")):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))


def test_bpe_equals_the_library(spark, byte_bpe):
    rng = random.Random(3)
    alphabet = "aaaaab  'strevl\n\té中́ 12XY\U0001f600　\x85\x1c"
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    odd += ["a<|endoftext|>b <|endoftext|>", "a" * 3000, " " * 100, "don't we'll I'm", *(t for t in texts() if t)]
    reference, own = Tokenizer.from_file(byte_bpe), bpe.TrieBPE(byte_bpe)
    want = [e.ids for e in reference.encode_batch(odd, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode_batch(odd)] == want
    assert [own.decode(np.array(x, np.uint32)) for x in want] == [reference.decode(x, skip_special_tokens=False) for x in want] == odd
    docs = frame(spark, [*enumerate(odd[:20]), (None, None)])
    got = {r.doc_id: r for r in bpe.encode(docs, byte_bpe).collect()}
    assert got[None].n_tokens == 0 and len(got) == 21
    for i, t in enumerate(odd[:20]):
        assert list(got[i].token_ids) == want[i]
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode(frame(spark, []), byte_bpe).count() == 0


def test_token_files(spark, word_bpe, tmp_path):
    rng = random.Random(4)
    rows = list(enumerate([*texts(), "Ünïcode ẞ é x y don't 12,3", "<|endoftext|> a", "\x0b\x1c a"]))
    rng.shuffle(rows)
    path = f"file://{tmp_path}/tokens"
    tokenfile.write_tokens(tokenfile.encode_tokens(tokenfile.in_ranges(frame(spark, rows)), word_bpe, 2), path)
    got = sorted(tokenfile.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.doc_id)
    reference, start = Tokenizer.from_file(word_bpe), 0
    for (i, text), r in zip(sorted(rows), got, strict=True):
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.token_ids)) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


@pytest.mark.parametrize(("n", "kind"), [(1500, "plain"), (1500, "norms"), (30, "plain")])
def test_neighbours(spark, n, kind):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(12, 16))
    v = centers[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, 16))
    if kind == "norms":
        v *= rng.uniform(0.5, 1.5, n)[:, None]
    v[5:15] = v[4]
    v = v.astype(np.float32)
    rows = [(i, [float(x) for x in v[i]]) for i in range(n)]
    odd = [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), list_rows=32).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(found) == {i for i in range(n) if i % 20 == 0}
    hits = total = 0
    exact = v.astype(np.float64)
    for q, mine in found.items():
        score = exact @ exact[q]
        order = [i for i in np.lexsort((np.arange(n), -score)) if i != q][:20]
        assert len(mine) == len(order)
        assert [mine[k][1] for k in sorted(mine)] == sorted((mine[k][1] for k in mine), reverse=True)
        assert all(s == pytest.approx(score[i]) for i, s in mine.values()) and q not in {i for i, _ in mine.values()}
        hits, total = hits + len({i for i, _ in mine.values()} & set(order)), total + len(order)
    assert hits / total >= (1 if n == 30 else 0.9)
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "org/")]


def test_url_rules_and_mined_rules(spark):
    pages = [(i, f"http://{'bad' if i % 3 == 0 else 'good'}{i % 2}.com/en/{i}?q=1#f") for i in range(10, 60)]
    pages += [(100, "https://A.Example.COM/en/7x"), (101, None), (102, "no url"), (103, "http://notcom/en/"), (104, "ftp://x.org/"), (105, "://com/en/")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.judge(df, RULES).collect()}
    assert len(got) == len(pages)
    assert (got[100].host, got[100].path, got[100].rule, got[100].verdict) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert (got[101].host, got[101].path, got[101].rule, got[101].verdict) == ("", "", None, "allow")
    assert got[103].rule is None and got[104].rule == "org/" and got[105].rule == "com/en/"
    assert urlfilter.judge(df.limit(0), RULES).count() == 0


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(8)
    urls = [f"http://{rng.choice(['a', 'b', 'c'])}.{rng.choice(['x', 'y'])}/{rng.choice(['p', 'q'])}/{rng.choice(['r', 's'])}" for _ in range(300)]
    label = lambda u: "block" if "//a.x/" in u or u.endswith("/q/s") else "allow"
    df = spark.createDataFrame([(u, label(u)) for u in urls], "url string, label string")
    rules = [set(r.antecedent) for r in urlfilter.mine(df, 0.01, 0.95).collect()]
    assert rules
    tokens = {r.url: set(r.t) for r in df.select("url", urlfilter.tokens(df["url"]).alias("t")).distinct().collect()}
    for rule in rules:
        meant = [label(u) == "block" for u in urls if rule <= tokens[u]]
        assert len(meant) >= 3 and sum(meant) / len(meant) >= 0.95
    fired = {r.url for r in urlfilter.apply_rules(df, urlfilter.mine(df, 0.01, 0.95), 0.95).collect()}
    assert fired == {u for u in urls if any(rule <= tokens[u] for rule in rules)}


def labelled(spark, mark, n=400):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(10, 60))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(mark))
        docs.append((i, " ".join(words)))
        labels.append((i, y, y))
    docs += [(n, None), (n + 1, ""), (None, "stray"), (3, docs[3][1])]
    return frame(spark, docs), spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int"), dict((a, b) for a, b, _ in labels)


@pytest.mark.parametrize(("module", "name"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, module, name):
    docs, labels, truth = labelled(spark, ["horrible", "dreadful", "ghastly"])
    model = module.fit(docs, labels, name)
    got = module.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = [(r.score >= 0.5) == bool(truth[r.doc_id]) for r in held]
    assert sum(right) / len(right) >= 0.9
    blank = module.fit(docs, labels.limit(0), name)
    assert {r.score for r in module.score(docs, blank).collect()} == {0.5}
    assert module.score(docs.limit(0), model).count() == 0
