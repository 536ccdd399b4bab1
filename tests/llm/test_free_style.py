"""Operators that SQL can't express, against brute force, round trips and held-out rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from strandloom.llm import near_dedup, registry, token_shards, toxicity, url_filter, wavelet

from tests.llm import helpers

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def shingles(text):
    words = [w for w in SPACE.split((text or "").translate(LOWER)) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_groups(texts):
    """Smallest reachable id of every row."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_copies():
    rng = random.Random(8)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(30, 80))]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    return [None, "", " ", "a b c", "A b  c", "a b", *texts, texts[0], " ".join(f"x{i % 911}" for i in range(40_000))]


@pytest.mark.parametrize("extra", [False, True])
def test_near_dedup_against_brute_force(spark, extra):
    texts = near_copies()
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, f1 string" if extra else "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in near_dedup.groups(df).collect()}
    roots, sizes = brute_groups(texts)
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert [got[i].kept for i in range(len(texts))] == [r == i for i, r in enumerate(roots)]
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(roots)


def test_near_dedup_finds_links_inside_a_family_of_one_template(spark):
    """Texts of sentences from one stock share most shingles but aren't links; 40 have a partner that is one."""
    rng = random.Random(11)
    stock = [" ".join(f"s{i}w{j}" for j in range(10)) for i in range(40)]
    texts = []
    for i in range(1000):
        chosen = sorted(rng.sample(range(40), 29))
        texts.append(" ".join(stock[j] for j in chosen))
        if i < 40:
            gone = rng.sample(chosen[1:-1], 3)
            texts.append(" ".join(stock[j] for j in chosen if j not in gone))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots, _ = brute_groups(texts)
    assert len(texts) - len(set(roots)) >= 30
    got = {r.doc_id: r.component_id for r in near_dedup.groups(df).collect()}
    assert [got[i] for i in range(len(texts))] == roots


def test_near_dedup_null_and_repeated_ids(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (7, text), (9, "else")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.groups(df).collect()), key=str)
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True), (None, None, True)]


def test_near_dedup_of_one_id_with_two_texts(spark):
    """Each text has its own links; copies of one row don't multiply."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "pq")
    rows = [(1, a), (1, b), (7, a + " x"), (8, b + " x"), (9, b + " y"), (9, "something else altogether")] + [(11, a + " z")] * 40 + [(12, a + " z z")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.groups(df).collect())
    assert got == sorted([(1, 1, True), (1, 1, True), (7, 1, False), (8, 1, False), (9, 1, False), (9, 9, True)] + [(11, 1, False)] * 40 + [(12, 1, False)] * 40)
    clash = near_dedup.keep_one(df.selectExpr("*", "1 AS th", "2 AS x_gone", "3 AS gone", "4 AS kept"))
    assert sorted((r.doc_id, r.text) for r in clash.collect()) == sorted([(1, a), (1, b), (9, "something else altogether")])
    assert clash.columns == ["doc_id", "text", "th", "x_gone", "gone", "kept"]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i + 1, i) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7)]
    found = near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def brute_tokens(rows):
    """(doc_id, start, n, crc) of (id, text) rows in order."""
    from tokenizers import Tokenizer

    tokenizer, at, out = Tokenizer.from_file(token_shards.word_bpe()), 0, []
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_shards_round_trip(spark, tmp_path):
    folder = helpers.write(tmp_path, extra=True)
    table = helpers.documents()
    rows = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True), key=lambda r: r[0])
    got = sorted((tuple(r) for r in registry.queries()["op5_token_shards"](spark, folder).collect()), key=lambda r: r[1])
    assert got == brute_tokens(rows)


def test_small_shards_and_null_ids(spark):
    rows = [(None, "first of all"), *((i, f"text {i} it's Ünï " * (i % 9)) for i in range(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shards = token_shards.write_shards(df, token_shards.word_bpe(), shard_tokens=50)
    assert shards.count() > 5
    got = sorted((tuple(r) for r in token_shards.read_documents(shards).collect()), key=lambda r: r[1])
    assert got == brute_tokens(rows)


def test_pieces_equal_the_whole_tokenizer():
    rng = random.Random(3)
    letters = "abzABZéÉñßÿÀ×÷ªµ019.,!?'|<>- \t\ńKİſ中\x00\x1f\x7f\x85’"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["<|startoftext|> a <|ENDOFTEXT|>", "I'LL don't", "T\u0308 H\u0331x J\u030c W\u030a Y\u030a"]
    encoder = token_shards.PieceEncoder(token_shards.word_bpe())
    assert encoder.known_rules
    for lo, ids, sizes in encoder.batches(pa.array(texts)):
        for i, end in enumerate(np.cumsum(sizes)):
            assert encoder.tokenizer.encode(texts[lo + i], add_special_tokens=False).ids == ids[end - sizes[i] : end].tolist()


def test_a_tokenizer_with_other_rules_encodes_whole_texts(tmp_path):
    import json

    with open(token_shards.word_bpe(), encoding="utf-8") as f:
        rules = json.load(f)
    rules["normalizer"]["normalizers"].pop()  # no lower-casing
    (tmp_path / "other.json").write_text(json.dumps(rules))
    encoder = token_shards.PieceEncoder(str(tmp_path / "other.json"))
    assert not encoder.known_rules
    texts = ["Mixed CASE one", "", "it's T\u0308"]
    for _, ids, sizes in encoder.batches(pa.array(texts)):
        assert [len(encoder.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts] == list(sizes)


def test_one_id_with_many_texts(spark):
    rows = [(7, f"text {i % 40} of one id") for i in range(120)] + [(8, "last")]
    shards = token_shards.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), token_shards.word_bpe(), shard_tokens=100)
    got = sorted(tuple(r) for r in token_shards.read_documents(shards).select("start", "doc_id", "n_tokens").collect())
    assert len(got) == len(rows) and got[-1][1] == 8 and got[0][0] == 0
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("n", [0, 1, 1000, 70_000])
def test_wavelet_queries(n, tmp_path):
    ids = np.minimum(np.random.default_rng(n).geometric(0.01, n), 60_000).astype(np.uint32)
    image = wavelet.build(ids, [4, None], np.array([n // 2, n]))
    (tmp_path / "shard").write_bytes(image)
    file = wavelet.WaveletFile.open(str(tmp_path / "shard"))
    assert file.doc_ids == [4, None] and file.ends.tolist() == [n // 2, n]
    assert file.decode().tolist() == ids.tolist()
    for token in (1, 5, 300, 99_999):
        assert file.count(token) == int((ids == token).sum())
        assert file.count(token, n // 3, n // 2) == int((ids[n // 3 : n // 2] == token).sum())
    if n:
        assert [file.access(i) for i in range(0, n, max(1, n // 50))] == ids[:: max(1, n // 50)].tolist()
        assert file.occurrences(300) == np.flatnonzero(ids == 300).tolist()
    with pytest.raises(IndexError):
        file.access(n)


def brute_walk(edges, seeds):
    """Personalised PageRank of (src, dst, w) edges by plain iteration."""
    out, score = {}, dict(seeds)
    for a, _, w in edges:
        out[a] = out.get(a, 0) + w
    for _ in range(400):
        new = {h: 0.15 * s for h, s in seeds.items()}
        for a, b, w in edges:
            new[b] = new.get(b, 0) + 0.85 * score.get(a, 0) * w / out[a]
        score = new
    return score


@pytest.mark.parametrize("hub", [100_000, 2])
def test_host_walks_against_a_direct_version(spark, monkeypatch, hub):
    """A chain of 12 links away from a trusted host, links to a blocked one, and a hub."""
    monkeypatch.setattr(url_filter, "HUB", hub)
    links = [(f"c{i}.x", f"c{i + 1}.x") for i in range(12)] + [("a.y", "bad.z"), ("b.y", "a.y"), ("b.y", "c0.x")] + [("hub.q", f"m{i}.q") for i in range(20)] + [("m3.q", "bad.z")]
    links += [("c9.x", ".".join(["d"] * 6) + ".tail.z")]
    said = {"c0.x": "allow", "bad.z": "block", "hub.q": "allow"}
    hosts = sorted({h for pair in links for h in pair})
    rows = [(h, "".join(f"<a href='http://{b}/p'>" for a, b in links if a == h), said.get(h)) for h in hosts]
    got = url_filter.host_scores(spark.createDataFrame(rows, "host string, html string, verdict string"))
    deep = next(h for h in hosts if h.endswith("tail.z")).split(".")
    steps = [(".".join(deep[i:]), ".".join(deep[i + 1 :])) for i in range(len(deep) - 2)]
    edges = [(a, b, 1.0) for a, b in [*links, *steps, *[(b, a) for a, b in steps]]]
    trust = brute_walk(edges, {"c0.x": 0.5, "hub.q": 0.5})
    distrust = brute_walk([(b, a, w) for a, b, w in edges], {"bad.z": 1.0})
    found = {r.host: (r.trust, r.distrust) for r in got.collect()}
    assert set(found) == {h for h in {*trust, *distrust} if trust.get(h, 0) + distrust.get(h, 0) > 0}
    for h, (t, d) in found.items():
        for x, y in ((t, trust.get(h, 0)), (d, distrust.get(h, 0))):
            assert abs(x - y) <= 0.004 * y + 1e-15, (h, x, y)
    assert "c12.x" in found and "tail.z" in found and found["b.y"][1] > 0


def toxic_rows():
    rng = random.Random(4)
    bad = ["idiot", "moron", "scum", "pathetic", "worthless"]
    rows = []
    for i in range(900):
        words = ["".join(rng.choice(["ka", "lo", "mi", "ter", "sun"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 400))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows_and_misspellings(spark, tmp_path):
    rows = toxic_rows()
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": ["s"] * len(rows)}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "toxic": pa.array([r[2] for r in rows], pa.int32())}), tmp_path / "labels.parquet")
    got = {r.doc_id: r for r in toxicity.op10_toxicity(spark, str(tmp_path)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in rows)
    wrong = [r[0] for r in held if got[r[0]].predicted != r[2]]
    assert len(wrong) <= 0.03 * len(held)
    assert all(r.predicted == (r.score >= 0.7) for r in got.values())
    model = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    odd = spark.createDataFrame([(1, "kalo mi idiott ter sun lo ka"), (2, None), (3, ""), (4, "kalo mi terlo")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert scores[1] > scores[4] and scores[2] == scores[3] < 0.7
    assert [r.doc_id for r in toxicity.not_toxic(odd, model).orderBy("doc_id").collect() if r.doc_id > 1] == [2, 3, 4]


def mix(x):
    x &= 2**64 - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 2**64 - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 2**64 - 1
    return x ^ x >> 31


def brute_buckets(text):
    """The buckets of every word's bag, word by word."""
    bags = []
    for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()):
        word = word.lower()
        padded, bag = b" " + word + b" ", []
        for n in (3, 4, 5):
            for i in range(len(padded) - n + 1):
                h = 0x811C9DC5 + n
                for c in padded[i : i + n]:
                    h = (h ^ c) * 0x01000193 & 2**32 - 1
                bag.append((h ^ h >> 15) & toxicity.BUCKETS - 1)
        power, total = 1, len(word)
        for c in word:
            total += mix((c + 1) * 0x9E3779B97F4A7C15) * power
            power = power * 0xD6E8FEB86659FD93 & 2**64 - 1
        bags.append([*bag, mix(total) & toxicity.BUCKETS - 1])
    return bags


def test_features_and_scores_against_a_direct_version():
    rng = random.Random(6)
    letters = "abzABZ09éñ中 ,.-_\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, "", " ", "a", "ab cd", "x" * 5000, "word " * 3000]
    weight = np.random.default_rng(1).normal(0, 3, toxicity.BUCKETS).astype(np.float32)
    model = toxicity.Model(weight, -0.3)
    for lo, hi, data, offsets in toxicity.blocks(pa.array(texts)):
        bucket, word, first = toxicity.features(data, offsets)
        scores = toxicity.score_block(model, data, offsets)
        for i in range(lo, hi):
            bags = brute_buckets(texts[i])
            assert first[i - lo + 1] - first[i - lo] == len(bags)
            for w, bag in enumerate(bags[:200]):
                assert sorted(bucket[word == first[i - lo] + w].tolist()) == sorted(bag)
            runs = [sum(bags[s : s + toxicity.PASSAGE], []) for s in range(max(1, len(bags) - toxicity.PASSAGE + 1))]
            best = max(float(np.sum(weight[r], dtype=float)) / max(1, len(r)) for r in ([int(x) for x in r] for r in runs)) - 0.3
            assert abs(scores[i - lo] - 1 / (1 + np.exp(-best))) < 1e-9


def test_fit_is_bounded_in_bytes_and_counts_a_repeated_id_once(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(3, "z " * 50)] * 20 + [(6, "y " * 4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, sample_bytes=40_000)
    again = toxicity.fit(docs.dropDuplicates(), labels, sample_bytes=40_000)
    assert model.bias == again.bias and (model.weight == again.weight).all() and model.weight.any()
    assert not toxicity.fit(docs, labels, sample_bytes=1).weight.any()


@pytest.mark.parametrize("size", [1_000_000, 22_500_000])
def test_a_long_text_first_in_the_order_takes_no_place(spark, size):
    """A toxic and a clean text of up to 22.5 MB, each the first of its class by the digest of its id."""
    rows = toxic_rows()
    first = {}
    for c in (0, 1):
        usable = [r[0] for r in rows if r[2] == c and zlib.crc32(str(r[0]).encode()) % 3 != 1]
        first[min(usable, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())] = "filler sun " * (size // 11)
    docs = spark.createDataFrame([(r[0], first.get(r[0], r[1])) for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [r for r in rows if r[2] and r[0] not in first and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(scores[r[0]] >= toxicity.THRESHOLD for r in held) >= 0.95 * len(held) > 40


def test_score_of_one_class_is_flat(spark):
    docs = spark.createDataFrame([(0, "a b"), (2, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (2, 0)], "doc_id long, toxic int")
    assert {r.score < 0.7 for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {True}


@pytest.mark.parametrize("limit", [7, 64, 1000])
@pytest.mark.parametrize("text", ["a bc  d é xyzzy " * 300, "x" * 3000 + " y z " + "q" * 900, " , ", "", "abc"])
def test_a_sample_in_pieces_has_the_features_of_the_whole_text(text, limit):
    data = np.frombuffer(text.encode(), np.uint8)
    bucket, word, first = toxicity.features(data, np.array([0, len(data)]))
    begins = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=first[-1]))])[:-1]
    buckets, firsts = toxicity.sample_of(data, limit)
    assert buckets.tolist() == bucket[np.argsort(word, kind="stable")].tolist()
    assert firsts.tolist() == begins.tolist()
