"""Merkle audit, packing, suffix dedup, SimHash, toxicity and language ID against brute force."""

import gzip
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from covarium.llm import language_id, merkle, packing, simhash, suffix_dedup, toxicity


def docs(spark, rows, empty=False):
    data = [] if empty else [(i, t, None, "s", 7, "k", 1) for i, t in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, x_id int, kept string, count int")


# --- Merkle fixity

def pages(spark, n=60):
    rows = [(i, f"http://h/{i}" if i % 7 else None, "é" * (i * 13 % 400) if i % 11 else None, "extra") for i in range(n)] + [(None, "http://n", "x", "e"), (5, "http://h/5", "x", "e")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, sha256 string")


@pytest.mark.parametrize("size", [(64, 2), (1 << 16, 16)])
def test_audit(spark, size):
    from pyspark.sql import functions as F

    a = merkle.index(pages(spark), 25).persist()
    assert a.count() == 62
    where = defaultdict(int)
    for r in a.orderBy("archive", "offset").collect():  # offsets are contiguous
        assert r.offset == where[r.archive]
        where[r.archive] += r.length
    b = a.where("coalesce(page_id, 0) <> 13").withColumn("sha256", F.when(F.col("page_id").isin(20, 40), "00").otherwise(F.col("sha256")))
    extra = a.where("page_id = 30").withColumn("offset", F.lit(10**6).cast("long"))
    got = {(r.archive, r.offset): r for r in merkle.audit(a, b.unionByName(extra), *size).collect()}
    assert len(got) == 63
    status = Counter(r.status for r in got.values())
    assert status == {"ok": 59, "corrupt": 2, "missing": 1, "extra": 1}
    assert {r.page_id for r in got.values() if r.status == "corrupt"} == {20, 40} and {r.page_id for r in got.values() if r.status == "missing"} == {13}
    assert all(r.sha256_a == r.sha256_b for r in got.values() if r.status == "ok")
    same = merkle.audit(a, a, *size)
    assert {r.status for r in same.collect()} == {"ok"} and same.count() == 62
    assert merkle.audit(a.limit(0), a.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F

    p = pages(spark, 10).where("page_id is not null and page_id <> 5")
    want = {(r.offset, r.length, r.sha256) for r in merkle.index(p, 100).collect()}
    texts = [r.t for r in p.orderBy("page_id").select(merkle.record_text(F.col("page_id"), F.col("url"), F.col("html")).alias("t")).collect()]
    (tmp_path / "a.warc").write_bytes("".join(texts).encode())
    got = merkle.read_archives(spark, f"file://{tmp_path}/a.warc").collect()
    assert {(r.offset, r.length, r.sha256) for r in got} == want
    members = [gzip.compress(t.encode()) for t in texts]
    (tmp_path / "b.warc.gz").write_bytes(b"".join(members))
    packed = sorted(merkle.read_archives(spark, f"file://{tmp_path}/b.warc.gz").collect(), key=lambda r: r.offset)
    assert [r.length for r in packed] == [len(m) for m in members] and [r.sha256 for r in packed] == [hashlib.sha256(m).hexdigest() for m in members]
    assert [r.record_id for r in packed] == [r.record_id for r in sorted(got, key=lambda r: r.offset)]
    torn = b"".join(members)[:-9]
    assert sum(n for _, n, *_ in merkle.parse_archive(torn)) == len(torn)
    assert list(merkle.parse_archive(b"")) == [] and len(list(merkle.parse_archive("".join(texts).encode()[:-9]))) == len(texts)


# --- packing

def naive_pack(lengths, capacities):
    """Best fit by looking at every open bin."""
    left, bins, of = sum(lengths), [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        w = lengths[i]
        room = [(c - u - w, b) for b, (c, u) in enumerate(bins) if c - u >= w]
        if room:
            b = min(room)[1]
        else:
            c = min((c for c in capacities if c >= w), key=lambda c: (packing.cost(c) / min(c, left), c))
            b = len(bins)
            bins.append((c, 0))
        bins[b] = (bins[b][0], bins[b][1] + w)
        of[i] = b
        left -= w
    return sorted((min(c for c in capacities if c >= u), u) for _, u in bins)


def test_pack_equals_a_naive_best_fit():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 400):
        for capacities in ((64,), (16, 32, 64), packing.CAPACITIES):
            lengths = rng.integers(1, capacities[-1] + 1, n).tolist()
            of, size = packing.pack(lengths, capacities)
            used = np.bincount(of, weights=lengths).astype(int).tolist()
            assert sorted(zip(size, used)) == naive_pack(lengths, capacities)


def test_shards_hold_pieces_of_long_texts_and_rows_without_ids(spark):
    rows = [(None, "w " * 3000)] * 60 + [(i, "short text") for i in range(20)]
    got = packing.best_fit(spark.createDataFrame(rows, "doc_id long, text string"), capacities=(10, 100), shard_pieces=200).collect()
    shards = {}
    for r in got:
        shards[r.bin_id.split("-")[0]] = shards.get(r.bin_id.split("-")[0], 0) + r.n_pieces
    assert sum(shards.values()) == 60 * 31 + 20 and max(shards.values()) < 300


def test_pack_fills_bins():
    rnd = random.Random(2)
    for _ in range(30):
        lengths = [rnd.choice([1, 5, 64, 500, 512, 513, 4000, 8192, rnd.randint(1, 8192)]) for _ in range(rnd.randint(1, 400))]
        of, size = packing.pack(lengths)
        used = Counter()
        for b, w in zip(of, lengths):
            used[b] += w
        assert set(of) == set(range(len(size)))
        for b, c in enumerate(size):
            assert used[b] <= c and c in packing.CAPACITIES and not any(x < c and used[b] <= x for x in packing.CAPACITIES)
        if len(lengths) > 200:
            assert sum(size) <= 1.12 * sum(lengths)


def test_best_fit(spark):
    rows = [(i, "w " * (i % 700)) for i in range(900)] + [(1000, "w " * 20_000), (1001, None), (1002, ""), (None, "a b"), (1003, "x"), (1003, "x"), (1004, "  \n")]
    got = packing.best_fit(docs(spark, rows), shard_pieces=300).collect()
    pieces = [(i, s, n) for r in got for i, s, n in zip(r.doc_ids, r.starts, r.lengths)]
    assert all(sum(r.lengths) == r.used <= r.capacity and len(r.doc_ids) == r.n_pieces for r in got)
    total = Counter()
    for i, _, n in pieces:
        total[i] += n
    want = Counter()
    for i, t in rows:
        import re

        want[i] += len(re.findall(r"[^ \t\n\x0b\f\r]+", t or "")) + 1
    assert total == want and len({r.bin_id for r in got}) == len(got)
    assert sorted((s, n) for i, s, n in pieces if i == 1000) == [(0, 8192), (8192, 8192), (16384, 3617)]
    assert packing.best_fit(docs(spark, [], True)).count() == 0


# --- suffix dedup

def brute_repeats(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        gone = gone[: len(t)]
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("blocks", [suffix_dedup.BLOCKS, 2])
def test_repeats(spark, blocks):
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("abcdeéü ") for _ in range(n))
    source, passage = text(3000), text(520)
    rows = []
    for i in range(24):
        a = rnd.randint(0, 2200)
        rows.append((i, text(rnd.randint(0, 200)) + source[a : a + rnd.randint(100, 800)] + text(rnd.randint(0, 300))))
    rows += [(100 + i, text(rnd.randint(0, 300)) + passage + text(rnd.randint(0, 300))) for i in range(20)]
    rows += [(200, None), (201, ""), (202, "a" * 399), (203, "ab" * 700), (204, passage[:399]), (205, source), (206, rows[0][1]), (206, rows[0][1]), (None, passage), (207, "z" * 401)]
    got = sorted(map(tuple, suffix_dedup.repeats(docs(spark, rows), blocks_a_task=blocks).collect()), key=str)
    assert got == sorted(brute_repeats(rows), key=str)
    assert suffix_dedup.repeats(docs(spark, [], True)).count() == 0


def test_colliding_symbols_do_not_make_strings_equal(spark, monkeypatch):
    """With hashes of three bits nearly every symbol collides; what repeats is the same."""
    rng = np.random.default_rng(9)
    word = lambda n: bytes(rng.integers(97, 101, n).astype(np.uint8))
    shared = [word(500), word(900)]
    texts = [word(300) + shared[0] + word(200), shared[0] + word(100), word(450), shared[1] * 2, word(10) + shared[1][:450] + word(40), word(400)]
    want = [w.tolist() for w in suffix_dedup.merged_runs(texts)]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    assert want == [[seen[t[i : i + 400]] > 1 for i in range(len(t) - 399)] for t in texts]
    exact = suffix_dedup.Rolling.of
    monkeypatch.setattr(suffix_dedup.Rolling, "of", lambda self, a, b, by=suffix_dedup._M1: exact(self, a, b, by) & np.uint64(7))
    assert [w.tolist() for w in suffix_dedup.merged_runs(texts)] == want
    monkeypatch.setattr(suffix_dedup, "CHUNK", 150)  # runs are compared a few at a time
    assert [w.tolist() for w in suffix_dedup.merged_runs(texts)] == want


def test_blocks_of_pieces():
    """A text that is scanned in pieces gives the same starts."""
    rng = np.random.default_rng(0)
    t = bytes(rng.integers(97, 101, 9000, dtype=np.uint8))
    whole, old = suffix_dedup.blocks([b"short", t]), suffix_dedup.CHUNK
    try:
        suffix_dedup.CHUNK = 1000
        cut = suffix_dedup.blocks([b"short", t])
    finally:
        suffix_dedup.CHUNK = old
    starts = lambda b: sorted((int(k), int(c)) for lo, hi, c in zip(b[1], b[2], b[4]) for k in range(lo, hi + 1))
    assert starts(whole) == starts(cut) and len(starts(cut)) == 8601


# --- SimHash

def brute_print(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(prints):
    root = list(range(len(prints)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_near_classes(spark, monkeypatch):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(12):
        base = [rnd.choice(words) for _ in range(400)]
        for _ in range(6):
            own = list(base)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(400)] = rnd.choice(words)
            rows.append((len(rows), " ".join(own)))
    rows += [(900, None), (901, " \t\n"), (902, "One two"), (903, "one two"), (904, "ONE TWO"), (905, "one two three"), (906, "w " * 200_000), (906, "w " * 200_000), (None, "one two")]
    prints = [brute_print(t) for _, t in rows]
    root = classes(prints)
    least = defaultdict(lambda: 10**9)
    for (i, _), r in zip(rows, root):
        least[r] = min(least[r], i if i is not None else 10**9)
    want = sorted(((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, root)), key=str)
    assert sorted(map(tuple, simhash.near_classes(docs(spark, rows)).collect()), key=str) == want
    monkeypatch.setattr(simhash, "BUCKET_NODES", 2)  # dealt by node pairs
    assert sorted(map(tuple, simhash.near_classes(docs(spark, rows)).collect()), key=str) == want
    assert simhash.near_classes(docs(spark, [], True)).count() == 0


def test_trie_links(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(simhash, "FRONTIER", 300)
    for sides in (1, 2):
        rest = np.unique(np.concatenate([int(rng.integers(0, 1 << 48)) ^ (1 << rng.integers(0, 48, 40).astype(np.uint64)) ^ (1 << rng.integers(0, 48, 40).astype(np.uint64)) for _ in range(4)]).astype(np.uint64))
        rng.shuffle(rest)
        side, group = rng.integers(0, sides, len(rest)), rng.integers(0, 3, len(rest))
        order = np.lexsort((rest, side, group))
        rest, side, group = rest[order], side[order], group[order]
        a, b = simhash.trie_links(rest, group, side)
        root = simhash._roots(len(rest), a, b)
        i, j = np.triu_indices(len(rest), 1)
        one = np.array([len(set(side[group == g])) == 1 for g in range(3)])
        ok = (group[i] == group[j]) & (one[group[i]] | (side[i] != side[j])) & (np.bitwise_count(rest[i] ^ rest[j]) <= 3)
        assert np.array_equal(simhash._roots(len(rest), i[ok], j[ok]), root)


# --- classifiers

def test_toxicity(spark):
    rnd = random.Random(6)
    words = [f"plain{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(500):
        bad = i % 4 == 0
        w = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        if bad:
            w.insert(rnd.randrange(len(w)), "vile" + rnd.choice(["st", "r", "", "ness"]))
        rows.append((i, " ".join(w), "en" if i % 2 else "de"))
        labels.append((i, 1, int(bad)))
    data = spark.createDataFrame([*rows, (900, None, None), (901, "", "xx"), (902, "VILEST plain3", "en"), (902, "VILEST plain3", "en"), (None, "plain5", "de")], "doc_id bigint, text string, lang string")
    label = spark.createDataFrame([*labels, (7, 0, None), (None, 0, 1), (12345, 0, 1)], "doc_id bigint, quality int, toxic int")
    model, cuts = toxicity.train(data, label)
    got = toxicity.scores(data, model, cuts).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == 505 and len(held) > 80
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.predicted for r in got if r.doc_id == 902} == {1} and next(r for r in got if r.doc_id == 900).score == next(r for r in got if r.doc_id == 901).score
    left = toxicity.drop_toxic(data, label)
    assert left.columns == data.columns
    gone = {r.doc_id for r in got} - {r.doc_id for r in left.collect()}
    assert 100 < len(gone) < 140 and 902 in gone
    assert toxicity.scores(data.limit(0), model, cuts).count() == 0
    nothing, c = toxicity.train(data, label.limit(0))
    assert toxicity.scores(data, nothing, c).where("predicted = 1").count() == 0


def test_toxicity_learns_from_all_rows(spark):
    """Kinds of words that few rows have, more rows than the driver fits, and marks that only long texts have."""
    rnd = random.Random(9)
    words = [f"{rnd.randrange(1 << 30):x}" for _ in range(300)]
    kinds = [f"{rnd.randrange(1 << 30):x}vile" for _ in range(40)]
    rows, labels = [], []
    for i in range(1600):
        w = [rnd.choice(words) for _ in range(rnd.randint(5, 30))]
        if i % 4 == 0:
            w.insert(rnd.randrange(len(w)), kinds[i // 4 % 40])
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(i % 4 == 0)))
    data = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model, cuts = toxicity.train(data, spark.createDataFrame(labels, "doc_id bigint, toxic int"), train_rows=150)
    held = [r for r in toxicity.scores(data, model, cuts).collect() if r.held_out]
    assert np.mean([r.predicted for r in held if r.doc_id % 4 == 0]) > 0.9 and np.mean([r.predicted for r in held if r.doc_id % 4]) < 0.05
    assert set(cuts) == {None, "en"}

    filler = " ".join(rnd.choice(words) for _ in range(4000))
    some = [(i, f"{filler} {kinds[i % 2]}" if i % 2 else filler[: rnd.randint(20_500, 30_000)], "en") for i in range(80)]
    model, _ = toxicity.train(spark.createDataFrame(some, data.schema), spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id bigint, toxic int"))
    assert model.out.any()  # only long texts are labelled: something was learnt from them


def test_toxicity_long_text(monkeypatch):
    model = toxicity.TextCnn()
    t = b" ".join(b"w%d" % (i * i % 97) for i in range(5000))
    want = model.logits([t, b""])
    monkeypatch.setattr(toxicity, "BLOCK", 700)
    assert np.allclose(model.logits([t, b""]), want, atol=1e-4)


def naive_logit(model, text):
    """The classifier word by word."""
    ids, n = toxicity.word_ids([text])
    vectors = [model.emb[row].sum(axis=0) for row in ids] + [np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)
    pooled = []
    for w, c in zip(toxicity.WIDTHS, model.conv):
        pooled += list(np.max([sum(vectors[at + j] @ c[j] for j in range(w)) for at in range(n[0] + 1)], axis=0))
    return float(np.maximum(np.array(pooled) + model.bias, 0) @ model.out + model.base[0])


def test_toxicity_forward_and_gradient(monkeypatch):
    """A forward pass by loops, and backpropagation against finite differences."""
    rng = np.random.default_rng(3)
    texts = [b"one two three four", b"", b"two", "äh two one".encode(), b"five six seven one two"]
    model = toxicity.TextCnn(seed=5)
    model.emb, model.conv, model.bias, model.out, model.base = model.emb.astype(float), [c.astype(float) for c in model.conv], rng.normal(size=len(model.bias)), model.out.astype(float), model.base.astype(float)
    assert np.allclose(model.logits(texts), [naive_logit(model, t) for t in texts], atol=1e-9)
    y, (ids, n) = np.array([1.0, 0, 1, 0, 1]), toxicity.word_ids(texts)

    def loss():
        z = np.array([naive_logit(model, t) for t in texts])
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    params = [model.emb, *model.conv, model.bias, model.out, model.base]
    for w, grad in zip(params, model.gradients(ids, n, y)):
        places = [(r, k) for r in ids[:4].ravel() for k in (0, 7)] if w is model.emb else [tuple(rng.integers(0, k) for k in w.shape) for _ in range(15)]
        for place in places:
            old, both = w[place], []
            for step in (1e-6, -1e-6):
                w[place] = old + step
                both.append(loss())
            w[place] = old
            assert abs((both[0] - both[1]) / 2e-6 - grad[place]) < 1e-6, place


def test_best_cut():
    score, y = np.array([0.9, 0.8, 0.2]), np.array([1.0, 1, 0])
    assert toxicity.best_cut(score, y, cases=1) == pytest.approx(0.5)
    assert toxicity.best_cut(score, y) == toxicity.CUT  # too few rows to calibrate by
    assert toxicity.best_cut(np.array([0.9, 0.8, 0.7, 0.2]), np.array([0.0, 0, 0, 1]), cases=1) == toxicity.CUT


def test_gru_gradient():
    """Backpropagation through time against finite differences."""
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 5, (6, language_id.WINDOW)).astype(np.int16), rng.integers(0, 3, 6)
    g = language_id.ByteGru(["a", "b", "c"])
    for name in ("inp", "rec", "out", "base"):
        setattr(g, name, getattr(g, name).astype(np.float64))

    def loss():
        p = g._position_probabilities(x)
        return -np.log(p[:, np.arange(6), y]).mean()

    for name, grad in zip(("inp", "rec", "out", "base"), g.gradients(x, y)):
        w = getattr(g, name)
        for place in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(12)] if name != "inp" else [(d, k, j) for d in (0, 1) for k in range(5) for j in (0, 9, 20)]:
            old, both = w[place], []
            for step in (1e-5, -1e-5):
                w[place] = old + step
                both.append(loss())
            w[place] = old
            assert abs((both[0] - both[1]) / 2e-5 - grad[place]) < 1e-6, (name, place)


def test_languages(spark):
    from pyspark.sql import functions as F

    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(data)
    got = language_id.languages(data, model).alias("g").join(data.select(F.col("doc_id").alias("i"), "lang"), F.col("doc_id") == F.col("i")).where("held_out").collect()
    assert len(got) > 150 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    by_lang = {}
    for r in got:
        by_lang.setdefault(r.lang, []).append(r.lang == r.lang_pred)
    assert len(by_lang) > 3 and all(np.mean(v) > 0.9 for k, v in by_lang.items() if k), by_lang
    odd = docs(spark, [(1, None), (2, ""), (3, "12 34 !"), (4, "é"), (None, "the and of"), (5, "the quick " * 50_000)])
    rows = {r.doc_id: r for r in language_id.languages(odd, model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[4].lang_pred in model.langs and 0 < rows[5].score <= 1
    assert language_id.languages(odd.limit(0), model).count() == 0
    assert language_id.train(odd) is None and {r.lang_pred for r in language_id.languages(odd, None).collect()} == {"und"}


def test_language_sample(spark, monkeypatch):
    """An id on many texts, equal rows and long texts keep the sample bounded; too many languages are an error."""
    rows = [(1, f"text number {i}", "en") for i in range(50)] + [(2, "equal rows", "en")] * 50 + [(3, "sehr lang " * 20_000, "de")] + [(4, None, "de"), (None, "no id", "de")]
    data = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    seen = []
    monkeypatch.setattr(language_id.ByteGru, "fit", lambda self, x, y: (seen.append((len(x), self.langs, y.tolist())), self)[1])
    language_id.train(data, per_lang=10)
    (n, langs, y), = seen
    assert langs == ["de", "en"] and y.count(0) == language_id.WINDOWS_A_DOC and 10 <= y.count(1) <= 11
    monkeypatch.setattr(language_id, "MAX_LANGS", 1)
    with pytest.raises(ValueError):
        language_id.train(data)


def test_gru_groups(monkeypatch):
    g = language_id.ByteGru(["a", "b"])
    texts = [b"x" * 700, b"", b"hello", b"y" * 64, bytes(range(97, 123)) * 40]
    want = g.probabilities(texts)
    monkeypatch.setattr(language_id, "LANES", 1)
    assert np.allclose(g.probabilities(texts), want, atol=1e-5)
