"""The pipeline's near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

import tracemalloc
from pathlib import Path

import numpy as np

import corpus_pipeline
from covarium.llm import base, near_dedup, simhash


def sets_of(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_planted_near_copies(spark):
    rng = np.random.default_rng(7)
    rows, planted, far = [], [], []
    for k in range(150):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((10 * k, " ".join(words)))
        for i, edits in enumerate((1, 3, 4, 12)):
            other = list(words)
            for at in rng.choice(200, edits, replace=False):
                other[at] = f"v{rng.integers(0, 1 << 30)}"
            rows.append((10 * k + 1 + i, " ".join(other)))
            a, b = sets_of(rows[10 * k // 10 * 5][1]), sets_of(rows[-1][1])
            (planted if len(a & b) >= 0.8 * len(a | b) else far).append(rows[-1][0])
    assert len(planted) > 300 and len(far) > 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()}
    assert {10 * k for k in range(150)} <= left
    assert sum(i not in left for i in planted) >= 0.97 * len(planted)
    assert sum(i in left for i in far) >= 0.9 * len(far)


def test_many_near_copies_null_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = []
    for k in range(1500):  # more than a bucket holds
        other = list(base)
        other[rng.integers(0, 120)] = f"v{k}"
        rows.append((k if k % 3 else None, " ".join(other)))
    rows += [(1, "a text of its own under an id that another text has"), (None, "and one more without any id"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()]
    assert sorted(map(str, left)) == sorted(map(str, [rows[1], *rows[1500:1502], left[-1] if left[-1][1] in (None, "") else next(r for r in left if r[1] in (None, ""))]))
    assert corpus_pipeline.near_dedup_stage(spark, docs.limit(0), "").count() == 0


def kept_by_brute_force(rows):
    """Smallest ids of the classes that pairs with a similarity of at least 0.8 form; rows are (id, text)."""
    texts = {i: sets_of(t or "") for i, t in rows}
    ids = sorted(texts)
    root = {i: i for i in ids}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = texts[i], texts[j]
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = root[i], root[j]
                root = {n: min(x, y) if r in (x, y) else r for n, r in root.items()}
    return set(root.values())


def test_stage_keeps_what_brute_force_keeps(spark):
    docs = corpus_pipeline.exact_dedup_stage(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "")
    left = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()}
    assert left == kept_by_brute_force([(r.doc_id, r.text) for r in docs.collect()]) and len(left) < docs.count()


def test_chains_of_near_copies(spark, monkeypatch):
    """A class whose far ends aren't similar: few mates a round, later rounds join the rest."""
    monkeypatch.setattr(near_dedup, "FIRST", (2, 1))
    monkeypatch.setattr(near_dedup, "LATER", (near_dedup.PRINTS, 2))
    rng = np.random.default_rng(5)
    rows = []
    for g in range(3):
        words = [f"g{g}w{x}" for x in rng.integers(0, 5000, 150)]
        for k in range(60):
            rows.append((len(rows), " ".join(words)))
            words[(2 * k + 7) % 150] = f"v{g}-{k}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in near_dedup.keep_one_of_near(docs).collect()}
    assert left == kept_by_brute_force(rows) == {0, 60, 120}


def test_every_pair_at_the_threshold(spark):
    """Pairs of a similarity of exactly 0.8: none may be left to chance."""
    rng, rows = np.random.default_rng(11), []
    for k in range(300):
        words = [f"w{x}" for x in rng.integers(0, 100_000, 184)]
        rows.append((2 * k, " ".join(words)))
        for at in rng.choice(17, 4, replace=False):
            words[10 * at + 7] = f"v{k}-{at}"
        rows.append((2 * k + 1, " ".join(words)))
    a, b = sets_of(rows[0][1]), sets_of(rows[1][1])
    assert 10 * len(a & b) == 8 * len(a | b)
    left = {r.doc_id for r in near_dedup.keep_one_of_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {2 * k for k in range(300)}


def test_large_buckets_lose_no_partner(spark, monkeypatch):
    """Every text has the same passage; buckets are large, are dealt by blocks, and their links go to far neighbours as well."""
    monkeypatch.setattr(near_dedup, "BUCKET_ROWS", 4)
    monkeypatch.setattr(near_dedup, "CELL_ROWS", 16)
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    rng = np.random.default_rng(12)
    passage, rows = [f"p{x}" for x in range(70)], []
    for k in range(240):
        own = np.random.default_rng(k // 3)
        rows.append((k, " ".join(passage + [f"w{x}" for x in own.integers(0, 5000, 20 + k // 3 % 9)] + [f"v{x}" for x in rng.integers(0, 9, 3)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in near_dedup.keep_one_of_near(docs).collect()}
    assert left == kept_by_brute_force(rows) and 60 < len(left) < 240


def test_small_tables_take_few_files(spark, monkeypatch):
    """A file costs processes on its executor, so steps of known size don't write one for each shuffle partition."""
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    files = []

    def counted(df, tag):
        out = base.materialise(df, tag)
        files.append((tag, len(out.inputFiles())))
        return out

    monkeypatch.setattr(near_dedup, "materialise", counted)
    monkeypatch.setattr(simhash, "materialise", counted)
    rng, rows = np.random.default_rng(15), []
    for k in range(120):
        words = [f"w{x}" for x in rng.integers(0, 5000, 60)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "more"]))]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        left = {r.doc_id for r in near_dedup.keep_one_of_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert left == {2 * k for k in range(120)}
    assert all(n == 1 for tag, n in files if tag in ("wanted", "sets", "similar", "edges", "low", "large", "labels")), files


def test_steps_hold_little(spark, monkeypatch, tmp_path):
    """Tables of a step have no checksum files, each of which costs a process as large as its executor; texts go to Python in small batches."""
    monkeypatch.setattr(base, "TEXT_ROWS", 7)
    before, sizes = spark.conf.get(base.ARROW_ROWS), spark.createDataFrame([(i, "a text") for i in range(60)], "doc_id long, text string").coalesce(1)
    sizes = sizes.mapInPandas(lambda batches: (b.assign(doc_id=len(b))[:1] for b in batches), "doc_id long, text string")
    with base.text_batches(spark):
        out = base.materialise(sizes, "few_texts")
    assert spark.conf.get(base.ARROW_ROWS) == before
    assert sum(r.doc_id for r in out.collect()) == 60 and max(r.doc_id for r in out.collect()) <= 7
    folder = Path(out.inputFiles()[0].removeprefix("file://")).parent
    assert list(folder.iterdir()) and not [f for f in folder.iterdir() if f.suffix == ".crc"]


def test_repeated_hashes():
    """Counted without the copies that np.unique makes of all hashes: a stretch takes half of its own size besides."""
    rng = np.random.default_rng(16)
    for n in (0, 1, 2, 3, 50, 4000):
        hashes = rng.integers(0, max(1, n // 3), n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        key, times = np.unique(hashes, return_counts=True)
        found = near_dedup.repeated(hashes.copy())
        assert [x.tolist() for x in found] == [key[times >= near_dedup.LEAST].tolist(), times[times >= near_dedup.LEAST].tolist()]
    hashes = rng.integers(0, 1 << 63, 1_000_000).astype(np.uint64)
    tracemalloc.start()
    near_dedup.repeated(hashes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < hashes.nbytes / 2


def test_rows_equal_in_id_and_text(spark):
    """One row of a class stays, also where the one of the smallest id is there several times; others keep their rows."""
    words = [f"w{x}" for x in range(60)]
    near, alone = " ".join(words), " ".join(reversed(words))
    rows = [(3, near)] * 2 + [(2, f"{near} more")] * 3 + [(None, near)] * 2 + [(7, alone), (7, f"{near} and much " + " ".join(f"v{x}" for x in range(60)))] + [(8, "so"), (8, "so"), (None, "no"), (None, "no")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()]
    assert sorted(left, key=str) == sorted({rows[2], rows[7], rows[8], (8, "so"), (None, "no")}, key=str)
