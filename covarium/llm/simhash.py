"""SimHash near-dedup: fingerprints, a binary-trie self-join on them, and connected classes.

Fingerprints that are equal collapse to one node before anything is joined, so
a group of copies, however large, is one node.  Two 64-bit fingerprints that
differ in at most three bits agree on one of four 16-bit blocks; each node goes
into four tries, one for each block, whose first 16 levels allow no error.
Below them, pairs of trie nodes are walked together: the four pairs of
children follow, a pair of unlike children costs one bit, and a pair over the
budget is pruned.  A trie with many leaves is cut into tries that agree on twelve
more bits, one of four groups of them, and only what is still large is dealt over
tasks by node pairs of the next eight levels, so no task holds an unbounded bucket.  Each task returns
a spanning star for each of its local classes instead of all links; classes are
then joined over tasks by alternating star contractions.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.llm.base import few, materialise, small

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: A bucket with more nodes than this is cut by 12 further bits, then dealt over tasks by pairs of 8-bit prefixes.
BUCKET_NODES = 2048
#: So many node pairs are walked at once; more wait on a stack.
FRONTIER = 400_000
_CHUNK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one text as an unsigned integer; zero where it has no words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    total, n = np.zeros(64, np.int64), max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_digest
    for at in range(0, n, _CHUNK):
        part = tokens[at : min(at + _CHUNK, n) + words - 1]
        runs = zip(*(part[i:] for i in range(words))) if len(part) >= words else [part]
        raw = np.frombuffer(b"".join([digest(b" ".join(r), SEED) for r in runs]), np.uint8).reshape(-1, 8)
        for k in range(8):
            total[8 * k : 8 * k + 8] += np.bincount(raw[:, k], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(x_id, x_fp): a row per input row, the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for b in batches:
            made = np.array([fingerprint(t, words) for t in b["x_text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"x_id": b["x_id"], "x_fp": made})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("x_id"), F.col(text_col).cast("string").alias("x_text")).mapInPandas(run, f"x_id {kind}, x_fp bigint")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's class under links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    return root


def trie_links(rest: np.ndarray, group: np.ndarray, side: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect the rows of each group that differ in at most ``max_bits`` of their 48 bits.

    Rows are sorted by (group, side, rest) and distinct.  A group with one side is joined
    with itself, one with two sides (0 and 1) across them.  Pairs found so far are
    replaced by a spanning star of their classes whenever they get many.
    """
    n = len(rest)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[first[1:], n]
    ones = np.r_[0, np.cumsum(side)]
    mid = ends - (ones[ends] - ones[first])
    alone = mid == ends
    stack = [(0, first, mid, np.where(alone, first, mid), ends, np.zeros(len(first), np.int64))]
    zeros: dict[int, np.ndarray] = {}
    out_a, out_b = [], []
    while stack:
        depth, al, ah, bl, bh, e = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(depth, al[:half], ah[:half], bl[:half], bh[:half], e[:half]), (depth, al[half:], ah[half:], bl[half:], bh[half:], e[half:])]
            continue
        if depth == 48:
            own = al != bl
            out_a.append(al[own])
            out_b.append(bl[own])
            if sum(map(len, out_a)) > 4 * FRONTIER:
                root = _roots(n, np.concatenate(out_a), np.concatenate(out_b))
                out_a = [np.flatnonzero(root != np.arange(n))]
                out_b = [root[out_a[0]]]
            continue
        if depth not in zeros:
            zeros[depth] = np.r_[0, np.cumsum(((rest >> np.uint64(47 - depth)) & np.uint64(1)) == 0)]
        z = zeros[depth]
        am, bm = al + z[ah] - z[al], bl + z[bh] - z[bl]
        same = al == bl
        parts = [(al, am, bl, bm, e), (am, ah, bm, bh, e), (al, am, bm, bh, e + 1), (am[~same], ah[~same], bl[~same], bm[~same], e[~same] + 1)]
        al, ah, bl, bh, e = (np.concatenate(x) for x in zip(*parts))
        ok = (ah > al) & (bh > bl) & (e <= max_bits)
        ok &= ~((al == bl) & (ah - al == 1))
        if ok.any():
            stack.append((depth + 1, al[ok], ah[ok], bl[ok], bh[ok], e[ok]))
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _local_stars(max_bits: int):
    cols = ["x_band", "x_block", "x_lo", "x_hi"]

    def stars(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*cols, "x_side", "x_rest"], kind="stable").reset_index(drop=True)
        key = rows[cols].to_numpy()
        group = np.cumsum(np.r_[0, (key[1:] != key[:-1]).any(axis=1)])
        a, b = trie_links(rows["x_rest"].to_numpy().astype(np.uint64), group, rows["x_side"].to_numpy(), max_bits)
        root = _roots(len(rows), a, b)
        fp = rows["x_fp"].to_numpy()
        own = root != np.arange(len(rows))
        return pd.DataFrame({"u": fp[own], "v": fp[root[own]]})

    def run(batches):
        kept = None
        for b in batches:
            b = b if kept is None else pd.concat([kept, b], ignore_index=True)
            last = b[cols].iloc[-1].to_numpy() if len(b) else None
            tail = (b[cols].to_numpy() == last).all(axis=1) if len(b) else np.zeros(0, bool)
            kept = b[tail]
            if (~tail).any():
                yield stars(b[~tail])
        if kept is not None and len(kept):
            yield stars(kept)

    return run


def _rest(fp, band: int):
    """The 48 bits besides block ``band``, as a non-negative long."""
    left, right = 16 * band, 48 - 16 * band
    high = F.shiftrightunsigned(fp, 64 - left) if left else F.lit(0).cast("long")
    low = fp.bitwiseAND(F.lit((1 << right) - 1).cast("long"))
    return F.shiftleft(high, right).bitwiseOR(low) if left else low


def _by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of buckets (x_band, x_block) of at most BUCKET_NODES rows, and those of larger ones or None."""
    sizes = materialise(rows.groupBy("x_band", "x_block").count().where(f"count > {BUCKET_NODES}").select(F.col("x_band").alias("s_band"), F.col("x_block").alias("s_block")), "hot")
    if sizes.limit(1).count() == 0:
        return rows, None
    other = F.broadcast(sizes) if small(sizes) else sizes
    hot = (F.col("x_band") == F.col("s_band")) & (F.col("x_block") == F.col("s_block"))
    return rows.join(other, hot, "left_anti"), rows.join(other, hot, "left_semi")


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v): links that connect all of ``nodes`` (column x_fp, distinct) within ``max_bits`` (at most 3) bits."""
    fp = F.col("x_fp")
    each = [F.struct(F.lit(b).alias("x_band"), F.shiftrightunsigned(fp, 48 - 16 * b).bitwiseAND(F.lit(0xFFFF).cast("long")).alias("x_block"), _rest(fp, b).alias("x_rest")) for b in range(4)]
    rows = nodes.select("x_fp", F.inline(F.array(*each)))
    none = F.lit(-1).cast("long")
    cols = ["x_band", "x_block", "x_lo", "x_hi", "x_side", "x_rest", "x_fp"]
    parts = []
    for level in (0, 1):
        if level:  # texts within three bits agree on one of four groups of 12 of the other 48 bits as well
            cuts = [F.struct((F.col("x_block") + F.lit((k + 1) << 16) + F.shiftleft(F.shiftrightunsigned("x_rest", 36 - 12 * k).bitwiseAND(F.lit(0xFFF).cast("long")), 20)).alias("x_block")) for k in range(4)]
            rows = rows.select("x_band", "x_rest", "x_fp", F.inline(F.array(*cuts)))
        cold, rows = _by_size(rows)
        parts.append(cold.select("x_band", "x_block", none.alias("x_lo"), none.alias("x_hi"), F.lit(0).alias("x_side"), "x_rest", "x_fp"))
        if rows is None:
            break
    if rows is not None:
        own = F.shiftrightunsigned("x_rest", 40)
        masks = F.array(*[F.lit(m).cast("long") for m in range(256) if m.bit_count() <= max_bits])
        more = rows.withColumn("x_own", own).withColumn("x_mask", F.explode(masks)).withColumn("x_mate", F.col("x_own").bitwiseXOR(F.col("x_mask")))
        parts.append(more.select("x_band", "x_block", F.least("x_own", "x_mate").alias("x_lo"), F.greatest("x_own", "x_mate").alias("x_hi"), (F.col("x_own") > F.col("x_mate")).cast("int").alias("x_side"), "x_rest", "x_fp"))
    dealt = reduce(lambda a, b: a.unionByName(b), parts)
    dealt = dealt.repartition("x_band", "x_block", "x_lo", "x_hi").sortWithinPartitions("x_band", "x_block", "x_lo", "x_hi")
    return dealt.select(*cols).mapInPandas(_local_stars(max_bits), "u bigint, v bigint").distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(x_node, x_root): each node of ``edges`` (u, v) with one node of its class, the same for the whole class.

    Large-star and small-star steps alternate until nothing changes; each step is
    written, so a lost executor costs no earlier step.  ``rows``: how many edges there are
    at most, if that is known.
    """
    def directed(e):
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(e):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = materialise(directed(edges) if rows is None else few(directed(edges), rows), "edges")
    seen = mark(now)
    while seen[0]:
        n = 2 * seen[0]  # a step makes no more rows than this
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(few(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m")), n), "low")
        large = directed(both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = materialise(few(large, n), "large")
        low = materialise(few(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), n), "low")
        met = large.join(low, F.col("u") == F.col("k"))
        now = materialise(few(directed(met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("k").alias("u"), F.col("m").alias("v")))), n), "edges")
        after = mark(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("u").alias("x_node"), F.col("v").alias("x_root"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """A row per input row: id, fingerprint (16 hex digits), component_id (smallest id of its class).

    Null and wordless texts have fingerprint zero and are linked like any other; fewer words than a
    shingle form one; null ids never become a component_id unless a class has no other; repeated rows
    repeat.  An empty table gives no rows.  Other columns are not read.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, words), "prints")
    nodes = materialise(prints.groupBy("x_fp").agg(F.min("x_id").alias("x_min")), "nodes")
    label = components(links(nodes, max_bits))
    named = nodes.join(label, F.col("x_fp") == F.col("x_node"), "left").select("x_fp", "x_min", F.coalesce("x_root", "x_fp").alias("x_root"))
    named = materialise(named, "named")
    least = materialise(named.groupBy("x_root").agg(F.min("x_min").alias("x_component")).withColumnRenamed("x_root", "r_root"), "least")
    of = materialise(named.join(least, F.col("x_root") == F.col("r_root")).select(F.col("x_fp").alias("c_fp"), "x_component"), "classes")
    return prints.join(of, F.col("x_fp") == F.col("c_fp"), "left").select(
        F.col("x_id").alias(id_col), F.lower(F.lpad(F.hex("x_fp"), 16, "0")).alias("fingerprint"), F.col("x_component").alias("component_id")
    )
