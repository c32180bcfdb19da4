"""Suffix-array dedup of long repeated strings, by merging shard Burrows-Wheeler transforms.

A byte goes if a string of SPAN bytes that covers it also starts elsewhere.

1.  *Blocks.*  Each start is assigned the smallest gram hash among the GRAM-byte
    grams that begin within the next WINDOW bytes (the leftmost of equals).  That
    anchor depends on the SPAN bytes after the start only, so equal strings have
    equal anchors, and with them an equal core, the bytes after the anchor that all
    its starts share.  Starts with one anchor are a block.  Only a core's hash, a
    digest of the whole block, and positions leave the scan.
2.  *Pre-aggregation.*  Cores that occur once end here.  Blocks that are the same
    (by core hash and BLAKE2 digest) collapse to one block with a count; where that count is above
    one, all of its starts are repeated.
3.  *Merge.*  Different blocks with one core are fetched and indexed.  Every
    position of a block is a suffix over symbols of STEP bytes.  Blocks are dealt
    over shards, each shard's suffixes are sorted and give its transform, and the
    transforms are merged by refining their interleave: one stable pass by symbol
    for each symbol of depth moves the shard numbers to the order of longer
    prefixes.  Suffixes are not sorted again and not looked at.  Runs whose common
    prefix reaches SPAN bytes are the repeated intervals.  Symbols are ranks of
    bytes that were compared, so no hash collision makes strings equal here.
4.  A core with more blocks than a task should hold is dealt over tasks.  Strings
    that repeat within none of them, and one of each that does, are matched over
    tasks: first bands of BAND starts by a hash of the bytes that all their strings
    share, then, only in bands that meet another, the strings by theirs.

Texts are moved twice: to fetch the blocks of step 3, and to cut the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.llm.base import materialise
from covarium.llm.toxicity import _powers

SPAN = 400
GRAM = 32
WINDOW = 256
CORE = SPAN - WINDOW + 1
STEP = 100
SHARDS = 4
#: Bytes of text that are hashed at a time, and bytes of blocks that are indexed at a time.
CHUNK = 1 << 21
BATCH = 1 << 20
#: Blocks of one core that one task indexes together.
BLOCKS = 1500
BAND = 32
_POS = np.uint64(0xFFFFFF)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray, by: np.uint64 = _M1) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * by
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any substrings of a buffer."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.sums[1:])

    def of(self, start, end, by: np.uint64 = _M1) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start], by)


def blocks(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """text number, first start, last start, anchor, core hash, block hash of each block of ``texts``."""
    out = []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
            size += len(texts[to])
            to += 1
        if to == at + 1 and size > CHUNK:  # pieces that share SPAN - 1 bytes: each start is in one piece
            for cut in range(0, size - SPAN + 1, CHUNK):
                got = _blocks([texts[at][cut : cut + CHUNK + SPAN - 1]])
                out.append((got[0] + at, *(x + cut for x in got[1:4]), *got[4:]))
        else:
            got = _blocks(texts[at:to])
            out.append((got[0] + at, *got[1:]))
        at = to
    return tuple(np.concatenate(x) for x in zip(*out)) if out else _blocks([])


def _blocks(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    size = np.array([len(t) for t in texts], np.int64)
    long = np.flatnonzero(size >= SPAN)
    begin = np.r_[0, np.cumsum(size[long])]
    raw = np.frombuffer(b"".join([texts[i] for i in long]), np.uint8)
    if not len(long):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    with np.errstate(over="ignore"):
        roll, n = Rolling(raw), len(raw)
        last = n - GRAM
        gram = np.full(-(-n // WINDOW) * WINDOW + WINDOW, np.iinfo(np.uint64).max, np.uint64)
        place = np.arange(last + 1, dtype=np.uint64)
        gram[: last + 1] = (roll.of(slice(0, last + 1), slice(GRAM, n + 1)) & ~_POS) | place
        rows = gram.reshape(-1, WINDOW)
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        before = np.minimum.accumulate(rows, axis=1).ravel()
        least = np.minimum(after[: n - SPAN + 1], before[WINDOW - 1 : WINDOW + n - SPAN])  # of the window that starts here
        anchor = (least & _POS).astype(np.int64)
        valid = np.ones(n - SPAN + 1, bool)
        for e in begin[1:-1]:
            valid[max(0, e - SPAN + 1) : e] = False
        start = np.flatnonzero(valid)
        anchor = anchor[start]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]
        lo = start[new]
        hi = start[np.r_[np.flatnonzero(new)[1:], len(start)] - 1]
        p = anchor[new]
        of = np.searchsorted(begin, lo, "right") - 1
        core = roll.of(p, p + CORE)
    base, joined, digest = begin[of], raw.tobytes(), hashlib.blake2b
    whole = np.frombuffer(b"".join([digest(joined[a:z], digest_size=8).digest() for a, z in zip(lo.tolist(), (hi + SPAN).tolist())]), np.int64)
    whole = whole ^ ((p - lo) << 10) ^ (hi - lo)
    return long[of], lo - base, hi - base, p - base, core.view(np.int64), whole


def _sorted_places(key: np.ndarray) -> np.ndarray:
    """Places of a stable sort of non-negative integers.

    Where key and place fit 64 bits together, their combinations are sorted as plain
    numbers, which is several times as fast as a stable indirect sort.
    """
    n = len(key)
    shift = max(1, int(n).bit_length())
    if not n or int(key.max()).bit_length() + shift > 64:
        return np.argsort(key, kind="stable")
    both = (key.astype(np.uint64) << np.uint64(shift)) | np.arange(n, dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << shift) - 1)).astype(np.int64)


def _unequal(raw: np.ndarray, q: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Which of the STEP-byte strings at ``q`` differ from those at ``rep``.

    Neighbouring strings at equal distance from their representatives share all but a byte,
    so each run of them is compared once, as one string.
    """
    far = np.flatnonzero(q != rep)
    out = np.zeros(len(q), bool)
    if not len(far):
        return out
    x, y = q[far], rep[far]
    new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1] + 1)])
    length = np.diff(np.r_[new, len(far)])
    part = np.cumsum(length + STEP - 1) // CHUNK  # runs are laid out some at a time, as periodic texts have a run for each string
    for lo, hi in zip(*(lambda cut: (cut, [*cut[1:], len(new)]))(np.flatnonzero(np.r_[True, part[1:] != part[:-1]]))):
        at, n = new[lo:hi], length[lo:hi]
        begin = np.r_[0, np.cumsum(n + STEP - 1)]
        inner = np.arange(begin[-1]) - np.repeat(begin[:-1], n + STEP - 1)
        odd = raw[np.repeat(x[at], n + STEP - 1) + inner] != raw[np.repeat(y[at], n + STEP - 1) + inner]
        seen = np.r_[0, np.cumsum(odd, dtype=np.int32)]
        each = np.arange(at[0], at[-1] + n[-1])
        place = each - np.repeat(at - begin[:-1], n)
        out[far[each]] = seen[place + STEP] > seen[place]
    return out


def _symbols(raw: np.ndarray, q: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Ranks of the STEP-byte strings at ``q``: equal ranks, equal bytes.  Hashes order them, and bytes are compared."""
    order = np.argsort(hashes, kind="stable")
    new = np.r_[True, hashes[order][1:] != hashes[order][:-1]][: len(order)]
    symbol = np.empty(len(q), np.int64)
    symbol[order] = np.cumsum(new) - 1
    first = q[order[new]]
    odd = np.flatnonzero(_unequal(raw, q, first[symbol]))
    if len(odd):  # strings that share a hash with another one
        whole = np.lib.stride_tricks.sliding_window_view(raw, STEP)
        names: dict[bytes, int] = {}
        symbol[odd] = [names.setdefault(whole[k].tobytes(), len(first) + len(names)) for k in q[odd]]
    return symbol


def merged_runs(texts: list[bytes], shards: int = SHARDS) -> list[np.ndarray]:
    """For each block, which of its starts (0 .. len - SPAN) begin a string that another start in ``texts`` begins too.

    Only the class of a start's first SPAN bytes is derived; see ``classes``.
    """
    of, at, group, size = classes(texts, shards)
    out = [np.zeros(len(t) - SPAN + 1, bool) for t in texts]
    many = size[group] > 1
    for i, q in zip(of[many], at[many]):
        out[i][q] = True
    return out


def classes(texts: list[bytes], shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, start, class) of each start of all blocks, and the size of each class: equal classes, equal SPAN bytes."""
    depth = SPAN // STEP
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.r_[0, np.cumsum(size)]
    with np.errstate(over="ignore"):
        raw = np.frombuffer(b"".join(texts), np.uint8)
        per = size - STEP + 1  # positions with a symbol
        first = np.r_[0, np.cumsum(per)]
        of = np.repeat(np.arange(len(texts)), per)
        at = np.arange(first[-1]) - first[of]
        q = begin[of] + at
        symbol = _symbols(raw, q, Rolling(raw).of(q, q + STEP))
    n = len(q)
    ends = STEP * len(texts)  # one end for each of a block's STEP interleaved strings
    is_last = at + STEP >= per[of]
    # nodes: ends first, then positions
    nxt = np.empty(ends + n, np.int64)
    nxt[:ends] = np.arange(ends)
    nxt[ends:] = np.where(is_last, of * STEP + at % STEP, ends + np.minimum(np.arange(n) + STEP, n - 1))
    shard_of = np.r_[np.repeat(np.arange(len(texts)), STEP), of] % shards
    before = np.full(ends + n, -1, np.int64)
    before[nxt[ends:]] = symbol

    orders, letters = [], []
    rank = np.r_[np.arange(ends), ends + symbol]
    for s in range(shards):  # each shard on its own: its suffix order and its transform
        own = np.flatnonzero(shard_of == s)
        local = np.empty(ends + n, np.int64)
        local[own] = np.arange(len(own))
        r, to = rank[own], local[nxt[own]]
        long = max((len(texts[i]) for i in range(s, len(texts), shards)), default=0)
        span = 1
        while True:
            low = int(r.max()).bit_length() if len(r) else 1
            key = (r << low) | r[to]
            order = _sorted_places(key)
            r = np.empty(len(own), np.int64)
            if len(own):
                r[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
            to, span = to[to], span * 2
            if span * STEP > long:
                break
        orders.append(own[order])
        letters.append(before[own[order]])

    # the interleave: which shard each suffix in merged order comes from
    counts = np.array([len(x) for x in orders])
    lane = np.repeat(np.arange(shards, dtype=np.uint8), counts)
    top = np.sort(np.r_[np.zeros(0, np.uint8), np.arange(len(texts)) % shards].repeat(STEP)).astype(np.uint8)
    group = np.zeros(len(lane), np.int64)
    for _ in range(depth):
        letter = np.empty(len(lane), np.int64)
        for s in range(shards):
            letter[lane == s] = letters[s]
        some = np.flatnonzero(letter >= 0)
        some = some[_sorted_places(letter[some])]
        moved, was = letter[some], group[some]
        new = np.r_[True, (moved[1:] != moved[:-1]) | (was[1:] != was[:-1])] if len(some) else np.zeros(0, bool)
        lane = np.r_[top, lane[some]]
        group = np.r_[np.zeros(len(top), np.int64), np.cumsum(new)]
    node = np.empty(len(lane), np.int64)
    for s in range(shards):
        node[lane == s] = orders[s]
    real = node >= ends
    pos, group = node[real] - ends, group[real]
    full = at[pos] <= size[of[pos]] - SPAN
    pos, group = pos[full], group[full]
    return of[pos], at[pos], group, np.bincount(group, minlength=1)


def _bytes(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def _scan(batches):
    for b in batches:
        i, lo, hi, p, core, whole = blocks(_bytes(b["x_text"]))
        yield pd.DataFrame({"x_id": b["x_id"].to_numpy()[i], "x_sig": b["x_sig"].to_numpy()[i], "x_lo": lo, "x_n": (hi - lo).astype(np.int32), "x_p": (p - lo).astype(np.int32), "core": core, "whole": whole})


def _cut_blocks(batches):
    for b in batches:
        rows = []
        for text, wanted in zip(_bytes(b["x_text"]), b["wanted"]):
            rows += [(w["core"], w["whole"], w["salt"], w["m"], w["p"], text[w["lo"] : w["lo"] + w["n"] + SPAN]) for w in wanted]
        yield pd.DataFrame(rows, columns=["core", "whole", "salt", "m", "p", "block"])


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].view(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _index(batches):
    """Per (core, salt): rows (core, whole, lo, hi, hash): repeated ranges of starts; with a hash, a band of starts to match over tasks."""
    def run(rows: pd.DataFrame):
        texts = [bytes(x) for x in rows["block"]]
        of, at, group, size = classes(texts)
        many = (size[group] > 1) | (rows["m"].to_numpy() > 1)[of]
        first = np.r_[0, np.cumsum([len(t) - SPAN + 1 for t in texts])]
        flags = np.zeros(first[-1], bool)
        flags[first[of[many]] + at[many]] = True
        core, whole, m, anchor, salt = (rows[c].to_numpy() for c in ("core", "whole", "m", "p", "salt"))
        out = [(core[i], whole[i], lo, hi, None) for i in range(len(texts)) if m[i] == 1 for lo, hi in _ranges(flags[first[i] : first[i + 1]])]
        lead = np.zeros(len(group), bool)
        lead[np.unique(group, return_index=True)[1]] = True  # one of each class, hence all that aren't repeated here
        lead &= (salt >= 0)[of]
        if lead.any():
            bands = np.unique(np.stack([of[lead], (anchor[of[lead]] - at[lead]) // BAND], axis=1), axis=0)
            i, band = bands[:, 0], bands[:, 1]
            length = np.array([len(t) for t in texts])
            last, start = anchor[i] - band * BAND, anchor[i] - band * BAND - BAND + 1  # its starts, as far as the block has them
            with np.errstate(over="ignore"):
                roll, begin = Rolling(np.frombuffer(b"".join(texts), np.uint8)), np.r_[0, np.cumsum(length)][:-1]
                shared = _mix(roll.of(begin[i] + last, begin[i] + start + SPAN, _M2) + band.astype(np.uint64)).view(np.int64)
            lo, hi = np.maximum(start, 0), np.minimum(last, length[i] - SPAN)
            out += list(zip(core[i].tolist(), whole[i].tolist(), lo.tolist(), hi.tolist(), shared.tolist()))
        return pd.DataFrame(out, columns=["core", "whole", "lo", "hi", "hash"]).astype({"hash": "Int64"})

    kept, size = [], 0
    for b in batches:
        key = b[["core", "salt"]].to_numpy()
        for rows in np.split(np.arange(len(b)), np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1):
            part = b.iloc[rows]
            more = int(part["block"].map(len).sum())
            same = kept and len(part) and tuple(kept[-1][["core", "salt"]].iloc[-1]) == tuple(part[["core", "salt"]].iloc[0])
            if kept and not same and size + more > BATCH:
                yield run(pd.concat(kept, ignore_index=True))
                kept, size = [], 0
            if len(part):
                kept.append(part)
                size += more
    if kept:
        yield run(pd.concat(kept, ignore_index=True))


def _strings(batches):
    """Hash of each string that starts in the bands of a block."""
    for b in batches:
        texts = [bytes(x) for x in b["block"]]
        lo, n = b["lo"].to_numpy(), (b["hi"] - b["lo"] + 1).to_numpy()
        begin, of = np.r_[0, np.cumsum([len(t) for t in texts])][:-1], np.repeat(np.arange(len(texts)), n)
        at = np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n) + lo[of]
        with np.errstate(over="ignore"):
            q = begin[of] + at
            h = Rolling(np.frombuffer(b"".join(texts), np.uint8)).of(q, q + SPAN, _M2).view(np.int64)
        yield pd.DataFrame({"core": b["core"].to_numpy()[of], "whole": b["whole"].to_numpy()[of], "lo": at, "hash": h})


def _remove(batches):
    for b in batches:
        rows = []
        for text, spans in zip(_bytes(b["x_text"]), b["spans"]):
            kept, at, removed, n = hashlib.sha256(), 0, 0, 0
            end = 0
            for lo, hi in sorted((s["lo"], s["hi"]) for s in spans) if spans is not None else ():
                if n == 0 or lo > end:
                    kept.update(text[at if n == 0 else end : lo])
                    n, start = n + 1, lo
                else:
                    start = end
                if hi + SPAN > end:
                    removed += hi + SPAN - start
                    end = hi + SPAN
            kept.update(text[end:])
            rows.append((len(text), removed, n, kept.hexdigest()))
        made = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
        yield made.assign(x_id=b["x_id"].to_numpy())


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks_a_task: int = BLOCKS) -> DataFrame:
    """A row per input row: id, n_bytes, n_removed, n_spans, kept_sha256.

    Null counts as empty; texts shorter than SPAN bytes lose nothing; repeated rows are
    repeats of each other; null ids are carried; an empty table gives no rows.  Other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("x_id"), F.xxhash64(text).alias("x_sig"), text.alias("x_text"))
    found = materialise(rows.where(F.octet_length("x_text") >= SPAN).mapInPandas(_scan, f"x_id {kind}, x_sig bigint, x_lo bigint, x_n int, x_p int, core bigint, whole bigint"), "blocks")

    shared = materialise(found.groupBy("core").count().where("count > 1").select(F.col("core").alias("s_core")), "cores")
    some = materialise(found.join(shared, F.col("core") == F.col("s_core"), "left_semi"), "shared")
    block = some.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("x_id", "x_sig", "x_lo", "x_n", "x_p")).alias("r"))
    block = materialise(block, "distinct")
    odd = block.groupBy("core").agg(F.count(F.lit(1)).alias("k"), F.sum((F.col("m") == 1).cast("int")).alias("singles")).where("k > 1 and singles > 0")
    odd = materialise(odd.select(F.col("core").alias("o_core"), F.ceil(F.col("k") / blocks_a_task).alias("salts")), "odd")

    wanted = block.join(odd, F.col("core") == F.col("o_core"))
    salt = F.when(F.col("salts") > 1, F.pmod(F.col("whole"), F.col("salts"))).otherwise(F.lit(-1)).cast("long")
    wanted = wanted.groupBy("r.x_id", "r.x_sig").agg(F.collect_list(F.struct(F.col("r.x_lo").alias("lo"), F.col("r.x_n").alias("n"), F.col("r.x_p").alias("p"), "core", "whole", salt.alias("salt"), "m")).alias("wanted"))
    wanted = wanted.select(F.col("x_id").alias("w_id"), F.col("x_sig").alias("w_sig"), "wanted")
    fetched = rows.join(wanted, F.col("x_id").eqNullSafe(F.col("w_id")) & (F.col("x_sig") == F.col("w_sig"))).select("x_text", "wanted")
    fetched = materialise(fetched.mapInPandas(_cut_blocks, "core bigint, whole bigint, salt bigint, m bigint, p int, block binary"), "fetched")
    dealt = fetched.repartition("core", "salt").sortWithinPartitions("core", "salt")
    ranges = materialise(dealt.mapInPandas(_index, "core bigint, whole bigint, lo bigint, hi bigint, hash bigint"), "ranges")

    far = ranges.where("hash is not null")
    met = materialise(far.groupBy("core", "hash").count().where("count > 1").select(F.col("core").alias("t_core"), F.col("hash").alias("t_hash")), "bands")
    some_bands = far.join(met, (F.col("core") == F.col("t_core")) & (F.col("hash") == F.col("t_hash")), "left_semi").select(F.col("core").alias("b_core"), F.col("whole").alias("b_whole"), "lo", "hi")
    strings = fetched.where("salt >= 0").dropDuplicates(["core", "whole"]).join(some_bands, (F.col("core") == F.col("b_core")) & (F.col("whole") == F.col("b_whole")))
    strings = materialise(strings.select("core", "whole", "lo", "hi", "block").mapInPandas(_strings, "core bigint, whole bigint, lo bigint, hash bigint"), "strings")
    twice = strings.groupBy("core", "hash").count().where("count > 1").select(F.col("core").alias("t_core"), F.col("hash").alias("t_hash"))
    over = strings.join(twice, (F.col("core") == F.col("t_core")) & (F.col("hash") == F.col("t_hash")), "left_semi").select("core", "whole", "lo", F.col("lo").alias("hi"))
    sure = block.where("m > 1").select("core", "whole", F.lit(0).cast("long").alias("lo"), F.col("r.x_n").cast("long").alias("hi"))
    decided = ranges.where("hash is null").select("core", "whole", "lo", "hi").unionByName(over).unionByName(sure)
    decided = materialise(decided.groupBy("core", "whole").agg(F.collect_set(F.struct("lo", "hi")).alias("cuts")).withColumnsRenamed({"core": "d_core", "whole": "d_whole"}), "decided")

    spans = some.join(decided, (F.col("core") == F.col("d_core")) & (F.col("whole") == F.col("d_whole")))
    spans = spans.groupBy("x_id", "x_sig").agg(F.collect_set(F.transform("cuts", lambda c: F.struct((c["lo"] + F.col("x_lo")).alias("lo"), (c["hi"] + F.col("x_lo")).alias("hi")))).alias("spans"))
    spans = materialise(spans.select(F.col("x_id").alias("p_id"), F.col("x_sig").alias("p_sig"), F.flatten("spans").alias("spans")), "spans")
    cut = rows.join(spans, F.col("x_id").eqNullSafe(F.col("p_id")) & (F.col("x_sig") == F.col("p_sig")), "left").select("x_id", "x_text", "spans")
    made = cut.mapInPandas(_remove, f"n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, x_id {kind}")
    return made.select(F.col("x_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")
