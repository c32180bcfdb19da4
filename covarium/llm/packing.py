"""Best-fit packing into sequences of several permitted lengths.

Texts are counted in tokens (words plus one end mark), texts longer than the
largest length are cut into pieces of that length, and pieces are dealt by a
hash of their row's number over shards of about SHARD_PIECES; texts are never
moved, only ids and lengths.  In a shard, pieces are taken by decreasing length.  A piece goes into
the open bin that it leaves the least room in; where none has room, the length
is opened whose cost per token that it can still be filled with is least; in
the end each bin shrinks to the smallest permitted length that holds its
contents.  A shard is large enough that its partly filled last bins don't
matter, and its size, hence a task's memory, doesn't grow with the input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.llm.base import materialise

CAPACITIES = (512, 1024, 2048, 4096, 8192)
SHARD_PIECES = 20_000
#: Cost of a sequence of c tokens: OVERHEAD + c + c * c / ATTENTION.
OVERHEAD = 64
ATTENTION = 16_384


def cost(c: float) -> float:
    return OVERHEAD + c + c * c / ATTENTION


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int]]:
    """Bin of each piece, and each bin's final capacity.  Every length is at least 1 and at most the largest capacity."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    left, bins, room, used = sum(lengths), [], [], []
    of = [0] * len(lengths)
    by_room: dict[int, list[int]] = {}
    open_rooms = 0  # bit r is set if a bin has room for r tokens
    for i in order:
        w = lengths[i]
        fit = open_rooms >> w
        if fit:
            r = w + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms &= ~(1 << r)
        else:
            c = min((c for c in capacities if c >= w), key=lambda c: (cost(c) / min(c, left), c))
            b, r = len(bins), c
            bins.append(c)
            room.append(c)
            used.append(0)
        of[i] = b
        used[b] += w
        left -= w
        r -= w
        if r:
            by_room.setdefault(r, []).append(b)
            open_rooms |= 1 << r
    return of, [min(c for c in capacities if c >= u) for u in used]


def tokens_of(text_col: str):
    """Words of a text and one end mark; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"\S+")), F.lit(0)).cast("long") + 1


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """A row per bin: bin_id, capacity, used, n_pieces, doc_ids, starts, lengths (of pieces, in tokens of their text).

    Every token of every row is in one bin.  Null and empty texts have one token, their end
    mark; null ids are carried; repeated rows are packed each; ties go by id.  Which rows
    share a shard follows the order in which the table is read.  An empty table gives no
    rows.  Other columns are not read.
    """
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    rows = docs.select(F.col(id_col).alias("x_id"), tokens_of(text_col).alias("x_n"), F.monotonically_increasing_id().alias("x_row"))
    rows = materialise(rows, "lengths")
    n = rows.agg(F.coalesce(F.sum(F.ceil(F.col("x_n") / top)), F.lit(0))).first()[0]
    shards = max(1, -(-n // shard_pieces))
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("x_n") - 1, F.lit(top).cast("long")))
    pieces = rows.select("x_id", "x_n", "x_row", start.alias("x_start"))
    size = F.least(F.lit(top), F.col("x_n") - F.col("x_start")).cast("long")
    pieces = pieces.select("x_id", "x_start", size.alias("x_len"), F.pmod(F.xxhash64("x_row", "x_start"), F.lit(shards)).cast("long").alias("x_shard"))
    kind = docs.schema[id_col].dataType.simpleString()

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x_len", "x_id", "x_start"], ascending=[False, True, True], kind="stable")
        of, size = pack(rows["x_len"].tolist(), capacities)
        rows = rows.assign(b=of).sort_values("b", kind="stable")
        cuts = np.flatnonzero(np.diff(np.r_[-1, rows["b"].to_numpy()]))
        ids = [None if pd.isna(x) else x for x in rows["x_id"].astype(object)]
        ends = [*cuts[1:], len(rows)]
        starts, lens = rows["x_start"].tolist(), rows["x_len"].tolist()
        shard = int(rows["x_shard"].iloc[0])
        return pd.DataFrame({
            "bin_id": [f"{shard}-{b}" for b in range(len(size))], "capacity": size, "used": [sum(lens[a:z]) for a, z in zip(cuts, ends)], "n_pieces": [int(z - a) for a, z in zip(cuts, ends)],
            "doc_ids": [ids[a:z] for a, z in zip(cuts, ends)], "starts": [starts[a:z] for a, z in zip(cuts, ends)], "lengths": [lens[a:z] for a, z in zip(cuts, ends)],
        })

    return pieces.groupBy("x_shard").applyInPandas(one, f"bin_id string, capacity bigint, used bigint, n_pieces bigint, doc_ids array<{kind}>, starts array<bigint>, lengths array<bigint>")
