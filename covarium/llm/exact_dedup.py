"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Level 1 and 2 come from one narrow scan: rows are counted by (byte length,
hash of the first characters), with partial aggregation, so a hot group costs
each task one row.  A length that no two rows share cannot form a shared pair,
hence the pair count contains the length count.  Only rows of pairs that occur
twice or more reach level 3, where their whole content is hashed and counted.
The text itself is never shuffled, only digests are.

Which pairs are shared is told to the scan by a map of WORDS * 64 bits, one bit
for each hash of a pair, whose size is the same for any input: a row whose bit
is set goes on, and one that goes on by a collision only costs its hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.llm.base import HOT_ROWS, ascii_lower, join_spread, materialise, small

PREFIX_CHARS = 64
#: Rows of the map of shared pairs, 16 bytes each; each has 64 bits.
WORDS = 1 << 20


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z.

    Returns a row per input row: id, keep_id, group_size, kept, text_sha256.
    Null text counts as empty.  The row with the largest id stays; null ids
    rank lowest; of rows repeated with id and text, one stays.  A text that
    nobody shares forms a group of one.  ``text_sha256`` of rows that level 2
    ruled out is null unless ``digest_all``.  An empty table gives no rows.
    Other columns are not read.
    """
    found = _grouped(docs, id_col, text_col, digest_all)
    return found.select(F.col("x_id").alias(id_col), "keep_id", "group_size", "kept", F.col("x_hash").alias("text_sha256"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, digest_all: bool) -> DataFrame:
    """(x_id, x_sig, x_hash, keep_id, group_size, kept); x_sig is a 64-bit hash of the normalised text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.substring(text, 1, PREFIX_CHARS)
    pair = [F.octet_length(text).alias("x_len"), F.xxhash64(ascii_lower(start)).alias("x_prefix")]

    shared = docs.select(*pair).groupBy("x_len", "x_prefix").count().where("count > 1").select(F.xxhash64("x_len", "x_prefix").alias("h"))
    place = lambda h: F.pmod(h, F.lit(WORDS)).cast("int")
    bit = lambda h: F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int")
    of_bit = F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("h")))
    marks = materialise(shared.groupBy(place(F.col("h")).alias("m_word")).agg(F.bit_or(of_bit).alias("m_bits")), "pairs")

    rows = docs.select(F.col(id_col).alias("x_id"), text.alias("x_text"), F.xxhash64(*pair).alias("x_pair"), pair[0])
    rows = rows.join(F.broadcast(marks), place(F.col("x_pair")) == F.col("m_word"), "left")  # at most WORDS rows
    is_open = F.coalesce(F.call_function("shiftright", F.col("m_bits"), bit(F.col("x_pair"))).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))
    lowered = ascii_lower(F.col("x_text"))
    rows = rows.select("x_id", F.monotonically_increasing_id().alias("x_row"), "x_len", is_open.alias("x_open"), lowered.alias("x_text"))
    whole = F.sha2(F.col("x_text"), 256)
    rows = rows.select("x_id", "x_row", "x_len", "x_open", F.xxhash64("x_text").alias("x_sig"), (whole if digest_all else F.when(F.col("x_open"), whole)).alias("x_hash"))
    rows = materialise(rows, "digests")

    groups = (
        rows.where("x_open").groupBy("x_len", "x_hash")
        .agg(F.max(F.struct("x_id", "x_row")).alias("x_best"), F.count(F.lit(1)).alias("x_size"))
        .where("x_size > 1")
    )
    groups = materialise(groups.select(F.col("x_hash").alias("g_hash"), "x_best", "x_size"), "groups")
    met = join_spread(rows, "x_hash", groups, "g_hash", "x_size", "x_row", HOT_ROWS)
    size, best = F.col("x_size"), F.col("x_best")
    return met.select(
        "x_id", "x_sig", "x_hash",
        F.when(size.isNull(), F.col("x_id")).otherwise(best["x_id"]).alias("keep_id"),
        F.coalesce(size, F.lit(1)).cast("long").alias("group_size"),
        F.when(size.isNull(), F.lit(True)).otherwise(F.col("x_row") == best["x_row"]).alias("kept"),
    )


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns and order of columns stay as they are.

    Dropped rows are joined away by id and content; only where a group repeats an id, hence
    drops a row that looks like the one that stays, are rows told apart by a shuffle of the rest.
    """
    found = _grouped(docs, id_col, text_col, False)
    drops = found.where("not kept").select(F.col("x_id").alias("drop_id"), F.col("x_sig").alias("drop_sig"), F.col("x_id").eqNullSafe(F.col("keep_id")).alias("same"))
    drops = materialise(drops.distinct(), "drops")
    other = drops.where("not same")
    if small(other):
        other = F.broadcast(other)
    left = docs.withColumn("covarium_sig", F.xxhash64(ascii_lower(F.coalesce(F.col(text_col), F.lit("")))))
    left = left.join(other, F.col(id_col).eqNullSafe(F.col("drop_id")) & (F.col("covarium_sig") == F.col("drop_sig")), "left_anti")
    if drops.where("same").limit(1).count():
        left = left.dropDuplicates([id_col, "covarium_sig"])
    return left.drop("covarium_sig")
