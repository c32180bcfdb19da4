"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are hashed, every K consecutive words give a gram hash, and of each span
of SPAN consecutive grams the smallest (the leftmost of equals) is a
fingerprint.  A shared run of WINDOW = SPAN + K - 1 words therefore has a shared
fingerprint, whatever surrounds it.  Document fingerprints meet the benchmark's
by an equi-join; each hit is extended over the words around it, compared word
by word, so a hash collision never counts.  Items of fewer words than a window
are windows themselves and are found by hashes of that many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.llm.base import BROADCAST_ROWS, ascii_lower, materialise, small, without_rows

WINDOW = 10
GRAM = 5
SPAN = WINDOW - GRAM + 1
#: Low bits of a fingerprint that hold a gram's position (modulo 2^24); the rest is its hash.
_AT = 24
_MASK = (1 << _AT) - 1
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(c: Column) -> Column:
    """Words after lower-casing A-Z; null has none.  Splitting at the gaps is five times as fast as extracting by the negated class."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(c), F.lit("")), _GAP), "")


def _upto(n: Column, make) -> Column:
    """``make(i)`` for i in 0 .. n-1; empty where n < 1."""
    return F.when(n < 1, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), make))


def _grams(size: int) -> Column:
    """Hash of each ``size`` consecutive entries of x_hash, low bits replaced by the position."""
    def one(i):
        mixed = F.xxhash64(*[F.get("x_hash", i + j) for j in range(size)])
        return mixed.bitwiseAND(F.lit(~_MASK).cast("long")).bitwiseOR(i.cast("long").bitwiseAND(F.lit(_MASK).cast("long")))

    return _upto(F.size("x_hash") - (size - 1), one)


def _selected(docs: DataFrame) -> DataFrame:
    """Adds x_picks, the fingerprints of x_words."""
    out = docs.withColumn("x_hash", F.transform("x_words", lambda w: F.xxhash64(w))).withColumn("x_gram", _grams(GRAM))
    least = _upto(F.size("x_gram") - (SPAN - 1), lambda i: F.least(*[F.get("x_gram", i + j) for j in range(SPAN)]))
    return out.withColumn("x_picks", F.array_distinct(least))


def _placed(rows: DataFrame) -> DataFrame:
    """Explode x_picks into x_key and x_at, the 0-based word at which the gram starts.

    The position is known modulo 2^24; texts that are longer give each candidate that fits, which the comparison of words settles.
    """
    # the outer form: for the other one the optimizer would filter by size(x_picks) far below, computing x_picks there in an inlined, quadratic form
    rows = rows.withColumn("x_pick", F.explode_outer("x_picks")).where("x_pick is not null")
    low = F.col("x_pick").bitwiseAND(F.lit(_MASK).cast("long")).cast("int")
    rows = rows.withColumn("x_key", F.shiftright("x_pick", _AT))
    return rows.withColumn("x_at", low)


def _benchmark(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """x_item (string), x_words of items that have words."""
    return bench.select(F.col(item_col).cast("string").alias("x_item"), words_of(F.col(text_col)).alias("x_words")).where(F.size("x_words") > 0)


def _every(rows: DataFrame) -> DataFrame:
    """All positions that x_at stands for in long texts."""
    top = F.size("x_words") - 1
    return rows.withColumn("x_at", F.explode(F.sequence(F.col("x_at"), F.greatest(top, F.col("x_at")), F.lit(_MASK + 1))))


def _hits_of(rows: DataFrame) -> DataFrame:
    """Extend hits: (x_row, x_item, x_from) for each window of the item that holds the hit's gram and equals the document's words.

    ``y_words`` are the item's words around its gram, which starts at ``y_at`` of them.
    """
    begin = F.greatest(F.lit(0), F.col("x_at") - F.col("y_at"))
    around = F.slice("x_words", begin + 1, F.size("y_words"))
    shift = begin - (F.col("x_at") - F.col("y_at"))  # words of the item that would lie before the document
    rows = rows.withColumn("x_begin", begin).withColumn("x_shift", shift).withColumn("x_near", around)
    rows = rows.withColumn("x_same", F.transform("x_near", lambda w, i: F.when(w == F.get("y_words", i + F.col("x_shift")), "1").otherwise("0")))
    rows = rows.withColumn("x_same", F.array_join("x_same", "")).where(F.col("x_same").contains("1" * WINDOW))
    starts = F.filter(F.sequence(F.lit(0), F.length("x_same") - WINDOW), lambda i: F.substring("x_same", i + 1, F.lit(WINDOW)) == "1" * WINDOW)
    return rows.select("x_row", "x_item", F.explode(starts).alias("x_from"), "x_begin").select("x_row", "x_item", (F.col("x_begin") + F.col("x_from")).alias("x_from"), F.lit(WINDOW).alias("x_len"))


def windows_hit(docs: DataFrame, bench: DataFrame, item_col: str = "item_id", bench_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(x_row, x_item, x_from, x_len): occurrences of benchmark windows in ``docs`` (columns x_row, x_words).

    The benchmark's fingerprints are counted and measured; up to ``broadcast_rows`` they are broadcast, so
    documents are not shuffled; beyond that fingerprints are joined by a shuffle and only
    documents with a hit are read again.
    """
    items = materialise(_benchmark(bench, item_col, bench_text), "items")
    side = _every(_placed(_selected(items.where(F.size("x_words") >= WINDOW))))
    first = F.greatest(F.lit(0), F.col("x_at") - (SPAN - 1))
    side = side.select("x_key", F.col("x_item"), F.slice("x_words", first + 1, F.col("x_at") - first + WINDOW).alias("y_words"), (F.col("x_at") - first).alias("y_at")).distinct()
    side = materialise(side.withColumnRenamed("x_key", "y_key"), "marks")
    marked = _placed(_selected(docs))
    if small(side, F.octet_length(F.array_join("y_words", " ")) + 8 * F.size("y_words"), broadcast_rows):
        met = marked.join(F.broadcast(side), F.col("x_key") == F.col("y_key"))
        found = _hits_of(_every(met))
    else:
        met = marked.select("x_row", "x_key", "x_at").join(side, F.col("x_key") == F.col("y_key")).drop("y_key", "x_key")
        again = docs.select(F.col("x_row").alias("d_row"), "x_words")
        found = _hits_of(_every(again.join(materialise(met.distinct(), "met"), F.col("d_row").eqNullSafe(F.col("x_row")))))

    short = items.where(F.size("x_words") < WINDOW)
    least = short.agg(F.min(F.size("x_words"))).first()[0]  # one number
    if least is not None:  # one pass for all: hashes of as many words as the shortest item has meet those of the items' first words
        short = short.withColumn("x_hash", F.transform("x_words", lambda w: F.xxhash64(w)))
        short = materialise(short.select(F.shiftright(_grams(least)[0], _AT).alias("y_key"), "x_item", F.col("x_words").alias("y_words")), "short")
        if small(short, F.octet_length(F.array_join("y_words", " ")) + 8 * F.size("y_words"), broadcast_rows):
            short = F.broadcast(short)
        text = docs.withColumn("x_hash", F.transform("x_words", lambda w: F.xxhash64(w))).withColumn("x_picks", _grams(least))
        met = _every(_placed(text).join(short, F.col("x_key") == F.col("y_key")))
        whole = F.slice("x_words", F.col("x_at") + 1, F.size("y_words")) == F.col("y_words")
        found = found.union(met.where(whole).select("x_row", "x_item", F.col("x_at").alias("x_from"), F.size("y_words").alias("x_len")))
    return found


def _row(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells rows apart: id and hash of the text."""
    return F.struct(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("sig"))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row per input row: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and wordless texts have no words and no hits; null ids are carried; rows are
    told apart by id and text, so an id on two texts gives each its own hits; an item
    without words is no item; empty tables give no rows (documents) or no hits
    (benchmark).  Other columns are not read.
    """
    row = _row(docs, id_col, text_col)
    rows = docs.select(row.alias("x_row"), words_of(F.col(text_col)).alias("x_words"))
    found = materialise(windows_hit(rows, bench, item_col, bench_text, broadcast_rows).distinct(), "hits")
    at = found.select("x_row", F.explode(F.sequence("x_from", F.col("x_from") + F.col("x_len") - 1)).alias("x_at")).distinct()
    at = at.groupBy("x_row").agg(F.count(F.lit(1)).alias("x_hit"))
    named = found.select(F.col("x_row").alias("h_row"), "x_item").distinct().groupBy("h_row").agg(F.sort_array(F.collect_set("x_item")).alias("x_items"))
    of = at.join(named, F.col("x_row").eqNullSafe(F.col("h_row"))).select(F.col("h_row.id").alias("h_id"), F.col("h_row.sig").alias("h_sig"), "x_hit", "x_items")
    of = materialise(of, "perdoc")
    counted = docs.select(F.col(id_col).alias("x_id"), F.xxhash64(F.col(text_col)).alias("x_sig"), F.size(words_of(F.col(text_col))).alias("x_n"))
    joined = counted.join(F.broadcast(of) if small(of, F.octet_length(F.array_join("x_items", ",")) + 8 * F.size("x_items"), broadcast_rows) else of, F.col("x_id").eqNullSafe(F.col("h_id")) & (F.col("x_sig") == F.col("h_sig")), "left")
    return joined.select(
        F.col("x_id").alias(id_col), F.col("x_n").cast("long").alias("n_words"), F.coalesce("x_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("x_items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("x_items", ","), F.lit("")), 256).alias("items_sha256"), (F.coalesce("x_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; columns stay as they are."""
    rows = docs.select(_row(docs, id_col, text_col).alias("x_row"), words_of(F.col(text_col)).alias("x_words"))
    drops = windows_hit(rows, bench).select(F.col("x_row.id").alias("drop_id"), F.col("x_row.sig").alias("drop_sig")).distinct()
    return without_rows(docs, materialise(drops, "leaks"), id_col, text_col)
