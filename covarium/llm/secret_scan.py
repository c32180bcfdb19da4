"""Secret scans: three base rules, and a Markov log-likelihood ratio for what they miss.  DataFrame functions only.

Regular expressions give matches but no positions; ``split`` by the same pattern
gives the gaps between them, and running sums of gap and match lengths give the
positions.  Only rows with a match go on from the scan, without their text.

Two first-order Markov models over characters, one of random strings and one of
ordinary identifiers, are counted from what the base rules label: the values
they find are random strings, words of all documents that they don't touch are
identifiers.  A token's summed log-likelihood ratio per
character decides.  Counts are aggregated on executors; the driver sees one
table of at most |alphabet|^2 numbers.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covarium.llm.base import materialise

#: Kind, pattern, group whose length counts, least length.  Fixed values.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),  # a shorter match fills its run, so the length may stand in the pattern
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: What a text that a rule matches holds once it is lower-cased; spares the other texts the patterns.
LITERALS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",)}
MARKOV = "markov"
CANDIDATE = r"[A-Za-z0-9+/_=-]{12,}"
#: A candidate holds a letter; plain numbers aren't secrets.
LETTER = "[A-Za-z]"
#: Whole tokens without digits: secrets that no base rule finds would otherwise pass for identifiers.
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z_-]{5,}(?![A-Za-z0-9+/_=-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Random strings are learnt from the distinct values of at most so many characters that the base rules find.
SAMPLE_CHARS = 256
#: Least log-likelihood ratio per character and of a whole candidate, in nats.
MARGIN = 0.3
TOTAL = 6.0
MASS = 16.0
_KINDS = [k for k, *_ in BASE] + [MARKOV]


def _found(text: Column, kind: int, pattern: str, group: int, test) -> Column:
    """Array of (kind, pos, gap, size, value, ok): all leftmost non-overlapping matches of one pattern; ``test(value)`` gives ok."""
    rx = F.lit(pattern)
    hit = F.regexp_extract_all(text, rx, F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hit.alias("hit"), (F.regexp_extract_all(text, rx, F.lit(group)) if group else hit).alias("value"))
    shaped = F.transform(zipped, lambda z, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("pos"), F.char_length(z["gap"]).cast("long").alias("gap"),
        F.char_length(z["hit"]).cast("long").alias("size"), z["value"].alias("value"), test(z["value"]).alias("ok")))
    return F.filter(shaped, lambda z: z["size"].isNotNull())


def _may_hold(text: Column, kind: str) -> Column:
    """Whether a text can match a base rule."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(x) for x in LITERALS[kind]]) if kind in LITERALS else F.lit(True)


def _codes(token: Column) -> Column:
    """The place of each character in ALPHABET, from 1; 0 for others.  One pass over the token."""
    places = F.array(*[F.lit(ALPHABET.find(chr(i)) + 1) for i in range(128)])
    return F.transform(F.split(token, ""), lambda x: F.coalesce(F.get(places, F.ascii(x)), F.lit(0)))


def _pairs(tokens: DataFrame) -> DataFrame:
    """Counts of (a, b): codes of neighbouring characters of x_token, x_n times each; code 0 is the start, or a character outside ALPHABET."""
    coded = tokens.where(F.char_length("x_token") > 0).select("x_n", _codes(F.col("x_token")).alias("c"))
    before = F.concat(F.array(F.lit(0)), F.slice("c", 1, F.size("c") - 1))
    pair = F.zip_with(before, F.col("c"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return coded.select("x_n", F.inline(pair)).groupBy("a", "b").agg(F.sum("x_n").alias("count"))


def train(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) at a * (|ALPHABET| + 1) + b.  Each sample has columns x_token and x_n.

    Pairs are smoothed by MASS times the character's own frequency, so characters that
    identifiers hardly hold count after any other.  A token counts x_n times.
    """
    k = len(ALPHABET) + 1
    tables = []
    for sample in (random, ordinary):
        seen = {(r.a, r.b): r["count"] for r in _pairs(sample).collect()}  # at most k * k rows
        before, each, n = [0] * k, [0] * k, sum(seen.values())
        for (a, b), c in seen.items():
            before[a] += c
            each[b] += c
        alone = [(c + 0.5) / (n + 0.5 * k) for c in each]
        tables.append([math.log((seen.get((a, b), 0) + MASS * alone[b]) / (before[a] + MASS)) for a in range(k) for b in range(k)])
    return [x - y for x, y in zip(*tables)]


def _odd(token: Column, model: list[float], margin: float) -> Column:
    """Whether a token's log-likelihood ratio reaches TOTAL, and ``margin`` for each character."""
    k, table = len(ALPHABET) + 1, F.array(*[F.lit(round(x, 6)) for x in model])
    last = F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("s"))
    total = F.aggregate(_codes(token), last, lambda acc, b: F.struct(b.alias("a"), (acc["s"] + F.get(table, acc["a"] * k + b)).alias("s")), lambda acc: acc["s"])
    return token.rlike(LETTER) & (total >= F.greatest(F.lit(TOTAL), F.lit(margin) * F.char_length(token)))


def _placed(hits: DataFrame) -> DataFrame:
    """Start and end of each match, in code points."""
    before = W.partitionBy("x_id", "x_sig", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    hits = hits.dropDuplicates(["x_id", "x_sig", "kind", "pos"])
    start = F.coalesce(F.sum(F.col("gap") + F.col("size")).over(before), F.lit(0)) + F.col("gap")
    return hits.withColumn("start", start).withColumn("end", start + F.col("size")).where("ok")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """A row per input row: id, n_assign, n_access, n_hex, base_sha256, spans (``kind:start:end``, comma-joined).

    Spans are whole matches in code points, end exclusive, by start and then kind
    (assign, access, hex, markov).  A markov span that overlaps a base span is left
    out.  Null text counts as empty; ids may be null or repeat; no hits give an
    empty ``spans`` and the hash of the empty string; an empty table gives no rows.
    Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("x_id"), text.alias("x_text"), F.xxhash64(text).alias("x_sig"))
    text = F.col("x_text")
    shape = "array<struct<kind:int,pos:int,gap:bigint,size:bigint,value:string,ok:boolean>>"
    none = F.array().cast(shape)
    kinds = [F.when(_may_hold(text, k) & text.rlike(rx), _found(text, i, rx, group, lambda v, n=least: F.char_length(v) >= n)).otherwise(none) for i, (k, rx, group, least) in enumerate(BASE)]
    hits = materialise(rows.select("x_id", "x_sig", F.explode_outer(F.concat(*kinds)).alias("h")).where("h is not null").select("x_id", "x_sig", "h.*"), "secrets")

    words = rows.select("x_text")
    for k, rx, *_ in BASE:
        words = words.withColumn("x_text", F.when(_may_hold(text, k), F.regexp_replace("x_text", rx, " ")).otherwise(text))
    words = words.select(F.explode_outer(F.regexp_extract_all(text, F.lit(ORDINARY), F.lit(0))).alias("x_token"))
    words = materialise(words.groupBy("x_token").agg(F.count(F.lit(1)).alias("x_n")), "words")
    values = hits.where(f"ok and char_length(value) <= {SAMPLE_CHARS}").select(F.col("value").alias("x_token"), F.lit(1).alias("x_n")).distinct()
    model = train(values, words)

    judged = F.when(text.rlike(CANDIDATE), _found(text, len(BASE), CANDIDATE, 0, lambda v: _odd(v, model, margin))).otherwise(none)
    judged = materialise(rows.select("x_id", "x_sig", F.transform(judged, lambda z: z.dropFields("value")).alias("h")), "candidates")
    judged = judged.where(F.exists("h", lambda z: z["ok"])).select("x_id", "x_sig", F.inline("h"))
    odd = hits.drop("value").unionByName(judged)
    spans = F.sort_array(F.collect_list(F.struct("start", "kind", "end")))
    of = _placed(odd).groupBy("x_id", "x_sig").agg(spans.alias("x_spans")).select(F.col("x_id").alias("h_id"), F.col("x_sig").alias("h_sig"), "x_spans")
    met = rows.select("x_id", "x_sig").join(of, F.col("x_id").eqNullSafe(F.col("h_id")) & (F.col("x_sig") == F.col("h_sig")), "left")

    all_spans = F.coalesce("x_spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    base = F.filter(all_spans, lambda s: s["kind"] < len(BASE))
    met = met.select("x_id", all_spans.alias("x_spans"), base.alias("x_base"))
    kept = F.filter("x_spans", lambda s: (s["kind"] < len(BASE)) | ~F.exists("x_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    def joined(spans):
        names = F.array(*[F.lit(k) for k in _KINDS])
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("x_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{_KINDS[kind]}")

    return met.select(F.col("x_id").alias(id_col), *map(number, range(len(BASE))), F.sha2(joined(F.col("x_base")), 256).alias("base_sha256"), joined(kept).alias("spans"))
