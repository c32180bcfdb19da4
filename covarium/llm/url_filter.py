"""URL filters: rules first, then a ratio of two character language models.  DataFrame functions only.

URLs with a rule are the labelled sample: one variable-order Markov model is
counted over accepted ones, one over rejected ones.  A character's probability
after up to ORDER characters is interpolated from the longest context down:
p(c | h) = (n(hc) + MASS * p(c | shorter h)) / (n(h) + MASS), so a context
counts as far as it has been seen.  The mean difference of log-probabilities
over a whole URL is compared with a threshold calibrated on labelled URLs that
were not counted: one in HELD, by a hash of the URL.

Counts are taken per distinct gram of ORDER + 1 characters, with partial
aggregation; shorter grams are sums over that table, so the URLs are cut up
twice only: to count, and to score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.llm.base import BROADCAST_ROWS, LOWER, UPPER, join_spread, materialise, small

#: Verdict, host, path.  Fixed values.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 3
MASS = 4.0
HELD = 5
#: Characters a URL can hold, for the shortest context's uniform distribution.
SYMBOLS = 256
#: Scores are binned to 1/BINS for calibration, between -LIMIT and LIMIT.
BINS, LIMIT = 100, 10
_START = "\u0002"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null where none does."""
    found = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(rows: DataFrame) -> DataFrame:
    """Explode x_text into x_gram, one for each of its characters, in one pass over the text."""
    rows = rows.where("x_text <> ''").withColumn("x_chars", F.split(F.concat(F.lit(_START * ORDER), F.col("x_text")), ""))
    gram = F.transform(F.sequence(F.lit(0), F.size("x_chars") - ORDER - 1), lambda i: F.concat(*[F.get("x_chars", i + k) for k in range(ORDER + 1)]))
    return rows.withColumn("x_gram", F.explode(gram)).drop("x_chars", "x_text")


def gram_ratios(texts: DataFrame) -> DataFrame:
    """(x_gram, x_ratio) for each gram of ``texts`` (x_text, x_verdict: allow, block or null, x_times)."""
    grams = _grams(texts.select("x_text", "x_verdict", "x_times"))
    n = {v: F.sum(F.when(F.col("x_verdict") == v, F.col("x_times")).otherwise(0)).cast("double") for v in ("allow", "block")}
    counts = materialise(grams.groupBy("x_gram").agg(n["allow"].alias("a"), n["block"].alias("b")), "grams")
    total = counts.agg(F.coalesce(F.sum("a"), F.lit(0.0)), F.coalesce(F.sum("b"), F.lit(0.0))).first()  # two numbers

    table, prob = counts.select("x_gram"), {v: F.lit(1.0 / SYMBOLS) for v in "ab"}
    for k in range(ORDER + 1):  # contexts of k characters
        tail = F.substring("x_gram", ORDER + 1 - k, k + 1)
        seen = counts.groupBy(tail.alias(f"tail{k}")).agg(F.sum("a").alias(f"na{k}"), F.sum("b").alias(f"nb{k}"))
        table = table.join(seen, F.substring("x_gram", ORDER + 1 - k, k + 1) == F.col(f"tail{k}"))
        if k:
            head = F.substring("x_gram", ORDER + 1 - k, k)
            under = counts.groupBy(head.alias(f"head{k}")).agg(F.sum("a").alias(f"ta{k}"), F.sum("b").alias(f"tb{k}"))
            table = table.join(under, head == F.col(f"head{k}"))
        for v, all_seen in zip("ab", total):
            t = F.col(f"t{v}{k}") if k else F.lit(float(all_seen))
            prob[v] = (F.col(f"n{v}{k}") + F.lit(MASS) * prob[v]) / (t + F.lit(MASS))
    return table.select("x_gram", (F.log(prob["a"]) - F.log(prob["b"])).alias("x_ratio"))


def _cut(scored: DataFrame) -> float:
    """Threshold of the best balanced accuracy on labelled texts: the middle of the best bins; 0 where a class is missing."""
    bin_of = F.round(F.least(F.greatest(F.col("x_score"), F.lit(-LIMIT)), F.lit(LIMIT)) * BINS).cast("int")
    seen = scored.where("x_verdict is not null").groupBy(bin_of.alias("k")).agg(
        F.sum(F.when(F.col("x_verdict") == "allow", F.col("x_times")).otherwise(0)).alias("a"), F.sum(F.when(F.col("x_verdict") == "block", F.col("x_times")).otherwise(0)).alias("b")
    ).orderBy("k").collect()  # at most 2 * LIMIT * BINS + 1 rows
    a, b = sum(r.a for r in seen), sum(r.b for r in seen)
    if not a or not b:
        return 0.0
    best, passed_a, passed_b, last = [(-1.0, 0.0)], 0, 0, None
    for r in seen:  # a threshold just below this bin
        gain = (a - passed_a) / a + passed_b / b
        best.append((gain, (r.k if last is None else (r.k + last) / 2) / BINS))
        passed_a, passed_b, last = passed_a + r.a, passed_b + r.b, r.k
    top = max(g for g, _ in best)
    return next(t for g, t in best if g == top)


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row per input row: id, host, path, rule, verdict, score.

    Null urls, and those without ``://``, have empty host and path; null and empty urls,
    having no characters, score 0.  Equal urls get equal verdicts; without held-out labelled
    urls of both kinds the threshold is 0.  Ids may be null or repeat; an empty table
    gives no rows; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("x_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("x_text"), F.monotonically_increasing_id().alias("x_row"))
    rule = rule_of(host_of(F.col("x_text")), path_of(F.col("x_text")), rules)
    texts = rows.groupBy("x_text").agg(F.count(F.lit(1)).alias("x_times")).withColumn("x_verdict", rule["verdict"]).withColumn("x_no", F.monotonically_increasing_id())
    texts = materialise(texts.withColumn("x_held", F.pmod(F.xxhash64("x_text"), F.lit(HELD)) == 0), "urls")
    counted = texts.withColumn("x_verdict", F.when(~F.col("x_held"), F.col("x_verdict")))
    ratios = materialise(gram_ratios(counted), "ratios").withColumnRenamed("x_gram", "r_gram")
    met = _grams(texts.select("x_text", "x_no")).join(F.broadcast(ratios) if small(ratios, rows=broadcast_rows) else ratios, F.col("x_gram") == F.col("r_gram"))
    score = met.groupBy("x_no").agg(F.round(F.avg("x_ratio"), 9).alias("x_score")).withColumnRenamed("x_no", "s_no")
    score = texts.join(score, F.col("x_no") == F.col("s_no"), "left").withColumn("x_score", F.coalesce("x_score", F.lit(0.0)))
    score = materialise(score.select(F.col("x_text").alias("s_text"), "x_verdict", "x_times", "x_held", "x_score"), "scores")
    cut = _cut(score.where("x_held"))
    out = join_spread(rows, "x_text", score.select("s_text", "x_times", "x_score"), "s_text", "x_times", "x_row")
    out = out.select("x_id", "x_score", host_of(F.col("x_text")).alias("host"), path_of(F.col("x_text")).alias("path")).withColumn("x_rule", rule_of(F.col("host"), F.col("path"), rules))
    return out.select(
        F.col("x_id").alias(id_col), "host", "path", F.col("x_rule.rule").alias("rule"),
        F.coalesce("x_rule.verdict", F.when(F.col("x_score") >= cut, "allow").otherwise("block")).alias("verdict"), F.col("x_score").alias("score"),
    )
