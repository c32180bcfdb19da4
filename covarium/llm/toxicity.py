"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (runs of letters, digits and non-ASCII bytes, A-Z lower-cased) are hashed
into embedding rows, and so are their first PREFIXES bytes, so that inflected and
compound forms of a word share a part of its vector; filters of several widths slide over the whole text, each
is pooled by its maximum, and a dense layer gives a logit.  To score, the
filters are multiplied into the embedding table once, so a position costs one
row lookup for each filter offset and whole texts are scored at any length.

The classifier is fitted on every labelled row and whole text.  A few rows are
fitted on the driver; more are dealt to files, each of which is passed over on
its own from common weights, and the changes are averaged after each pass.  A part
of the rows is held back to calibrate one decision threshold for each language.
Language never enters a score: it only chooses the threshold that ``flagged`` uses.
"""

from __future__ import annotations

import copy

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.llm.base import few, materialise, small

#: At most so many rows, of so many bytes of text together, are fitted on the driver; files of more have about so many rows.
TRAIN_ROWS = 4000
TRAIN_BYTES = 32 << 20
#: Weights are averaged in so many parts.
PARTS = 16
#: Words of texts that are fitted at a time; of a longer text, those that the filters' maxima lie at in stretches of so many.
WORDS = 1 << 16
BUCKETS = 1 << 14
#: A word's vector is the sum of the rows of the word and of its prefixes of so many bytes.
PREFIXES = (4, 6)
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 12
#: Passes over the sample; a small sample is passed over until MIN_STEPS steps are taken.
EPOCHS = 8
MIN_STEPS = 300
CUT = 0.3
#: A calibrated threshold needs so many rows of either class, and so much precision on them.
CASES = 10
PRECISION = 0.8
#: Bytes of text that are scored at a time; a longer text is scored in pieces that overlap by the widest filter.
BLOCK = 1 << 19

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int):
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _POWERS[size] = np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (of the word and its prefixes) of each word of all texts, and for each text the number of its words."""
    raw = _LOW[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    word = _IS_WORD[raw]
    edge = np.flatnonzero(np.diff(np.r_[False, word, False].view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])]
        ids = np.empty((len(start), 1 + len(PREFIXES)), np.int32)
        for k, stop in enumerate([end, *(np.minimum(end, start + p) for p in PREFIXES)]):
            h = (sums[stop] - sums[start]) * down[start] + np.uint64(k)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            ids[:, k] = (h >> np.uint64(40)) % np.uint64(BUCKETS)
    return ids, np.diff(np.r_[0, np.searchsorted(start, ends_of)])


def _blocks(texts: list[bytes]):
    """(from, to) of runs of texts with at most BLOCK bytes together, or of one longer text."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def _cut_words(text: bytes):
    """Words of one long text, of at most BLOCK bytes at a time."""
    at = 0
    while at < len(text):
        to = min(len(text), at + BLOCK)
        if to < len(text):  # end between words, if there is a place to
            back = np.flatnonzero(~_IS_WORD[np.frombuffer(text[at:to], np.uint8)])
            to = at + int(back[-1]) + 1 if len(back) else to
        yield word_ids([text[at:to]])[0]
        at = to


def _laid_out(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text followed by as many blanks (row BUCKETS) as the widest filter has; start of each text."""
    pad = max(WIDTHS)
    begin = np.r_[0, np.cumsum(n + pad)]
    out = np.full((begin[-1], ids.shape[1]), BUCKETS, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)) * pad, n)] = ids
    return out, begin[:-1]


class _Adam:
    def __init__(self, model: TextCnn, rate: float = 0.01):
        self.params, self.rate, self.t = model.params(), rate, 0
        self.m, self.v = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        m, v, t = self.m, self.v, self.t
        for i, g in enumerate(gradients):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            self.params[i] -= self.rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-6)


class TextCnn:
    """Weights and their training.  ``score`` takes UTF-8 texts and gives a probability each, empty texts too."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.emb = (rng.normal(size=(BUCKETS + 1, DIM)) * 0.1).astype(np.float32)
        self.emb[BUCKETS] = 0
        self.conv = [(rng.normal(size=(w, DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = (rng.normal(size=len(WIDTHS) * FILTERS) * 0.3).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def _folded(self):
        if self._tables is None:
            self._tables = [[np.ascontiguousarray(self.emb @ c[j]) for j in range(len(c))] for c in self.conv]
        return self._tables

    def _pooled(self, ids, n, where=False):
        """Maximum of each filter over each text, and where it lies."""
        seq, begin = _laid_out(ids, n)
        cuts = np.c_[begin, begin + n + 1].ravel()
        pooled, at = [], []
        for w, tables in zip(WIDTHS, self._folded()):
            x = np.zeros((len(seq), FILTERS), self.emb.dtype)
            for j in range(w):
                for k in range(seq.shape[1]):
                    x[: len(seq) - j] += tables[j].take(seq[j:, k], axis=0)
            most = np.maximum.reduceat(x, cuts[: 2 * len(n)] if cuts[-1] < len(seq) else cuts[:-1], axis=0)[::2]
            pooled.append(most)
            if where:
                at.append(np.stack([begin[i] + x[begin[i] : begin[i] + n[i] + 1].argmax(axis=0) for i in range(len(n))]))
        return seq, np.concatenate(pooled, axis=1), at

    def logits(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for at, to in _blocks(texts):
            pool = self._long(texts[at]) if len(texts[at]) > BLOCK else self._pooled(*word_ids(texts[at:to]))[1]
            out[at:to] = np.maximum(pool + self.bias, 0) @ self.out + self.base[0]
        return out

    def _long(self, text: bytes) -> np.ndarray:
        """Pooled filters of one long text: pieces overlap by the words that the widest filter spans."""
        most, kept = None, np.zeros((0, 1 + len(PREFIXES)), np.int32)
        for words in _cut_words(text):
            ids = np.concatenate([kept, words])
            pool = self._pooled(ids, np.array([len(ids)]))[1]
            most = pool if most is None else np.maximum(most, pool)
            kept = ids[1 - max(WIDTHS) :]
        return most

    def _peaks(self, ids: np.ndarray) -> np.ndarray:
        """Words of a long text that the maxima of the filters lie at in each stretch, with blanks between."""
        self._tables, found = None, []
        blank = np.full((max(WIDTHS), ids.shape[1]), BUCKETS, np.int32)
        for at in range(0, len(ids), WORDS):
            part = ids[at : at + WORDS + max(WIDTHS) - 1]
            for w, place in zip(WIDTHS, self._pooled(part, np.array([len(part)]), where=True)[2]):
                found += [x for p in np.unique(place) for x in (part[p : p + w], blank)]
        return np.concatenate(found)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30)))

    def gradients(self, ids: np.ndarray, n: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss, for emb, each of conv, bias, out and base; they flow to the position each filter's maximum lies at."""
        keep = np.unique(np.r_[ids.ravel(), BUCKETS])  # only rows in use are multiplied out
        self._tables = [[self._rows(c[j], keep) for j in range(len(c))] for c in self.conv]
        seq, pool, at = self._pooled(ids, n, where=True)
        act = np.maximum(pool + self.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.base[0], -30, 30)))
        d = ((p - y) / len(y)).astype(self.emb.dtype)
        d_act = np.outer(d, self.out) * (act > 0)
        g_emb, g_conv = np.zeros_like(self.emb), []
        for k, (w, c) in enumerate(zip(WIDTHS, self.conv)):
            dk, g = d_act[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(c)
            for j in range(w):
                rows = seq[np.minimum(at[k] + j, len(seq) - 1)]  # text, filter, part of the word
                g[j] = np.einsum("bf,bfd->df", dk, self.emb[rows].sum(axis=2))
                back = np.repeat(dk[..., None] * c[j].T[None], rows.shape[2], axis=1)
                np.add.at(g_emb, rows.ravel(), back.reshape(-1, DIM))
            g_conv.append(g)
        g_emb[BUCKETS] = 0
        return [g_emb, *g_conv, d_act.sum(0), act.T @ d, np.array([d.sum()], d.dtype)]

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 7) -> TextCnn:
        """Adam on the log loss."""
        rng, adam = np.random.default_rng(seed), _Adam(self, rate)
        words = self.words(texts)
        for _ in range(max(epochs, -(-MIN_STEPS * batch // max(1, len(texts))))):
            self.epoch(words, y, adam, rng, batch)
        return self

    @staticmethod
    def words(texts: list[bytes]) -> list[np.ndarray]:
        """Buckets of the words of each text."""
        out = []
        for at, to in _blocks(texts):
            if len(texts[at]) > BLOCK:
                out.append(np.concatenate(list(_cut_words(texts[at]))))
            else:
                ids, n = word_ids(texts[at:to])
                out += np.split(ids, np.cumsum(n)[:-1])
        return out

    def epoch(self, words: list[np.ndarray], y: np.ndarray, adam: _Adam, rng: np.random.Generator, batch: int = 64) -> None:
        """One pass over texts in random order."""
        order = rng.permutation(len(words))
        for some in np.array_split(order, max(1, len(order) // batch)):
            own = [words[i] if len(words[i]) <= WORDS else self._peaks(words[i]) for i in some]
            n = np.array([len(x) for x in own], np.int64)
            part = np.cumsum(n) // WORDS  # long texts are fitted a few at a time
            for k in np.unique(part):
                here = np.flatnonzero(part == k)
                adam.step(self.gradients(np.concatenate([own[i] for i in here]), n[here], y[some[here]]))
        self._tables = None

    def params(self) -> list[np.ndarray]:
        return [self.emb, *self.conv, self.bias, self.out, self.base]

    def _rows(self, c: np.ndarray, keep: np.ndarray) -> np.ndarray:
        out = np.zeros((BUCKETS + 1, FILTERS), self.emb.dtype)
        out[keep] = self.emb[keep] @ c
        return out


def best_cut(score: np.ndarray, y: np.ndarray, otherwise: float = CUT, cases: int = CASES, times: np.ndarray | None = None) -> float:
    """Threshold of the best F1 among those of enough precision, in the middle of its gap.

    ``otherwise`` where either class has fewer than ``cases`` rows or none is precise enough.
    ``times``: how many rows each entry stands for.
    """
    times = np.ones(len(y), np.int64) if times is None else times
    all_hits = (y * times).sum()
    if min(all_hits, times.sum() - all_hits) < cases:
        return otherwise
    order = np.argsort(-score, kind="stable")
    hit, n = np.cumsum((y * times)[order]), np.cumsum(times[order])
    last = np.r_[score[order][1:] != score[order][:-1], True]
    f1 = np.where(last & (hit >= PRECISION * n), 2 * hit / (n + all_hits), -1)
    k = int(np.argmax(f1))
    if f1[k] < 0:
        return otherwise
    below = score[order][k + 1] if k + 1 < len(y) else 0.0
    return float((score[order][k] + below) / 2)


def fold(id_col: Column, parts: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % parts


def _bytes(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def _passed(rows: DataFrame, model: TextCnn, turn: int) -> TextCnn:
    """``model`` after one pass over all ``rows`` (text, y): each task starts from it, and the mean of what they changed is taken.

    A weight's mean is over the rows of the tasks that changed it, so a rare word counts as a frequent one does.
    """
    def run(batches):
        own, n = copy.deepcopy(model), 0
        adam, rng = _Adam(own), np.random.default_rng((7, turn))
        for b in batches:
            if len(b):
                own.epoch(own.words(_bytes(b["text"])), b["y"].to_numpy(np.float32), adam, rng)
                n += len(b)
        if n:
            change = np.concatenate([(x - y).ravel() for x, y in zip(own.params(), model.params())])
            parts = [x.tobytes() for x in np.array_split(change, PARTS)]
            yield pd.DataFrame({"part": np.arange(PARTS, dtype=np.int32), "task": np.int32(TaskContext.get().partitionId()), "n": np.int64(n), "change": parts})

    def mean(rows):
        rows = rows.sort_values("task")
        total, n = 0, 0
        for x, k in zip(rows["change"], rows["n"]):
            x = np.frombuffer(x, np.float32).astype(np.float64)
            total, n = total + k * x, n + k * (x != 0)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "change": [(total / np.maximum(n, 1)).astype(np.float32).tobytes()]})

    made = rows.select("text", "y").mapInPandas(run, "part int, task int, n bigint, change binary")
    found = sorted(made.groupBy("part").applyInPandas(mean, "part int, change binary").collect())
    change, at, out = np.concatenate([np.frombuffer(r.change, np.float32) for r in found]), 0, copy.deepcopy(model)
    for p in out.params():
        p += change[at : at + p.size].reshape(p.shape)
        at += p.size
    return out


def _calibrated(rows: DataFrame, model: TextCnn) -> dict:
    """Thresholds by language (key None: all) from the scores, to four digits, of all ``rows`` (text, lang, y)."""
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "y": b["y"], "score": np.round(model.score(_bytes(b["text"])), 4)})

    met = rows.select("lang", "y", "text").mapInPandas(run, "lang string, y float, score double").groupBy("lang", "y", "score").agg(F.count(F.lit(1)).alias("n"))
    met = materialise(met, "calibration")
    cut = lambda x, otherwise: best_cut(x["score"].to_numpy(), x["y"].to_numpy(), otherwise, times=x["n"].to_numpy())
    cuts = {None: cut(met.groupBy("y", "score").agg(F.sum("n").alias("n")).toPandas(), CUT)}
    hits = F.sum(F.col("n") * F.col("y"))
    enough = met.where("lang is not null").groupBy("lang").agg(hits.alias("hits"), F.sum("n").alias("all")).where(f"hits >= {CASES} and all - hits >= {CASES}").select("lang")
    for one, x in met.join(enough, "lang").toPandas().groupby("lang"):
        cuts[one] = cut(x, cuts[None])
    return cuts


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[TextCnn, dict]:
    """A classifier, and thresholds by language (key None: all).

    Learns from all labelled rows outside the held-out fold (crc32 of the id, modulo 4, is 2) and
    their whole texts; one in five calibrates.  At most ``train_rows`` rows are fitted on the driver.
    """
    ids = labels.where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id"), 4) != 2)
    ids = materialise(ids.groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("l_toxic")), "labels")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    rows = rows.join(F.broadcast(ids) if small(ids) else ids, F.col("doc_id") == F.col("l_id"))
    rows = rows.select("doc_id", "text", "lang", F.col("l_toxic").cast("float").alias("y"), F.xxhash64("doc_id", F.lit(5)).alias("h"))
    n, size, least, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.min("y"), F.max("y")).first()
    model = TextCnn()
    if n < 2 or least == most:  # nothing to learn from: the base rate
        model.out[:] = 0
        model.base[0] = np.float32(-5.0 if not n or most == 0 else 5.0)
        return model, {None: CUT}
    if n > train_rows or size > TRAIN_BYTES:
        dealt = rows.withColumn("apart", F.pmod("h", F.lit(5)) == 0).repartition("h").sortWithinPartitions("h", "doc_id", F.xxhash64("text"), "lang")
        dealt = materialise(few(dealt, n, train_rows).select("text", "lang", "y", "apart"), "labelled")
        for turn in range(EPOCHS):
            model = _passed(dealt.where("not apart"), model, turn)
        return model, _calibrated(dealt.where("apart"), model)
    found = rows.orderBy("h", "doc_id", F.xxhash64("text"), "lang").toPandas()
    y, texts, apart = found["y"].to_numpy(np.float32), _bytes(found["text"]), np.arange(n) % 5 == 0
    model.fit([t for t, a in zip(texts, apart) if not a], y[~apart])
    score, truth, lang = model.score([t for t, a in zip(texts, apart) if a]), y[apart], found["lang"].to_numpy()[apart]
    cuts = {None: best_cut(score, truth)}
    for one in sorted({x for x in lang if x is not None}):
        cuts[one] = best_cut(score[lang == one], truth[lang == one], cuts[None])
    return model, cuts


def scores(docs: DataFrame, model: TextCnn, cuts: dict, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row per input row: id, held_out, score, predicted (score >= CUT), threshold of its language, flagged.

    Whole texts are scored; null and empty texts get the score of no words; an unknown or null
    language gets the common threshold; ids may be null or repeat; an empty table gives no rows.
    """
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"x_id": b["x_id"], "score": model.score(_bytes(b["x_text"])), "threshold": [cuts.get(x, cuts[None]) for x in b["x_lang"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("x_id"), F.col(text_col).cast("string").alias("x_text"), F.col(lang_col).alias("x_lang"))
    made = rows.mapInPandas(run, f"x_id {kind}, score double, threshold double")
    return made.select(
        F.col("x_id").alias(id_col), F.coalesce(fold(F.col("x_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose score reaches their language's threshold; columns stay as they are."""
    model, cuts = train(docs, labels)

    def run(batches):
        for b in batches:
            cut = np.array([cuts.get(x, cuts[None]) for x in b["x_lang"]], float)
            yield pd.DataFrame({"x_bad": model.score(_bytes(b["x_text"])) >= cut})

    judge = F.pandas_udf(lambda text, lang: next(run([pd.DataFrame({"x_text": text, "x_lang": lang})]))["x_bad"], "boolean")
    return docs.where(~judge(F.col("text").cast("string"), F.col("lang")))
