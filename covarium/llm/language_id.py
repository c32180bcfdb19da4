"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

A text's bytes (A-Z lower-cased) are cut into windows of WINDOW bytes.  In each
window one recurrent layer reads forwards and one backwards from a zero state,
every position gets a distribution over languages from both states, and a
document's probabilities are the mean over all of its positions.  All windows of
a batch of documents advance together, so a time step is one small matrix
product, and memory depends on the batch, not on a text's length.

The network is fitted on the driver by backpropagation through time, on
WINDOWS_A_DOC random windows of each of at most PER_LANG labelled rows of each
language; texts of any length serve, and only windows are sent to the driver.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covarium.llm.base import materialise
from covarium.llm.toxicity import fold

PER_LANG = 300
#: More values of ``lang`` than this are an error: then the column doesn't hold languages.
MAX_LANGS = 500
WINDOW = 64
HIDDEN = 8
EPOCHS = 6
WINDOWS_A_DOC = 4
#: Windows that advance together.
LANES = 2048
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_LOW = np.arange(257, dtype=np.int16)
_LOW[65:91] += 32
PAD = 256


def _sigmoid(x):
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class ByteGru:
    """Weights of both directions stacked on the first axis; ``probabilities`` takes UTF-8 texts."""

    def __init__(self, langs: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.langs = langs
        self.inp = (rng.normal(size=(2, PAD + 1, 3 * h)) * 0.4).astype(np.float32)
        self.rec = (rng.normal(size=(2, h, 3 * h)) / np.sqrt(h)).astype(np.float32)
        self.out = (rng.normal(size=(2, h, len(langs))) * 0.3).astype(np.float32)
        self.base = np.zeros(len(langs), np.float32)

    def _states(self, x: np.ndarray) -> np.ndarray:
        """States (2, T, lanes, HIDDEN) of windows x (lanes, T); the second direction is in reading order of the first."""
        h, (lanes, steps) = HIDDEN, x.shape
        out = np.empty((2, steps, lanes, h), self.inp.dtype)
        for d in (0, 1):
            state = np.zeros((lanes, h), self.inp.dtype)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                a, g = self.inp[d].take(x[:, t], axis=0), state @ self.rec[d]
                gates = _sigmoid(a[:, : 2 * h] + g[:, : 2 * h])
                new = np.tanh(a[:, 2 * h :] + gates[:, h:] * g[:, 2 * h :])
                new += gates[:, :h] * (state - new)
                out[d, t] = state = new
        return out

    def _position_probabilities(self, x: np.ndarray) -> np.ndarray:
        s = self._states(x)
        z = s[0] @ self.out[0]
        z += s[1] @ self.out[1]
        z += self.base
        z -= z.max(axis=-1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=-1, keepdims=True)
        return z  # (T, lanes, langs)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean of position probabilities of each text (a text without bytes: zeros)."""
        pooled, size = np.zeros((len(texts), len(self.langs))), np.array([len(t) for t in texts], np.int64)
        wins = -(-size // WINDOW)
        begin, at, group = np.r_[0, np.cumsum(wins)], 0, 64 * LANES
        while at < len(texts):  # texts whose windows fit a group; a longer text alone, group by group
            to = max(at + 1, int(np.searchsorted(begin, begin[at] + group, "right")) - 1)
            for cut in range(0, max(1, int(begin[to] - begin[at])), group):
                part = texts[at:to] if to > at + 1 else [texts[at][cut * WINDOW : (cut + group) * WINDOW]]
                n = np.array([len(t) for t in part], np.int64)
                k = -(-n // WINDOW)
                flat = np.full(int(k.sum()) * WINDOW, PAD, np.int16)
                place = np.repeat(np.r_[0, np.cumsum(k * WINDOW)][:-1] - np.r_[0, np.cumsum(n)][:-1], n)
                flat[np.arange(n.sum()) + place] = _LOW[np.frombuffer(b"".join(part), np.uint8)]
                x, own = flat.reshape(-1, WINDOW), np.repeat(np.arange(len(part)), k)
                for i in range(0, len(x), LANES):
                    lane = x[i : i + LANES]
                    p = (self._position_probabilities(lane) * (lane != PAD).T[..., None]).sum(axis=0)
                    np.add.at(pooled[at : at + len(part)], own[i : i + LANES], p)
            at = to
        return pooled / np.maximum(size, 1)[:, None]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss over all positions, for inp, rec, out and base; through all steps of a window."""
        h, rows, real = HIDDEN, np.arange(len(x)), (x != PAD).T
        s = self._states(x)
        z = s[0] @ self.out[0] + s[1] @ self.out[1] + self.base
        z -= z.max(axis=-1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=-1, keepdims=True)
        p[:, rows, y] -= 1
        dz = (p * real[..., None] / max(1, real.sum())).astype(self.inp.dtype)
        grads = [np.zeros_like(q) for q in (self.inp, self.rec, self.out, self.base)]
        grads[3] += dz.sum((0, 1))
        for d in (0, 1):
            grads[2][d] += np.einsum("tbh,tbl->hl", s[d], dz)
            ds_all, carry, none = dz @ self.out[d].T, 0, np.zeros((len(x), h), self.inp.dtype)
            steps = range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1)
            for k in range(WINDOW - 1, -1, -1):
                t = steps[k]
                before = s[d, steps[k - 1]] if k else none
                a, g = self.inp[d].take(x[:, t], axis=0), before @ self.rec[d]
                gates = _sigmoid(a[:, : 2 * h] + g[:, : 2 * h])
                u, r = gates[:, :h], gates[:, h:]
                new = np.tanh(a[:, 2 * h :] + r * g[:, 2 * h :])
                ds = ds_all[t] + carry
                dn = ds * (1 - u) * (1 - new * new)
                da = np.concatenate([ds * (before - new) * u * (1 - u), dn * g[:, 2 * h :] * r * (1 - r), dn], axis=1)
                dg = np.concatenate([da[:, : 2 * h], dn * r], axis=1)
                np.add.at(grads[0][d], x[:, t], da)
                grads[1][d] += before.T @ dg
                carry = ds * u + dg @ self.rec[d].T
        return grads

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.02, seed: int = 11) -> ByteGru:
        """Adam; gradients are clipped to norm 1."""
        rng, params, step = np.random.default_rng(seed), [self.inp, self.rec, self.out, self.base], 0
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for _ in range(epochs):
            for some in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                grads = self.gradients(x[some], y[some])
                norm, step = float(np.sqrt(sum((g * g).sum() for g in grads))), step + 1
                for i, g in enumerate(grads):
                    g = g / max(1.0, norm)
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.01 * (g * g - v[i])
                    params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)
        return self


def _bytes(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def training_windows(texts: list[bytes], seeds: list[int], windows: int = WINDOWS_A_DOC) -> tuple[list[bytes], np.ndarray]:
    """Some windows of each text at random places, and the text that each is from."""
    out, of = [], []
    for i, (t, seed) in enumerate(zip(texts, seeds)):
        places = np.random.default_rng(seed).integers(0, max(1, len(t) - WINDOW + 1), size=windows if len(t) > WINDOW else 1)
        out += [t[at : at + WINDOW] for at in places]
        of += [i] * len(places)
    return out, np.array(of, np.int64)


def laid_out(windows: list[bytes]) -> np.ndarray:
    x = np.full((len(windows), WINDOW), PAD, np.int16)
    for row, w in zip(x, windows):
        row[: len(w)] = _LOW[np.frombuffer(w, np.uint8)]
    return x


def train(docs: DataFrame, per_lang: int = PER_LANG) -> ByteGru | None:
    """A network from rows outside the held-out fold (crc32 of the id, modulo 5, is 0) with text and lang; None where there are none.

    At most ``per_lang`` different rows of each language are used, those whose ids hash lowest;
    the limit is applied in each task first, so no language is gathered whole.  More than
    MAX_LANGS languages are an error.
    """
    text = F.col("text").cast("string")
    ok = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length(text) > 0) & (fold(F.col("doc_id"), 5) != 0)
    key = ["h", "doc_id", "sig"]
    rows = docs.where(ok).select("doc_id", "lang", text.alias("text"), F.xxhash64("doc_id").alias("h"), F.xxhash64(text).alias("sig"))
    ids = rows.select("lang", *key)
    salted = ids.withColumn("k", F.dense_rank().over(W.partitionBy("lang", F.pmod("h", F.lit(32))).orderBy(*key))).where(f"k <= {per_lang}").drop("k").distinct()
    chosen = salted.withColumn("k", F.dense_rank().over(W.partitionBy("lang").orderBy(*key))).where(f"k <= {per_lang}").select(F.col("lang").alias("c_lang"), *[F.col(k).alias(f"c_{k}") for k in key])
    chosen = materialise(chosen, "sample")
    if chosen.select("c_lang").distinct().count() > MAX_LANGS:
        raise ValueError(f"lang has more than {MAX_LANGS} values")

    def cut(batches):
        for b in batches:
            found, of = training_windows(_bytes(b["text"]), (b["sig"].to_numpy() ^ b["h"].to_numpy()).view(np.uint64).tolist())
            yield pd.DataFrame({"lang": b["lang"].to_numpy()[of], "h": b["h"].to_numpy()[of], "sig": b["sig"].to_numpy()[of], "piece": found})

    same = (F.col("lang") == F.col("c_lang")) & (F.col("doc_id") == F.col("c_doc_id")) & (F.col("sig") == F.col("c_sig"))
    found = rows.join(F.broadcast(chosen), same, "left_semi").dropDuplicates(["lang", *key])  # at most per_lang * MAX_LANGS rows
    found = found.select("lang", "text", "h", "sig").mapInPandas(cut, "lang string, h bigint, sig bigint, piece binary").toPandas()
    if not len(found):
        return None
    found = found.sort_values(["h", "sig", "lang", "piece"], kind="stable")
    langs = sorted(found["lang"].unique())
    return ByteGru(langs).fit(laid_out([bytes(p) for p in found["piece"]]), found["lang"].map(langs.index).to_numpy())


def languages(docs: DataFrame, model: ByteGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, held_out, lang_pred, score (probability of lang_pred).

    Texts that are null or have no letter are ``und`` with score 0; so are all where
    nothing could be learnt.  Of equal probabilities the first language by name wins.
    Ids may be null or repeat; an empty table gives no rows; other columns are not read.
    """
    def run(batches):
        for b in batches:
            has = np.array([model is not None and isinstance(t, str) and _LETTER.search(t) is not None for t in b["x_text"]], bool)
            pred, score = np.full(len(b), UNKNOWN, object), np.zeros(len(b))
            if has.any():
                p = model.probabilities(_bytes(b["x_text"][has]))
                pred[has], score[has] = np.array(model.langs, object)[p.argmax(axis=1)], np.minimum(p.max(axis=1), 1.0)
            yield pd.DataFrame({"x_id": b["x_id"], "lang_pred": pred, "score": score})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("x_id"), F.col(text_col).cast("string").alias("x_text"))
    made = rows.mapInPandas(run, f"x_id {kind}, lang_pred string, score double")
    return made.select(F.col("x_id").alias(id_col), F.coalesce(fold(F.col("x_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
