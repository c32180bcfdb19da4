"""The secret scan learns identifiers from all documents."""

import math
import random
import re
import time
from collections import Counter

from covarium.llm import secret_scan
from tests.llm.test_native import KINDS, base_spans

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
TOKEN = "[A-Za-z0-9+/_=-]"


def test_identifiers_of_all_documents_count(spark, monkeypatch):
    seen, train = [], secret_scan.train
    monkeypatch.setattr(secret_scan, "train", lambda random, ordinary: (seen.append(ordinary.agg({"x_n": "sum"}).first()[0]), train(random, ordinary))[1])
    rows = [(i, f"identifier_{random.Random(i).choice(['alpha', 'beta'])}") for i in range(2500)]
    assert secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).count() == 2500
    assert seen == [2500]


def corpus(n_clean=400, n_secret=80):
    rnd = random.Random(11)
    parts = ["config", "manager", "value", "reader", "stream", "handle", "number", "format", "window", "record", "table", "index", "query", "batch", "state", "merge"]
    name = lambda: "_".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4)))
    key = lambda n: "".join(rnd.choice(LETTERS) for _ in range(n))
    rows, planted = [], {}
    for i in range(n_clean):
        rows.append((i, " ".join(name() for _ in range(60)) + f" on 4539148803436467 password={key(18)}"))
    for n in (12, 14, 16, 20, 32, 40):
        for _ in range(n_secret):
            before = " ".join(name() for _ in range(20)) + " "
            planted[len(rows)] = (n, len(before), len(before) + n)
            rows.append((len(rows), before + key(n) + " " + name()))
    return rows, planted


def brute_markov(rows):
    """Spans by dictionaries: the same models, one character after the other."""
    values, ordinary = set(), Counter()
    for _, t in rows:
        for (name, rx, group, least) in KINDS:
            values |= {m.group(group) for m in rx.finditer(t) if least <= len(m.group(group)) <= secret_scan.SAMPLE_CHARS}
        for _, rx, *_ in secret_scan.BASE:
            t = re.sub(rx, " ", t)
        ordinary.update(re.findall(rf"(?<!{TOKEN})[A-Za-z][A-Za-z_-]{{5,}}(?!{TOKEN})", t))
    code = lambda c: secret_scan.ALPHABET.find(c) + 1
    k, tables = len(secret_scan.ALPHABET) + 1, []
    for sample in (Counter(values), ordinary):
        pair, first, each = Counter(), Counter(), Counter()
        for t, n in sample.items():
            for a, b in zip([0, *map(code, t)], map(code, t)):
                pair[a, b] += n
                first[a] += n
                each[b] += n
        total = sum(each.values())
        tables.append(lambda a, b, p=pair, f=first, e=each, t=total: math.log((p[a, b] + secret_scan.MASS * (e[b] + 0.5) / (t + 0.5 * k)) / (f[a] + secret_scan.MASS)))
    out = {}
    for i, t in rows:
        base = [tuple(map(int, s.split(":")[1:])) for s in base_spans(t)]
        out[i] = []
        for m in re.finditer(secret_scan.CANDIDATE, t):
            c = [0, *map(code, m.group())]
            ratio = sum(tables[0](a, b) - tables[1](a, b) for a, b in zip(c, c[1:]))
            if re.search("[A-Za-z]", m.group()) and ratio >= max(secret_scan.TOTAL, secret_scan.MARGIN * len(m.group())) and not any(s < m.end() and m.start() < e for s, e in base):
                out[i].append((m.start(), m.end()))
    return out


def test_markov_spans_equal_brute_force_and_find_short_secrets(spark):
    rows, planted = corpus()
    got = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("markov")] for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_markov(rows)
    for n in (12, 14, 16, 20, 32, 40):
        mine = [(i, a, b) for i, (m, a, b) in planted.items() if m == n]
        assert sum((a, b) in got[i] for i, a, b in mine) >= 0.9 * len(mine), n
    assert sum(len(v) for i, v in got.items() if i not in planted) <= 4  # of some 60 identifiers in each of 400 texts
    assert sum(s != planted[i][1:] for i, v in got.items() if i in planted for s in v) <= 4


def test_long_token(spark):
    rnd = random.Random(1)
    rows = [(0, "".join(rnd.choices(LETTERS, k=1_000_000))), (1, "x" * 1_000_000), (2, f"password={'ab1' * 10}")]
    began = time.time()
    got = {r.doc_id: r.spans for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 30 and got[2] == "assign:0:39" and "markov:0:1000000" in got[0]
