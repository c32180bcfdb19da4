"""Exact dedup, secret scans, decontamination and URL filters against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from covarium.llm import decontam, exact_dedup, secret_scan, url_filter

LONG = "word " * 30_000
TEXTS = [
    (1, "Hello World"), (2, "hello world"), (3, "HELLO WORLD"), (4, None), (5, ""), (6, "É hello"), (7, "é hello"), (8, LONG), (9, LONG.upper()), (10, "x" * 100 + "a"), (11, "x" * 100 + "b"), (12, "only"), (12, "only"), (None, "only"), (None, None),
]


def docs(spark, rows, empty=False):
    """With extra columns whose names clash with the operators' own."""
    data = [] if empty else [(i, t, None, "s", 7, "k", 1) for i, t in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, x_id int, kept string, count int")


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("digest_all,hot,words", [(True, 1000, 1 << 20), (False, 1000, 1 << 20), (False, 1, 1), (True, 2, 2)])
def test_exact_groups(spark, monkeypatch, digest_all, hot, words):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot)  # hot groups are sent, others gathered; a full map opens every row
    monkeypatch.setattr(exact_dedup, "WORDS", words)
    got = exact_dedup.exact_groups(docs(spark, TEXTS), digest_all=digest_all).collect()
    assert len(got) == len(TEXTS)
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[low(t)].append(i)
    kept = Counter()
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    for i, t in TEXTS:
        own = groups[low(t)]
        best = max((x for x in own if x is not None), default=None)
        h = hashlib.sha256(low(t).encode()).hexdigest()
        assert any(r.keep_id == best and r.group_size == len(own) and (r.text_sha256 == h or (not digest_all and r.text_sha256 is None and len(own) == 1)) for r in by_id[i]), (i, by_id[i])
    for r in got:
        kept[r.text_sha256 or r.doc_id] += r.kept
    assert set(kept.values()) == {1}


def test_exact_hot_group_and_stage(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i}") for i in range(300)]
    left = exact_dedup.keep_one_copy(docs(spark, rows))
    assert left.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted([i for i in range(300) if i % 3] + [297])
    assert sorted((r.doc_id is None, r.doc_id or 0, low(r.text)) for r in exact_dedup.keep_one_copy(docs(spark, TEXTS)).collect()) == sorted(
        (i is None, i or 0, low(t)) for i, t in {(3, "hello world"), (5, ""), (6, "É hello"), (7, "é hello"), (9, LONG), (10, "x" * 100 + "a"), (11, "x" * 100 + "b"), (12, "only")})
    assert exact_dedup.keep_one_copy(docs(spark, [], True)).count() == 0
    assert exact_dedup.exact_groups(docs(spark, [], True)).count() == 0


# --- secrets

KINDS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]


def base_spans(t):
    found = []
    for k, (name, rx, group, least) in enumerate(KINDS):
        found += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in rx.finditer(t or "") if len(m.group(group)) >= least]
    return [x[2] for x in sorted(found)]


def test_secrets(spark):
    rnd = random.Random(3)
    key = lambda n: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    words = "ordinary identifiers like configuration_manager and international_registration appear everywhere in documentation"
    rows = [(1, "É password=hunter2hunter2 x"), (2, "token=token : abcdefgh12 token=token=abcdefgh"), (3, f"AKIA{'A' * 11} AKIA{'B' * 12}"), (4, "0" * 31 + " " + "a" * 40 + "g"), (5, None), (6, ""),
            (7, f"note {key(40)} end"), (8, words), (8, words), (None, "secret: 'abcdefghij'"), (9, "api_key = \"0123456789abcdef0123456789abcdef\" ÄÖ passwd:short"), (10, "password=" * 500 + " " + ("ä token=abcdefgh " * 500))]
    rows += [(100 + i, f"{words} password={key(20)} {words.upper()}") for i in range(60)]
    got = defaultdict(list)
    for r in secret_scan.secrets(docs(spark, rows)).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        want = base_spans(t)
        for r in got[i]:
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, want, r.spans)
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
            assert [s for s in r.spans.split(",") if s and not s.startswith("markov")] == want
    assert got[7][0].spans == "markov:5:45"  # a random string without a rule
    assert "markov" not in got[8][0].spans  # long ordinary identifiers
    assert secret_scan.secrets(docs(spark, [], True)).count() == 0


# --- decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_hits(rows, items):
    wins = defaultdict(set)
    for i, t in items:
        w = WORD.findall(low(t))
        if w:
            for k in range(max(1, len(w) - 9)):
                wins[tuple(w[k : k + 10])].add(str(i))
    sizes = {len(w) for w in wins}
    out = []
    for i, t in rows:
        w, hit, names = WORD.findall(low(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    names |= wins[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_contamination(spark, broadcast_rows):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["É", "naïve", "漢字"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.randint(10, 40))) for i in range(20)] + [(50, "Three Short words"), (51, None), (52, "..."), (53, text(10)), (54, "a a a a a a a a a a a a a"), (55, "lone"), (50, "Three short words")]
    rows = []
    for i in range(120):
        item = WORD.findall(low(items[i % 20][1]))
        cut = rnd.randint(0, max(0, len(item) - 9))
        rows.append((i, f"{text(rnd.randint(0, 30))}, {' -- '.join(item[cut : cut + rnd.randint(8, 14)]).upper()}! {text(rnd.randint(0, 30))}"))
    rows += [(500, None), (501, ""), (502, "a " * 50), (503, "x three SHORT words three short words"), (504, items[0][1]), (505, " ".join(t or "" for _, t in items) * 3), (506, "Lone"), (507, "É" * 5), (508, " ".join(WORD.findall(items[3][1])[:9]))]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id bigint, text string, doc_id string")
    got = sorted(tuple(r) for r in decontam.contamination(docs(spark, rows), bench, broadcast_rows=broadcast_rows).collect())
    assert got == sorted(brute_hits(rows, items))
    clean = decontam.drop_contaminated(docs(spark, rows), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [r[0] for r in sorted(brute_hits(rows, items)) if not r[5]]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in decontam.contamination(docs(spark, rows[:5]), none).collect())
    assert decontam.contamination(docs(spark, [], True), bench).count() == 0


# --- URL filters

def brute_rule(host, path):
    best = None
    for verdict, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


def split_url(u):
    if not u or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return low(host), re.match(r"[^?#]*", rest[len(host) :]).group()


URLS = ["https://Blog.Example.NET/en/1?x#y", "http://example.net", "http://net/", "http://a.net/x", "http://annet/x", "https://example.com/de/5", "https://m.example.com/fr/5", "http://x.org/fr/", "http://x.org/fr", "http://x.org/en/7", None, "", "no scheme", "http://", "http:///path", "a://b://c/d", "http://u?q=/en/", "HTTP://É.NET/en/", "http://example.net/EN/3", "http://example.com/en/1", "http://example.com/en/1"]


def brute_score(texts, order=3, mass=url_filter.MASS):
    """Scores by counting with dictionaries."""
    count = {v: [Counter() for _ in range(order + 2)] for v in ("allow", "block")}
    total = Counter()
    for t, v, n in texts:
        if v:
            p = "\u0002" * order + t
            for i in range(order, len(p)):
                total[v] += n
                for k in range(order + 1):
                    count[v][k][p[i - k : i + 1]] += n
    def prob(v, gram):
        q = 1 / url_filter.SYMBOLS
        for k in range(order + 1):
            g = gram[order - k :]
            under = total[v] if k == 0 else sum(c for x, c in count[v][k].items() if x[:-1] == g[:-1])
            q = (count[v][k][g] + mass * q) / (under + mass)
        return q
    out = {}
    for t, _, _ in texts:
        p = "\u0002" * order + t
        d = [math.log(prob("allow", p[i - order : i + 1])) - math.log(prob("block", p[i - order : i + 1])) for i in range(order, len(p))]
        out[t] = sum(d) / len(d) if d else 0.0
    return out


def held_out(u):
    return np.uint64(xxhash.xxh64_intdigest((u or "").encode(), 42)).view(np.int64) % url_filter.HELD == 0


def brute_cut(scored):
    """The middle of the gap with the best balanced accuracy; (score, verdict) of each held-out labelled row."""
    scored = [(math.floor(s * url_filter.BINS + 0.5), v) for s, v in scored]
    n = Counter(v for _, v in scored)
    if len(n) < 2:
        return 0.0
    bins, best = sorted({s for s, _ in scored}), (-1, 0)
    for low, b in zip([None, *bins], bins):
        gain = sum(v == "allow" and s >= b for s, v in scored) / n["allow"] + sum(v == "block" and s < b for s, v in scored) / n["block"]
        if gain > best[0]:
            best = (gain, (b if low is None else (b + low) / 2) / url_filter.BINS)
    return best[1]


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_urls(spark, broadcast_rows):
    rnd = random.Random(4)
    urls = URLS + [f"https://{rnd.choice(['a', 'shop', 'm'])}.{host}{rnd.choice(['/en/', '/de/', '/fr/', '/x/'])}{rnd.choice('abcdef') * 3}{i}?{q}={i}" for i in range(60) for host, q in (("spam.net", "ref"), ("good.example.net", "page"), ("x.org", "id"), ("free.io", "ref"))]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://z.net/spam")]
    pages = spark.createDataFrame([(i, u, "h", 1.0) for i, u in rows], "page_id bigint, url string, html string, score double")
    got = url_filter.judged(pages, broadcast_rows=broadcast_rows).collect()
    assert len(got) == len(rows)
    rule = {u: brute_rule(*split_url(u)) or (None, None) for _, u in rows}
    times = Counter(u or "" for _, u in rows)
    want = brute_score([(u, rule.get(u, (None, None))[1] if not held_out(u) else None, n) for u, n in times.items()])
    cut = brute_cut([(want[u], rule[u][1]) for _, u in rows if u and rule[u][1] and held_out(u)])
    for r in got:
        u = dict(rows)[r.page_id]
        assert (r.host, r.path) == split_url(u)
        assert r.rule == rule[u][0]
        assert abs(r.score - want[u or ""]) < 1e-8
        assert r.verdict == (rule[u][1] or ("allow" if r.score >= cut else "block"))
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_long_and_hot_urls(spark, monkeypatch):
    rnd = random.Random(5)
    long = "http://long.io/" + "".join(rnd.choices("abcdefgh/", k=100_000))
    rows = [(i, "http://hot.net/x") for i in range(3000)] + [(3000 + i, f"http://a.org/fr/{i}") for i in range(30)] + [(None, long), (None, None), (None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    began = time.time()
    got = url_filter.judged(pages).collect()
    assert time.time() - began < 30 and len(got) == len(rows)
    assert Counter((r.host, r.rule, r.verdict) for r in got if r.rule) == {("hot.net", "net/", "block"): 3000, ("a.org", "org/fr/", "allow"): 30}
    assert {r.score for r in got if not r.host} == {0.0}
