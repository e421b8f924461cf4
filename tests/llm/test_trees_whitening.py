"""URL templates, the prefix trie and whitening, each against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomtrace.llm import prefixtrie, urltree, whitening

from .helpers import LOW

# --- URL templates ---

URL = "page_id bigint, url string, html string, host string, template string, n bigint, key string"


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOW), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path, rules=urltree.RULES):
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_general(seg):
    ending = m[0] if (m := re.search(r"\.[A-Za-z]{1,5}$", seg)) else ""
    stem = seg[: len(seg) - len(ending)]
    if len(seg) > 64:
        return "<t>"
    if re.fullmatch("[0-9]+", stem):
        return "<n>" + ending
    if re.fullmatch("[0-9A-Fa-f-]{8,}", stem) and re.search("[0-9]", stem):
        return "<h>" + ending
    return seg


def plain_purity(a, b):
    return (a + urltree.PRIOR * urltree.WEIGHT) / (a + b + urltree.WEIGHT)


def plain_alike(x, y):
    distance = chi = 0.0
    for k in ("ends", "wild", "other"):
        p, q, s = x[k] / x["n"], y[k] / y["n"], x[k] + y[k]
        distance += abs(p - q) / 2
        chi += x["n"] * y["n"] * (p - q) ** 2 / s if s else 0
    p, q = (plain_purity(z["allow"], z["block"]) for z in (x, y))
    spread = sum(r * (1 - r) / (z["allow"] + z["block"] + urltree.WEIGHT + 1) for r, z in ((p, x), (q, y)))
    return (distance <= urltree.NEAR or chi <= urltree.CHI) and (abs(p - q) <= urltree.NEAR or abs(p - q) <= urltree.Z * math.sqrt(spread))


def plain_judge(pages):
    rows = []
    for i, url in pages:
        host, path = plain_host_path(url)
        segs = path.split("/")[1:] if "/" in path else []
        if len(segs) > urltree.DEPTH:
            segs = [*segs[: urltree.DEPTH], "/".join(segs[urltree.DEPTH :])]
        rows.append([i, host, path, *plain_rule(host, path), tuple(map(plain_general, segs)), ""])
    for level in range(max((len(r[5]) for r in rows), default=0)):
        nodes = defaultdict(list)
        for r in rows:
            if len(r[5]) > level:
                nodes[r[1], r[6]].append(r)
        for own in nodes.values():
            n = Counter(r[5][level] for r in own)
            name = {s: s if s in ("<n>", "<h>", "<t>") or c >= max(urltree.SUPPORT, len(own) * urltree.SHARE) else "*" for s, c in n.items()}
            branch = defaultdict(lambda: dict.fromkeys(("n", "ends", "wild", "other", "allow", "block"), 0))
            for r in own:
                b = branch[name[r[5][level]]]
                b["n"] += 1
                after = r[5][level + 1] if len(r[5]) > level + 1 else None
                b["ends" if after is None else "wild" if after.startswith("<") else "other"] += 1
                if r[4]:
                    b[r[4]] += 1
            groups = []
            for k in sorted(branch, key=lambda k: (-branch[k]["n"], k)):
                for g in groups:
                    if plain_alike(branch[g[0]], branch[k]):
                        g.append(k)
                        break
                else:
                    groups.append([k])
            final = {k: g[0] if len(g) == 1 else "{" + "|".join(sorted(g)) + "}" for g in groups for k in g}
            for r in own:
                r[6] += "/" + final[name[r[5][level]]]
    labels = defaultdict(Counter)
    for r in rows:
        labels[r[1], r[6]][r[4]] += 1
    out = []
    for i, host, path, rule, verdict, _, template in rows:
        c = labels[host, template]
        p = plain_purity(c["allow"], c["block"])
        out.append((i, host, path, rule, verdict, None, None) if rule else (i, host, path, None, "allow" if p >= urltree.LEAST else "block", template, round(p, 9)))
    return sorted(out, key=repr)


def judged(spark, pages):
    df = spark.createDataFrame([(i, u, None, "h", "t", 1, "k") for i, u in pages], URL)
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.template, r.purity if r.purity is None else round(r.purity, 9)) for r in urltree.judge(df).collect()), key=repr)


def test_url_templates(spark):
    rng = random.Random(5)
    hosts = ["A.example.com", "b.example.net", "c.example.org", "example.net", "notexample.net", "d.io", "d.io:8080", "xnet"]
    urls = [None, "", "no scheme/x", "http://", "://?q", "http://d.io", "http://d.io/", "http://d.io//", "HTTP://D.IO/en/1?u=http://x.net/", "http://e.net#f/", "http://d.io/" + "a/" * 30, "http://d.io/" + "x" * 70000, "http://ä.net/é/1"]
    for _ in range(1500):
        first = rng.choice(["en", "de", "fr", "blog", "p"])
        second = rng.choice([str(rng.randrange(9999)), f"{rng.randrange(99)}.html", "".join(rng.choice("abcdefgh") for _ in range(6)), "%032x" % rng.getrandbits(128), "about"])
        third = rng.choice(["", "", "/", "/edit", "/view?x=1", "#top"])
        urls.append(f"https://{rng.choice(hosts)}/{first}/{second}{third}")
    pages = [*enumerate(urls), (None, "http://d.io/en/5"), (3, urls[40]), (3, urls[40])]
    got = judged(spark, pages)
    assert got == plain_judge(pages)
    assert {v for *_, v, _, _ in got} == {"allow", "block"}


def test_url_templates_learn_from_rules(spark):
    """A host's other templates follow what rules say of templates like them."""
    pages = [(i, f"http://s.example.com/de/{i}") for i in range(40)] + [(100 + i, f"http://s.example.com/en/{i}") for i in range(40)]
    assert all(v == ("block" if "/de/" in p else "allow") for _, _, p, _, v, _, _ in judged(spark, pages))
    # without rules of their own, and alike in all else
    rules = (("s.io", "/a/1", "block"), ("t.io", "/a/1", "allow"))
    df = spark.createDataFrame([(i, f"http://{'st'[i % 2]}.io/a/{i}") for i in range(400)], "page_id bigint, url string")
    assert {(r.host, r.verdict) for r in urltree.judge(df, rules).collect()} == {("s.io", "block"), ("t.io", "allow")}
    assert judged(spark, []) == []


def test_joins_of_heavy_and_light_keys(spark, monkeypatch):
    """Keys that are broadcast and keys that are shuffled give one result."""
    from pyspark.sql import functions as F

    from loomtrace.llm import session

    rows = spark.range(4000).select((F.col("id") % 7 * F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50)).alias("k"), "id").withColumn("k", F.when(F.col("id") % 40 == 1, None).otherwise(F.col("k")))
    table = rows.where("k is not null and k <> 12").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    want = sorted(map(tuple, rows.join(table, "k").select("id", "v").collect()))
    for heavy in (1, 3, 20, 1000):
        monkeypatch.setattr(session, "HEAVY", heavy)
        assert sorted(map(tuple, session.keyed(rows, table, ["k"], "n").select("id", "v").collect())) == want


@pytest.mark.parametrize("heavy", [2, 30])
def test_url_templates_with_few_heavy_nodes(spark, monkeypatch, heavy):
    from loomtrace.llm import session

    monkeypatch.setattr(session, "HEAVY", heavy)
    rng = random.Random(heavy)
    pages = [(i, f"http://{'hot.example.com' if i % 3 == 0 else f'h{rng.randrange(9)}.example.org'}/{rng.choice(['en', 'de', 'fr', 'x' + str(rng.randrange(40))])}/{rng.choice(['a', 'b', str(i)])}") for i in range(700)]
    assert judged(spark, pages) == plain_judge(pages)


def test_url_templates_of_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.template, r.purity if r.purity is None else round(r.purity, 9)) for r in urltree.judge(pages).collect()), key=repr)
    assert got == plain_judge([(r.page_id, r.url) for r in pages.select("page_id", "url").collect()])


# --- the prefix trie ---


def plain_trie(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [z[2:] for z in sorted(v, key=lambda z: z[:2])] for c, v in conv.items()}
    built = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = conv.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    saved, leaves, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        saved[k] = ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0) + sum(saved[q] for q in kids[k])
        leaves[k] = sum(leaves[q] for q in kids[k]) or 1
        ends = sorted(c for c in members[k] if len(built[c]) == len(k))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


TURN = "conv_id bigint, turn bigint, role string, text string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(df, **named):
    return sorted((tuple(r[c] for c in NODE) for r in prefixtrie.trie(df, **named).collect()), key=repr)


@pytest.mark.parametrize("block", [3, 512])
def test_prefix_trie(spark, block):
    from pyspark.sql import functions as F

    rng = random.Random(block)
    rows = []
    for c in [*range(-12, 30), 1000, 1001]:
        for t in range(rng.choice([1, 2, 3, 8, 9, 14, 22])):
            rows.append((c, t - 3, rng.choice(["u", None, ""]) if rng.random() < 0.2 else "u", rng.choice(["a", "é", None, ""]) if rng.random() < 0.15 else "a"))
    rows += [(None, 1, "u", "x"), (7, None, "q", "w"), (2000, 0, "u", "long " * 50_000), (2002, 0, "u", "long " * 50_000)]
    rows += [(3000, 5, "same", "same")] * 7  # equal rows count repeatedly
    df = spark.createDataFrame(rows, TURN).repartition(5)
    for name in ("pos", "conv", "bucket", "blk", "shard", "key", "depth", "ids"):
        df = df.withColumn(name, F.lit(name))
    assert nodes(df, block=block) == plain_trie(rows)


def test_prefix_trie_of_copies(spark):
    """Thousands of equal conversations are one way, in many shards."""
    rows = [(5 * c, t, "u", f"turn {t}") for c in range(900) for t in range(3)] + [(1, 0, "u", "other")]
    assert nodes(spark.createDataFrame(rows, TURN).repartition(6)) == plain_trie(rows)
    assert nodes(spark.createDataFrame([], TURN)) == []


# --- whitening ---

VEC = "vec_id bigint, embedding array<float>, label int, x int, component int, n int"


def test_characteristic_polynomial(spark):
    rng = np.random.default_rng(2)
    for d in (1, 2, 7):
        a = rng.integers(-50, 50, (d, 2 * d))
        m = [[int(x) for x in row] for row in a @ a.T]
        got = whitening.characteristic(spark, m)
        expected = np.poly(np.array(m, dtype=float))[::-1]
        assert np.allclose([float(x) for x in got], expected, rtol=1e-9, atol=1e-6 * abs(expected).max())
        # its value at integers is the determinant
        if d < 3:
            assert sum(c * 7**k for k, c in enumerate(got)) == round(float(np.linalg.det(7 * np.eye(d) - np.array(m, dtype=float))))


def test_roots():
    # (t - 9)^2 (t - 4) t
    c = [0, -324, 153, -22, 1]
    r = whitening.Roots(c)
    one = 1 << whitening.POINT
    assert [r.root(k, 40 * one) for k in (1, 2, 3)] == [9 * one, 9 * one, 4 * one] and r.root(4, 40 * one) <= 1
    assert [r.above(x * one) for x in (-1, 0, 3, 4, 8, 9)] == [4, 3, 3, 2, 2, 0]


def plain_whiten(rows):
    kept = [(i, [math.floor(float(np.float32(c)) * 64) + 1_000_000 for c in v]) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = Counter(len(v) for _, v in kept)
    d = max(lengths, key=lambda k: (lengths[k], k))
    kept = [(i, v) for i, v in kept if len(v) == d]
    u = np.array(sorted(set(map(tuple, (v for _, v in kept)))), dtype=np.int64)
    n, s = len(u), u.sum(axis=0)
    centred = (u * n - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    return {i: (n, sum((n * x - int(y)) ** 2 for x, y in zip(v, s, strict=True)), ((np.array(v) * n - s) / n) @ vectors / np.sqrt(values)) for i, v in kept}, values / np.trace(centred.T @ centred / n)


def test_whitening(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=20) * np.arange(1, 21)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 420)]
    bad = [(900, None), (901, []), (902, [1.0] * 19 + [None]), (903, [1.0] * 19 + [math.nan]), (904, [1.0] * 19 + [math.inf]), (905, [1.0, 2.0]), (906, [1e30] * 20)]
    got = whitening.whiten(spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows + bad], VEC).repartition(5)).toPandas()
    plain, explained = plain_whiten(rows)
    assert len(got) == 420 * 16 and set(got.vec_id) == set(plain)
    got = got.sort_values(["vec_id", "component"])
    w = got.whitened.to_numpy().reshape(-1, 16)
    expected = np.array([plain[i][2] for i in sorted(plain)])
    assert np.abs(w * np.sign((w * expected).sum(axis=0)) - expected).max() < 1e-9
    assert {i: (n, d) for i, n, d in zip(got.vec_id, got.n, got.deviation, strict=True)} == {i: p[:2] for i, p in plain.items()}
    assert np.allclose(got.explained.to_numpy()[:16], explained, rtol=1e-9) and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9


def test_whitening_of_few_and_large(spark):
    # two vectors: one direction, the other components have no variance
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 0.0, 2.0], 0, 0, 0, 0), (2, [0.0, 1.0, 2.0], 0, 0, 0, 0), (None, [0.0, 1.0, 2.0], 0, 0, 0, 0)], VEC)).collect()
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == 9 and abs(abs(by[1, 1].whitened) - 1) < 1e-12 and by[1, 1].whitened == -by[2, 1].whitened == -by[None, 1].whitened
    assert by[1, 1].explained == 1 and all(by[i, c].whitened == 0 and by[i, c].explained == 0 for i in (1, 2) for c in (2, 3))
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, 0, 0, 0)], VEC)).collect()
    assert [(r.component, r.whitened, r.deviation) for r in one] == [(1, 0.0, 0), (2, 0.0, 0)]
    large = whitening.whiten(spark.createDataFrame([(i, [float(2**50 + i * 2**40), float(i % 3)], 0, 0, 0, 0) for i in range(9)], VEC)).collect()
    assert large[0].identity_error < 1e-9 and all(r.deviation is None for r in large if r.vec_id == 0)
    assert whitening.whiten(spark.createDataFrame([], VEC)).count() == 0


def test_whitening_of_given_vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).toPandas()
    plain, explained = plain_whiten(rows)
    assert np.allclose(got.sort_values(["vec_id", "component"]).explained.to_numpy()[:16], explained, rtol=1e-9) and len(got) == 16 * len(plain)
