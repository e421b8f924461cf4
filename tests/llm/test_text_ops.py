"""Fingerprints, languages, sub-words, licences, quality, decontamination and token files against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtrace.llm import decontam, fingerprints, kernels, langid, licenses, pieces, quality, tokenfile
from loomtrace.llm.queries import tokenizer

from .helpers import OTHER, PROSE, SCHEMA, alnum_words, awkward, frame, in_order, rows_of, space_words


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("aB1 \n\t\x00-é🙂", max_size=40), max_size=5), st.sampled_from(["space", "alnum"]))
def test_words(texts, kind):
    raw, at = kernels.flat_texts([t.encode() for t in texts])
    start, end, h, first = kernels.words(raw, at, kernels.SPACE if kind == "space" else kernels.ALNUM)
    plain = [space_words(t) if kind == "space" else alnum_words(t) for t in texts]
    assert np.diff(first).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert [raw[a:b].tobytes().decode().lower() for a, b in zip(start, end, strict=True)] == [w.lower() for w in flat]
    code = {}
    assert all(code.setdefault(w, x) == x for w, x in zip(flat, h.tolist(), strict=True)) and len(set(code.values())) == len(code)


def test_words_longer_than_a_segment(monkeypatch):
    monkeypatch.setattr(kernels, "SEGMENT", 16)
    raw, at = kernels.flat_texts([b"a" * 50 + b" b cc " + b"d" * 40, b"", b"e" * 33])
    start, end, h, first = kernels.words(raw, at, kernels.SPACE)
    assert (end - start).tolist() == [50, 1, 2, 40, 33] and first.tolist() == [0, 4, 4, 5]


def plain_sketch(text):
    """The 128 smallest hashes of a text's shingles, one shingle at a time."""
    w = space_words(text)
    every = [" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4) if w else 0)]
    return sorted({int(x) for one in every for x in fingerprints.sketches([one])[0].tolist()})[:128]


def plain_likeness(a, b):
    if not a and not b:
        return 1.0
    u = sorted(set(a) | set(b))[:128]
    return len([x for x in u if x in set(a) and x in set(b)]) / len(u)


@pytest.mark.parametrize("parts", [None, 9])
def test_fingerprint_edits(spark, monkeypatch, parts):
    if parts:
        monkeypatch.setattr(fingerprints, "fanout", lambda docs: parts)
    more = [(None, f"no key {k}") for k in range(20)] + [(30, PROSE * 9 + str(k % 3)) for k in range(9)]
    rows = in_order([(i, t or "") for i, t, *_ in awkward()] + more)
    want = []
    for j, (i, t) in enumerate(rows):
        q, after = len(t) // 4, rows[(j + 1) % len(rows)][1]
        e = t[: len(t) - q] + after[:q]
        a, b, c = plain_sketch(t), plain_sketch(e), plain_sketch(after)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), plain_likeness(a, b), plain_likeness(a, c), np.array(a, ">u8").tobytes().hex()))
    got = fingerprints.fingerprint_edits(frame(spark, awkward() + [(i, t, None, None, 0) for i, t in more])).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, fingerprints.from_text(r.fingerprint).astype(">u8").tobytes().hex()) for r in got], key=str) == sorted(want, key=str)
    assert len({r.fingerprint for r in got if r.doc_id in (9, 10)}) == 1 and next(r.fingerprint for r in got if r.doc_id == 3) == ""
    assert fingerprints.fingerprint_edits(frame(spark, [])).count() == 0
    only = fingerprints.fingerprint_edits(frame(spark, [(1, PROSE, None, None, 0)])).first()
    assert only.near_next == 1.0


def test_sketches_estimate():
    a, b = [f"a{i}" for i in range(4000)], [f"a{i}" for i in range(2000, 6000)]
    x, y = fingerprints.sketches([" ".join(a), " ".join(b)])
    assert abs(fingerprints.resemblance(x, y) - 1 / 3) < 0.15 and abs(fingerprints.distinct(x) / 3996 - 1) < 0.3 and abs(fingerprints.containment(x, y) - 0.5) < 0.2
    u = fingerprints.union(x, y)
    assert (u == np.unique(np.concatenate((x, y)))[: len(u)]).all() and (fingerprints.from_text(fingerprints.to_text(x)) == x).all()


def test_merged_sketches(spark):
    rows = [(i % 3, f"{PROSE} {i}") for i in range(60)] + [(9, None)]
    df = spark.createDataFrame(rows, "g int, text string")
    got = {r.g: r.fingerprint for r in fingerprints.merged(fingerprints.fingerprint(df, "g"), "g").collect()}
    for g in (0, 1, 2):
        u = fingerprints.sketches([""])[0]
        for s in fingerprints.sketches([t for h, t in rows if h == g]):
            u = fingerprints.union(u, s)
        assert got[g] == fingerprints.to_text(u)
    assert got[9] == ""


def test_languages(spark):
    rows = [(i, (PROSE if i % 2 else OTHER) * (1 + i % 5) + f" {i}", "en" if i % 2 else "fr", "s", 0) for i in range(120)]
    got = langid.languages(frame(spark, rows + awkward()[2:6])).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in by.values())
    assert all(by[i].lang_pred == ("en" if i % 2 else "fr") for i in range(50, 120))
    assert langid.languages(frame(spark, [(1, "ab cd", None, None, 0), (2, None, "en", None, 0)])).where("lang_pred <> 'und'").count() == 0
    assert langid.languages(frame(spark, [])).count() == 0


def test_every_language_is_learned(spark):
    """Many copies of one text, an only text, a text longer than a dictionary, a text of less than 8 bytes."""
    import random

    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    english = [word("abcdefghst") for _ in range(150)]
    greek, long, short = "αλφα βητα γαμμα δελτα", " ".join(word("пбдгжз") for _ in range(12_000)), "ßß"
    rows = [(4 * i, "un chien et un chat dorment sur le canapé", "fr", None, 0) for i in range(600)] + [(4 * i + 1, " ".join(rng.choice(english) for _ in range(30)), "en", None, 0) for i in range(300)]
    rows += [(10_001, greek, "el", None, 0), (10_003, long, "ru", None, 0), (10_005, short, "de", None, 0), (10_007, "", "xx", None, 0), (10_009, greek, None, None, 0)]
    df = frame(spark, rows)
    made = dict(langid.fit(df))
    assert set(made) == {"fr", "en", "el", "ru", "de"} and made["ru"] == long[: langid.LEARNED].encode() and len(made["de"]) >= 8
    got = {r.doc_id: r for r in langid.classify(df, list(made.items())).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in rows if lang not in (None, "xx") and i != 10_005) and got[10_009].lang_pred == "el" and got[10_007].lang_pred == "und"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("abc dé\n", max_size=3000), min_size=1, max_size=4))
def test_predictions_against_plain_compression(texts):
    import zstandard

    made = [("one", b"abc abc abd" * 40), ("two", "dé dé cab".encode() * 40), ("three", b"abc abc abd" * 40)]
    use = langid.Classifier(made)
    parameters = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, min_match=3, write_content_size=0, write_dict_id=0)
    for t in texts:
        if not any(c.isalpha() for c in t):
            assert use.predict(t) == ("und", 0.0, False)
            continue
        raw, sizes = t.encode(), {}
        for name, d in made:
            c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)
            sizes[name] = sum(len(c.compress(raw[i : i + langid.PIECE])) for i in range(0, len(raw), langid.PIECE))
        name, score, accepted = use.predict(t)
        first, second = sorted(sizes.values())[:2]
        assert name == min(sizes, key=lambda x: (sizes[x], list(sizes).index(x))) and score == (second - first) / second and accepted == (score >= langid.MARGIN) and name != "three"


def plain_viterbi(model, text):
    """Best pieces of a whole text by trying every one."""
    table = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == pieces.NORMAL}
    s = (pieces.MARK + text.replace(" ", pieces.MARK)) if text else ""
    unknown = float(model.scores[model.kinds == pieces.NORMAL].min()) - pieces.UNKNOWN
    best, back = [0.0] + [float("-inf")] * len(s), [None] * (len(s) + 1)
    for i in range(len(s)):
        for j in range(i + 1, min(len(s), i + 20) + 1):
            v = table.get(s[i:j])
            if v is not None and best[i] + model.scores[v] > best[j]:
                best[j], back[j] = best[i] + model.scores[v], (i, [v])
        if s[i] not in table and best[i] + unknown > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + unknown, (i, [model.bytes_at[b] for b in s[i].encode()])
    out, j = [], len(s)
    while j:
        j, ids = back[j]
        out = ids + out
    return out


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(tokenizer("piece_bpe_32k.model"))


def test_pieces_are_the_best_ones(model):
    texts = [t or "" for _, t, *_ in awkward()] + ["a  b", " a", "a ", "  ", "▁a▁▁b", "the best", "naïve 🙂🙂", "w" * 150]
    texts = [t[:400] for t in texts]
    use = pieces.Encoder(model)
    for t, got in zip(texts, use.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain_viterbi(model, t), t
        assert use.decode(got) == t.replace(pieces.MARK, " ")


def test_piece_rows(spark):
    got = pieces.encode(frame(spark), tokenizer("piece_bpe_32k.model"), keep=("doc_id", "n_tokens", "score"))
    assert got.columns == ["doc_id", "score", "n_tokens", "n_byte_tokens", "token_ids", "decoded_sha256", "round_trip"]
    rows = got.collect()
    assert len(rows) == len(awkward()) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows)
    assert pieces.encode(frame(spark, []), tokenizer("piece_bpe_32k.model")).count() == 0


def test_pieces_that_cross_words_are_refused():
    with pytest.raises(ValueError):
        pieces.model_of([("a▁b", 0.0, pieces.NORMAL)])


def test_double_array():
    words = [(w.encode(), i) for i, w in enumerate(["a", "ab", "abc", "b", "bca", "é", "zz"])]
    base, check, value = pieces.double_array(words)

    def find(w):
        p = 0
        for b in w:
            q = base[p] + b
            if check[q] != p:
                return -1
            p = q
        return value[p]

    assert [find(w) for w, _ in words] == list(range(7)) and find(b"bc") == -1 and find(b"x") == -1


def test_alignment():
    assert licenses.rising([3, 1, 2, 5, 4, 6]) in ([1, 2, 4, 5], [1, 2, 3, 5])
    a, b = "the a of the b and c of it".split(), "x the a of y the b and z c of it".split()
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == len(a) and pairs == sorted(pairs)


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "at no cost").replace("merge, publish", "merge and publish")
    rows = [(500, PROSE + mit + PROSE, None, None, 0), (501, PROSE * 30 + changed, None, None, 0), (502, mit[:300], None, None, 0), (503, "Released under the MIT License.\n" + PROSE, None, None, 0)]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows + awkward()[:8])).collect()}
    assert got[500].best_license == "MIT" and got[500].best_coverage == 1.0
    assert (PROSE + mit + PROSE).encode()[got[500].span_start : got[500].span_end].decode() == mit.rstrip(".")
    assert got[501].best_license == "MIT" and 0.9 < got[501].best_coverage < 1 and got[502].n_licenses == 0 and got[503].licenses == "MIT line" and got[3].n_words == 0
    assert licenses.scan(frame(spark, [])).count() == 0


def test_license_after_other_windows(spark):
    line = "Released under the MIT License."
    rows = [
        (510, "the one the two the three the four the five " + PROSE * 2 + line, None, None, 0),
        (511, (PROSE + "the " * 40) * 30 + line, None, None, 0),
        (512, line.replace("Released", "Published") * 9, None, None, 0),
        (513, "license mit the under " * 9, None, None, 0),
        (514, line, None, None, 0),
    ]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows), {"MIT line": line, "two": "mit license"}).collect()}
    for i in (510, 511):
        t = next(r[1] for r in rows if r[0] == i)
        assert got[i].n_licenses == 2 and got[i].best_license == "MIT line" and got[i].best_coverage == 1.0 and t[got[i].span_start : got[i].span_end] == line.rstrip(".")
    assert {r.doc_id: r.best_coverage for r in licenses.scan(frame(spark, rows[2:]), {"MIT line": line}).collect()} == {512: 0.8, 513: 0.0, 514: 1.0}
    assert licenses.scan(frame(spark, [(1, "mit license", None, None, 0)]), {"two": "mit license"}).first().best_coverage == 1.0


def test_licenses_with_foreign_words(spark):
    """Foreign words between the licence's own, and words of its own that stand around it, as many as there may be."""
    import random

    rng = random.Random(4)
    rows, names = [], ["Apache-2.0 notice", "MIT", "BSD-3-Clause", "MPL-2.0 notice", "LGPL-2.1 notice"]
    for name in names:
        words = licenses.TEMPLATES[name].split()
        for gap in (0, 1, 2, 5, 10):
            body = " ".join(w + " " + " ".join(f"qq{rng.randrange(99)}" for _ in range(gap)) for w in words)
            rows.append((len(rows), PROSE * gap + body + PROSE, None, None, 0))
    rows.append((len(rows), " ".join("the of and to " * 8 + w for w in licenses.TEMPLATES["MPL-2.0 notice"].split()), None, None, 0))
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    for i, r in got.items():
        if i < len(rows) - 1:
            assert names[i // 5] in r.licenses.split(",") and (r.best_coverage == 1.0)
    assert licenses.scan(frame(spark, [(1, PROSE * 200, None, None, 0)])).first().n_licenses == 0


def test_licenses_against_every_window(spark):
    import random

    rng = random.Random(8)
    long = "alpha beta gamma delta alpha eps zeta beta eta eps delta gamma theta"
    templates = {"one": "alpha beta gamma delta alpha eps", "two": "beta beta zeta eta", "three": "eps", "long": long}
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "other"]) for _ in range(rng.randrange(0, 150))) for _ in range(300)]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    for threshold in (0.8, 0.5):
        got = {r.doc_id: r for r in licenses.scan(frame(spark, rows), templates, threshold).collect()}
        for i, t in enumerate(texts):
            w, best = t.split(), {}
            for name, body in templates.items():
                b = body.split()
                if len(b) < licenses.LINE:
                    windows = [[x for x in w[a : a + n] if x in b] for a in range(len(w)) if w[a] in b for n in (len(b), 2 * len(b))]
                else:
                    own = [x for x in w if x in b]
                    windows = [own[a : a + n] for a in range(len(own)) for n in (len(b), 2 * len(b))]
                    n = 4 * len(b)
                    while len(own) > n // 2:
                        windows += [own[a : a + n] for a in range(0, len(own), n // 2)]
                        n *= 2
                best[name] = max([len(licenses.align(b, x)) / len(b) for x in windows], default=0)
            found = {n: c for n, c in best.items() if c >= threshold}
            assert got[i].licenses == ",".join(sorted(found)) and got[i].best_coverage == max(found.values(), default=0.0), t
            assert got[i].best_license == min(found, key=lambda n: (-found[n], n), default=None)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.lists(st.integers(0, 4), min_size=1, max_size=9), st.integers(1, 20))
def test_shared_words(text, template, wide):
    from collections import Counter

    place = np.flatnonzero(np.isin(text, template))
    if not len(place):
        return
    got = licenses.shared(place, np.array(text)[place], np.bincount(template, minlength=5), wide)
    assert got.tolist() == [sum((Counter(text[p : p + wide]) & Counter(template)).values()) for p in place.tolist()]


def test_quality(spark):
    rows = [(i, PROSE[i % 40 :] * 3 if i % 3 else "BUY!! NOW!! " * 20 + str(i), "en", "s", 0) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0), (6, 1, 0)] + [(9000 + i, 0, 0) for i in range(5000)], "doc_id bigint, quality int, toxic int")
    got = quality.quality(frame(spark, rows + awkward()[2:4]), labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in got if r.held_out]) > 0.98
    df = frame(spark, rows)
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and abs(kept.count() - 200) <= 4
    assert {r.score for r in quality.quality(df, labels.where("false")).collect()} == {0.5}
    assert quality.quality(frame(spark, []), labels).count() == 0


def plain_features(text):
    """quality.features in plain Python, of one text."""
    import math
    from collections import Counter

    raw = (text or "").encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    low = [raw[a:b].translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for a, b in found]
    n, size = len(found), len(raw)
    share = lambda a, b: a / max(b, 1)
    times = Counter(low)
    count = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    others = [*range(34, 44), 45, 47, *range(58, 63), 64, *range(91, 97), 123, 125, 126]
    lines = [tuple(re.findall(rb"[^\x20\x09-\x0D]+", line.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))) for line in raw.split(b"\n")]
    lines = [x for x in lines if x]
    return [
        math.log1p(n), math.log1p(share(size, n)), len(times) / math.sqrt(max(n, 1) * 10.0), share(sum(x == y for x, y in zip(low, low[1:], strict=False)), n), share(sum(x == y for x, y in zip(low, low[2:], strict=False)), n),
        share(len(set(zip(low, low[1:], strict=False))), max(n - 1, 1)), share(count(range(65, 91)), size), share(count(range(48, 58)), size), share(count([44]), n), share(count([46]), n), share(count([33, 63]), n), share(count([124]), n),
        share(count(others), size), share(count(range(128, 256)), size), share(count([10]), n), share(len(set(lines)), len(lines)), math.log1p(max((b - a for a, b in found), default=0)), share(sum(raw[b - 1] in (33, 63) for _, b in found), n),
        share(sum(65 <= raw[a] <= 90 for a, _ in found), n), share(sum(b - a == 1 for a, b in found), n), share(max(times.values(), default=0), n),
    ]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAb Z1,.!?|\n\té🙂-_") , max_size=60), max_size=6))
def test_quality_features(texts):
    raw = [t.encode() for t in texts]
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    got = quality.features(np.frombuffer(b"".join(raw), np.uint8), at)
    assert got.shape == (len(texts), len(quality.NAMES))
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, plain_features(text), rtol=1e-12, atol=1e-12), (text, [(n, a, b) for n, a, b in zip(quality.NAMES, row, plain_features(text), strict=True) if abs(a - b) > 1e-12])


def test_quality_fit_and_threshold():
    """The weights against a plain logistic fit on all pairs, the threshold against the plain quantile."""
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0.6, 1, (60, len(quality.NAMES))), rng.normal(0, 1, (90, len(quality.NAMES)))
    model = quality.Model(good, bad, 0.6)
    g, b = model.expand(good), model.expand(bad)
    pairs = (g[:, None, :] - b[None, :, :]).reshape(-1, g.shape[1])
    loss = lambda w: np.log1p(np.exp(-np.clip(pairs @ w, -40, 40))).mean() + 0.5e-4 * w @ w
    w = np.zeros(g.shape[1])
    for _ in range(3000):  # plain gradient steps on all pairs
        p = 1 / (1 + np.exp(-pairs @ w))
        w -= 1.0 * (-(pairs * (1 - p)[:, None]).mean(0) + 1e-4 * w)
    assert loss(model.w) < loss(np.zeros_like(w)) * 0.5 and loss(model.w) <= loss(w) * 1.25 + 1e-3
    order = np.argsort(np.concatenate([g @ w, b @ w]))
    mine = np.argsort(np.concatenate([g @ model.w, b @ model.w]))
    rank = lambda o: np.argsort(o)
    assert np.corrcoef(rank(order), rank(mine))[0, 1] > 0.95
    # as many good and bad ones, weighted, are below the threshold as the bad documents' share says
    below = lambda s: float((s < model.threshold).mean())
    assert abs(0.4 * below(g @ model.w) + 0.6 * below(b @ model.w) - 0.6) < 0.02
    x = np.concatenate([good, bad])
    plain = 1 / (1 + np.exp(-np.clip((model.expand(x) @ model.w - model.threshold) / model.scale, -500, 500)))
    assert np.allclose(model.score(x), plain)


def test_quality_query_against_plain_scores(spark, sf_dir):
    """The query's rows on a given table: each text's plain features, scored by the model that the query fits."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    from loomtrace.llm.langid import held_out

    model = quality.fit(docs, labels.where(~held_out("doc_id", 3, 1)))
    rows = docs.select("doc_id", "text").collect()
    plain = model.score(np.array([plain_features(r.text) for r in rows]))
    want = {r.doc_id: (zlib.crc32(str(r.doc_id).encode()) % 3 == 1, s) for r, s in zip(rows, plain, strict=True)}
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows) and all(g.held_out == want[g.doc_id][0] and abs(g.score - want[g.doc_id][1]) < 1e-9 and g.predicted == int(g.score >= 0.5) for g in got)
    held = {r.doc_id: r.quality for r in labels.collect() if want.get(r.doc_id, (False,))[0] and r.quality is not None}
    assert not held or np.mean([(want[k][1] >= 0.5) == v for k, v in held.items()]) >= 0.9


def test_quality_fit_takes_every_labelled_row(spark):
    """Of more rows than any sample once held: the fit of the table is that of all rows in memory, however they are dealt."""
    rng = np.random.default_rng(5)
    words = PROSE.split()
    texts = [" ".join(rng.choice(words, int(rng.integers(3, 30)))) + ("!" * int(rng.integers(0, 3)) if i % 2 else " 42, x") for i in range(8000)]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    label = lambda i: int(i % 2 == 0 or i % 17 == 0)
    labels = spark.createDataFrame([(i, label(i), 0) for i in range(8000)] + [(i, 1, 0) for i in range(9000, 9100)], "doc_id bigint, quality int, toxic int")
    raw = [t.encode() for t in texts]
    x = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    y = np.array([label(i) for i in range(8000)])
    want = quality.Model(x[y == 1], x[y == 0], float((y == 0).mean()))
    for dealt in (docs.repartition(1), docs.repartition(7)):
        got = quality.fit(dealt, labels)
        assert [e.tolist() for e in got.edges] == [e.tolist() for e in want.edges]
        assert np.allclose(got.w, want.w, atol=1e-4) and abs(got.threshold - want.threshold) < 1e-3 and abs(got.scale - want.scale) < 1e-3
    strengths = np.sort(want.expand(x) @ want.w)
    bad = int((y == 0).sum())
    assert abs(want.threshold - (strengths[bad - 1] + strengths[bad]) / 2) < 2 / quality.FINE


def test_quality_slope_is_that_of_all_pairs():
    rng = np.random.default_rng(6)
    good, bad = rng.normal(0.4, 1, (70, len(quality.NAMES))), rng.normal(0, 1, (90, len(quality.NAMES)))
    model = quality.Model(good, bad, 0.5)
    rows = quality.Rows(quality.on_grid(np.concatenate((good, bad))), np.repeat([1, 0], [len(good), len(bad)]))
    for part in (0.0, 0.3, 1.0):
        w = model.w
        model.w = np.rint(w * part * quality.WEIGHT) / quality.WEIGHT
        pairs = (model.expand(good)[:, None, :] - model.expand(bad)[None, :, :]).reshape(-1, len(w))
        plain = quality.RIDGE * model.w - (pairs / (1 + np.exp(pairs @ model.w))[:, None]).mean(0)
        assert np.abs(model.slope(*rows.sums(model.cells)) - plain).max() < 1e-3
        model.w = w


ITEMS = [(1, PROSE), (2, "alpha beta"), (3, None), (4, "--"), (5, OTHER), (6, "alpha, BETA!"), (7, "日本語"), (7, "eleven"), (None, "zzz")]


@pytest.mark.parametrize("block", [1 << 24, 40, 1])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    windows = {}
    for k, t in ITEMS:
        w = alnum_words(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).add("" if k is None else str(k))
    more = [(300, "so Alpha-beta is"), (301, "x " * 50 + PROSE[20:] + "y " * 9), (302, "alpha beta zzz"), (302, "qqq www eee"), (302, "alpha beta zzz"), (None, "alpha beta xx"), (None, None), (303, "日本語 zzz eleven " * 300)]
    docs = awkward() + [(i, t, None, None, 0) for i, t in more]
    want = []
    for i, t, *_ in docs:
        w, hit, found = alnum_words(t), set(), set()
        for j in range(len(w)):
            for n in range(1, 11):
                if tuple(w[j : j + n]) in windows and len(w[j : j + n]) == n:
                    hit.update(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        want.append((i, len(w), len(hit), len(found), decontam.sha_of_items(list(found)), len(hit) > 0))
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = rows_of(decontam.contamination_digests(frame(spark, docs), items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(want, key=lambda r: [(v is not None, v) for v in r])
    df = frame(spark, docs)
    cut = decontam.remove_spans(df, items)
    assert cut.columns == df.columns
    by = {r.doc_id: r.text for r in cut.collect()}
    assert by[6] == "a" and by[3] is None and "jumps" not in by[301] and by[300] == "so  is" and by[303].split() == []
    assert len(docs) == cut.count() and {r.text for r in cut.where("doc_id = 302").collect()} == {"", "qqq www eee"}
    assert decontam.contamination_digests(frame(spark, []), items).count() == 0
    assert decontam.contamination_digests(frame(spark), items.where("false")).where("contaminated").count() == 0


def test_benchmark_and_labels_with_clashing_columns(spark):
    from pyspark.sql import functions as F

    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(1, 22)], "doc_id bigint, quality int, toxic int")
    wide_items, wide_labels = items, labels
    for name in ("doc_id", "k", "t", "n_hit", "spans", "name"):
        wide_items = wide_items.withColumn(name, F.lit(name))
    for name in ("text", "__y", "h", "score", "c0"):
        wide_labels = wide_labels.withColumn(name, F.lit(name))
    one, two = [rows_of(decontam.contamination_digests(frame(spark), x), "doc_id", "n_words", "n_hit", "items_sha256") for x in (items, wide_items)]
    assert one == two
    one, two = [rows_of(quality.quality(frame(spark), x), "doc_id", "score", "predicted") for x in (labels, wide_labels)]
    assert one == two


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=4), min_size=1, max_size=5))
def test_fm_index(text, patterns):
    index = decontam.FMIndex(np.array(text))
    wide = max(map(len, patterns))
    lo, hi = index.search(np.array([p + [0] * (wide - len(p)) for p in patterns]), np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, lo.tolist(), hi.tolist(), strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text)) if text[i : i + len(p)] == p]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 300), st.integers(0, 2**32 - 1))
def test_packing(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 2**bits, n).astype(np.uint32)
    assert (tokenfile.unpack(tokenfile.pack(ids, bits), bits, n) == ids).all()


def test_random_access():
    ids = np.random.default_rng(1).integers(0, 50257, 5000).astype(np.uint32)
    f = tokenfile.TokenFile(b"".join(tokenfile.file_parts(3, 70, [5, 9, 11], [10, 4000, 990], ids, tokenfile.width(50257))))
    assert f.bits == 16 and (f.document(1) == ids[10:4010]).all() and (f.read(4990, 5000) == ids[4990:]).all() and len(f.read(7, 7)) == 0


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_BYTES", 500)
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(tokenfile, "fanout", lambda docs: 7)
    rows = in_order([(i, t or "") for i, t, *_ in awkward()] + [(40, "<|endoftext|> a"), (41, "it's  two\n\n lines "), (42, "x y z")] + [(None, f"null key {k}") for k in range(30)])
    want, at = [], 0
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = tokenfile.token_files(spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA), path, added=True)
    assert sorted([tuple(r) for r in got.collect()], key=lambda r: r[1]) == want
    assert tokenfile.token_files(frame(spark, []), path).count() == 0


def test_added_tokens_in_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    from loomtrace.llm.queries import op10_token_files

    texts = ["<|endoftext|> a", "a <|endoftext|> b", "a<|endoftext|>b c", " x  <|endoftext|>\n<|endoftext|>", "<|endoftext", PROSE, ""]
    spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want, at = [], 0
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows_of(op10_token_files(spark, str(tmp_path)), "doc_id", "start", "n_tokens", "ids_crc32") == want
