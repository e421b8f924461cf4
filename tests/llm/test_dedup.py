"""Near copies and repeated bytes against plain versions."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtrace.llm import minmax, neardup, suffix

from .helpers import OTHER, PROSE, SCHEMA, awkward, frame, in_order, rows_of, space_words


def plain_groups(rows, percent=85):
    sets = {}
    for i, t, *_ in rows:
        w = space_words(t)
        sets.setdefault(i, []).append(frozenset([tuple(w[j : j + 3]) for j in range(len(w) - 2)] if len(w) >= 3 else [tuple(w)] if w else []))
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return [(i, top(i) if i is not None else None) for i, *_ in rows]


@pytest.mark.parametrize("block, small, pivots", [(512, 16, 64), (2, 1, 1), (5, 3, 2)])
def test_near_groups(spark, monkeypatch, block, small, pivots):
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", block)
    monkeypatch.setattr(neardup, "PIVOTS", pivots)
    monkeypatch.setattr(neardup, "SMALL", small)
    rows = awkward() + [(100 + k, PROSE * 6 + " ".join(f"w{k}x{j}" for j in range(k % 7)), "en", "s", 0) for k in range(40)]
    # families whose members share bands, but aren't all linked: each has lost another part, and a chain of small changes
    base = [f"b{j}" for j in range(60)]
    rows += [(300 + k, " ".join(base[: 2 * k] + base[2 * k + 6 :]), "en", "s", 0) for k in range(27)] + [(400 + k, " ".join(base[k:] + [f"c{j}" for j in range(k)]), "en", "s", 0) for k in range(24)]
    got = rows_of(neardup.near_groups(frame(spark, rows)), "doc_id", "component_id")
    assert got == sorted(plain_groups(rows), key=lambda r: [(v is not None, v) for v in r])


def test_kept_documents(spark):
    df = frame(spark)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 9 in ids and 10 not in ids and 8 not in ids and None in ids and len(ids) == len(set(ids))


def test_near_empty(spark):
    assert neardup.near_groups(frame(spark, [])).count() == 0
    assert neardup.keep_one(frame(spark, [])).count() == 0


def test_same_key_other_text_links_through_the_document(spark):
    rows = [(1, "a b c d e", None, None, 0), (2, "a b c d e", None, None, 0), (2, "v w x y z", None, None, 0), (3, "v w x y z", None, None, 0)]
    assert {r.component_id for r in neardup.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == {1}


def lookalikes(n):
    """Texts of likeness 0.7 to 0.8: each has lost another stretch of one text; every tenth is a near copy of the one before it."""
    rng, out = np.random.default_rng(7), []
    for k in range(n):
        words = [f"b{j}" for j in range(100)]
        at = int(rng.integers(0, 92))
        words[at : at + 8] = [f"x{k}y{j}" for j in range(8)]
        out.append((k, out[-1][1] + " more" if k % 10 == 9 else " ".join(words), "en", "s", 0))
    return out


def test_rows_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    """A group of look-alikes that mostly aren't linked: each member goes to a bounded number of tasks, and no link is lost."""
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    made, arrow_map = [], neardup.arrow_map

    def counted(df, function, schema):
        if schema.startswith("a "):
            made[-1] += df.count()
        return arrow_map(df, function, schema)

    monkeypatch.setattr(neardup, "arrow_map", counted)
    for n in (80, 240):
        made.append(0)
        rows = lookalikes(n)
        assert rows_of(neardup.near_groups(frame(spark, rows)), "doc_id", "component_id") == plain_groups(rows)
    assert made[1] <= 4.5 * made[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=25), min_size=1, max_size=12), st.sampled_from([50, 80, 85, 100]))
def test_linked_sets_have_a_rare_value_in_common(sets, percent):
    part = [np.array(sorted(x), np.uint64) for x in sets]
    rare = minmax.Rarest(np.concatenate(part), np.cumsum([0, *map(len, part)]), percent)
    for x in range(len(part)):
        meets = rare.meets(x)
        assert all(meets[y] for y in range(len(part)) if minmax.linked(part[x], part[y], percent))


def test_signature_estimates_likeness():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    other = np.unique(np.concatenate((base[:800], rng.integers(0, 2**63, 200).astype(np.uint64))))
    s = minmax.signatures(np.concatenate((base, other)), np.array([0, len(base), len(base) + len(other)]))
    assert abs((s[0] == s[1]).mean() - minmax.common(base, other) / (len(base) + len(other) - minmax.common(base, other))) < 0.17


def plain_repeats(rows, length=100):
    rows = in_order(rows)
    seen, out = set(), []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        c = np.zeros(len(raw) + 1, np.int64)
        for j in range(len(raw) - length + 1):
            w = raw[j : j + length]
            if w in seen:
                c[j] += 1
                c[j + length] -= 1
            seen.add(w)
        gone = np.cumsum(c[:-1]) > 0
        spans = (int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))) if len(raw) else 0
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])


@pytest.mark.parametrize("big, part", [(4000, 16 << 20), (1, 16 << 20), (3, 2000), (0, 1)])
def test_repeated_bytes(spark, monkeypatch, big, part):
    monkeypatch.setattr(suffix, "BIG", big)
    monkeypatch.setattr(suffix, "PART_BYTES", part)
    rows = awkward() + [(200 + k, f"{k} " * 30 + PROSE + f" {k * k} " * 20, "en", "s", 0) for k in range(25)]
    rows += [(5, PROSE * 2 + "x", "en", "s", 0), (5, OTHER * 2, "en", "s", 0), (5, OTHER * 2, "fr", "s", 0), (None, PROSE, "fr", "s", 0)]
    got = rows_of(suffix.repeated_bytes(frame(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain_repeats(rows)


def test_many_rows_without_a_key(spark):
    rows = [(None, f"row {k % 1500} " * (k % 40) + PROSE[: k % 120], "en", "s", 0) for k in range(5000)] + [(7, PROSE, "en", "s", 0)] * 40 + [(None, None, None, None, None)] * 30
    got = rows_of(suffix.repeated_bytes(frame(spark, rows, extra=False)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain_repeats(rows)


def test_a_text_of_megabytes(spark):
    import random

    rng = random.Random(4)
    rows = [(1, "".join(rng.choice("abcdef") for _ in range(700_000)), "en", "s", 0)]
    rows += [(2, rows[0][1][300_000:300_500] + "z" * 250 + rows[0][1][1000:1100], "en", "s", 0)]
    got = {r.doc_id: r for r in suffix.repeated_bytes(frame(spark, rows)).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans) == (0, 500 + 249 + 100, 2)


def test_repeats_empty(spark):
    assert suffix.repeated_bytes(frame(spark, [])).count() == 0
    assert suffix.drop_repeats(frame(spark, [])).count() == 0


def test_dropped_repeats_keep_whole_characters(spark):
    rows = [(1, "ü" * 80 + PROSE, None, None, 0), (2, "é" + "ü" * 80, None, None, 0), (3, None, None, None, None)]
    df = frame(spark, rows)
    got = suffix.drop_repeats(df)
    assert got.columns == df.columns
    by = {r.doc_id: r for r in got.collect()}
    assert by[3].text is None and by[2].n_chars == len(by[2].text) < 81 and by[1].text.endswith(PROSE)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_difference_cover_order(values):
    t = np.array(values, np.int64)
    order = suffix.difference_cover_order(t, 1000).tolist()
    assert order == sorted(range(len(values)), key=lambda i: values[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=30), max_size=6), st.integers(1, 9))
def test_later_windows(texts, length):
    raw = [t.encode() for t in texts]
    got = suffix.later_windows(raw, np.arange(len(raw)), length)
    seen, want = set(), []
    for t in raw:
        for i in range(len(t)):
            w = t[i : i + length]
            want.append(len(w) == length and w in seen)
            if len(w) == length:
                seen.add(w)
    assert got.tolist() == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=200), max_size=5))
def test_runs_hold_every_window_once(texts):
    from loomtrace.llm import kernels

    raw, at = kernels.flat_texts([t.encode() for t in texts])
    _, _, start, more, _ = suffix.runs(raw, at, 20, 8, segment=37)
    got = sorted(w for s, m in zip(start.tolist(), more.tolist(), strict=True) for w in range(s, s + m + 1))
    assert got == [int(at[r]) + i for r in range(len(texts)) for i in range(len(texts[r]) - 19)]
