"""Phrase mining, circulant MinHash and the filter audit against brute force."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from broadsheet.llm import collocations, filter_audit, jaccard, minhash, packed
from tests.llm.test_pairs import LOWER, WORD, random_docs


def plain_phrases(rows, least, top):
    """{(lang, rank): (phrase, a, l, r, n, score)} by counting everything."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(LOWER)):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    many = {g: c for g, c in f.items() if c >= least}
    out = {}
    for lang in n:
        found = []
        for (own, w), a in many.items():
            if own != lang or len(w) < 2:
                continue
            cut = min(((2000000 * a) // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            longer = [c for (o, x), c in many.items() if o == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))]
            if all(100 * c < 80 * a for c in longer):
                found.append((-cut[0], -a, b" ".join(w), f[lang, w[: cut[1]]], f[lang, w[cut[1] :]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out[lang, rank] = (phrase.decode(), -a, left, right, n[lang], -score)
    return out


def phrase_rows(seed, n=150):
    rng = random.Random(seed)
    fixed = ["new york", "New York City", "once upon a time", "Grüße aus köln", "a b a b a b"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 8))]
        text = "".join(p + rng.choice([" ", ", ", ".", "\n", "\t", " ;", "\r\n", " ", ""]) for p in parts)
        rows.append((rng.choice(["en", "de", "und", None]), text if rng.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize("seed, held, bits", [(1, None, None), (2, 40, None), (3, None, 7)])
def test_phrases_match_brute_force(spark, monkeypatch, seed, held, bits):
    """Also with a task that sends after every few grams, and with bitmaps so small that they prune next to nothing."""
    if held:
        monkeypatch.setattr(collocations, "HELD_GRAMS", held)
        monkeypatch.setattr(collocations, "STEP_BYTES", 500)
    if bits:
        monkeypatch.setattr(collocations, "LEAST_BITS", bits)
    rows = phrase_rows(seed)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.mine(docs, least=5, top=40).collect()}
    assert got == plain_phrases(rows, 5, 40)


def test_counts_beyond_a_byte(spark):
    """A least count of 300 needs hits of four bytes."""
    rows = [("en", "x y z. x y q")] * 299 + [("en", "x y"), ("de", None), (None, "")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in collocations.mine(docs, least=300).collect()}
    assert got == {("en", "x y"): (599, 599, 599, 1796, 1000000)}
    one = [(r.phrase, r.score) for r in collocations.mine(docs, least=299).orderBy("rank").collect()]
    # "x y z" and "x y q" have half of the count of "x y": nothing is covered but "y z" and "y q".
    assert one == [("x y", 1000000), ("x y q", 665924), ("x y z", 665924)]


def test_scores_beyond_64_bits(spark):
    big = 5 * 10**18
    grams = spark.createDataFrame([(1, "en", "a", big), (1, "en", "b", big), (2, "en", "a b", big - 1)], "k int, lang string, phrase string, n long")
    r = collocations.score(grams).collect()[0]
    assert (r.a, r.l, r.r, r.score) == (big - 1, big, big, 2000000 * (big - 1) // (2 * big))


def test_phrases_of_odd_tables(spark):
    docs = spark.createDataFrame([(i, "red apple. " * 3, "en", "x", 1, 2) for i in range(20)] + [(None, None, None, None, 1, 2)], "doc_id long, text string, lang string, slice string, n int, k int")
    got = [(r.lang, r.rank, r.phrase, r.a, r.n) for r in collocations.mine(docs).collect()]
    assert got == [("en", 1, "red apple", 60, 120)]
    assert collocations.mine(docs.limit(0)).collect() == []
    long = spark.createDataFrame([("en", "left right " * 400_000)], "lang string, text string")
    top = {r.phrase: r.a for r in collocations.mine(long).collect()}
    assert top == {"left right left right": 399_999, "right left right left": 399_998}


def plain_linked(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().translate(LOWER))
        sets[i] = {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("seed, vocabulary, block", [(1, 40, 512), (2, 400, 512), (3, 400, 7)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, seed, vocabulary, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = random_docs(seed, 140, vocabulary)
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_linked(rows)


def test_unconnected_sets_of_a_large_group_meet_all_others(spark, monkeypatch):
    """A group of many blocks: chains whose ends are not similar to the least id, and sets that only a similar pair shares."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        w = list(base)
        for k in rng.sample(range(60), rng.choice([0, 1, 4, 6, 8])):
            w[k] = f"y{rng.randrange(5)}"
        rows.append((i * 2, " ".join(w)))
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_linked(rows)
    assert got == want and len({c for _, c, _ in want.values()}) > 5


def test_no_link_is_lost_to_chance():
    assert minhash.chance_of_missing(0.8) < 1e-11 and minhash.chance_of_missing(0.05) > 0.9999


def test_second_permutation_and_its_shifts():
    """A bijection (on a sample: no two places get one value), and signatures as its definition says, for any length."""
    places = np.random.default_rng(5).choice(2**32, 200_000, replace=False).astype(np.uint32)
    assert len(np.unique(minhash.second_permutation(places))) == len(places)
    for n in (1, 7, 5000):
        s = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        ring = minhash.first_permutation(s)
        want = [int(minhash.second_permutation((ring.astype(np.uint64) + np.uint64(k)).astype(np.uint32)).min()) for k in range(8)]
        assert minhash.signature(s, 8).tolist() == want


def test_coordinates_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(11)
    for share in (0.2, 0.5, 0.8):
        agree = []
        for _ in range(60):
            both = rng.integers(0, 2**63, 300).astype(np.uint64)
            rest = int(300 * (1 - share) / share / 2)
            a, b = (np.unique(np.append(both, rng.integers(0, 2**63, rest).astype(np.uint64))) for _ in range(2))
            agree.append((minhash.signature(a) == minhash.signature(b)).mean())
        assert abs(np.mean(agree) - share) < 0.03


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "x y z"), (2, "X y Z"), (None, "a b c d"), (3, None), (4, " "), (5, "one"), (6, "ONE")]
    docs = spark.createDataFrame([(*r, "e", "e", "e") for r in rows], "doc_id long, text string, kept string, center string, band string")
    got = sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in minhash.link(docs).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 3, None, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False)], key=str)
    assert minhash.link(docs.limit(0)).collect() == []
    text = " ".join(f"w{i % 9973}" for i in range(1_500_000))
    pair = spark.createDataFrame([(7, text), (9, text + " end")], "doc_id long, text string")
    assert {(r.id, r.component_id, r.kept) for r in minhash.link(pair).collect()} == {(7, 7, True), (9, 7, False)}


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = {}
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = ""
        fails += "A" if len(w) < 200 else ""
        fails += "B" if 100 * len(set(w)) < 50 * len(w) else ""
        fails += "C" if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else ""
        fails += "D" if re.search(r"[#$%&*|]", t) else ""
        fails += "E" if i is not None and i > first[t] else ""
        parts.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        shares = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, x in enumerate(order, 1):
                removed = [r for r in left if x in r[0]]
                failing = sum(x in r[0] for r in rows)
                left = [r for r in left if x not in r[0]]
                shares[x] += len(removed)
                out[part, order, step] = [len(left), len(removed), failing - len(removed), sum(r[0] == x for r in rows), sum(r[1] for r in removed), sum(r[2] for r in removed)]
        for (own, order, step), row in out.items():
            if own == part:
                row.append(shares[order[step - 1]])
    return out


def audited(spark, docs, labels):
    rows = filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows.collect()}


def test_audit_matches_brute_force(spark):
    """Nulls anywhere, copies in other parts, repeated ids, labels on several rows and of no document, a very long text."""
    rng = random.Random(4)
    texts = [" ".join(f"{rng.choice(['w', 'W', 'é', '#'])}{rng.randrange(n)}" for _ in range(m)) for n, m in ((20, 300), (900, 300), (900, 30), (5, 30), (900, 210), (3, 250))]
    texts += ["", " \n", None, "ABC def", "$", "WORD " * 200_000, "a\x0bb c"]
    docs = [(rng.choice([None, rng.randrange(60), i]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(90)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(40)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (500, 1, 1)]
    merged = {}
    for i, q, t in labels:
        have = merged.get(i, (0, 0))
        merged[i] = (max(have[0], q or 0), max(have[1], t or 0))
    assert audited(spark, docs, labels) == plain_audit(docs, [(i, q, t) for i, (q, t) in merged.items() if i is not None])


def test_audit_of_an_empty_table_and_clashing_names(spark):
    assert audited(spark, [], []) == {}
    docs = spark.createDataFrame([(1, "x", "en", 1, 2, 3)], "doc_id long, text string, lang string, mask int, first int, good int")
    rows = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == 600 and all(r.removed == (r.filter_order[r.step - 1] == "A") for r in rows)


def test_cells_are_recovered_exactly(spark):
    rng = random.Random(9)
    rows = [("p", rng.randrange(32), rng.random() < 0.3, rng.random() < 0.2) for _ in range(500)]
    got = filter_audit.cells(filter_audit.parity_sums(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean"), 5), 5).collect()[0]
    assert list(got["all"]) == [sum(r[1] == m for r in rows) for m in range(32)]
    assert list(got["good"]) == [sum(r[1] == m and r[2] for r in rows) for m in range(32)]
    assert list(got["toxic"]) == [sum(r[1] == m and r[3] for r in rows) for m in range(32)]
