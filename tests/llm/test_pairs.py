"""N-gram Jaccard join, substring dedup, decontamination and licenses against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import decontaminate, jaccard, licenses, packed, queries, repeats
from broadsheet.llm.signature_tree import Tree, bitmap

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def random_docs(seed: int, n: int, vocabulary: int = 40, most: int = 90) -> list[tuple[int, str]]:
    """Texts with exact and near copies, shared passages, empties and a null."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    docs: list[tuple[int, str | None]] = []
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.2:
            text = rng.choice(docs)[1]
        elif docs and kind < 0.6:
            base = (rng.choice(docs)[1] or "").split(" ")
            for _ in range(rng.randint(1, 3)):
                base[rng.randrange(len(base))] = rng.choice(words).upper()
            text = " ".join(base)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.randint(1, most)))
        if text and rng.random() < 0.15:
            text = text + "\n" + passage
        docs.append((i * 3 + 1, text))
    return docs + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \t\n"), (10**6 + 3, "one"), (10**6 + 4, "ONE"), (10**6 + 5, "é É")]


def plain_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def plain_repeats(rows: list[tuple[int, str | None]], width: int) -> dict[int, tuple[int, int, str]]:
    words = {i: (t.encode().split() if t else []) for i, t in rows}
    low: dict = {}
    for i, w in words.items():
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            low[k] = min(low.get(k, i), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if low[tuple(w[p : p + width])] < i:
                gone[p : p + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = random_docs(seed, 150)
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)


@pytest.mark.parametrize("host_blocks, hot_level", [(64, 20), (1, 5), (0, 20), (64, 5)])
def test_blocks_and_hosts_match_brute_force(spark, monkeypatch, host_blocks, hot_level):
    """Groups larger than a block, ranked hashes, and few salts, so that completion has to find links; hosts dealt by
    blocks, and all those of several blocks, or of any size, dealt by hashes; hosts of frequent hashes known beforehand."""
    monkeypatch.setattr(jaccard, "HOT_LEVEL", hot_level)
    by_hash, dealt = jaccard._by_hash, []
    monkeypatch.setattr(jaccard, "_by_hash", lambda *a: dealt.append(by_hash(*a)) or dealt[-1])
    monkeypatch.setattr(jaccard, "HOST_BLOCKS", host_blocks)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "SALTS", 1)
    monkeypatch.setattr(jaccard, "FIRST_LEVEL", 1)
    rng = random.Random(5)
    base = [f"x{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in rng.sample(range(60), rng.randint(0, 4)):
            w[k] = f"y{rng.randrange(6)}"
        rows.append((i, " ".join(w)))
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)
    assert bool(dealt) == (host_blocks < 64)


def test_coverage_counts_lose_no_class():
    """Classes that several flushes hold, with a hash that nearly all of them share: no count falls short."""
    rng = np.random.default_rng(7)
    sets = {n: np.unique(np.append(rng.integers(1, 60, rng.integers(1, 12)), [0] * (n % 9 > 0))).astype(np.uint64) for n in range(1, 60)}
    flushes = [rng.choice(np.arange(1, 60), 20, replace=False).tolist() for _ in range(6)]
    held = {n for f in flushes for n in f}
    want = {n: sum(any(h in sets[m] for m in held if m != n) for h in sets[n].tolist()) for n in held}
    rows: dict[int, list] = {}
    for f in flushes:
        for batch in jaccard._flush([(sets[n], np.full(len(sets[n]), n, np.int64)) for n in f if len(sets[n])], 4):
            for row in batch.to_pylist():
                rows.setdefault(row["bucket"], []).append(row)
    got = dict.fromkeys(held, 0)
    for bucket in rows.values():
        for r in jaccard._shared(pa.Table.from_pylist(bucket, packed.ARROW)).to_pylist():
            got[r["c1"]] += r["shared"]
    assert all(got[n] >= want[n] for n in held)
    assert all(got[n] == want[n] for n in held if sum(n in f for f in flushes) == 1)
    assert sum(len(r["owners"]) // 8 for b, bucket in rows.items() if b >= 0 for r in bucket) < sum(len(sets[n]) for f in flushes for n in f)


def test_whole_documents_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_ngram_jaccard_join(spark, sf).collect()}
    assert got == plain_components(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op5_substring_dedup(spark, sf).collect()}
    assert got == plain_repeats(rows, 50)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(120):
        s = rng.integers(0, 2**63, rng.integers(1, 200)).astype(np.uint64)
        if sets and rng.random() < 0.6:
            base = sets[rng.integers(len(sets))]
            s = np.concatenate([base[rng.random(len(base)) < 0.9], s[:10]])
        sets.append(np.unique(s))
    tree = Tree(np.stack([bitmap(s) for s in sets]), np.array([len(s) for s in sets]), np.array([s[0] for s in sets]))
    found = {tuple(sorted(p)) for a, b in tree.pairs(3, 4) for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))}
    assert {tuple(sorted(p)) for p in want} <= found and len(found) < 120 * 119 // 2


@pytest.mark.parametrize("width", [4, 10, 50])
def test_repeats_match_brute_force(spark, width):
    rows = random_docs(7, 120, vocabulary=12 if width == 4 else 60, most=150)
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, bucket string, id boolean")
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(df, window=width, digest=True).collect()}
    assert got == plain_repeats(rows, width)


def test_repeats_keep_untouched_texts_and_carried_columns(spark):
    text = " ".join(f"a{i}" for i in range(10))
    df = spark.createDataFrame([(1, "x\n" + text, "p"), (2, text + "  tail\n", "q"), (3, "own  text", None), (None, text, "r")], "doc_id long, text string, lang string")
    got = {r.id: (r.kept, r.n_removed, r.rest.lang, [(s.start, s.end) for s in r.spans]) for r in repeats.remove_repeats(df, window=4, carry=("lang",)).collect()}
    assert got == {1: ("x\n" + text, 0, "p", []), 2: ("tail", 10, "q", [(0, 10)]), 3: ("own  text", 0, None, []), None: ("", 10, "r", [(0, 10)])}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.link(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert licenses.scan(none).count() == 0
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert decontaminate.find(none, items).count() == 0
    assert decontaminate.find(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).where("contaminated").count() == 0


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(300)]
    item = [rng.choice(words) for _ in range(30)]
    changed = list(item)
    for k in (4, 13, 22):
        changed[k] = "other"
    half = [w if i % 2 else "other" for i, w in enumerate(item)]
    filler = lambda: " ".join(rng.choice(words) for _ in range(40))
    docs = [(1, filler() + " " + " ".join(item) + "! " + filler()), (2, filler() + " " + " ".join(changed).upper() + filler()), (3, filler()), (4, " ".join(half)), (5, None), (6, ""), (7, "It is: SHORT item, five!"), (8, "it is a short item")]
    items = [(10, " ".join(item)), (11, "it is short item five"), (12, "t1 t2"), (13, None), (None, "x"), (14, " ".join(item))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for ship in (decontaminate.SHIP_SEEDS, 0):
        got = {r.id: r["items"] for r in decontaminate.find(d, b, ship_seeds=ship).collect()}
        assert got == {1: [10, 14], 2: [10, 14], 3: [], 4: [], 5: [], 6: [], 7: [11], 8: []}
        assert sorted(r.doc_id for r in decontaminate.keep_clean(d, b, ship_seeds=ship).collect()) == [3, 4, 5, 6, 8]


def test_seeds_hit_every_accepted_pattern():
    for n in range(1, decontaminate.WINDOW + 1):
        masks = next(m for low, high, m in decontaminate.CLASSES if low <= n <= high)
        places = [{s + k for k, c in enumerate(m) if c == "1"} for m in masks for s in range(n - len(m) + 1)]
        for gone in itertools.combinations(range(n), n - -(-decontaminate.AGREE * n // 100)):
            assert any(not p & set(gone) for p in places), (n, gone)


def test_decontamination_by_length_of_item(spark):
    """Every accepted pattern in one passage each: short items with one substitution, long ones with three, and tiny ones."""
    docs, items, want = [], [], {}
    for n in (1, 3, 5, 8, 9, 10, 15, 16):
        item = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for gone in itertools.combinations(range(n), n - -(-decontaminate.AGREE * n // 100)):
            want[len(docs)] = [n]
            docs.append((len(docs), "before " + " ".join("other" if k in gone else w for k, w in enumerate(item)) + " after"))
        worse = tuple(range(0, n, 2))[: 1 + n - -(-decontaminate.AGREE * n // 100)]
        want[len(docs)] = []
        docs.append((len(docs), "before " + " ".join("other" if k in worse else w for k, w in enumerate(item)) + " after"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for ship in (decontaminate.SHIP_SEEDS, 0):
        assert {r.id: r["items"] for r in decontaminate.find(d, b, ship_seeds=ship).collect()} == want


def test_decontamination_finds_every_planted_item(spark, sf):
    def flat(t):
        return " " + " ".join(re.findall(r"\w+", t.lower())) + " "

    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = [flat(r.text) for r in items.collect()]
    want = {r.doc_id for r in docs.collect() if any(t in flat(r.text) for t in texts)}
    got = {r.doc_id for r in queries.op8_benchmark_decontamination(spark, sf).where("contaminated").collect()}
    assert got == want and want


def test_patience_alignment():
    a = "the quick brown fox jumps over the lazy dog".split()
    b = "x the quick red fox jumps over a lazy dog y".split()
    pairs = licenses.patience(a, b)
    assert [a[i] for i, _ in pairs] == [b[j] for _, j in pairs] == "the quick fox jumps over lazy dog".split()
    assert licenses.patience([], a) == [] and licenses.patience(a, a) == [(i, i) for i in range(len(a))]


def test_licenses(spark, sf):
    mit = licenses.TEMPLATES["MIT"]
    docs = [(1, "code\nReleased under the MIT License.\nReleased under the MIT License."), (2, "intro " + mit.replace("Software", "Program").lower() + " end"), (3, "The license of the author"), (4, None), (5, ""), (6, mit[: len(mit) // 2])]
    got = {r.id: (r.n_findings, r.licenses) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (2, ["MIT notice"]), 2: (1, ["MIT"]), 3: (0, []), 4: (0, []), 5: (0, []), 6: (0, [])}
    # The notice lines that the tables hold.
    lines = {"All rights reserved.": "All rights reserved", "Released under the MIT License.": "MIT notice", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0 notice", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0 notice", "Licensed under the Apache License, Version 2.0.": "Apache-2.0 notice"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op2_license_scan(spark, sf).collect():
        assert r.licenses == sorted(n for line, n in lines.items() if line in texts[r.doc_id]), r.doc_id


def test_all_rights_reserved_and_whole_bodies(spark, sf):
    t = licenses.TEMPLATES
    head = t["BSD-3-Clause"].split(" THIS SOFTWARE")[0]
    docs = [(1, "text\nAll rights reserved.\nmore"), (2, "Copyright (c) 2021 Example Corp. All rights reserved."), (3, t["BSD-2-Clause"]), (4, t["BSD-3-Clause"]), (5, t["ISC"]), (6, head), (7, "all rights are reserved")]
    got = {r.id: r.licenses for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: ["All rights reserved"], 2: ["All rights reserved"], 3: ["BSD-2-Clause"], 4: ["BSD-3-Clause"], 5: ["ISC"], 6: [], 7: []}
    planted = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if "All rights reserved." in (r.text or "")}
    found = {r.doc_id for r in queries.op2_license_scan(spark, sf).collect() if "All rights reserved" in r.licenses}
    assert planted and found == planted


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0 notice"]),
        ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0 notice"]),
        ("Licensed under CC BY 3.0.", []),
        ("GNU General Public License, version 1", []),
        ("Licensed under the GNU General Public License, version 1.", []),
        ("Licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0 notice"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0 notice"]),
        ("Licensed under the Sleepycat License.", []),
        ("Released under the BSD License.", ["BSD notice"]),
    ],
)
def test_deciding_words(text, want):
    got = licenses.Scanner(licenses.TEMPLATES).scan(pa.array([text]))
    assert [x[0] for x in got[0]] == want


def test_licenses_match_alignment_over_all_windows():
    """Brute force: every template aligned with every window of its length and half as much again."""
    rng = random.Random(12)
    names = ["MIT", "ISC", "Unlicense", "BSD-2-Clause", "GPL-3.0-or-later", "CC-BY-NC-4.0 long notice"]
    scanner = licenses.Scanner({n: licenses.TEMPLATES[n] for n in names})
    words = "a of the to and system river notice permission copy license software".split()
    texts = []
    for n in names * 3:
        body = licenses.TEMPLATES[n].split()
        share = rng.choice([0.03, 0.1, 0.3])
        made = [rng.choice(words) if rng.random() < share else w for w in body if rng.random() > share / 4]
        around = [rng.choice(words) for _ in range(60)]
        texts.append(" ".join(around + made + around))
    texts += [" ".join(rng.choice(words) for _ in range(300)), "permission is hereby granted " * 400]
    tokens = [w.tolist() for w in np.split(licenses._tokens(pa.array(texts)).hash, licenses._tokens(pa.array(texts)).bounds[1:-1])]
    for text, own, found in zip(texts, tokens, scanner.scan(pa.array(texts))):
        want = set()
        for t, template in enumerate(scanner.tokens):
            reach = len(template) + len(template) // 2
            if any(scanner._fits(t, own[a : a + reach]) for a in range(0, max(1, len(own) - len(template)), max(1, len(template) // 20))):
                want.add(scanner.names[t])
        # Of overlapping findings one stays, so what is found is part of what fits, and nothing is missed altogether.
        got = {x[0] for x in found}
        assert got <= want and bool(got) == bool(want), text[:80]


SHORT = [n for n in licenses.TEMPLATES if len(licenses._plain(licenses.TEMPLATES[n])) <= licenses.SHORT]


@pytest.mark.parametrize("name", SHORT)
def test_short_templates_with_every_single_change(name):
    """Every substitution, deletion and insertion of a word: a template is found where any window around fits it."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    words = licenses._plain(licenses.TEMPLATES[name])
    made = [words]
    for p in range(len(words)):
        made += [[*words[:p], "our", *words[p + 1 :]], [*words[:p], *words[p + 1 :]], [*words[:p], "our", *words[p:]], [*words[:p], "our", "own", *words[p:]]]
        made += [[*words[:p], "MIT", *words[p + 1 :]], [*words[:p], "3", *words[p:]]]
    texts = [" ".join(["so", "it", "is", *m, "and", "so", "on"]) for m in made]
    tokens = licenses._tokens(pa.array(texts))
    own = [w.tolist() for w in np.split(tokens.hash, tokens.bounds[1:-1])]
    for text, window, got in zip(texts, own, scanner.scan(pa.array(texts))):
        want = set()
        for t, template in enumerate(scanner.tokens):
            reach = len(template) + max(2, len(template) // 5)
            if len(template) <= licenses.SHORT and any(scanner._fits(t, window[a:b], *licenses._beside(window, a, b)) for a in range(len(window)) for b in range(a + 1, min(len(window), a + reach) + 1)):
                want.add(scanner.names[t])
        found = {x[0] for x in got}
        # Of templates that fit one place one stays: the one with the most aligned tokens.
        assert found <= want and bool(found) == bool(want), (text, want, found)
    assert name in {x[0] for x in scanner.scan(pa.array(texts[:1]))[0]}


@pytest.mark.parametrize("text", ["Licensed under an MIT License.", "Released under an MIT License.", "Licensed under a BSD License.", "Licensed under our MIT License here", "All my rights are reserved"])
def test_short_notices_with_a_changed_word(text):
    assert len(licenses.Scanner(licenses.TEMPLATES).scan(pa.array([text]))[0]) == 1


def test_scans_of_odd_rows(spark):
    """Null ids, clashing names, repeated rows and a very long text."""
    long = "word " * 200_000 + "Released under the MIT License. " + "word " * 1000
    df = spark.createDataFrame([(None, "Released under the MIT License.", 1, "x"), ("b", long, 2, "y"), ("b", None, 3, None), ("b", long, 2, "y")], "doc_id string, text string, coverage int, licenses string")
    got = [(r.id, r.n_findings, r.licenses) for r in licenses.scan(df).collect()]
    assert got == [(None, 1, ["MIT notice"]), ("b", 1, ["MIT notice"]), ("b", 0, []), ("b", 1, ["MIT notice"])]


def test_decontamination_of_odd_rows_is_the_same_with_any_benchmark(spark):
    """Null and repeated ids, clashing names and a very long text, with a shipped index and with stored ones."""
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(None, "so " + item, "p", 1), (7, item, "q", 2), (7, "nothing here", None, 3), (8, "filler " * 100_000 + item, "r", 4), (9, None, "s", 5)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, seed int")
    b = spark.createDataFrame([(1, item), (1, "another item of some length to look for"), (2, item), (None, item)], "item_id long, text string")
    for ship in (decontaminate.SHIP_SEEDS, 10, 0):
        got = [(r.id, r.contaminated, r.n_items, r["items"]) for r in decontaminate.find(d, b, ship_seeds=ship).collect()]
        assert got == [(None, True, 2, [1, 2]), (7, True, 2, [1, 2]), (7, False, 0, []), (8, True, 2, [1, 2]), (9, False, 0, [])]
        assert [r.seed for r in decontaminate.keep_clean(d, b, ship_seeds=ship).collect()] == [3, 5]
    with pytest.raises(TypeError):
        decontaminate.find(d.withColumn("doc_id", F.lit("x")), b)


def plain_documents(rows):
    """Components of documents that may have several sets: rows that repeat an id are one vertex."""
    of = plain_components([(k, t) for k, (_, t) in enumerate(rows)])
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, _) in enumerate(rows):
        a, b = find(i), find(rows[of[k][1]][0])
        up[max(a, b)] = min(a, b)
    return sorted((i, of[k][0], find(i)) for k, (i, _) in enumerate(rows))


def test_rows_that_repeat_an_id_are_one_document(spark):
    a, b, c = ("a b c d e f g h", "k l m n o p q r", "s t u v w x y z")
    rows = [(5, a), (5, b), (2, b), (3, a), (9, c), (9, ""), (9, c), (4, ""), (4, None), (1, "z z"), (8, c + " more"), (8, "z z")]
    rng = random.Random(3)
    many = [(rng.randrange(70), t) for _, t in random_docs(11, 90)]
    for part in (rows, many):
        df = spark.createDataFrame([(*r, "x", 0) for r in part] + [(None, a, "x", 0)], "doc_id long, text string, id string, label int")
        got = [(r.id, r.n_shingles, r.component_id) for r in jaccard.link(df).collect()]
        assert sorted(x for x in got if x[0] is not None) == plain_documents(part)
        assert [x[2] for x in got if x[0] is None] == [None]
    with pytest.raises(TypeError):
        jaccard.link(df.withColumn("doc_id", F.lit("5")))


def test_very_long_text_is_handled_whole(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000))
    rows = [(1, long), (2, long + " end"), (3, "start " + long), (4, "short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component_id for r in jaccard.link(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    got = {r.id: (r.n_words, r.n_removed) for r in repeats.remove_repeats(df, digest=True).collect()}
    assert got == {1: (150_000, 0), 2: (150_001, 150_000), 3: (150_001, 150_000), 4: (2, 0)}
