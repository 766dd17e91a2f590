"""Near duplicates, lines, benchmark passages, top-k and URLs against brute force."""

import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, graph, linededup, neardup, shared, topk, urlfilter
from tallyspark.llm.bloom import Bloom

SAMPLES = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def varied(rng, text, share):
    return " ".join(rng.choice(["zz", "qq", "vv"]) + str(rng.randint(0, 99)) if rng.random() < share else w for w in text.split(" "))


# ---------------------------------------------------------------- near duplicates


def brute_classes(docs):
    sets, sequence = {}, {}
    for d, t in docs:
        w = words(t)
        sequence[d] = " ".join(w)
        sets[d] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    rep = {}
    for d in sorted(sequence):
        rep.setdefault(sequence[d] or d, d)
    reps, links, parent = sorted({r for k, r in rep.items() if isinstance(k, str)}), Counter(), {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(reps):
        for b in reps[:i]:
            common = len(sets[a] & sets[b])
            if 9 * common >= 4 * (len(sets[a]) + len(sets[b])):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    out = {}
    for d in sequence:
        own = rep[sequence[d] or d]
        out[d] = (root(own), links[own], own)
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "CHECK_BLOCK", block)
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", block * 2)
    rng, vocab = random.Random(1), vocabulary(1)
    docs = [(0, None), (1, ""), (2, "one two"), (3, "One, two!"), (4, "...")]
    for base in range(12):
        text = " ".join(rng.choice(vocab) for _ in range(rng.choice([6, 60, 200])))
        docs += [(10 + 40 * base + k, varied(rng, text, rng.choice([0, 0.005, 0.02, 0.05]))) for k in range(rng.choice([1, 3, 30]))]
    table = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, class_id string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links, r.copy_of) for r in neardup.near_duplicates(table).collect()}
    assert got == brute_classes(docs)


def test_lower_threshold_equals_brute_force(spark):
    rng, vocab = random.Random(9), vocabulary(9)
    docs = []
    for base in range(60):
        own = [rng.choice(vocab) for _ in range(150)]
        # a changed word every 27 words takes five shingles: a similarity between 0.5 and 0.8
        docs += [(2 * base, " ".join(own)), (2 * base + 1, " ".join("zz" if k % 27 == 13 else w for k, w in enumerate(own)))]
        docs += [(1000 + base, " ".join([*own[:100], *(rng.choice(vocab) for _ in range(50))]))]
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in docs}
    links = {a: sum(a != b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.45 for b in sets) for a in sets}
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), threshold=0.45)
    assert {r.doc_id: r.n_links for r in got.collect()} == links and min(links.values()) >= 0 < max(links.values())


def test_stage_keeps_one_of_each(spark):
    docs = spark.createDataFrame([(5, "a b c d e f", 1), (3, "A b c d e f.", 2), (3, "A b c d e f.", 2), (7, "other words", 3), (None, "a b", 4), (8, None, 5), (9, "", 6)], "doc_id long, text string, extra int")
    got = neardup.drop_near_duplicates(docs)
    assert got.columns == docs.columns and sorted(r.extra for r in got.collect()) == [2, 3, 4, 5, 6]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_stage_tells_rows_of_one_id_apart(spark):
    long = " ".join(f"w{k}" for k in range(100))
    docs = spark.createDataFrame([(3, long, 1), (5, f"{long} more", 2), (5, "a clean text of other words", 3), (5, "and one more clean text", 4), (5, "and one more clean text", 4), (7, "x " + long[::-1], 5), (7, long[::-1], 5), (7, long[::-1].upper(), 5)], "doc_id long, text string, extra int")
    assert sorted(r.extra for r in neardup.drop_near_duplicates(docs).collect()) == [1, 3, 4, 5]
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in neardup.near_duplicates(docs.where("doc_id < 7")).collect()) == [(3, 3, 1), (5, 3, 1), (5, 5, 0), (5, 5, 0), (5, 5, 0)]


def test_recall_of_the_forest():
    depth = neardup.prefix_depth(0.8)
    assert 1 - (1 - 0.8**depth) ** neardup.TREES >= 0.999 > 1 - (1 - 0.8 ** (depth + 1)) ** neardup.TREES
    n, top = neardup.TREES * neardup.DEPTH, neardup.DEPTH
    assert neardup.shortened({}, top, 0.8) == top - 1  # nothing found yet
    assert neardup.shortened({n: 3}, top, 0.8) == top  # copies alone are found by whole prefixes
    assert neardup.shortened({n: 90, int(0.87 * n): 1}, top, 0.8) == neardup.prefix_depth(0.85) < top
    assert neardup.shortened({n: 90, int(0.7 * n): 1}, top, 0.8) == depth == neardup.shortened({}, depth, 0.8)


def test_descent_finds_what_the_shortest_prefixes_find(spark):
    rng, vocab = random.Random(11), vocabulary(11)
    base = [[rng.choice(vocab) for _ in range(120)] for _ in range(40)]
    docs = [(2 * k + j, " ".join(varied(rng, " ".join(t), 0.02 * j).split())) for k, t in enumerate(base) for j in range(2)]
    got = {r.doc_id: r.n_links for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: v[1] for d, v in brute_classes(docs).items()}


def test_texts_of_colliding_words_are_told_apart(spark):
    morse = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    other = morse.translate(str.maketrans("ab", "ba"))
    got = neardup.near_duplicates(spark.createDataFrame([(1, morse), (2, other), (3, morse + "!")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_links_near_the_threshold(spark, threshold):
    rng = random.Random(13)
    docs = []
    for k in range(150):  # n + extra shingles, of which n are shared
        n = rng.randint(60, 120)
        own = [f"w{k}x{i}" for i in range(n)]
        more = int(n * (1 / threshold - 1) * rng.uniform(0.85, 1.15))
        docs += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own, *(f"v{k}x{i}" for i in range(more))]))]
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in docs}
    want = {d: int(len(sets[d] & sets[d ^ 1]) / len(sets[d] | sets[d ^ 1]) >= threshold) for d in sets}
    got = {r.doc_id: r.n_links for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), threshold=threshold).collect()}
    assert 20 < sum(want.values()) < 280 and sum(got[d] != want[d] for d in want) == 0


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


# ---------------------------------------------------------------- lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k, kind = rng.randint(0, len(out)), rng.random()
        if kind < 0.4 or not out:
            out.insert(k, rng.choice("abcé"))
        elif kind < 0.7:
            out.pop(min(k, len(out) - 1))
        else:
            out[min(k, len(out) - 1)] = rng.choice("abcé")
    return "".join(out)


def test_edit_distance(spark):
    rng = random.Random(1)
    pairs = [(a, edited(rng, a, rng.randint(0, 4))) for a in ("".join(rng.choice("abé") for _ in range(rng.randint(0, 9))) for _ in range(800))]
    table = spark.createDataFrame(pairs, "a string, b string")
    for t in (1, 2, 3):
        got = table.select("a", "b", linededup.edit_distance(F.col("a"), F.col("b"), t).alias("d")).collect()
        assert all(min(r.d, t + 1) == min(distance(r.a, r.b), t + 1) for r in got)


def brute_lines(docs, threshold, least):
    strip = lambda x: x.strip(linededup.BLANKS)
    first = {}
    for d, t in docs:
        for k, x in enumerate(t.split("\n")):
            if strip(x):
                first.setdefault(strip(x), (d, k))
    order, near = sorted(first, key=first.get), set()
    for i, x in enumerate(order):
        if len(x) >= least and any(len(y) >= least and abs(len(x) - len(y)) <= threshold and distance(x, y) <= threshold for y in order[:i]):
            near.add(x)
    stays = lambda d, k, x: not strip(x) or (first[strip(x)] == (d, k) and strip(x) not in near)
    return {d: "\n".join(x for k, x in enumerate(t.split("\n")) if stays(d, k, x)) for d, t in docs}


@pytest.mark.parametrize("threshold, pairwise", [(1, 16), (1, 2), (2, 16), (2, 2), (3, 2)])
def test_lines_equal_brute_force(spark, monkeypatch, threshold, pairwise):
    monkeypatch.setattr(linededup.near_lines, "__defaults__", (1, 20, pairwise))
    monkeypatch.setattr(linededup, "CROWD", pairwise)
    rng = random.Random(2)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(15, 60))).strip() for _ in range(25)]
    docs = []
    for d in range(70):
        lines = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 1, 2, 3])) for _ in range(rng.randint(0, 8))]
        docs.append((d, "\n".join([*lines, *["  "] * rng.randint(0, 1)])))
    docs += [(100 + k, f"{base[0]} number {k:03} and so on") for k in range(40)]
    table = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, gone int").repartition(3)
    got = linededup.dedup_lines(table, threshold=threshold)
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(docs, threshold, 20)


def test_longer_lines_may_differ_by_more_edits(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)).strip() for n in (30, 47, 48, 49, 50, 51, 73, 74, 75, 76, 120, 200)]
    docs = [(d, "\n".join(edited(rng, rng.choice(base), rng.randint(0, 4)) for _ in range(4))) for d in range(60)]
    edits = lambda n: max(e for begin, e in linededup.EDITS if n >= begin)
    kept, seen = {}, []
    for d, t in docs:
        own = []
        for x in (x.strip(linededup.BLANKS) for x in t.split("\n")):
            if not any(distance(x, y) <= (edits(min(len(x), len(y))) if min(len(x), len(y)) >= 20 else 0) for y in seen):
                own.append(x)
            seen.append(x)
        kept[d] = own
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: [x.strip(linededup.BLANKS) for x in r.text.split("\n") if x] for r in got.collect()} == kept
    assert {edits(20), edits(60), edits(100)} == {1, 2, 3}


@pytest.mark.parametrize("pairwise", [16, 2])
def test_crowds_of_near_copies(spark, monkeypatch, pairwise):
    """Hundreds of lines that share most of their text: some within three edits of others, some further from all."""
    monkeypatch.setattr(linededup.near_lines, "__defaults__", (None, 20, pairwise))
    monkeypatch.setattr(linededup, "CROWD", pairwise)
    rng = random.Random(12)
    frame = "".join(rng.choice("abcdefgh ") for _ in range(90)).strip()
    texts = [f"{frame[:20]}{rng.randrange(10**6):06} {frame[20:60]}{rng.choice('xyz') * rng.randint(0, 3)}{frame[60:]}{rng.randrange(10**4):04}" for _ in range(120)]
    texts += [edited(rng, rng.choice(texts), rng.randint(1, 4)) for _ in range(80)]
    texts += [f"number {k:03} of a template line that is somewhat longer" for k in rng.sample(range(1000), 60)]
    rng.shuffle(texts)
    edits = lambda n: max(e for begin, e in linededup.EDITS if n >= begin)
    want = {d: "" if any(x != y and distance(x, y) <= edits(min(len(x), len(y))) for y in texts[:d]) or x in texts[:d] else x for d, x in enumerate(texts)}
    got = linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == want and 20 < sum(not t for t in want.values()) < 240


def within(a, b, t):
    """Whether two texts are within t edits, by trying each edit where they first differ."""
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[k:], b[k:]
    if not a or not b:
        return len(a) + len(b) <= t
    return t > 0 and (within(a[1:], b[1:], t - 1) or within(a[1:], b, t - 1) or within(a, b[1:], t - 1))


@pytest.mark.parametrize("within_join", [4096, 10])
def test_variants_of_a_long_line_make_no_rows_by_the_square(spark, monkeypatch, within_join):
    """Most variants of a paragraph are far from all others: they are told apart within a join, and not cut again."""
    monkeypatch.setattr(linededup, "WITHIN_JOIN", within_join)
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    base = [rng.choice(vocab) for _ in range(60)]
    texts = [" ".join(rng.choice(vocab) if rng.random() < 0.05 else w for w in base) for _ in range(220)]
    texts = list(dict.fromkeys([*texts, *[edited(rng, rng.choice(texts), rng.randint(1, 4)) for _ in range(60)]]))
    rng.shuffle(texts)
    cut, segments = [], linededup._segments
    monkeypatch.setattr(linededup, "_segments", lambda *args, **options: (cut.append(options.get("group")), segments(*args, **options))[1])
    want = {d: "" if any(within(x, y, 3) for y in texts[:d]) else x for d, x in enumerate(texts)}
    got = linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == want and 20 < sum(not t for t in want.values()) < 200
    assert "group" not in cut


def test_what_lines_take_in_between_is_deleted(spark):
    """No shuffle files of a result that is stored, no keys and members of lines, and the session's settings as before."""
    place = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for top in place for f in Path(top).rglob("shuffle_*.data")}
    before, settings = files(), [spark.conf.get(k) for k in shared.WHILE_STORED]
    assert shared.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts").count() == 7
    until = time.time() + 20
    # the count itself may leave a shuffle of its own, of one row
    while any(f.exists() and f.stat().st_size > 200 for f in files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not any(f.exists() and f.stat().st_size > 200 for f in files() - before)
    folder = Path(shared.shared_dir(spark).removeprefix("file://"))
    held = set(folder.iterdir())
    docs = [(d, f"a line that many others are like, of number {d % 9}\nand one of {'xy' * d}") for d in range(40)]
    linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    new = {p.name.rpartition("-")[0] for p in set(folder.iterdir()) - held if any(p.glob("part-*"))}
    assert not new & {"line-keys", "line-members", "line-blocks"} and "line-marks" in new
    assert [spark.conf.get(k) for k in shared.WHILE_STORED] == settings


def test_short_rests_are_cut_in_classes_as_wide_as_the_edits(spark):
    """A text and one of up to threshold edits more share a segment whatever their lengths; the classes of short ones were too narrow."""
    rng = random.Random(3)
    for t in (1, 2, 3):
        pairs = [(k, x, edited(rng, x, t)) for k, x in enumerate("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2 * t + 1, 20))) for _ in range(400))]
        table = spark.createDataFrame([(k, side, x) for k, *both in pairs for side, x in enumerate(both)], "k long, side int, text string")
        keys = linededup._segments(table, "text", t, "k", "side", group="k").groupBy("k", "key").agg(F.count_distinct("side").alias("n"), F.expr("bit_or(role)").alias("roles"))
        got = {r.k for r in keys.where("n = 2 and (roles & 1) = 1").select("k").distinct().collect()}
        assert {k for k, x, y in pairs if min(len(x), len(y)) > 2 * t + 1} <= got


def test_occurrences_are_counted_without_sorting(spark, monkeypatch):
    """The first of a line's occurrences stays: by id, for one id by the text's hash, within a text by place."""
    plans, stored = [], shared.stored
    monkeypatch.setattr(shared, "stored", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stored(df, label))[1])
    monkeypatch.setattr(linededup, "near_lines", lambda lines, *_: lines.select("h1", "h2").where("h1 is null"))
    rows = [(3, "x\ny\nx"), (1, "z\ny\nz\nz"), (2, "é\nx\né"), (2, "x\né\nw"), (2, "x\né\nw")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(set(texts.select("doc_id", F.xxhash64("text"), "text").collect()), key=lambda r: r[:2])
    seen, want = set(), {}
    for d, _, t in order:
        want[d, t] = "\n".join(x for x in t.split("\n") if not (x in seen or seen.add(x)))
    got = linededup.dedup_lines(texts).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted((d, want[d, t]) for d, t in rows)
    assert plans and not any("SortAggregate" in p for p in plans)


def anonymous_mb(spark):
    pid = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


def test_memory_outside_of_the_heap_is_returned(spark):
    """What a thread took from the C library and gave back stays with the process until it is trimmed; the heap shrinks to what it holds."""
    platform = spark._jvm.org.apache.spark.unsafe.Platform
    options = {k: shared._option(spark, k) for k in shared.WHILE_TIDIED}
    taken = [platform.allocateMemory(100_000) for _ in range(3000)]
    for at in taken:
        platform.setMemory(at, 1, 100_000)
    for at in taken[:-1]:  # the last one keeps the C library from shrinking by itself
        platform.freeMemory(at)
    held = anonymous_mb(spark)
    shared.stored(spark.range(10), "range")
    assert anonymous_mb(spark) < held - 150
    platform.freeMemory(taken[-1])
    assert {k: shared._option(spark, k) for k in shared.WHILE_TIDIED} == options and all(options.values())


def test_a_tidied_heap_keeps_little_free(spark, monkeypatch):
    monkeypatch.setattr(shared, "HEAP_SHARE", 0.0)
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    assert shared.tidy(spark)
    assert runtime.freeMemory() < 0.35 * runtime.totalMemory()


def test_driver_gives_memory_back_beyond_a_share_of_its_heap(spark, monkeypatch):
    done, tidy = [], shared.tidy
    monkeypatch.setattr(shared, "tidy", lambda session: done.append(tidy(session)))
    for share in (0, 1):
        monkeypatch.setattr(shared, "HEAP_SHARE", share)
        assert shared.stored(spark.range(5), "few").count() == 5
    assert done == [True, False]


def test_columns_that_clash_with_those_inside(spark):
    docs = spark.createDataFrame([(1, "same line", 7, 8, 9), (2, "same line", 7, 8, 9)], "doc_id long, text string, n_gone int, __doc int, __N_GONE int")
    got = linededup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "n_gone", "__doc", "__n_lines", "__n_gone"]
    assert sorted(map(tuple, got.collect())) == [(1, "same line", 7, 8, 1, 0), (2, "", 7, 8, 1, 1)]


def test_a_line_that_a_third_of_all_rows_hold(spark):
    docs = [(k, "the very common line of all\n" + f"and a line of its own {k * 7919:09}, {k * 104729:09}") for k in range(300)]
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    assert sum("common" in r.text for r in got) == 1 and sum(r["__n_gone"] for r in got) == 299


def test_lines_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "same line\nother"), (2, None), (3, ""), (4, "same line"), (1, "same line\nother"), (None, "same line"), (5, "\n".join(f"l{k % 3000}" for k in range(6000)))], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text, r["__n_lines"], r["__n_gone"]) for r in linededup.dedup_lines(docs).collect()), key=str)
    assert [g[:4] for g in got if g[0] < 5] == [(0, "same line", 1, 0), (1, "same line\nother", 2, 0), (1, "same line\nother", 2, 0), (2, None, 0, 0), (3, "", 0, 0), (4, "", 1, 1)]
    assert [g[2:] for g in got if g[0] == 5] == [(6000, 3000)]
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- benchmark


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        import numpy as np

        assert decontaminate.common_subsequence(decontaminate.places(np.array(a, int)), len(a), b) == table[-1][-1]


def test_leaks_of_planted_passages(spark):
    rng, vocab = random.Random(4), vocabulary(4, 3000)
    items = [" ".join(rng.choice(vocab) for _ in range(rng.randint(9, 70))) for _ in range(60)]
    free = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs, want = [], set()
    for k in range(240):
        text = free(rng.choice([0, 30, 400]))
        if k % 4 == 1:
            text += f" {items[k // 4].upper()}. {free(50)}"
            want.add((k, k // 4))
        if k % 4 == 2 and len(items[k // 4].split()) >= 25:
            text += f" {varied(rng, items[k // 4], 0.15)} {free(50)}"
            want.add((k, k // 4))
        docs.append((k, text))
    docs += [(900, None), (901, ""), (902, free(50_000))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (500, None), (501, ""), (None, "x y")], "item_id long, text string")
    models = decontaminate.fit(table, bench)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(table, models).collect()}
    assert not {p for p in got if p[0] % 4 in (0, 3)} and {p for p in want if p[0] % 4 == 1} <= got
    assert len(want & got) >= 0.95 * len(want)
    left = decontaminate.decontaminate(table, models)
    assert left.columns == table.columns and {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.find_leaks(table, decontaminate.fit(table, bench.limit(0))).count() == 0


def test_paraphrase_without_the_rarest_words(spark):
    rng, vocab = random.Random(5), vocabulary(5, 600)
    items = [rng.sample(vocab, 35) + [f"rare{i}x{k}" for k in range(5)] for i in range(20)]
    for item in items:
        rng.shuffle(item)
    free = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    # four of the five rarest words replaced: nine tenths of the passage stay in order
    docs = [(i, " ".join([free(20), *(f"other{w}" if w.startswith("rare") and not w.endswith("x0") else w for w in item), free(20)])) for i, item in enumerate(items)]
    docs += [(100 + k, free(200)) for k in range(100)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    models = decontaminate.fit(table, spark.createDataFrame([(i, " ".join(item)) for i, item in enumerate(items)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.common >= 36) for r in decontaminate.find_leaks(table, models).collect()} == {(i, i, True) for i in range(20)}


def test_recall_of_paraphrases(spark):
    """Passages of the sample, with words replaced by other words of the corpus, amid other text; reports what each step loses."""
    rng = random.Random(6)
    docs, bench = shared.table(spark, "/root/testdata/sf0.01", "documents"), shared.table(spark, "/root/testdata/sf0.01", "benchmark")
    lots = decontaminate.fit(docs, bench)
    corpus = [w for r in docs.select("text").collect() for w in words(r.text)]
    some = lambda n: corpus[(k := rng.randrange(len(corpus) - n)) : k + n]
    rows = []
    for share in (0.0, 0.1, 0.2, 0.3, 0.4):
        for r in bench.collect():
            rows.append((share, r.item_id, " ".join([*some(60), *(w if rng.random() >= share else rng.choice(corpus) for w in words(r.text)), *some(60)])))
    planted = spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    model = lots[0].models[0]
    place = {int(i): k for k, i in enumerate(model.items)}
    import numpy as np
    import pyarrow as pa

    scanned = shared.Words(pa.array([t for *_, t in rows], pa.large_string()))
    number = model.numbers(scanned.hashes())
    near = {(d, i) for d, i, *_ in model.near(scanned, number)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(planted, lots).collect()}
    for share in (0.0, 0.1, 0.2, 0.3, 0.4):
        own = [(k, i) for k, (s, i, _) in enumerate(rows) if s == share]
        candidates, found = (sum(x in y for x in own) / len(own) for y in ([(d, int(model.items[i])) for d, i in near], got))
        print(f"replaced {share}: among the candidates {candidates:.3f}, found {found:.3f}")
        assert candidates >= 0.97 and found >= (1 if share < 0.15 else 0.98 if share < 0.25 else 0.9)
    assert len(place) == bench.count() and len(near) < 20 * len(rows)  # the cosine does choose
    items = {r.item_id: " ".join(words(r.text)) for r in bench.collect()}
    texts = {r.doc_id: " ".join(words(r.text)) for r in docs.collect()}
    assert all(f" {items[r.item_id]} " in f" {texts[r.doc_id]} " for r in decontaminate.find_leaks(docs, lots).collect())


def test_answers_and_repeated_rows(spark):
    rng, vocab = random.Random(7), vocabulary(7, 900)
    item = rng.sample(vocab, 30)
    half = " ".join(w if k % 2 else f"other{k}" for k, w in enumerate(item))
    bench = spark.createDataFrame([(1, " ".join(item), "Blue whale!"), (1, " ".join(item), "Blue whale!")], "item_id long, text string, answer string")
    docs = spark.createDataFrame([(1, f"{half} the whale is blue"), (2, f"{half} the shark is grey"), (3, " ".join(item)), (3, " ".join(item)), (4, None)] + [(100 + k, " ".join(rng.sample(vocab, 300))) for k in range(40)], "doc_id long, text string")
    found = lambda **o: sorted((r.doc_id, r.common) for r in decontaminate.find_leaks(docs, decontaminate.fit(docs, bench, **o)).collect())
    assert found(answer_col="answer") == [(1, 15), (3, 30), (3, 30)]  # half of the passage is a leak with the answer only
    assert found() == [(1, 15), (2, 15), (3, 30), (3, 30)]
    clash = docs.withColumn("__leaks", F.lit(1))
    left = decontaminate.decontaminate(clash, decontaminate.fit(docs, bench, answer_col="answer"))
    assert left.columns == clash.columns and sorted(r.doc_id for r in left.collect() if r.doc_id < 100) == [2, 4]
    assert decontaminate.find_leaks(docs.limit(0), decontaminate.fit(docs.limit(0), bench)).count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    docs, bench = shared.table(spark, SAMPLES, "documents"), shared.table(spark, SAMPLES, "benchmark")
    whole = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, decontaminate.fit(docs, bench)).collect()}
    verbatim = {(d, i) for d, t in docs.select("doc_id", "text").collect() for i, p in bench.collect() if f" {' '.join(words(p))} " in f" {' '.join(words(t))} "}
    assert whole == verbatim
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 15)
    monkeypatch.setattr(decontaminate, "LOT_CHARS", 2000)
    assert len(decontaminate.fit(docs, bench)) > 1
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, decontaminate.fit(docs, bench)).collect()} == whole


# ---------------------------------------------------------------- top k, URLs, filters


def same(got, want):
    got, want = (f[sorted(f.columns)].sort_values(sorted(f.columns)).reset_index(drop=True) for f in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_top_k_with_ties_repeats_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = random.Random(6)
    rows = [(k, [rng.choice([-0.5, 0.0, 0.25, 0.26]) for _ in range(4)]) for k in range(150)]
    rows += [(150, None), (151, []), (152, [0.1, None, 0.1, 0.1]), (153, [float("nan")] * 4), (154, [float("inf")] * 4), (200, [0.1, 0.1]), (None, [0.1] * 4), rows[3]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    embeddings = table.toPandas()
    numbers = topk.whole_numbers(table, "vec_id", "embedding")
    got = topk.top_k(numbers, numbers.where("id % 50 = 0")).toPandas()
    con = duckdb.connect()
    con.register("e", embeddings)
    con.sql("CREATE VIEW embeddings AS SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS FLOAT[]) AS embedding FROM e")
    same(got, con.sql(topk.OP9_SQL).df())
    assert topk.top_k(numbers.limit(0), numbers.limit(0)).count() == 0


def test_threshold_search_stops_early():
    import numpy as np

    x = np.zeros((4096, 3))
    x[:, 0] = np.arange(4096)
    best = topk.Best(1, 5)
    assert topk.Lists(np.arange(4096), x).search(np.array([[1.0, 0, 0]]), np.array([4095]), best) < 64
    assert best.ids[0].tolist() == [4094, 4093, 4092, 4091, 4090]
    # a block that can't reach the scores carried from the last one isn't read beyond the first step
    assert topk.Lists(np.arange(4096) + 9000, x - 5000).search(np.array([[1.0, 0, 0]]), np.array([4095]), best) <= topk.FIRST_DEPTH


def test_threshold_search_equals_brute_force():
    import numpy as np

    rng = np.random.default_rng(3)
    for skew in (0.0, 3.0):  # none of the dimensions matters more, and a few do
        scale = np.exp(-skew * np.arange(8))
        x, queries = np.round(rng.normal(size=(3000, 8)) * 40 * scale), np.round(rng.normal(size=(20, 8)) * 40 * scale)
        best, scored = topk.Best(20, 5), 0
        for part in range(3):
            scored += topk.Lists(np.arange(part * 1000, part * 1000 + 1000), x[part * 1000 : part * 1000 + 1000]).search(queries, np.arange(20), best)
        scores = (queries @ x.T).astype(int)
        for q in range(20):
            want = sorted((-s, i) for i, s in enumerate(scores[q].tolist()) if i != q)[:5]
            assert [(-s, i) for s, i in zip(best.scores[q].tolist(), best.ids[q].tolist())] == want
        assert skew == 0 or scored < 20 * 3000 / 2


def test_products_beyond_whole_doubles_fail(spark):
    rows = spark.createDataFrame([(50, [1 << 30, 1 << 30]), (51, [1 << 30, 1])], "id long, q array<bigint>")
    with pytest.raises(ValueError):
        topk.top_k(rows, rows.where("id = 50"))


@pytest.mark.parametrize("name", ["op9_topk", "op10_urlfilter"])
def test_queries_equal_their_sql(spark, name):
    from tallyspark.llm import queries

    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SAMPLES}/{t}.parquet'")
    same(queries.queries()[name](spark, SAMPLES).toPandas(), con.sql(queries.oracle_sql()[name]).df())


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.ORG/x", "http://a.org", "https://b.example.org/es/1?x#y", "http://example.org/en/12", "http://notexample.org/es/", "http://x.com/fr/1", "http://x.com/de/1",
            "http://x.com/en/1", "ftp://casino.net/a", "http://a-casino.b.net?q=/fr/", "http://casinos.net/", "http://É.com://y/z", "http://casino.com/fr/", "http://x.com:80/de/"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, urlfilter.listed_hosts(pages)).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.org", "/x", "org/", "allow") and got[4] == ("a.org", "", None, "allow")
    assert got[5] == ("b.example.org", "/es/1", "example.org/es/", "block") and got[6][2:] == ("example.org/en/1", "block") and got[7][2:] == ("org/", "allow")
    assert got[8][2:] == ("com/fr/", "allow") and got[9][2:] == ("com/de/", "block") and got[10][2:] == (None, "allow")
    assert [got[k][3] for k in (11, 12, 13, 15)] == ["block", "block", "allow", "allow"] and got[14][:2] == ("É.com:", "//y/z") and got[16][2] is None


@pytest.mark.parametrize("bits", [1 << 28, 300])  # one cascade, and more than one shard
def test_lists_of_hosts(spark, monkeypatch, bits):
    monkeypatch.setattr(urlfilter, "LEVEL_BITS", bits)
    pages = spark.createDataFrame([(k, f"http://h{k % 400}.net/x", k, "y", 1) for k in range(900)], "page_id long, url string, found long, member string, Host int")
    listed = spark.createDataFrame([(f"h{k}.net", k) for k in range(0, 400, 3)] + [("not.there", 1), (None, 1), ("h0.net", 1)], "h string, n long")
    got = urlfilter.filter_urls(pages, listed)
    assert got.columns == ["page_id", "url", "found", "member", "host", "path", "rule", "verdict"]
    assert {r.page_id: r.verdict for r in got.collect()} == {k: "allow" if k % 400 % 3 else "block" for k in range(900)}
    assert urlfilter.filter_urls(pages.limit(0), listed).count() == 0 and {r.verdict for r in urlfilter.filter_urls(pages, listed.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("share", [0, 0.02, 0.5, 1])
def test_cascade_is_exact(spark, share):
    keys = spark.range(3000).select(F.concat(F.lit("host"), "id").alias("host"), (F.pmod(F.xxhash64("id"), F.lit(100)) < 100 * share).alias("listed"))
    cascade = urlfilter.Cascade.fit(keys, "host", "listed")
    assert keys.where(cascade.holds(F.col("host")) != F.col("listed")).count() == 0
    assert not share or (share == 1) == (len(cascade.levels) == 1)


def test_bloom(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"), "id")
    bloom = Bloom(keys.where("id % 2 = 0"), "key", 20_000, 7)
    got = defaultdict(int, {(r.own, r.held): r["count"] for r in keys.select((F.col("id") % 2).alias("own"), bloom.holds(F.col("key")).alias("held")).groupBy("own", "held").count().collect()})
    assert got[0, False] == 0 and got[1, True] < 40


# ---------------------------------------------------------------- the pipeline


def test_pipeline(spark):
    import corpus_pipeline
    from tallyspark.llm import quality

    docs = shared.table(spark, SAMPLES, "documents")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, shared.stored(stage(spark, now, SAMPLES), "test")
        if name != "packing":
            assert now.columns == docs.columns
        if name == "lines":
            rows = sorted(map(tuple, before.select("doc_id", "text").collect()))
            want = brute_lines(rows, 1, 20)
            lost = {d for d, t in rows if want[d] != t and not want[d].strip(" \t\r\n")}
            assert {r.doc_id: r.text for r in now.collect()} == {d: t for d, t in want.items() if d not in lost}
            assert now.where("n_chars != char_length(text)").count() == 0
        if name == "near_duplicates":
            rows = list(map(tuple, before.select("doc_id", "text").collect()))
            assert {r.doc_id for r in now.collect()} == {d for d, own in brute_classes(rows).items() if own[0] == d}
        if name == "decontamination":
            items = [" ".join(words(r.text)) for r in shared.table(spark, SAMPLES, "benchmark").collect()]
            clean = {r.doc_id for r in before.collect() if not any(f" {i} " in f" {' '.join(words(r.text))} " for i in items)}
            assert {r.doc_id for r in now.collect()} == clean
        if name == "packing":
            assert {r.doc_id for r in now.collect()} == {r.doc_id for r in before.collect()}
    assert corpus_pipeline.run(spark, SAMPLES).count() == now.count()
    assert quality.THRESHOLD == 0.3 and corpus_pipeline.ORACLE_SQL is None
