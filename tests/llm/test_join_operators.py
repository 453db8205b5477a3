"""Near-duplicates, alignment, decontamination and mixing against brute force."""

import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborspan.llm import decontaminate, line_align, minhash, mixture, queries, shared, vector_join
from arborspan.llm.shared import components

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text, pattern=SPACE):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def joined(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# -------------------------------------------------------------- components


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (9, 8)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 29)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    want = {n: c for n, c in joined({x for e in edges for x in e}, edges).items() if n != c}
    assert got == want


# ----------------------------------------------------------------- minhash


def shingle_set(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return sets, joined(ids, links)


def near_rows(n=70, seed=0):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 9999, 150)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rng.choice(150, int(rng.integers(0, 7)), replace=False):
            w[at] = f"x{rng.integers(0, 9999)}"
        rows.append((i + 10, " ".join(w)))
    rows += [(1, "one two three"), (2, "One  two\tthree"), (3, ""), (4, None), (5, "   "), (6, "solo"), (7, "alone and quite different from all of the rest here")]
    return rows


@pytest.mark.parametrize("block", [8, 256])
def test_near_duplicates_equal_brute_force(spark, block):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("other"))
    sets, comp = brute_near(rows)
    got = minhash.near_duplicates(df, block=block).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_on_the_table(spark, tiny):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    _, comp = brute_near(rows)
    assert {r["doc_id"]: r["component_id"] for r in queries.op2_minhash_near_dedup(spark, tiny).collect()} == comp


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, long), (3, long), (5, "q r s t u"), (5, "completely other words in here")]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 2, 0, False), (1, 2, 1, True), (1, 2, 1, True), (2, 29_996, 2, True), (3, 29_996, 2, False), (5, 1, 5, True), (5, 1, 5, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ----------------------------------------------------------------- vectors


def brute_vectors(rows, cosine=0.93):
    unit = {}
    for i, v, label in rows:
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            unit[i] = (label, x / np.linalg.norm(x))
    ids = sorted(unit)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= cosine]
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return joined([i for i, _, _ in rows], links), count


@pytest.mark.parametrize("block, per_pivot", [(16, 5), (2048, 500)])
def test_vectors_equal_brute_force(spark, block, per_pivot):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=8) * 0.15], int(i % 2)) for i in range(240)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(20)]
    rows += [(2000, None, 0), (2001, [0.0] * 8, 0), (2002, [float("nan")] * 8, 0), (2003, [None] + [1.0] * 7, 0), (2004, rows[0][1], None), (2005, [], 0), (2006, [1.0, 2.0], 0), (2007, [1.0, 2.0], 0), (2008, [float("inf")] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    comp, count = brute_vectors(rows)
    got = vector_join.near_vectors(df, block=block, per_pivot=per_pivot).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["component_id"], r["n_links"], r["kept"]) == (comp[r["vec_id"]], count[r["vec_id"]], comp[r["vec_id"]] == r["vec_id"]), r


def test_vector_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_join.near_vectors(empty).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in vector_join.near_vectors(odd).collect())
    assert got == [(0, 0, 0, False), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def classes_of(spark, x, label="a"):
    rows = [(i, 1, [float(c) for c in v], len(v), label) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "node bigint, copies bigint, v array<double>, width int, label string")


def test_pairs_meet_in_one_cell_and_clusters_have_few_guests(spark):
    rng = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    spread = unit(rng.normal(size=(400, 64)))
    tight = unit(unit(rng.normal(size=(10, 64)))[rng.integers(0, 10, 400)] + rng.normal(size=(400, 64)) * 0.02)  # fewer clusters than pivots
    guests = {}
    for name, x in (("spread", spread), ("tight", tight)):
        dealt = vector_join.deal(classes_of(spark, x), "array<double>", 0.93, 64, 20).collect()
        home = {r["node"]: r["cell"] for r in dealt if r["resident"]}
        cells = defaultdict(set)
        for r in dealt:
            cells[r["node"]].add(r["cell"])
        assert len(home) == 400 and len(set(home.values())) > 10
        guests[name] = len(dealt) - 400
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1))):
            meet = [c for c in cells[a] & cells[b] if c in (home[a], home[b])]
            assert len(meet) == 1
    assert 2 * guests["tight"] < guests["spread"] <= 400 * 19 // 2  # half of the 19 other cells at most


def test_the_registered_join_uses_several_cells(spark, tiny):
    v = spark.read.parquet(f"{tiny}/embeddings.parquet")
    classes = v.select(F.col("vec_id").alias("node"), F.lit(1).cast("bigint").alias("copies"), F.col("embedding").alias("v"), F.size("embedding").alias("width"), F.lit("all").alias("label"))
    assert vector_join.deal(classes, "array<float>", vector_join.MIN_COSINE, vector_join.MAX_PIVOTS, vector_join.PER_PIVOT).select("cell").distinct().count() > 1


def test_extreme_components_link(spark):
    rows = [(1, [1e200, 2e200], 0), (2, [1.0, 2.0], 0), (3, [1e-200, 2e-200], 0), (4, [5e-324, 0.0], 0), (5, [1.7e308, 0.0], 0), (6, [-1.0, 0.0], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


# -------------------------------------------------------------------- lines


def line(seed, n=25):
    rng = np.random.default_rng(seed)
    return " ".join(f"k{seed}x{v}" for v in rng.integers(0, 999, n))


def test_blocks_go_from_later_documents_only(spark):
    a, b, c, d = line(1), line(2), line(3), line(4)
    short = "a short shared line"
    rows = [
        (10, f"{a}\n{short}\n{b}"), (11, f"{c}\n{a}\n{short}"), (12, f"{b}\n{a}\n{d}"), (13, f"{short}\n{d}"), (14, f"{a}\n{a}"), (15, f"{c}\n{short}"), (16, None), (17, ""), (None, a), (18, short),
        (19, f"{line(5, 8)}\n{line(6, 8)}\n{line(7, 8)}"), (20, f"x\n{line(5, 8)}\n{line(6, 8)}\n{line(7, 8)}\ny"),
    ]
    got = {r["doc_id"]: r for r in line_align.remove_duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = {k: r["text"] for k, r in got.items()}
    assert text == {10: rows[0][1], 11: c, 12: d, 13: short, 14: "", 15: short, 16: None, 17: "", None: a, 18: short, 19: rows[10][1], 20: "x\ny"}
    assert (got[11]["lines_cut"], got[11]["words_cut"], got[14]["lines_cut"], got[16]["words_cut"]) == (2, 29, 2, 0)
    kept = line_align.remove_duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), drop_emptied=True)
    assert {r["doc_id"] for r in kept.collect()} == set(text) - {14}


def brute_blocks(early, late, min_words):
    """Whether any common run of lines of enough words is left."""
    for i in range(len(late)):
        for j in range(len(early)):
            n = 0
            k = 0
            while i + k < len(late) and j + k < len(early) and late[i + k] == early[j + k]:
                n += len(late[i + k].split())
                k += 1
            if n >= min_words:
                return True
    return False


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=9), st.lists(st.integers(0, 5), max_size=9))
def test_alignment_leaves_no_common_block(a, b):
    count = np.array([1, 2, 3, 4, 5, 6])
    early, late = np.array(a, np.int64), np.array(b, np.int64)
    gone = line_align.common_blocks(early, late, count[late] if len(late) else np.zeros(0, int), 5)
    assert set(gone) <= set(range(len(late)))
    for i in gone:
        assert late[i] in early
    text = lambda k: " ".join([f"t{k}"] * count[k])
    runs, run = [], []
    for i in range(len(late)):
        if i in gone:
            runs, run = [*runs, run], []
        else:
            run.append(text(late[i]))
    for r in [*runs, run]:
        assert not brute_blocks([text(k) for k in early], r, 5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=14), st.lists(st.integers(0, 9), max_size=14))
def test_patience_pairs_rise_and_match(a, b):
    pairs = line_align.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_lines_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lines_cut string, cut int, id int")
    assert line_align.remove_duplicate_lines(empty).columns == ["doc_id", "text", "cut", "id", "lines_cut", "words_cut"]
    long = "\n".join(line(i, 12) for i in range(900))
    twice = spark.createDataFrame([(1, long), (2, long), (2, long)], "doc_id long, text string")
    assert sorted(len(r["text"]) for r in line_align.remove_duplicate_lines(twice).collect()) == [0, 0, len(long)]


def test_long_passages_go_wherever_they_begin(spark):
    rng = np.random.default_rng(12)
    own = lambda n: [f"o{v}" for v in rng.integers(0, 10**9, n)]
    shared = [f"p{k}" for k in range(400)]
    parts = [(0, 400), (7, 58), (100, 150), (30, 90), (200, 251), (349, 400), (0, 51), (60, 130)]
    rows = [(0, own(30) + shared), (1, [w.upper() for w in shared[:60]])]
    for i, (a, b) in enumerate(parts[1:] * 2, 2):
        rows.append((i, own(int(rng.integers(0, 40))) + shared[a:b] + own(int(rng.integers(1, 40)))))
    rows.append((50, own(5) + shared[10:40] + shared[300:330] + own(5)))  # 30 words each of two passages
    rows.append((51, own(5) + ["a", "b"] * 40))
    rows.append((52, own(5) + ["b", "a"] * 40))
    want, seen = {}, set()
    for i, w in rows:
        low = [x.lower() for x in w]
        runs = [tuple(low[k : k + 51]) for k in range(len(low) - 50)]
        lost = {k + d for k, x in enumerate(runs) if x in seen for d in range(51)}
        want[i] = (" ".join(x for k, x in enumerate(w) if k not in lost), len(lost))
        seen |= set(runs)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["words_cut"]) for r in line_align.remove_duplicate_lines(docs, inside_lines=True).collect()}
    assert got == want and sum(n > 0 for _, n in want.values()) > 12


def test_gaps_about_passages(spark):
    p = [f"p{k}" for k in range(60)]
    one, two = " ".join(p[:30]), " ".join(p[30:])
    rows = [(1, " ".join(p)), (2, f"a b {one} {two} c\nd"), (3, f"é {one}\n{two} f"), (4, f"g\n{one} {two}\nh"), (5, f"{one}  {two} i"), (6, f"j\n k {one}\n\n{two}"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["lines_cut"], r["words_cut"]) for r in line_align.remove_duplicate_lines(docs, inside_lines=True).collect()}
    assert got == {1: (rows[0][1], 0, 0), 2: ("a b c\nd", 0, 60), 3: ("é\nf", 0, 60), 4: ("g\nh", 1, 60), 5: ("i", 0, 60), 6: ("j\n k\n", 1, 60), 7: (None, 0, 0)}
    assert line_align.remove_duplicate_lines(docs.limit(0), inside_lines=True).count() == 0


def test_rows_of_one_id_lose_their_own_lines_only(spark):
    a, b, c = line(41), line(42), line(43)
    rows = [(1, a), (2, f"{a}\n{b}"), (2, f"{c}\n{b}"), (2, f"{a}\n{b}")]
    got = line_align.remove_duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"], r["lines_cut"]) for r in got) == sorted([(1, a, 0), (2, b, 1), (2, f"{c}\n{b}", 0), (2, b, 1)])


def test_lines_on_the_table(spark, tiny):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    out = {r["doc_id"]: r for r in queries.op9_patience_line_dedup(spark, tiny).collect()}
    assert out.keys() == docs.keys()
    seen: dict[str, int] = {}
    for i in sorted(docs):
        kept = out[i]["text"].split("\n")
        for x in kept:
            if len(x.split()) > 50:
                key = " ".join(words(x))
                assert key not in seen or seen[key] == i
                seen[key] = i
    pieces = lambda t: {" ".join(words(x)) for x in re.split(r"\n|(?<=[.!?]) ", t)}
    left = set().union(*(pieces(r["text"] or "") for r in out.values()))
    for text in docs.values():  # every line, and every sentence of one, stays somewhere
        assert pieces(text) <= left | {""}


def test_sentences_are_lines_of_their_own(spark):
    first, second, third = (line(k, 15).capitalize() + "." for k in (31, 32, 33))
    rows = [(1, f"{first} {second}\n{third}"), (2, f"Before it. {first} {second} After it.\nlast"), (3, f"{third} {third}! {second}? no"), (4, f"{second}"), (5, f"x{first} {second} y")]
    got = {r["doc_id"]: (r["text"], r["lines_cut"], r["words_cut"]) for r in line_align.remove_duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0, 0), 2: ("Before it. After it.\nlast", 2, 30), 3: (rows[2][1], 0, 0), 4: (second, 0, 0), 5: (rows[4][1], 0, 0)}


# --------------------------------------------------------------- benchmark


def brute_windows(docs, items):
    out = {}
    windows = defaultdict(set)
    for item, text in items:
        w = words(text, ALNUM)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(item))
    sizes = {len(w) for w in windows}
    for i, text in docs:
        w = words(text, ALNUM)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("shard_bytes", [8 << 20, 200])
def test_windows_equal_brute_force(spark, shard_bytes):
    rng = np.random.default_rng(2)
    item = lambda n: " ".join(f"t{v}" for v in rng.integers(0, 12, n))
    items = [(i, item(int(rng.integers(13, 40)))) for i in range(8)] + [(50, "only four words here"), (51, "here"), (52, ""), (53, None), (54, "Only, FOUR words"), (55, item(13))]
    docs = []
    for i in range(40):
        w = [f"t{v}" for v in rng.integers(0, 14, 60)]
        if i % 2:
            own = items[int(rng.integers(0, 8))][1].split()
            a = int(rng.integers(0, 8))
            w[20 : 20 + len(own) - a] = own[a:]
        docs.append((i, " ".join(w).upper() if i % 3 else ", ".join(w)))
    docs += [(100, "only four words here"), (101, None), (102, ""), (103, "er here-here"), (104, " ".join(f"t{v}" for v in rng.integers(0, 12, 5000)))]
    want = brute_windows(docs, items)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.find_benchmark_spans(d, b, shard_bytes=shard_bytes).collect():
        n, hit, found = want[r["doc_id"]]
        assert (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) == (n, hit, found), r["doc_id"]


def test_benchmark_query_on_the_table(spark, tiny):
    read = lambda t, k: [(r[k], r["text"]) for r in spark.read.parquet(f"{tiny}/{t}.parquet").collect()]
    want = brute_windows(read("documents", "doc_id"), read("benchmark", "item_id"))
    for r in queries.op10_automaton_decontamination(spark, tiny).collect():
        n, hit, found = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0 and 20 * hit >= n)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_spans_are_cut_out(spark):
    item = " ".join(f"q{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"é before. {item.upper()}! after", "x"), (2, "clean", "y"), (3, None, "z"), (4, item, "w"), (4, item, "w")], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted((r["doc_id"], r["text"], r["n_words"]) for r in decontaminate.remove_spans(docs, bench).collect() if r["text"] is not None)
    assert got == [(1, "é before. ! after", "x"), (2, "clean", "y"), (4, "", "w"), (4, "", "w")]
    left = decontaminate.remove_spans(docs, bench, drop_coverage=0.9)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3]
    assert decontaminate.remove_spans(docs, bench.limit(0)).exceptAll(docs).count() == 0
    assert decontaminate.find_benchmark_spans(docs.limit(0), bench).count() == 0


def test_coverage_counts_over_all_shards(spark):
    items = [(i, " ".join(f"q{i}x{k:02d}" for k in range(13))) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    limit = sum(len(t) for _, t in items) // 2 + 1
    shards = [s for s in decontaminate.item_shards(bench, shard_bytes=limit) if s]
    assert len(shards) > 1
    one, two = shards[0][0][1], shards[1][0][1]
    fill = [f"w{k}" for k in range(374)]
    text = " ".join(["É", *fill[:100], one, *fill[100:200], two + ".", *fill[200:-1]])  # 13 and 13 of 400 words
    rows = [(1, text, 0), (1, text, 0), (2, " ".join([one, *fill]), 0), (3, None, 0), (4, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    for size in (decontaminate.SHARD_BYTES, limit):
        left = decontaminate.remove_spans(docs, bench, drop_coverage=0.05, shard_bytes=size)
        assert left.columns == docs.columns and sorted(tuple(r) for r in left.collect()) == rows[2:], size
        cut = decontaminate.remove_spans(docs, bench, shard_bytes=size).where("doc_id = 1").collect()
        assert [r["text"] for r in cut] == [text.replace(one, "").replace(two, "")] * 2, size


# ------------------------------------------------------------------ mixing


def fill(sizes, weights=(5.0, 2.0, 1.0)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level >= 3 * sizes[s]}
        if not full:
            target |= {s: w[s] * level for s in open_}
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("rows_per_piece", [3, 4000])
def test_mix_meets_targets(spark, rows_per_piece):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), ["b", "a", None, "é", "tiny"][min(4, int(rng.integers(0, 40)) % 9)] if i % 60 else "tiny") for i in range(400)]
    rows += [(900, None, "a"), (None, "no id here", "b"), (901, "only one", "zz"), (902, None, "void")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixture.mix_sources(df, keep=("source",), rows_per_piece=rows_per_piece).collect()
    assert len(out) == len(rows)
    sizes, took = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target = fill(dict(sizes))
    for r in out:
        took[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
    for s in sizes:
        assert abs(took[s] - target[s]) <= 1
    again = mixture.mix_sources(df.repartition(5), keep=("source",), rows_per_piece=rows_per_piece).collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["taken"]) for r in rs)
    assert key(out) == key(again)


def test_mix_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixture.mix_sources(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (1, None, None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixture.mix_sources(blank).collect()] == [(0, 0.0, 0)] * 2


def test_mix_equals_sql(spark, tiny):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    con.execute(queries.ORACLE_SQL["op3_weighted_fair_mix"])
    names = [d[0] for d in con.description]
    want = sorted(map(tuple, con.fetchall()))
    assert sorted(tuple(r[c] for c in names) for r in queries.op3_weighted_fair_mix(spark, tiny).collect()) == want


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 50)
    many = spark.range(1000).select((F.col("id") % 7).alias("x"), "id").withColumn("key", F.when(F.col("x") < 3, 0).otherwise(F.col("id")))
    one = spark.range(0, 1000, 2).select(F.col("id").alias("key"), (F.col("id") * 10).alias("value"))
    for counts in (None, many.groupBy("key").agg(F.count(F.lit(1)).alias("n"))):
        got = {(r["id"], r["key"], r["value"]) for r in shared.spread_join(many, one, "key", counts).collect()}
        assert got == {(i, k, 10 * k) for i in range(1000) for k in [0 if i % 7 < 3 else i] if k % 2 == 0}
    blocks = shared.spread_join(many, one, "key")._jdf.queryExecution().optimizedPlan().toString()
    assert "__block" in blocks


def test_near_duplicates_with_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    rows = near_rows(60, seed=4)
    _, comp = brute_near(rows)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=8).collect()} == comp


# ------------------------------------------------- whole tables by brute force


def plain_lines(text):
    """A text's lines as tuples of words."""
    return [tuple(words(line)) for line in re.split(r"\n|(?<=[.!?]) ", text)]


def plain_cuts(rows, least=20):
    """Lines of each document in a common run of ``least`` words or more with the
    first document that holds one of its runs that just reach as many."""
    first, lines, out = {}, {}, {}
    for i, text in sorted(rows):
        lines[i] = own = plain_lines(text)
        keys = set()
        for a in range(len(own)):
            n = 0
            for b in range(a, len(own)):
                n += len(own[b])
                if n >= least and own[a]:
                    keys.add(tuple(own[a : b + 1]))
                    break
        cut = set()
        for early in {first[k] for k in keys if k in first}:
            other = lines[early]
            for a in range(len(own)):
                for c in range(len(other)):
                    if own[a] != other[c] or (a and c and own[a - 1] == other[c - 1]):
                        continue  # no run begins here
                    n = 0
                    while a + n < len(own) and c + n < len(other) and own[a + n] == other[c + n]:
                        n += 1
                    if sum(map(len, own[a : a + n])) >= least:
                        cut |= set(range(a, a + n))
        out[i] = sorted(cut)
        for k in keys:
            first.setdefault(k, i)
    return out


def test_line_dedup_of_a_table_equals_brute_force(spark, tiny):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").where("text is not null").collect()]
    want = plain_cuts(rows)
    text = dict(rows)
    got = {r["doc_id"]: r for r in queries.op9_patience_line_dedup(spark, tiny).collect()}
    for i, cut in want.items():
        assert got[i]["lines_cut"] == len(cut), i
        assert words(got[i]["text"]) == [w for k, line in enumerate(plain_lines(text[i])) if k not in cut for w in line], i
