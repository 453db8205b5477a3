"""The pipeline's stages, each on its own input."""

from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from arborspan.llm import minhash, queries
from arborspan.llm.shared import stage

from test_join_operators import ALNUM, joined, plain_cuts, shingle_set, words


def fixture(spark, folder):
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(f"w{v}" for v in rng.integers(0, 4000, n))
    rows, labels = [], []
    for i in range(120):
        body = "\n".join(text(60) for _ in range(3))
        junk = i % 6 == 5
        rows.append((i, " ".join(f"{x.upper()}!!$$" for x in body.split()) if junk else body, "en", f"src{i % 3}"))
        labels.append((i, int(not junk), 0))
    rows += [(200, rows[0][1], "en", "src0"), (201, text(80) + "\n" + rows[1][1].split("\n")[1], "en", "src1")]
    near = [text(40) for _ in range(8)]  # lines too alike for whole-line matches
    rows += [(210, "\n".join(near), "en", "src1"), (211, "\n".join(x if k else x.replace("w", "y", 1) for k, x in enumerate(near)), "en", "src1")]
    item = text(30)
    rows += [(220, item + " " + text(40), "en", "src2"), (221, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_take_effect(spark, tmp_path):
    folder = str(tmp_path)
    docs = fixture(spark, folder)
    junk = {i for i in range(120) if i % 6 == 5}
    seen, now = [], docs
    for name, step in P.STAGES[:-1]:
        now = step(spark, now, folder)
        assert now.columns == docs.columns and now.schema == docs.schema
        seen.append((name, {r["doc_id"]: r["text"] for r in now.collect()}))
        now = spark.createDataFrame(now.collect(), docs.schema)
    stage = dict(seen)
    assert not junk & set(stage["quality"]) and set(range(120)) - junk <= set(stage["quality"])
    assert 200 not in stage["line_dedup"] and stage["line_dedup"][201].count("\n") == 0 and stage["line_dedup"][1] == stage["quality"][1]
    comp = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame([(k, v) for k, v in stage["line_dedup"].items()], "doc_id long, text string")).collect()}
    assert set(stage["near_dedup"]) == {k for k in stage["line_dedup"] if comp[k] == k}
    assert 220 in stage["near_dedup"] and 220 not in stage["decontaminate"]
    assert set(stage["decontaminate"]) == set(stage["near_dedup"]) - {220}
    mixed = {r["doc_id"]: r for r in P.STAGES[-1][1](spark, now, folder).collect()}
    assert mixed and all(r["taken"] > 0 for r in mixed.values()) and set(mixed) <= set(stage["decontaminate"])
    whole = {r["doc_id"]: r["taken"] for r in P.run(spark, folder).collect()}
    assert whole == {k: r["taken"] for k, r in mixed.items()}


def test_stage_files_are_written_without_checksum_files(spark):
    """Hadoop starts one more program for a file that has a checksum file."""
    table = stage(spark.range(0, 1000, 1, 5).withColumn("text", F.col("id").cast("string")), "plain")
    files = {p.name for p in Path(table._stage_path.removeprefix("file:")).iterdir()}
    assert "_SUCCESS" in files and sum(n.endswith(".parquet") for n in files) == 5
    assert not {n for n in files if n.endswith(".crc")}
    assert sorted(map(tuple, table.collect())) == [(k, str(k)) for k in range(1000)]
    assert spark._jsc.hadoopConfiguration().get("fs.file.impl") is None  # the session's own writes stay as they are


def test_damaged_stage_files_are_noticed(spark):
    table = stage(spark.range(0, 20000, 1, 1).select(F.xxhash64("id").alias("h")), "damaged")
    (file,) = Path(table._stage_path.removeprefix("file:")).glob("*.parquet")
    raw = bytearray(file.read_bytes())
    raw[len(raw) // 2] ^= 1
    file.write_bytes(raw)
    with pytest.raises(Exception, match="(?i)checksum|corrupt|crc|could not verify"):
        table.collect()


def test_line_dedup_cuts_passages_inside_lines(spark):
    shared, names = " ".join(f"p{k}" for k in range(60)), "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame([(1, f"one {shared} two.", "en", "src"), (2, f"three {shared} four.", "en", "src")], names)
    assert {r["doc_id"]: r["text"] for r in P.line_dedup(spark, docs, "").collect()} == {1: f"one {shared} two.", 2: "three four."}


def test_near_dedup_links_from_four_fifths(spark):
    first, other = ([f"{name}{k}" for k in range(104)] for name in "vw")
    changed = lambda words, n: " ".join("new" + w if k in range(20, 20 + 30 * n, 30) else w for k, w in enumerate(words))
    rows = [(1, changed(first, 0)), (2, changed(first, 2)), (3, changed(other, 0)), (4, changed(other, 3))]  # 90 of 110 and 85 of 115 shingles
    docs = spark.createDataFrame([(i, t, "en", "src") for i, t in rows], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in P.near_dedup(spark, docs, "").collect()} == {1, 3, 4}


def test_stages_on_empty_and_repeated_rows(spark, tmp_path):
    folder = str(tmp_path)
    docs = fixture(spark, folder)
    extra = docs.where("doc_id in (1, 2)").union(docs.where("doc_id = 2")).union(docs.where("doc_id = 2").selectExpr("cast(null as long)", "text", "lang", "source", "n_chars")).withColumn("kept", F.lit("clash")).withColumn("score", F.lit("clash"))
    for table in (extra, extra.limit(0)):
        for name, step in P.STAGES[:-1]:
            out = step(spark, table, folder)
            if name == "quality":
                assert set(out.columns) == set(table.columns)
            else:
                assert out.columns == table.columns
            assert out.count() <= table.count()
    assert P.near_dedup(spark, extra, folder).where("doc_id = 2").count() == 1
    assert P.near_dedup(spark, extra, folder).where("doc_id is null").count() == 1


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    text = lambda name, n=104: " ".join(f"{name}{k}" for k in range(n))
    near = text("p").replace("p50 ", "other ")
    rows = [(1, text("p")), (2, text("p")), (2, text("q")), (3, text("r")), (3, near), (4, text("s")), (4, text("s").replace("s50 ", "new ")), (5, text("t")), (5, text("t"))]
    docs = spark.createDataFrame([(i, t, "en", "src") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = sorted((r["doc_id"], r["text"]) for r in P.near_dedup(spark, docs, "").collect())
    assert [x for x in got if x[0] < 4] == [(1, text("p")), (2, text("q")), (3, text("r"))]
    assert [x[0] for x in got if x[0] > 3] == [4, 5]
    cut = {(r["doc_id"], r["text"]) for r in P.line_dedup(spark, docs.where("doc_id < 3"), "").collect()}
    assert cut == {(1, text("p")), (2, text("q"))}


def test_stages_on_a_table_equal_brute_force(spark, tiny):
    """Each stage's result on its own input, on the smallest tables."""
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.where("text is not null").collect()}
    steps, docs = dict(P.STAGES), spark.read.parquet(f"{tiny}/documents.parquet")
    good = stage(steps["quality"](spark, docs, tiny), "t1")
    whole = queries.op7_bradley_terry_quality(spark, tiny).where("predicted = 1").select("doc_id").distinct().collect()
    assert {r["doc_id"] for r in good.select("doc_id").collect()} == {r["doc_id"] for r in whole}
    # no run of 51 words of a document stands in an earlier one
    cut = stage(steps["line_dedup"](spark, good, tiny), "t2")
    before, after, seen = rows(good), rows(cut), set()
    runs = lambda w: {tuple(w[k : k + 51]) for k in range(len(w) - 50)}
    lines = plain_cuts(before.items())
    for i in sorted(before):
        own = runs(words(before[i]))
        if i in after:
            assert not runs(words(after[i])) & seen
        if not lines[i] and not own & seen and words(before[i]):  # nothing to cut
            assert after[i] == before[i]
        seen |= own
    # one document of each group of near-duplicates
    near = stage(steps["near_dedup"](spark, cut, tiny), "t3")
    sets = {i: shingle_set(t) for i, t in after.items()}
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = joined(ids, links)
    assert set(rows(near)) == {i for i in after if group.get(i, i) == i}
    # documents of which a twentieth stands in benchmark windows go
    clean = stage(steps["decontaminate"](spark, near, tiny), "t4")
    items = [words(r["text"], ALNUM) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + min(13, len(w))]) for w in items if w for k in range(len(w) - min(13, len(w)) + 1)}
    sizes = {len(w) for w in windows}
    kept = set()
    for i, text in rows(near).items():
        w = words(text, ALNUM)
        hit = {p for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        if not hit or 20 * len(hit) < len(w):
            kept.add(i)
    assert set(rows(clean)) == kept
    # the manifest is the mix of what is left
    folder = clean._stage_path
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder.removeprefix('file:')}/*.parquet'")
    want = {i: taken for i, taken in con.execute(f"SELECT doc_id, taken FROM ({queries.ORACLE_SQL['op3_weighted_fair_mix']}) WHERE taken > 0").fetchall()}
    assert {r["doc_id"]: r["taken"] for r in steps["mix"](spark, clean, tiny).collect()} == want
