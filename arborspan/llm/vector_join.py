"""Embedding near-duplicates by an exact metric range join (operator 6).

On the unit sphere a cosine of at least ``c`` is a distance of at most
``r = sqrt(2 - 2c)``. Each label has pivots of its own, and a vector lives in the
cell of its nearest one. By the triangle inequality its partners live only in
cells with ``d(x, p) <= radius(p) + r`` and ``d(x, p) <= d(x, home) + 2r`` (the
distance to the bisecting plane, which is sharper, is tested too). Of two such
cells one is the receiver: vectors of the other one are dealt to it as guests,
so every pair meets in just one cell, and cells join independently: residents
with residents and with guests. That is never more comparing than all pairs of a
label; the better vectors are clustered, the fewer guests there are. A large cell
is cut into blocks whose pairs are tasks of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, components, drop_stage, map_texts, spread_join, stage

#: Least cosine of a link.
MIN_COSINE = 0.93
#: Pivots of all labels, and bytes of them, at most (they are sent to every
#: worker); residents per cell aimed at, and vectors of a block; vectors from
#: which on a label has two pivots at least.
MAX_PIVOTS, PIVOT_BYTES, PER_PIVOT, BLOCK, SPLIT = 4096, 16 << 20, 1024, 2048, 32
#: What distances in single steps of double precision may be off by.
SLACK = 1e-9


def _usable(column) -> np.ndarray:
    """Row numbers of vectors that are finite and not zero; none is null or empty."""
    if not len(column):
        return np.zeros(0, np.int64)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null is not finite either
    size = np.diff(column.offsets.to_numpy())
    heads = np.cumsum(size) - size
    return np.flatnonzero(np.logical_and.reduceat(np.isfinite(x), heads) & np.logical_or.reduceat(x != 0, heads))


def _matrix(column) -> np.ndarray:
    """Unit vectors, in double precision, of a column of vectors of one length;
    scaled by their largest component first, so that no square over- or underflows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


class Cells:
    """The pivots of one label and, once it is known, how far their cells reach."""

    def __init__(self, pivots: np.ndarray, radius: np.ndarray | None = None):
        self.pivots, self.radius = pivots, radius
        self.apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))
        at = np.arange(len(pivots))
        odd = (at[:, None] + at[None, :]) % 2 == 1
        #: whether the second cell takes guests from the first: the larger one of
        #: an odd sum, the smaller one of an even sum
        self.receives = np.where(odd, at[None, :] > at[:, None], at[None, :] < at[:, None])

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances to all pivots, the nearest one, and the distance to it."""
        d = np.sqrt(np.maximum(2 - 2 * (x @ self.pivots.T), 0))
        home = d.argmin(1)
        return d, home, d[np.arange(len(x)), home]

    def guests(self, x: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
        """Home of each vector, and whether it is a guest of each cell."""
        d, home, own = self.home(x)
        go = self.receives[home] & (d <= self.radius[None, :] + r + SLACK) & (d <= own[:, None] + 2 * r + SLACK)
        span = self.apart[home]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(span > 0, (d**2 - own[:, None] ** 2) / (2 * span), 0.0)
        return home, go & (plane <= r + 1e-7)


def choose_pivots(classes: DataFrame, max_pivots: int, per_pivot: int, split: int) -> dict[tuple[int, str], Cells]:
    """Pivots by length of vector and label: vectors drawn in the order of a hash.

    The labels with most vectors have pivots, one for each ``per_pivot`` vectors
    and two at least; all have ``max_pivots`` at most. Others are a cell each.
    """
    groups = classes.groupBy("width", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= split)
    rows = groups.orderBy(F.desc("n"), "width", "label").limit(max_pivots // 2).collect()
    if not rows:
        return {}
    most = max(2, min(max_pivots, PIVOT_BYTES // (8 * max(r["width"] for r in rows))))
    rows = rows[: most // 2]
    wanted = [max(2, r["n"] // per_pivot) for r in rows]
    share = min(1.0, most / sum(wanted))
    plan = [(r["width"], r["label"], r["n"], max(2, int(w * share))) for r, w in zip(rows, wanted)]
    spark = classes.sparkSession
    listed = F.broadcast(spark.createDataFrame(plan, "width int, label string, total bigint, pivots int"))
    turn = F.xxhash64("node")
    drawn = classes.join(listed, ["width", "label"]).where(F.pmod(turn, F.col("total")) < 4 * F.col("pivots") + 64).withColumn("turn", F.xxhash64("node", F.lit("pivot")))
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("width", "label").orderBy("turn", "node"))
    got = drawn.withColumn("place", place).where("place <= pivots").select("width", "label", "v").toArrow()
    found: dict[tuple[int, str], list[int]] = {}
    for k, key in enumerate(zip(got["width"].to_pylist(), got["label"].to_pylist())):
        found.setdefault(key, []).append(k)
    return {key: Cells(_matrix(got["v"].take(pa.array(at)))) for key, at in found.items() if len(at) > 1}


def _by_label(batch, cells: dict):
    """(rows, cells or None) of a batch ``(.., width, label)`` by label and length."""
    width, label = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
    places: dict[tuple[int, str], list[int]] = {}
    for k, key in enumerate(zip(width, label)):
        places.setdefault(key, []).append(k)
    for key, at in places.items():
        yield np.array(at), cells.get(key)


def deal(classes: DataFrame, vtype: str, min_cosine: float, max_pivots: int, per_pivot: int, split: int = SPLIT) -> DataFrame:
    """A row for each class ``(node, copies, v, width, label)`` and cell that it lives in
    (``resident``) or is a guest of; ``cell`` names the length, the label and the pivot."""
    spark = classes.sparkSession
    r = math.sqrt(max(0.0, 2 - 2 * min_cosine))
    cells = choose_pivots(classes, max_pivots, per_pivot, split)
    held = spark.sparkContext.broadcast(cells)

    def reach(batch):
        rows, cell, far = [], [], []
        for at, own in _by_label(batch, held.value):
            if own is None:
                continue
            _, home, d = own.home(_matrix(batch.column(0).take(pa.array(at))))
            rows.append(at)
            cell.append(home)
            far.append(d)
        if rows:
            at = pa.array(np.concatenate(rows))
            yield [batch.column(1).take(at), batch.column(2).take(at), np.concatenate(cell).astype(np.int32), np.concatenate(far)]

    if cells:
        far = map_texts(classes.select("v", "width", "label"), reach, "width int, label string, cell int, d double")
        for key, own in cells.items():
            own.radius = np.full(len(own.pivots), -np.inf)
        for row in far.groupBy("width", "label", "cell").agg(F.max("d").alias("d")).collect():  # a row for each pivot
            cells[row["width"], row["label"]].radius[row["cell"]] = row["d"]
    known = spark.sparkContext.broadcast(cells)

    def go(batch):
        node, copies, v = batch.columns[:3]
        rows, cell, lives = [], [], []
        for at, own in _by_label(batch, known.value):
            if own is None:
                rows.append(at)
                cell.append(np.zeros(len(at), np.int32))
                lives.append(np.ones(len(at), bool))
                continue
            home, guest = own.guests(_matrix(v.take(pa.array(at))), r)
            k, c = np.nonzero(guest)
            rows += [at, at[k]]
            cell += [home.astype(np.int32), c.astype(np.int32)]
            lives += [np.ones(len(at), bool), np.zeros(len(k), bool)]
        take = pa.array(np.concatenate(rows))
        yield [node.take(take), copies.take(take), v.take(take), batch.column(3).take(take), batch.column(4).take(take), np.concatenate(cell), pa.array(np.concatenate(lives))]

    schema = f"node bigint, copies bigint, v {vtype}, width int, label string, cell int, resident boolean"
    dealt = map_texts(classes.select("node", "copies", "v", "width", "label"), go, schema)
    return dealt.select("node", "copies", "v", F.concat_ws("/", "width", "cell", "label").alias("cell"), "resident")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", min_cosine: float = MIN_COSINE, block: int = BLOCK, max_pivots: int = MAX_PIVOTS, per_pivot: int = PER_PIVOT,
) -> DataFrame:
    """Per row: id, ``n_links``, ``component_id``, ``kept``.

    Vectors link when their labels are equal and not null (any, if ``label_col``
    is None) and their cosine in double precision is at least ``min_cosine``.
    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; vectors of different lengths don't link. Copies are one
    class; their links are counted, not listed. Every row gives one row, rows of
    one id too (they share a component and count each other); a null id links
    with nothing, its component is null. Other columns are ignored.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    vtype = vectors.schema[vector_col].dataType.simpleString()
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    rows = vectors.select(F.col(id_col).alias("id"), F.struct(label.alias("label"), F.col(vector_col).alias("v")).alias("key"))
    can_link = F.col("id").isNotNull() & F.col("key.label").isNotNull() & F.col("key.v").isNotNull() & (F.size("key.v") > 0)
    grouped = rows.where(can_link).groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "key.label", "copies", "key.v")

    def finite(batch):
        take = pa.array(_usable(batch.column(3)))
        yield [c.take(take) for c in batch.columns]

    classes = map_texts(grouped, finite, f"id {kind}, label string, copies bigint, v {vtype}")
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("width", F.size("v")), "vectors")
    dealt = stage(deal(classes, vtype, min_cosine, max_pivots, per_pivot), "vector-cells")
    found = stage(_join(dealt, min_cosine, block), "vector-links")
    parts = components(found.where("v is not null").select("u", "v"))
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    named = classes.join(parts.withColumnRenamed("node", "part"), F.col("node") == F.col("part"), "left").withColumn("comp", F.coalesce("component", "node"))
    named = named.select("node", "id", F.struct("label", "v").alias("key"), "copies", "comp")
    least = named.groupBy("comp").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n"))
    full = spread_join(named, least.drop("n"), "comp", least).join(counts, "node", "left")
    full = stage(full.select("key", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.col("copies").alias("n")).where("links > 0 or n > 1"), "vector-names")
    drop_stage(classes, dealt, found, parts)
    # vectors that are linked with none need no name from elsewhere
    alone = rows.where(can_link).join(full.select("key").hint("shuffle_hash"), "key", "left_anti").select("id")
    alone = alone.unionByName(rows.where(~F.coalesce(can_link, F.lit(False))).select("id")).select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component"))
    out = alone.unionByName(spread_join(rows.where(can_link), full.drop("n"), "key", full).select("id", "links", "component"))
    return out.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(False)).alias("kept"))


def _join(dealt: DataFrame, min_cosine: float, block: int) -> DataFrame:
    """Rows (u, v, n): partial link counts of u (v null) and spanning links (u, v).

    A cell of more than ``block`` vectors is cut into blocks of residents and,
    after these, blocks of guests; each pair of blocks but two of guests is a group.
    """
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("resident").cast("int")).alias("own")).where(F.col("n") > block)
    sizes = stage(sizes.select("cell", F.ceil(F.col("own") / block).cast("int").alias("homes"), F.ceil((F.col("n") - F.col("own")) / block).cast("int").alias("others")), "vector-blocks")
    member = dealt.join(bounded(sizes, sizes.count()), "cell", "left")
    turn = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    mine = F.when(F.col("homes").isNull(), 0).when(F.col("resident"), turn(F.col("homes"))).otherwise(F.col("homes") + turn(F.col("others")))
    last = F.when(F.col("homes").isNull(), 0).when(F.col("resident"), F.col("homes") + F.col("others") - 1).otherwise(F.col("homes") - 1)
    spread = member.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), last))).select(
        "cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "resident", "node", "copies", "v"
    )

    def compare(table: pa.Table) -> pa.Table:
        node, copies, mine = (table[c].to_numpy() for c in ("node", "copies", "mine"))
        lives = table["resident"].to_numpy()
        x = _matrix(table["v"])
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = np.flatnonzero((mine == i) & lives), np.flatnonzero(mine == j)
        links = np.zeros(len(node), np.int64)
        parent = np.arange(len(node))

        def root(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for s in range(0, len(left), 512):
            a = left[s : s + 512]
            ok = np.clip(x[a] @ x[right].T, -1, 1) >= min_cosine
            if i == j:  # two residents meet once
                ok &= ~lives[right][None, :] | (node[a][:, None] < node[right][None, :])
            links[a] += ok @ copies[right]
            links[right] += copies[a] @ ok
            for k in np.flatnonzero(ok.any(1)):
                me = root(a[k])
                for m in np.unique(parent[right[ok[k]]]):
                    other = root(m)
                    if other != me:
                        parent[other] = me
        roots = np.array([root(k) for k in range(len(node))])
        linked, joined = np.flatnonzero(links > 0), np.flatnonzero(roots != np.arange(len(node)))
        u = np.concatenate([node[linked], node[joined]])
        v = pa.array(np.concatenate([np.zeros(len(linked), np.int64), node[roots[joined]]]), mask=np.arange(len(u)) < len(linked))
        n = np.concatenate([links[linked], np.zeros(len(joined), np.int64)])
        return pa.table({"u": pa.array(u), "v": v, "n": pa.array(n)})

    return spread.groupBy("cell", "i", "j").applyInArrow(compare, "u bigint, v bigint, n bigint")
