"""Near-duplicates by MinHash (operator 2).

Texts with equal shingle sets are one class. Many universal hash functions give
each class its minima; bands of minima put classes into buckets. Each bucket's
members meet a few hubs among them, twice; then, in buckets whose members are
still in several components, members of different components meet, block by
block, and only links that join components leave a block. A pair is tested on
set sizes and signatures first; what passes is confirmed on full shingle sets,
which are made once for each likely class. Components come from alternating
large-star and small-star. No step makes a row for each pair of a group, and
joins on buckets and hubs deal hot keys over many tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, Words, bounded, buffer_of, components, drop_stage, map_texts, mix, shingles, spread_join, stage, steps

#: Words of a shingle; a link needs 100 * intersection >= LINK_PERCENT * union.
SHINGLE = 5
LINK_PERCENT = 85
#: Bands and minima per band: at a similarity of 0.85 a pair shares no bucket
#: with probability (1 - 0.85**5)**25 < 5e-7.
BANDS, ROWS = 25, 5
#: Members of a bucket that one group compares with each other at once by their
#: sets, and how many times as many by their signatures; hubs of a bucket in the
#: first and the second round.
BLOCK, SIGNATURES = 256, 8
HUBS = (2, 4)

_RNG = np.random.default_rng(97531)
_A = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_C = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_BAND = _RNG.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(column) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, off = buffer_of(column)
    out = []
    for i, j in steps(off):
        w = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i], SPACE)
        out += [np.unique(shingles(w.hash[a:b], SHINGLE)) for a, b in zip(w.first[:-1], w.first[1:])]
    return out


def minima(s: np.ndarray) -> np.ndarray:
    """Minimum of each universal hash ``(a*x + c mod 2^64) >> 32`` over a set."""
    x = (s >> np.uint64(32))[None, :]
    out = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, x.shape[1], 2048):
        v = _A[:, None] * x[:, k : k + 2048]
        v += _C[:, None]
        np.minimum(out, v.min(1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(BANDS, ROWS).astype(np.uint64)
    return mix((parts * _BAND).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def class_key(s: np.ndarray) -> bytes:
    """128-bit name of a shingle set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def linked(a: np.ndarray, b: np.ndarray, percent: int = LINK_PERCENT) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signatures(rows: DataFrame, kind: str) -> DataFrame:
    """Per row of ``(id, version, text)``: id, version, set size, class key, band keys, 16 bits of each minimum."""

    def run(batch):
        n, key, bands, bits = [], [], [], []
        for s in shingle_sets(batch.column(2)):
            n.append(len(s))
            if len(s):
                sig = minima(s)
                key.append(class_key(s))
                bands.append(band_keys(sig))
                bits.append((sig >> np.uint32(16)).astype(np.uint16).tobytes())
            else:
                key.append(None)
                bands.append(None)
                bits.append(None)
        yield [batch.column(0), batch.column(1), n, key, bands, bits]

    return map_texts(rows, run, f"id {kind}, version bigint, n_shingles bigint, key binary, bands array<bigint>, bits binary")


def least_agreement(percent: int) -> int:
    """Equal minima that a pair at the limit falls short of with probability < 1e-8."""
    wide, p = BANDS * ROWS, percent / 100
    return int(wide * p - 6 * (wide * p * (1 - p)) ** 0.5)


def likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, node) of classes that may be similar by set sizes and signatures."""
    own, rows = classes.select("node", "n", "bits"), pairs.count()
    hubs = own.join(bounded(pairs.select(F.col("hub").alias("node")).distinct(), rows), "node", "left_semi")
    hubs = hubs.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("bits").alias("hub_bits"))
    both = spread_join(own.join(bounded(pairs, rows), "node"), hubs, "hub", pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")))
    near = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    least = least_agreement(percent)

    def run(batch):
        a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in batch.columns[2:])
        take = pa.array(np.flatnonzero((a == b).sum(1) >= least))
        yield [batch.column(0).take(take), batch.column(1).take(take)]

    return map_texts(both.where(near).select("hub", "node", "bits", "hub_bits"), run, "hub bigint, node bigint")


def _sets_of(nodes: DataFrame, most: int, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, set) of at most ``most`` distinct classes: each one's shingle set, from
    the text of its first row, as a stage table."""
    side = bounded(nodes.join(classes.select("node", F.col("rep.id").alias("rep"), F.col("rep.version").alias("rep_version")), "node"), most)
    found = texts.join(side, (texts["id"] == side["rep"]) & (texts["version"] == side["rep_version"])).select("node", "text")

    def run(batch):
        yield [batch.column(0), [s.view(np.int64) for s in shingle_sets(batch.column(1))]]

    return stage(map_texts(found, run, "node bigint, set array<bigint>"), "sets")


def confirm(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The pairs (u, v) of classes whose full sets are similar enough, and the
    stage tables that they are read from."""
    likely = stage(likely_pairs(pairs, classes, percent), "likely")
    nodes = likely.select("node").unionByName(likely.select(F.col("hub").alias("node"))).distinct()
    sets = _sets_of(nodes, 2 * likely.count(), classes, texts)
    both = spread_join(likely.join(sets, "node"), sets.select(F.col("node").alias("hub"), F.col("set").alias("hub_set")), "hub", likely.groupBy("hub").agg(F.count(F.lit(1)).alias("n")))

    def run(batch):
        a, b = batch.column(2), batch.column(3)
        ok = [k for k in range(batch.num_rows) if linked(*(np.asarray(x[k].values).view(np.uint64) for x in (a, b)), percent)]
        take = pa.array(ok, pa.int64())
        yield [batch.column(0).take(take), batch.column(1).take(take)]

    # several rows may have the text of a class's first row
    return map_texts(both.select("hub", "node", "set", "hub_set"), run, "u bigint, v bigint").distinct(), [likely, sets]


def _drawn(members: DataFrame, hubs: int, salt: int, *more) -> DataFrame:
    """Per bucket: ``size`` and ``hubs``, members that lead when ids are read through
    a mask of the bucket's own. Sums of plain numbers only, so they add up map-side."""
    mask = [F.xxhash64("band", F.lit(salt + h)) for h in range(hubs)]
    least = members.groupBy("band").agg(F.count(F.lit(1)).alias("size"), *more, *[F.min(F.col("node").bitwiseXOR(m)).alias(f"least{h}") for h, m in enumerate(mask)])
    drawn = F.array_distinct(F.array(*[F.col(f"least{h}").bitwiseXOR(m) for h, m in enumerate(mask)]))
    return least.withColumn("hubs", drawn).drop(*[f"least{h}" for h in range(hubs)])


def _with_hubs(members: DataFrame, drawn: DataFrame, name: str) -> DataFrame:
    drawn = stage(drawn.select("band", "size", "hubs"), "hubs")
    out = stage(spread_join(members, drawn, "band", drawn.select("band", F.col("size").alias("n")), hashed=True), name)
    drop_stage(drawn)
    return out


def _hub_pairs(members: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Distinct pairs of a bucket's hubs and its members of other components."""
    pairs = members.select("node", "comp", F.explode("hubs").alias("hub")).where("node <> hub").distinct()
    if parts is None:
        return pairs.select("hub", "node")
    of_hub = parts.select(F.col("node").alias("hub"), F.col("component").alias("hub_comp"))
    return pairs.join(of_hub, "hub", "left").where(F.col("comp") != F.coalesce("hub_comp", "hub")).select("hub", "node")


def _mixed(members: DataFrame, parts: DataFrame, hubs: int, salt: int) -> DataFrame:
    """Members, with their components and new hubs, of the buckets that hold several components."""
    own = parts.select(F.col("node").alias("part"), "component")
    comp = stage(members.select("band", "pos", "node").join(own, F.col("node") == F.col("part"), "left").select("band", "pos", "node", F.coalesce("component", "node").alias("comp")), "comps")
    out = _with_hubs(comp, _drawn(comp, hubs, salt, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi"), "mixed")
    drop_stage(comp)
    return out


def _compare(table: pa.Table, percent: int, sets) -> tuple[list[int], list[tuple[int, int]]]:
    """Members of a group of two blocks that have a likely partner, and, given
    ``sets``, confirmed links that join components."""
    least = least_agreement(percent)
    n, mine, i, j = (table[c].to_numpy() for c in ("n", "mine", "i", "j"))
    pos, same = int(table["pos"][0].as_py()), i[0] == j[0]
    keys = table["node"].to_pylist()
    _, comp = np.unique(table["comp"].to_numpy(), return_inverse=True)
    bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint16).reshape(len(n), -1)
    bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(n), BANDS)
    likely, links = set(), []
    for k in range(len(n)):
        if not same and mine[k] != i[k]:
            continue
        ok = comp != comp[k]
        if same:
            ok[: k + 1] = False
        else:
            ok &= mine != mine[k]
        ok &= 100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k])
        at = np.flatnonzero(ok)
        at = at[(bits[at] == bits[k]).sum(1) >= least] if len(at) else at
        # a pair is looked at in the first band that it shares
        at = at[(bands[at] == bands[k]).argmax(1) == pos] if len(at) else at
        if sets is None:
            if len(at):
                likely |= {k, *at.tolist()}
            continue
        for m in at.tolist():
            if comp[m] != comp[k] and linked(sets[k], sets[m], percent):
                links.append((k, m))
                comp[comp == comp[m]] = comp[k]
    return sorted(likely), [(keys[a], keys[b]) for a, b in links]


_MEMBER = "band bigint, pos int, i int, j int, mine int, node bigint, comp bigint, n bigint, bits binary, bands array<bigint>"


def _in_blocks(members: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """Members ``(band, pos, node, comp, size)`` in each pair of blocks (i, j) of
    their bucket that they belong to; blocks have about ``block`` members."""
    own = members.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = own.join(classes.select("node", "n", "bits", "bands"), "node")
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    return spread.select(*[c.split()[0] for c in _MEMBER.split(", ")])


def _cross_links(mixed: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, block: int) -> DataFrame:
    """Confirmed links between the components of a bucket, as a stage table.

    A bucket is cut into blocks by a hash, and every pair of blocks is a group. A
    first pass on the minima, which are small, takes large blocks and names the
    members that have a likely partner; only their sets are made, and compared in
    blocks of about ``block`` members.
    """

    def name(table: pa.Table) -> pa.Table:
        at, _ = _compare(table, percent, None)
        return table.take(pa.array(at, pa.int64())).select(["band", "pos", "node", "comp"])

    groups = _in_blocks(mixed, classes, SIGNATURES * block).groupBy("band", "i", "j")
    likely = stage(groups.applyInArrow(name, "band bigint, pos int, node bigint, comp bigint").distinct(), "likely")
    sets = _sets_of(likely.select("node").distinct(), likely.count(), classes, texts)
    sizes = likely.groupBy("band").agg(F.count(F.lit(1)).alias("size"))

    def link(table: pa.Table) -> pa.Table:
        column = table["set"].combine_chunks()
        off, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        _, links = _compare(table, percent, [values[a:b] for a, b in zip(off[:-1], off[1:])])
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    sized = spread_join(likely, sizes, "band", sizes.withColumnRenamed("size", "n"))
    out = stage(_in_blocks(sized, classes, block).join(sets, "node").groupBy("band", "i", "j").applyInArrow(link, "u bigint, v bigint").distinct(), "cross")
    drop_stage(likely, sets)
    return out


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Stage tables of rows ``(id, version, n_shingles, key)`` and of class names
    ``(key, comp, rep, first, n)``: a class's component, its first row, that of
    its component, and its number of rows. ``version`` tells rows of one id apart
    by their text."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    sig = stage(_signatures(texts, kind), "signatures")
    usable = sig.where("id is not null and key is not null")
    first = [F.first(c).alias(c) for c in ("bands", "bits")]
    classes = usable.groupBy("key").agg(F.min(F.struct("id", "version")).alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("n_shingles").alias("n"), *first)
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers that stay, once written
    texts = texts.where("id is not null and text is not null")
    every = classes.select("node", F.posexplode("bands").alias("pos", "band"), F.col("node").alias("comp"))
    members = _with_hubs(every, _drawn(every, HUBS[0], 0).where("size > 1"), "buckets")
    parts = None
    for round_ in range(len(HUBS)):
        pairs = stage(_hub_pairs(members, parts), "pairs")
        links, read = confirm(pairs, classes, texts, percent)
        new = components(links if parts is None else links.unionByName(_edges(parts)))
        mixed = _mixed(members, new, *((HUBS[round_ + 1], 100 * (round_ + 1)) if round_ + 1 < len(HUBS) else (1, 0)))
        drop_stage(pairs, members, *read, *([parts] if parts is not None else []))
        parts, members = new, mixed
    if members.head(1):
        cross = _cross_links(members, classes, texts, percent, block)
        if cross.head(1):
            new = components(cross.unionByName(_edges(parts)))
            drop_stage(parts)
            parts = new
        drop_stage(cross)
    own = parts.select(F.col("node").alias("part"), "component")
    known = classes.join(own, F.col("node") == F.col("part"), "left").select("key", "rep", "rows", F.coalesce("component", "node").alias("comp"))
    least = known.groupBy("comp").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n"))
    names = stage(spread_join(known, least.drop("n"), "comp", least).select("key", "comp", "rep", "first", F.col("rows").alias("n")), "names")
    rows = stage(sig.select("id", "version", "n_shingles", "key"), "rows")
    drop_stage(members, parts, classes, sig)
    return rows, names


def _edges(parts: DataFrame) -> DataFrame:
    return parts.select(F.col("node").alias("u"), F.col("component").alias("v"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = LINK_PERCENT, block: int = BLOCK,
) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id``, ``kept``.

    Null texts and texts without words have no shingles and are a component
    each. A row with a null id links with nothing: its component is null and it
    is not kept. Rows of one id are compared by their texts like any others; a
    component is named by its smallest id. Every row gives one row; other
    columns are ignored.
    """
    rows, names = _grouped(docs, id_col, text_col, percent, block)
    # classes of one row that are linked with none need no name from elsewhere
    shared = names.where("n > 1 or rep <> first").select("key", F.col("first.id").alias("component"), "n")
    known = rows.where("id is not null and key is not null")
    loose = rows.where("id is null or key is null").withColumn("component", F.col("id"))
    alone = known.join(shared.select("key").hint("shuffle_hash"), "key", "left_anti").withColumn("component", F.col("id"))
    linked_ = spread_join(known, shared.drop("n"), "key", shared)
    columns = [F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(False)).alias("kept")]
    return loose.select(*columns).unionByName(alone.select(*columns)).unionByName(linked_.select(*columns))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = LINK_PERCENT, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest
    id and, of rows of one id, of the smallest hash of the text.

    Rows that are equal in id and text count once. Rows without an id, and texts
    without words, are in no group and stay. Columns are those of ``docs``.
    """
    rows, names = _grouped(docs, id_col, text_col, percent, block)
    version = F.xxhash64(F.col(text_col))
    # of each class at most its first row stays, and of each component one class
    shared = names.where("n > 1 or rep <> first")
    known = rows.where("id is not null and key is not null").select("id", "version", "key")
    gone = spread_join(known, shared.select("key", "rep", "first"), "key", shared.select("key", "n")).where("rep <> first or id <> rep.id or version <> rep.version")
    gone = stage(gone.select(F.col("id").alias("__gone"), F.col("version").alias("__version")).distinct(), "gone")
    twice = stage(rows.where("id is not null").groupBy("id", "version").count().where("count > 1").select(F.col("id").alias("__gone"), F.col("version").alias("__version")), "twice")
    drop_stage(rows, names)

    def same(side):
        return (docs[id_col] == side["__gone"]) & (version.eqNullSafe(side["__version"]))

    side = bounded(gone, gone.count())
    left = docs.join(side, same(side), "left_anti")
    n = twice.count()
    if n:
        side = bounded(twice, n)
        again = left.join(side, same(side), "left_semi").withColumn("__version", version).dropDuplicates([id_col, "__version"]).drop("__version")
        left = left.join(side, same(side), "left_anti").unionByName(again)
    return left
