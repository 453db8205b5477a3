"""What the training-data operators share: stage tables, word hashing on
Arrow buffers, connected components and distributed running totals."""

from __future__ import annotations

import atexit
import shutil
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.prefix import running_totals
from ..runtime import ship

# --------------------------------------------------------------- stage tables


def stage_dir(spark: SparkSession) -> str:
    """Shared folder for stage tables: the session's ``spark.checkpoint.dir``,
    or a folder in the warehouse where that setting is missing."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + f"/_stages/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
        if found.startswith(("/", "file:/")):  # no cluster's folder: nothing of it outlives the session
            atexit.register(shutil.rmtree, "/" + found.removeprefix("file:").lstrip("/"), ignore_errors=True)
    return found.rstrip("/")


#: Stage files on a local disk are written by Hadoop's plain file system. Its default
#: one adds a checksum file to each and starts a program once more for it; while an
#: executor starts one, its memory can count twice. Damage still shows, by Parquet's
#: checksums of pages. Other stores don't read the options of writing.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
CHECKED_PAGES = {"parquet.page.verify-checksum.enabled": "true"}


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later
    plans start from files that survive the loss of any executor."""
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**PLAIN_FILES).parquet(path)
    out = spark.read.options(**CHECKED_PAGES).schema(df.schema).parquet(path)
    out._stage_path = path
    # what a returned plan still reads goes when the application ends
    _path, system = _file_system(spark, path)
    system.deleteOnExit(_path)
    return out


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_stage(*tables: DataFrame) -> None:
    """Delete stage tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_stage_path", None)
        if path:
            p, system = _file_system(df.sparkSession, path)
            system.delete(p, True)


#: A side of a join is broadcast only up to this many rows of a few integers (some 50 MB).
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are few; else as it is,
    so that the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: A key of more rows than this, and of more than a thousandth of all rows, is hot.
HOT_ROWS, HOT_SHARE = 2000, 1000


def spread_join(many: DataFrame, one: DataFrame, key: str, counts: DataFrame | None = None, hashed: bool = False) -> DataFrame:
    """``many`` with the columns of ``one``, which has one row for each ``key`` or
    a few; rows without a partner go.

    Hot keys of ``many`` are dealt over several tasks: a row goes to a block by
    its hash, and the key's rows in ``one`` to each block. Fewer than ``HOT_SHARE``
    keys can be hot, so the list of them is safe to broadcast, at every size.
    ``counts (key, n)``: rows by key, where they are known. ``hashed``: build a
    hash table of ``one`` and sort nothing, for a long ``many`` of short rows.
    """
    counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts.select(key, "n")
    blocks = {
        r[key]: -(-r["n"] // HOT_ROWS)
        for r in counts.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n")).limit(HOT_SHARE).collect()
        if r[key] is not None
    }
    plain = lambda df: df.hint("shuffle_hash") if hashed else df
    if not blocks:
        return many.join(plain(one), key)
    kind = many.schema[key].dataType.simpleString()
    hot = F.broadcast(many.sparkSession.createDataFrame(list(blocks.items()), f"`{key}` {kind}, __blocks int"))
    own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in many.columns]), F.coalesce("__blocks", F.lit(1))).cast("int")
    dealt = many.join(hot, key, "left").withColumn("__block", own).drop("__blocks")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__blocks", F.lit(1)) - 1))
    copied = one.join(hot, key, "left").withColumn("__block", copies).drop("__blocks")
    return dealt.join(plain(copied), [key, "__block"]).drop("__block")


# ------------------------------------------------------------- text as buffers


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 18
#: Rows that Spark hands to a worker at once (its own default of 10,000 long texts is too much).
BATCH_ROWS = 1000


def steps(offsets: np.ndarray, limit: int = STEP_BYTES):
    """Ranges of rows whose texts hold about ``limit`` bytes together."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def byte_table(separators, drop=()) -> np.ndarray:
    """Byte to normalised byte: A-Z in lower case, separators 0."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


#: White space that parts words, and bytes that are no word characters.
SPACE = byte_table([0x20, *range(0x09, 0x0E)])
CASED_SPACE = np.where(np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)]), 0, np.arange(256)).astype(np.uint8)
ALNUM = byte_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
_LANES = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 256)
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of some texts: byte range, 64-bit hash and, per text, the first word's index."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True, prefixes: tuple[int, ...] = ()):
        norm = table[raw]
        inside = norm > 0
        n = len(raw)
        head = np.ones(n + 1, bool)
        head[1:n] = inside[1:] & ~inside[:-1]
        head[0] = n > 0 and inside[0]
        edges = offsets[(offsets < n) & (offsets > 0)]
        head[edges] = inside[edges]
        self.start = np.flatnonzero(head[:n])
        where = np.flatnonzero(inside)
        rank = np.searchsorted(where, self.start)
        self.length = np.diff(np.append(rank, len(where)))
        self.first = np.searchsorted(self.start, offsets)
        self.prefix = {}
        if hashed:
            if len(where):
                pos = np.arange(len(where)) - np.repeat(rank, self.length)
                part = _BYTE[norm[where]] * powers(int(self.length.max()))[pos]
                self.hash = mix(np.add.reduceat(part, rank) + self.length.astype(np.uint64))
                for k in prefixes:  # the first k bytes of longer words
                    longer = np.flatnonzero(self.length > k)
                    head = part[(rank[longer][:, None] + np.arange(k)).ravel()].reshape(-1, k).sum(1, dtype=np.uint64)
                    self.prefix[k] = longer, mix(head + np.uint64(1 << 40) + np.uint64(k))
            else:
                self.hash = np.zeros(0, np.uint64)
                self.prefix = {k: (np.zeros(0, np.int64), self.hash) for k in prefixes}

    @property
    def end(self) -> np.ndarray:
        return self.start + self.length


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of ``width`` words, or of the whole sequence if it is shorter."""
    n = len(hashes)
    if not n:
        return hashes
    if n < width:
        return mix(np.sum(hashes * _LANES[:n], keepdims=True) + _LANES[63:] * np.array([n], np.uint64))
    out = hashes[: n - width + 1] * _LANES[0]
    for k in range(1, width):
        out = out + hashes[k : n - width + 1 + k] * _LANES[k]
    return mix(out)


def arrow_type(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def small_batches(spark: SparkSession) -> None:
    """Bound a worker's batches, where the session has Spark's default, and ship the package."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    ship(spark)


def map_texts(df: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with the result's columns given as lists or arrays."""
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    small_batches(df.sparkSession)

    def run(batches):
        names = arrow_type(target)
        for batch in batches:
            if batch.num_rows:
                for columns in function(batch):
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, names)], schema=names
                    )

    return df.mapInArrow(run, target)


# --------------------------------------------------------- connected components


def _sizes(edges: DataFrame):
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def _with_least(edges: DataFrame, neighbours: DataFrame, rows: int) -> DataFrame:
    """``edges`` with ``m``, the least neighbour that ``u`` has in ``neighbours``. A
    giant component's centre is a hot key; among few rows there is none."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return spread_join(edges, least.drop("n"), "u", least) if rows > HOT_ROWS else edges.join(least.drop("n"), "u")


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both.where("v > u"), both, 2 * rows).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    turned = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _with_least(turned, turned, rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(turned.groupBy("u").agg(F.min("v").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Least member of each node's connected component.

    Alternates large-star and small-star over ``edges (u, v)`` until nothing
    changes; each round is a stage table. Returns ``(node, component)`` for the
    nodes that are not the least of their component. Any orderable type works;
    self-loops are ignored and an empty table gives an empty table.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    size = _sizes(now)
    while size[0]:
        new = stage(_small_star(_large_star(now, size[0]), size[0]), name)
        new_size = _sizes(new)
        drop_stage(now)
        now, done, size = new, new_size == size, new_size
        if done:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out._stage_path = now._stage_path
    return out


# ----------------------------------------------------------- running totals


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows up to each row, by ``group``, in the order
    of ``bucket`` and then ``order``; only one bucket is sorted in one task."""
    return running_totals(df, group, bucket, order, {value: out})
