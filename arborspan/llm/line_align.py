"""Line deduplication by pairwise alignment (operator 9).

A text's lines are cut further where a sentence ends before a space, so that a
passage inside a longer line is a run of lines too. Lines are hashed. A run of
consecutive lines that just reaches ``min_words`` words is a key; documents that
share a key overlap there. A key is rare enough to pair documents by when two of
them hold it; a commoner one pairs each later document with the first holder
only, so that no key makes more pairs than documents hold it, and none is passed
over. A pair is aligned by patience diff on line hashes, and common blocks of at
least ``min_words`` words are deleted from the later document (the larger id).
The first holder of a block never loses it. Keys that very many documents hold,
and first holders of very many, are dealt over many tasks.

With ``inside_lines``, passages of more than 50 words go too, wherever they
begin and end. In every 51 words in a row the run of 20 words of the least hash
is a sample, so that documents with a common passage share a sample. Around shared samples every run of 51
words is a key with one owner, and later documents lose the words of the keys
that an earlier one owns.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SPACE, Words, _LANES, buffer_of, drop_stage, map_texts, mix, spread_join, stage, steps

#: Words that a common block must have to be deleted.
MIN_WORDS = 20
#: Words of a common passage that is deleted even inside of lines, and of its samples.
PASSAGE, SAMPLE = 51, 20


def breaks_of(part: np.ndarray) -> np.ndarray:
    """Places of the bytes between lines: line feeds, and spaces after a sentence's end."""
    gap = part == 10
    ends = (part == 46) | (part == 33) | (part == 63)
    gap[1:] |= (part[1:] == 32) & ends[:-1]
    return np.flatnonzero(gap)


def line_table(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: a hash of each line (of its words, in lower case) and its words."""
    raw, off = buffer_of(column)
    out = []
    for i, j in steps(off):
        part, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        w = Words(part, o, SPACE)
        breaks = breaks_of(part)
        if len(breaks):  # a sentence's end in one text isn't one before the next
            breaks = breaks[(part[breaks] == 10) | ~np.isin(breaks, o)]
        per = np.searchsorted(breaks, o)  # breaks before each text
        lines_of = np.diff(per) + 1
        # line index, over all texts, of each word
        doc = np.repeat(np.arange(j - i), np.diff(w.first))
        line = np.searchsorted(breaks, w.start) + doc
        total = int(lines_of.sum())
        words = np.bincount(line, minlength=total)
        heads = np.searchsorted(line, np.arange(total))
        pos = np.arange(len(line)) - heads[line]
        value = mix(w.hash + (pos + 1).astype(np.uint64) * _LANES[7])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        h = mix(sums[heads + words] - sums[heads] + words.astype(np.uint64))
        cut = np.concatenate([[0], np.cumsum(lines_of)])
        out += [(h[a:b], words[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    return out


def run_keys(hashes: np.ndarray, words: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Distinct hashes of :func:`minimal_runs`."""
    return np.unique(minimal_runs(hashes, words, min_words)[2])


def minimal_runs(hashes: np.ndarray, words: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, end, hash) of the runs of lines that just reach ``min_words``
    words, none of them beginning with a line without words."""
    n = len(hashes)
    ends = np.concatenate([[0], np.cumsum(words)])
    start = np.flatnonzero(words > 0)
    stop = np.searchsorted(ends, ends[start] + min_words)
    ok = stop <= n
    start, stop = start[ok], stop[ok]
    if not len(start):
        return start, stop, np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * powers_odd(n), dtype=np.uint64)])
    value = (sums[stop] - sums[start]) * inverse_odd(n)[start]
    return start, stop, mix(value + (stop - start).astype(np.uint64))


_STEP = 0xD1342543DE82EF95
_INVERSE = pow(_STEP, -1, 1 << 64)


def powers_odd(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _STEP, np.uint64)]), dtype=np.uint64)


def inverse_odd(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _INVERSE, np.uint64)]), dtype=np.uint64)


def word_runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers_odd(n), dtype=np.uint64)])
    return mix((sums[width:] - sums[:-width]) * inverse_odd(n)[: n - width + 1] + np.uint64(width))


def samples(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the sampled runs: the least of each passage's runs of ``SAMPLE`` words."""
    span = PASSAGE - SAMPLE + 1
    runs = word_runs(hashes, SAMPLE)
    if len(runs) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    view = sliding_window_view(runs, span)
    at = np.unique(np.concatenate([view[k : k + 8192].argmin(1) + np.arange(k, min(k + 8192, len(view))) for k in range(0, len(view), 8192)]))
    return at, runs[at]


def passage_keys(hashes: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Distinct hashes of the runs of ``PASSAGE`` words that hold one of the samples ``shared``."""
    at, key = samples(hashes)
    keys = word_runs(hashes, PASSAGE)
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = at[np.isin(key, shared)]
    np.add.at(edge, np.maximum(at - (PASSAGE - SAMPLE), 0), 1)
    np.add.at(edge, at + 1, -1)
    return np.unique(keys[np.cumsum(edge)[: len(keys)] > 0])


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned index pairs of two sequences of line hashes.

    Between two aligned lines, equal heads and tails are matched first; then
    lines that occur once on either side are anchors, of which a longest
    increasing chain is kept. A stretch without such lines is matched on the
    n-th occurrence of each line instead.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        places: dict[int, list[list[int]]] = {}
        for i in range(a0, a1):
            places.setdefault(a[i], [[], []])[0].append(i)
        for i in range(b0, b1):
            if b[i] in places:
                places[b[i]][1].append(i)
        pairs = [(x[0], y[0]) for x, y in places.values() if len(x) == 1 and len(y) == 1]
        if not pairs:
            pairs = [p for x, y in places.values() for p in zip(x, y)]
        if not pairs:
            continue
        pairs.sort()
        tails, chain, back = [], [], []
        for k, (_, y) in enumerate(pairs):
            at = bisect_left(tails, y)
            if at == len(tails):
                tails.append(y)
                chain.append(k)
            else:
                tails[at], chain[at] = y, k
            back.append(chain[at - 1] if at else -1)
        k, anchors = chain[-1], []
        while k >= 0:
            anchors.append(pairs[k])
            k = back[k]
        x0, y0 = a0, b0
        for x, y in reversed(anchors):
            out.append((x, y))
            todo.append((x0, x, y0, y))
            x0, y0 = x + 1, y + 1
        todo.append((x0, a1, y0, b1))
    return sorted(out)


def common_blocks(early: np.ndarray, late: np.ndarray, words: np.ndarray, min_words: int = MIN_WORDS) -> list[int]:
    """Lines of ``late`` in common blocks of at least ``min_words`` words.

    What an alignment leaves over, such as moved or repeated blocks, is aligned
    with ``early`` again; where that finds no more, a minimal run that both
    still share is a block by itself, until none is left.
    """
    known = set(early.tolist())
    left = list(range(len(late)))
    a, gone = early.tolist(), []
    while left:
        if not any(int(late[i]) in known for i in left):
            break
        pairs = patience(a, [int(late[i]) for i in left])
        found, block = [], []
        for x, y in [*pairs, (-9, -9)]:
            if block and (x, y) == (block[-1][0] + 1, block[-1][1] + 1) and left[y] == left[block[-1][1]] + 1:
                block.append((x, y))
                continue
            lines = [left[k] for _, k in block]
            if sum(int(words[i]) for i in lines) >= min_words:
                found += lines
            block = [(x, y)]
        if not found:
            found = _shared_run(early, late, words, left, min_words)
        if not found:
            break
        gone += found
        drop = set(found)
        left = [i for i in left if i not in drop]
    return sorted(gone)


def _shared_run(early: np.ndarray, late: np.ndarray, words: np.ndarray, left: list[int], min_words: int) -> list[int]:
    """Lines of one run that ``early`` and the lines ``left`` of ``late`` share."""
    size = dict(zip(late.tolist(), words.tolist()))
    own = np.array([size.get(h, min_words) for h in early.tolist()], np.int64)
    at = {int(k): int(i) for i, _, k in zip(*(x[::-1] for x in minimal_runs(early.view(np.uint64), own, min_words)))}
    cuts = [0, *(k for k in range(1, len(left)) if left[k] != left[k - 1] + 1), len(left)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        lines = np.array(left[a:b], np.int64)
        for i, j, key in zip(*minimal_runs(late[lines].view(np.uint64), words[lines].astype(np.int64), min_words)):
            if int(key) in at:
                e = at[int(key)] + int(j - i)
                while j < len(lines) and e < len(early) and late[lines[j]] == early[e]:
                    j, e = j + 1, e + 1
                return lines[i:j].tolist()
    return []


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, version, text)`` of the rows that can overlap; ``version`` tells rows of one id apart by their text."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), text.alias("text")).where("id is not null and text is not null")


def _line_tables(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    def run(batch):
        tables = line_table(batch.column(2))
        keys = [run_keys(h, w, min_words).view(np.int64) for h, w in tables]
        yield [batch.column(0), batch.column(1), [h.view(np.int64) for h, _ in tables], [w.astype(np.int32) for _, w in tables], keys]

    kind = docs.schema[id_col].dataType.simpleString()
    rows = _named(docs, id_col, text_col)
    return stage(map_texts(rows, run, f"id {kind}, version bigint, lines array<bigint>, words array<int>, keys array<bigint>"), "lines")


def word_hashes(column) -> list[np.ndarray]:
    """Hashes of each text's words, in lower case."""
    raw, off = buffer_of(column)
    out = []
    for i, j in steps(off):
        w = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i], SPACE)
        out += [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
    return out


def common_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, version, passages array<bigint>)``: hashes of the runs of ``PASSAGE``
    words that an earlier document has too, for documents that have some."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _named(docs, id_col, text_col)

    def sample(batch):
        yield [batch.column(0), batch.column(1), [np.unique(samples(h)[1]).view(np.int64) for h in word_hashes(batch.column(2))]]

    sampled = stage(map_texts(rows, sample, f"id {kind}, version bigint, keys array<bigint>"), "samples")
    keys = sampled.select("id", "version", F.explode("keys").alias("key"))
    owned = stage(_owners(keys), "sample-owners")
    shared = spread_join(keys, owned.select("key"), "key", owned, hashed=True).groupBy("id", "version").agg(F.collect_set("key").alias("shared"))
    shared = stage(shared, "shared-samples")
    names = shared.select(F.col("id").alias("own_id"), F.col("version").alias("own"), "shared").hint("shuffle_hash")
    texts = rows.join(names, (F.col("id") == F.col("own_id")) & (F.col("version") == F.col("own"))).select("id", "version", "text", "shared")

    def around(batch):
        known = (np.asarray(s.values).view(np.uint64) for s in batch.column(3))
        yield [batch.column(0), batch.column(1), [passage_keys(h, s).view(np.int64) for h, s in zip(word_hashes(batch.column(2)), known)]]

    found = stage(map_texts(texts, around, f"id {kind}, version bigint, keys array<bigint>"), "passages")
    runs = found.select("id", "version", F.explode("keys").alias("key"))
    owners = stage(_owners(runs), "passage-owners")
    late = spread_join(runs, owners.drop("n"), "key", owners, hashed=True).where("early < id")
    out = stage(late.groupBy("id", "version").agg(F.collect_set("key").alias("passages")), "passage-cuts")
    drop_stage(sampled, owned, shared, found, owners)
    return out


def _owners(keys: DataFrame) -> DataFrame:
    """(key, early, n) of the keys that several documents hold: the first of
    these, and the key's rows."""
    several = keys.groupBy("key").agg(F.min("id").alias("early"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    return several.where("early < last").select("key", "early", "n")


def overlapping_pairs(tables: DataFrame) -> DataFrame:
    """Distinct (early, late): each key's first document and each later one."""
    keys = tables.select("id", F.explode("keys").alias("key"))
    owners = stage(_owners(keys), "line-owners")
    later = spread_join(keys, owners.drop("n"), "key", owners, hashed=True).where("early < id")
    out = stage(later.select("early", F.col("id").alias("late")).distinct(), "line-pairs")
    drop_stage(owners)
    return out


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, version, cut array<int>)``: indexes of the lines to delete, for documents that have some."""
    kind = docs.schema[id_col].dataType.simpleString()
    tables = _line_tables(docs, id_col, text_col, min_words)
    pairs = overlapping_pairs(tables)
    own = tables.select("id", "version", "lines", "words")
    early = own.select(F.col("id").alias("early"), F.col("lines").alias("early_lines"))
    late = own.select(F.col("id").alias("late"), "version", "lines", "words")
    partners = pairs.groupBy("early").agg(F.count(F.lit(1)).alias("n"))
    # an early document of many partners is sent to several tasks
    both = spread_join(pairs.join(late, "late"), early, "early", partners).select("late", "version", "early_lines", "lines", "words")

    def run(batch):
        ids, cuts = [], []
        e, l, w = batch.column(2), batch.column(3), batch.column(4)
        for k in range(batch.num_rows):
            cut = common_blocks(*(np.asarray(x[k].values) for x in (e, l, w)), min_words)
            if cut:
                ids.append(k)
                cuts.append(cut)
        take = pa.array(ids, pa.int64())
        yield [batch.column(0).take(take), batch.column(1).take(take), cuts]

    found = map_texts(both, run, f"id {kind}, version bigint, cut array<int>")
    merged = found.groupBy("id", "version").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("cut")))).alias("cut"))
    out = stage(merged, "line-cuts")
    drop_stage(pairs, tables)
    return out


def remove_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, drop_emptied: bool = False, inside_lines: bool = False) -> DataFrame:
    """Documents without the blocks that an earlier document has.

    Columns are those of ``docs`` with the text shortened, and ``lines_cut``
    and ``words_cut``; columns of these names give way. Null texts stay null and
    rows with a null id stay whole. Rows of one id aren't compared with each
    other, and each loses only what an earlier document has of its own text.
    ``drop_emptied``: leave out rows of which nothing is left. ``inside_lines``:
    cut every run of ``PASSAGE`` words that an earlier document has as well, also
    out of lines and sentences of which the rest stays.
    """
    none = F.array().cast("array<bigint>")
    cuts = duplicate_lines(docs, id_col, text_col, min_words).withColumn("passages", none)
    if inside_lines:
        both = cuts.unionByName(common_passages(docs, id_col, text_col).withColumn("cut", none.cast("array<int>")))
        cuts = both.groupBy("id", "version").agg(F.flatten(F.collect_list("cut")).alias("cut"), F.flatten(F.collect_list("passages")).alias("passages"))
    keep = [c for c in docs.columns if c not in ("lines_cut", "words_cut")]
    base = docs.select(*[F.col(c) for c in keep])
    # the same way at every size: texts are shuffled once, not sorted, to the lists of cut lines
    small = cuts.select(F.col("id").alias("__cut_id"), F.col("version").alias("__version"), F.col("cut").alias("__cut"), F.col("passages").alias("__passages")).hint("shuffle_hash")
    same = (base[id_col] == small["__cut_id"]) & (F.xxhash64(base[text_col]) == small["__version"])
    joined = base.join(small, same, "left").drop("__cut_id", "__version")
    at = keep.index(text_col)

    def run(batch):
        column, cut, passages = batch.column(at), batch.column(len(keep)), batch.column(len(keep) + 1)
        rows = np.flatnonzero(cut.is_valid().to_numpy(zero_copy_only=False) & column.is_valid().to_numpy(zero_copy_only=False))
        lines_cut, words_cut = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        texts = []
        own = column.take(pa.array(rows))
        for k, (text, (_, words)) in enumerate(zip(own, line_table(own))):
            runs = np.asarray(passages[rows[k]].values).view(np.uint64)
            first = np.flatnonzero(np.isin(word_runs(word_hashes(own.slice(k, 1))[0], PASSAGE), runs)) if len(runs) else np.zeros(0, np.int64)
            new_text, lines_cut[rows[k]], words_cut[rows[k]] = shortened(text.as_py(), words, np.asarray(cut[rows[k]].values), first)
            texts.append(new_text)
        mask = np.zeros(batch.num_rows, bool)
        mask[rows] = True
        new = pc.replace_with_mask(column, pa.array(mask), pa.array(texts, column.type))
        columns = [new if c == at else batch.column(c) for c in range(len(keep))]
        out = [*columns, pa.array(lines_cut), pa.array(words_cut)]
        if drop_emptied:
            left = pa.array(np.array([k for k in range(batch.num_rows) if not (mask[k] and not new[k].as_py().strip())], np.int64))
            out = [c.take(left) for c in out]
        yield out

    kinds = T.StructType([*(base.schema[c] for c in keep), T.StructField("lines_cut", T.LongType()), T.StructField("words_cut", T.LongType())])
    return map_texts(joined, run, kinds)


def shortened(text: str, words: np.ndarray, gone: np.ndarray, passages: np.ndarray) -> tuple[str, int, int]:
    """A text without the lines ``gone`` and the passages that begin at the words
    ``passages``, and how many lines and words that are.

    ``words``: those of each line. Each kept line has the break before it, but
    the first. Of the gaps about a passage inside of a line one stays.
    """
    raw = text.encode("utf-8")
    part = np.frombuffer(raw, np.uint8)
    edge = np.zeros(int(words.sum()) + 1, np.int64)
    np.add.at(edge, passages, 1)
    np.add.at(edge, passages + PASSAGE, -1)
    inside = np.cumsum(edge)[:-1] > 0
    ends = np.cumsum(words)
    covered = np.concatenate([[0], np.cumsum(inside)])
    out = (words > 0) & (covered[ends] - covered[ends - words] == words)
    out[gone] = True
    lost = inside | np.repeat(out, words)
    breaks = breaks_of(part)
    starts, stops = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(raw)]])
    keep = np.ones(len(raw), bool)
    stay = np.flatnonzero(~out)
    for k in np.flatnonzero(out):
        keep[max(starts[k] - 1, 0) : stops[k]] = False
    if len(stay):
        keep[: starts[stay[0]]] = False
    if inside.any():
        w = Words(part, np.array([0, len(raw)]), SPACE, hashed=False)
        line = np.repeat(np.arange(len(words)), words)
        heads = ends - words
        part_of = inside & ~out[line]  # passages' words in lines that stay
        for a in np.flatnonzero(part_of & ~np.concatenate([[False], part_of[:-1] & (line[1:] == line[:-1])])):
            b = a
            while b < ends[line[a]] and part_of[b]:
                b += 1
            if b < ends[line[a]]:  # with the gap after it, else with that before it
                keep[w.start[a] : w.start[b]] = False
            else:
                keep[(w.start[a - 1] + w.length[a - 1] if a > heads[line[a]] else w.start[a]) : w.start[b - 1] + w.length[b - 1]] = False
    return part[keep].tobytes().decode("utf-8"), int(out.sum()), int(lost.sum())
