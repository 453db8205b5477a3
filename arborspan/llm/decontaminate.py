"""Benchmark decontamination with a generalised suffix automaton (operator 10).

One automaton holds every substring of the normalised test items. Document
words are streamed through it; at each word the longest matching length is
tracked, and where it reaches a window's length the words of that window are
hit. A word that no item holds sends the automaton to its root, so only runs of
known words are walked; the rest of a text is passed over in numpy. States are
entries of arrays, some 40 bytes a word of the items in all: nearly every state
has one way on, and only those with several have a dictionary.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM, Words, buffer_of, map_texts, stage, steps

#: Words of a window, and UTF-8 bytes of item text that one automaton is built of.
WINDOW = 13
SHARD_BYTES = 4 << 20


class Automaton:
    """Suffix automaton of the items' word sequences with the windows' items.

    ``only[v]`` and ``onward[v]``: the word and the state that follow state ``v``;
    ``BRANCHED`` marks a state whose ways on are in ``ways[v]``.
    """

    NONE, BRANCHED = -1, -2

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window = window
        raw, off = buffer_of(pa.array([t for _, t in items], pa.large_string()))
        w = Words(raw, off, ALNUM)
        self.vocabulary, ids = np.unique(w.hash, return_inverse=True)
        self._seen = np.zeros(1 << 18, bool)
        self._seen[(self.vocabulary >> np.uint64(46)).astype(np.int64)] = True
        self.names = [name for name, _ in items]
        size = np.diff(w.first)
        self.shortest = int(min([window, *size[size > 0].tolist()]))
        self.only, self.onward, self.ways = array("i", [self.NONE]), array("i", [0]), {}
        self.link, self.longest = array("i", [-1]), array("i", [0])
        ended, ending = array("i"), array("i")  # states that a window of an item ends in, and the items
        whole: list[tuple[int, int, int]] = []
        for k in np.flatnonzero(size).tolist():
            last = 0
            for at, c in enumerate(ids[w.first[k] : w.first[k + 1]].tolist(), 1):
                last = self._extend(last, c)
                if at >= window:
                    ended.append(last)
                    ending.append(k)
            if size[k] < window:
                whole.append((last, int(size[k]), k))
        link, longest = np.array(self.link, np.int64), np.array(self.longest, np.int64)
        # the ancestor that holds the suffix of a window's length
        at_window = np.where(longest >= window, np.arange(len(link)), -1)
        while True:
            up = link[at_window]
            move = (at_window >= 0) & (longest[up] >= window)
            if not move.any():
                break
            at_window[move] = up[move]
        self.at_window = array("i", at_window.astype(np.int32).tobytes())
        # items by window: most have one
        pair = np.unique(np.stack([at_window[np.array(ended, np.int64)], np.array(ending, np.int64)], 1), axis=0)
        held, first, many = np.unique(pair[:, 0], return_index=True, return_counts=True)
        one = np.full(len(link), -1, np.int32)
        one[held] = pair[first, 1]
        self.item = array("i", one.tobytes())
        self.more = {int(v): pair[i + 1 : i + n, 1].tolist() for v, i, n in zip(held[many > 1], first[many > 1], many[many > 1])}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for v, k, item in whole:
            while self.link[v] >= 0 and self.longest[self.link[v]] >= k:
                v = self.link[v]
            self.short.setdefault(v, []).append((k, item))
        # the nearest suffix state that ends a short item, itself included
        self.ends_short = None
        if self.short:
            near = np.zeros(len(link), np.int64)
            own = np.fromiter(self.short, np.int64)
            near[own] = own
            for v in np.argsort(longest, kind="stable")[1:].tolist():
                if not near[v]:
                    near[v] = near[link[v]]
            self.ends_short = array("i", near.astype(np.int32).tobytes())

    def _step(self, v: int, c: int) -> int:
        """The state after ``v`` and the word ``c``; -1 if there is none."""
        if self.only[v] == c:
            return self.onward[v]
        return self.ways[v].get(c, -1) if self.only[v] == self.BRANCHED else -1

    def _lead(self, v: int, c: int, to: int) -> None:
        if self.only[v] in (self.NONE, c):
            self.only[v], self.onward[v] = c, to
        else:
            if self.only[v] != self.BRANCHED:
                self.ways[v] = {self.only[v]: self.onward[v]}
                self.only[v] = self.BRANCHED
            self.ways[v][c] = to

    def _extend(self, last: int, c: int) -> int:
        known = self._step(last, c)
        if known >= 0:
            return known if self.longest[known] == self.longest[last] + 1 else self._split(last, c, known)
        now = self._state(self.longest[last] + 1)
        p = last
        while p >= 0 and self._step(p, c) < 0:
            self._lead(p, c, now)
            p = self.link[p]
        if p < 0:
            self.link[now] = 0
        else:
            q = self._step(p, c)
            self.link[now] = q if self.longest[q] == self.longest[p] + 1 else self._split(p, c, q)
        return now

    def _state(self, length: int) -> int:
        self.only.append(self.NONE)
        self.onward.append(0)
        self.link.append(-1)
        self.longest.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.longest[p] + 1)
        self.only[twin], self.onward[twin] = self.only[q], self.onward[q]
        if self.only[q] == self.BRANCHED:
            self.ways[twin] = dict(self.ways[q])
        self.link[twin] = self.link[q]
        self.link[q] = twin
        while p >= 0 and self._step(p, c) == q:
            self._lead(p, c, twin)
            p = self.link[p]
        return twin

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary index of each word, -1 if no item holds it."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self._seen[(hashes >> np.uint64(46)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            ok = self.vocabulary[at] == hashes[maybe]
            out[maybe[ok]] = at[ok]
        return out

    def walk(self, ids: list[int], first: int, hits: list[tuple[int, int]], found: set[int]) -> None:
        """Stream a run of known words; note hit word ranges and items."""
        only, onward, ways, link, longest, window = self.only, self.onward, self.ways, self.link, self.longest, self.window
        at_window, one, more, ends_short = self.at_window, self.item, self.more, self.ends_short
        branched = self.BRANCHED
        v = length = 0
        for i, c in enumerate(ids, first + 1):
            while True:
                word = only[v]
                to = onward[v] if word == c else ways[v].get(c, -1) if word == branched else -1
                if to >= 0 or not v:
                    break
                v = link[v]
                length = longest[v]
            if to < 0:
                continue
            v, length = to, length + 1
            if length >= window:
                held = at_window[v]
                if one[held] >= 0:
                    hits.append((i - window, i))
                    found.add(one[held])
                    if held in more:
                        found.update(more[held])
            if ends_short:
                at = ends_short[v]
                while at:
                    for k, item in self.short[at]:
                        if k <= length:
                            hits.append((i - k, i))
                            found.add(item)
                    at = ends_short[link[at]]

    def scan(self, column):
        """Per text: words, byte ranges of the words, hit word ranges (joined), items."""
        raw, off = buffer_of(column)
        for i, j in steps(off):
            w = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM)
            ids = self.ids(w.hash)
            n = len(ids)
            brk = np.zeros(n + 1, bool)
            brk[w.first] = True
            known = ids >= 0
            head = np.flatnonzero(known & (brk[:n] | ~np.concatenate([[False], known[:-1]])))
            stop = np.flatnonzero(known & (brk[1 : n + 1] | ~np.concatenate([known[1:], [False]]))) + 1
            long = stop - head >= self.shortest
            head, stop = head[long], stop[long]
            doc = np.searchsorted(w.first, head, side="right") - 1
            by_doc: dict[int, list[tuple[int, int]]] = {}
            for d, a, b in zip(doc.tolist(), head.tolist(), stop.tolist()):
                by_doc.setdefault(d, []).append((a, b))
            for d in range(j - i):
                base, hits, found = int(w.first[d]), [], set()
                for a, b in by_doc.get(d, ()):
                    self.walk(ids[a:b].tolist(), a - base, hits, found)
                yield int(w.first[d + 1]) - base, (w, base, int(off[i]), int(off[i + d])), joined(hits), {self.names[k] for k in found}


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@lru_cache(maxsize=1)
def _automaton(items: tuple[tuple[str, str], ...], window: int) -> Automaton:
    return Automaton(list(items), window)


def item_shards(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES):
    """Item texts in shards whose bytes are within ``shard_bytes`` each (a larger
    single item is a shard), one at a time on the driver."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    count = 1 if total <= shard_bytes else 2 * -(-total // shard_bytes)
    for k in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(count)) == k)
        yield tuple((r["item"], r["text"]) for r in part.orderBy("item", "text").collect())


def find_benchmark_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: id, ``n_words``, ``spans`` (hit word ranges, joined), ``items``.

    Items of fewer words than ``window`` are one window each; null and empty
    items and texts hold nothing. One pass without a shuffle for each shard of
    items; with several shards the rows are joined with their spans by a row
    key, so repeated ids stay apart. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shards = item_shards(benchmark, shard_bytes=shard_bytes) if benchmark is not None else iter([()])
    first, second = next(shards), next(shards, None)
    if second is None:
        return map_texts(rows, _scanner(rows, first, window), f"{id_col} {kind}, {_FOUND}")
    keyed = stage(rows.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    found = _over_shards(_of_each_shard(keyed, chain([first, second], shards), window)).select(F.col("row").alias("hit_row"), "spans", "items")
    both = keyed.join(found, F.col("row") == F.col("hit_row"), "left").select("id", "text", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))

    def counted(batch):
        raw, off = buffer_of(batch.column(1))
        n = np.concatenate([np.diff(Words(raw[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM, hashed=False).first) for i, j in steps(off)])
        yield [batch.column(0), n, *batch.columns[2:]]

    return map_texts(both, counted, f"{id_col} {kind}, {_FOUND}")


_SPANS = "array<struct<start:bigint,end:bigint>>"
_FOUND = f"n_words bigint, spans {_SPANS}, items array<string>"
_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scanner(rows: DataFrame, shard, window: int):
    """Function of a batch ``(key, text)``: key, words, spans and items of one shard."""
    held = rows.sparkSession.sparkContext.broadcast(shard)

    def run(batch):
        n, spans, items = [], [], []
        for words, _, hits, found in _automaton(held.value, window).scan(batch.column(1)):
            n.append(words)
            spans.append([{"start": a, "end": b} for a, b in hits])
            items.append(sorted(found))
        yield [batch.column(0), n, pa.array(spans, _RANGES), items]

    return run


def _of_each_shard(keyed: DataFrame, shards, window: int) -> DataFrame:
    """Findings of every shard for ``keyed (row, text)``, written shard by shard:
    only the rows that it hits, and never more than one shard on the driver."""
    parts = None
    for shard in shards:
        own = stage(map_texts(keyed.select("row", "text"), _scanner(keyed, shard, window), f"row bigint, {_FOUND}").where("size(spans) > 0"), "shard")
        parts = own if parts is None else parts.unionByName(own)
    return parts


def _over_shards(parts: DataFrame) -> DataFrame:
    """One row for each ``row``, with the spans of all shards joined."""
    merged = parts.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def join_up(batch):
        spans = [[{"start": a, "end": b} for a, b in joined([(s["start"], s["end"]) for s in x])] for x in batch.column(1).to_pylist()]
        yield [batch.column(0), pa.array(spans, _RANGES), batch.column(2)]

    return map_texts(merged, join_up, f"row bigint, spans {_SPANS}, items array<string>")


def items_digest(items) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, min_coverage: float = 0.05, drop_coverage: float | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Documents with benchmark spans cut out of their text.

    Spans go from texts whose hit words are at least ``min_coverage`` of all
    words; rows at or beyond ``drop_coverage`` go altogether. Other rows, null
    texts among them, stay as they are. Columns are those of ``docs``. The words
    hit by items of any shard count together: one shard takes one pass without a
    shuffle, with several the rows are joined with their spans by a row key.
    """
    names = docs.columns
    at = names.index(text_col)
    shards = item_shards(benchmark, shard_bytes=shard_bytes)
    first, second = next(shards), next(shards, None)

    def cut(batch, found):
        """``found``: per text its words, their byte ranges and the hit word ranges."""
        texts, stay = [], []
        column = batch.column(at)
        raw = buffer_of(column)[0]
        for k, (n, (w, base, chunk, start), hits) in enumerate(found(batch, column)):
            hit = sum(b - a for a, b in hits)
            share = hit / n if n else 0.0
            text = column[k].as_py()
            if hit and share >= min_coverage:
                if drop_coverage is not None and share >= drop_coverage:
                    continue
                pieces, last = [], start
                for a, b in hits:
                    pieces.append(raw[last : chunk + int(w.start[base + a])].tobytes())
                    last = chunk + int(w.end[base + b - 1])
                pieces.append(raw[last : start + len(text.encode("utf-8"))].tobytes())
                text = b"".join(pieces).decode("utf-8")
            texts.append(text)
            stay.append(k)
        kept = batch.take(pa.array(stay, pa.int64()))
        yield [pa.array(texts, pa.string()) if c == at else kept.column(c) for c in range(len(names))]

    if second is None:
        held = docs.sparkSession.sparkContext.broadcast(first)

        def scanned(batch, column):
            return ((n, place, hits) for n, place, hits, _ in _automaton(held.value, window).scan(column))

        return map_texts(docs, lambda batch: cut(batch, scanned), docs.schema)
    keyed = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "decontaminate")
    texts = keyed.select(F.col("__row").alias("row"), F.col(text_col).alias("text"))
    parts = _of_each_shard(texts, chain([first, second], shards), window)
    spans = _over_shards(parts).select(F.col("row").alias("__row"), F.col("spans").alias("__spans"))
    rows = keyed.join(spans, "__row", "left").select(*[F.col(f"`{c}`") for c in names], "__spans")

    def merged(batch, column):
        raw, off = buffer_of(column)
        for k, hits in enumerate(batch.column(len(names)).to_pylist()):
            w = Words(raw[off[k] : off[k + 1]], off[k : k + 2] - off[k], ALNUM, hashed=False) if hits else None
            yield len(w.start) if w else 0, (w, 0, int(off[k]), int(off[k])), [(s["start"], s["end"]) for s in hits or ()]

    return map_texts(rows, lambda batch: cut(batch, merged), docs.schema)
