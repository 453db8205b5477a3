"""Token counts by a prefix table (operator 8).

Text is parted into pieces by the vocabulary's own pattern. For a piece, a
dynamic programme finds the last token of the encoding of *every* prefix: among
the vocabulary's tokens that end there, it is the one that byte-pair merging
would leave beside the last token of the rest. Counts follow by
``count[i] = count[i - len(last[i])] + 1``. Tables of pieces that come again are
kept. A text's own table strings them together: the exact count at every byte,
from which its count, its longest prefix within a budget and the count of any
prefix are read off, and nothing is encoded again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import buffer_of, map_texts

#: Tables of pieces in one generation of a worker's cache. A full generation
#: becomes the old one, from which pieces that come again are taken over. Pieces
#: of more characters are not kept.
KEPT_PIECES, KEPT_LENGTH = 500_000, 64
#: Pairs of tokens whose seam a worker remembers.
KEPT_PAIRS = 400_000


def _byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary file writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _classes() -> tuple[str, str]:
    """Letters and numbers as ranges of a character class."""
    out = []
    for kind in "LN":
        runs, start = [], None
        for c in range(0x110001):
            is_in = c < 0x110000 and unicodedata.category(chr(c))[0] == kind
            if is_in and start is None:
                start = c
            elif not is_in and start is not None:
                runs.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
        out.append("".join(runs))
    return out[0], out[1]


#: Unicode's white space.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@lru_cache(maxsize=2)
def piece_pattern():
    """The pattern of byte-level pieces, with Unicode's classes written out."""
    letter, number = _classes()
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{WHITE}{letter}{number}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
    )


class PrefixCounter:
    """Exact token counts at every prefix for a byte-level BPE vocabulary file.

    ``path``: a vocabulary in the JSON form with ``model.vocab`` and
    ``model.merges``. Strings of its added tokens count as one token each.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.rank = {}  # pair of token byte strings -> merge rank
        self.parts = {}  # token -> (rank, left, right) of the merge that made it
        for r, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            self.rank[a, b] = r
            self.parts.setdefault(a + b, (r, a, b))
        self.vocab = {raw(t) for t in spec["model"]["vocab"] if t not in self.added}
        self.vocab = {t for t in self.vocab if len(t) == 1 or t in self.parts}
        # lengths of the tokens, longest first, that end in some three bytes; shorter tokens come last
        lengths: dict[bytes, set[int]] = {}
        for t in self.vocab:
            if len(t) > 2:
                lengths.setdefault(t[-3:], set()).add(len(t))
        self.lengths = {end: (*sorted(own, reverse=True), 2, 1) for end, own in lengths.items()}
        self._pair: dict = {}
        self._tables: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def _stays(self, a: bytes, b: bytes) -> bool:
        """Whether ``a`` and ``b`` stay two tokens when their bytes are merged
        in order of rank: no merge across the seam comes before the merges
        that make ``a`` and ``b`` themselves."""
        left, right, cap, out = a, b, len(self.rank) + 1, True
        while True:
            across = self.rank.get((left, right))
            if across is not None and across < cap:
                out = False
                break
            la, lb = self.parts.get(left), self.parts.get(right)
            ra, rb = la[0] if la else -1, lb[0] if lb else -1
            if ra < 0 and rb < 0:
                break
            # undo the later of the two merges; an across-merge must then come before it
            if ra > rb:
                left, cap = la[2], ra
            else:
                right, cap = lb[1], rb + 1
        if len(self._pair) >= KEPT_PAIRS:
            self._pair.clear()
        self._pair[a, b] = out
        return out

    def table(self, piece: bytes) -> list[int]:
        """Tokens of each prefix of a piece, the empty one first."""
        vocab, stays, known, lengths = self.vocab, self._stays, self._pair, self.lengths
        count, last = [0], [b""]
        for end in range(1, len(piece) + 1):
            for size in lengths.get(piece[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                start = end - size
                if start < 0:
                    continue
                token = piece[start:end]
                if token in vocab:
                    if not start:
                        break
                    pair = last[start], token
                    fits = known.get(pair)
                    if stays(*pair) if fits is None else fits:
                        break
            count.append(count[start] + 1)
            last.append(token)
        return count

    def piece_table(self, piece: str) -> bytes:
        """Tokens at each byte of a piece, as 32-bit numbers."""
        found = self._tables.get(piece)
        if found is None:
            found = self._old.get(piece)
            if found is None:
                found = array("I", self.table(piece.encode("utf-8"))[1:]).tobytes()
            if len(piece) > KEPT_LENGTH:
                return found
            if len(self._tables) >= KEPT_PIECES:
                self._old = dict(self._tables)
                self._tables.clear()
            self._tables[piece] = found
        return found

    def _segments(self, text: str):
        """(is an added token, string) parts of a text in order: the leftmost
        added token first, of those the longest."""
        at = 0
        for m in self._special.finditer(text) if self._special else ():
            if m.start() > at:
                yield False, text[at : m.start()]
            yield True, m[0]
            at = m.end()
        if at < len(text):
            yield False, text[at:]

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens at every byte of a text. Inside an added token it is one token."""
        tables: list[bytes] = []
        known, one = self._tables, self.piece_table
        for special, part in self._segments(text):
            if special:
                tables.append(np.ones(len(part.encode("utf-8")), np.uint32).tobytes())
                continue
            pieces = piece_pattern().findall(part)
            found = list(map(known.get, pieces))
            if None in found:
                found = [one(p) if t is None else t for p, t in zip(pieces, found)]
            tables += found
        if not tables:
            return np.zeros(0, np.int64)
        inside = np.frombuffer(b"".join(tables), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, tables), np.int64, len(tables)) >> 2
        ends = np.cumsum(size)
        before = np.cumsum(inside[ends - 1])
        before = np.concatenate([[0], before[:-1]])
        return inside + np.repeat(before, size)

    def count(self, text: str) -> int:
        at = self.prefix_counts(text)
        return int(at[-1]) if len(at) else 0

    def measure(self, raw: bytes, limit: int) -> tuple[int, int]:
        """Tokens of a whole text, and code points of its longest prefix, cut
        between characters, that has at most ``limit`` tokens."""
        at = self.prefix_counts(raw.decode("utf-8"))
        total = int(at[-1]) if len(at) else 0
        heads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        if total <= limit:
            return total, int(heads.sum())
        whole = np.append(heads[1:], True)  # a character ends at this byte
        fits = np.flatnonzero(whole & (at <= limit))
        return total, int(whole[: fits[-1] + 1].sum()) if len(fits) else 0


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, path: str | None = None) -> DataFrame:
    """Per row: id, UTF-8 bytes, exact tokens, whether they exceed ``limit`` and
    the code points of the longest prefix within it.

    Null text counts as empty (0 tokens); every row gives one row, repeated ids
    too; other columns are ignored. ``path`` defaults, on each worker, to the
    installed public vocabulary. No shuffle.
    """

    def run(batch):
        tokens = counter(path or default_path())
        raw, off = buffer_of(batch.column(1))
        sizes = np.diff(off)
        counts, cuts = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for i in range(len(sizes)):
            counts[i], cuts[i] = tokens.measure(raw[off[i] : off[i + 1]].tobytes(), limit)
        yield [batch.column(0), sizes, counts, pa.array(counts > limit), cuts]

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(rows, run, f"{id_col} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, limit_chars bigint")
