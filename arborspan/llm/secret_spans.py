"""Secret scan by token efficiency (operator 5).

Three fixed patterns give the base spans. Beyond them, a long unbroken string
whose characters per token, under a rank-file vocabulary, are few is taken for
a random string; digests of known lengths, UUIDs, dotted or path-like names
and plain identifiers are left out. What a base span leaves of a string is
tested by itself, and where a string as a whole reads like words, so are its
parts between separators. Every pattern takes time in proportion to the text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_texts

#: The base patterns, in the order in which equal starts are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")

#: The hex pattern's runs that are long enough, found at once.
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
#: Left out: hex digests by length, UUIDs, and words joined by a separator.
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_PART = re.compile(r"[A-Za-z]*[0-9]{0,4}")
_SEPARATORS = re.compile(r"[_/+=-]+")
_EDGE = "=-_/+"

#: A string with fewer characters per token than this is random; one of fewer
#: characters than this isn't looked at.
MIN_RATIO, MIN_LENGTH = 2.0, 20
#: Characters that are encoded at once: the tokens of a longer string are summed.
CHUNK = 2048


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def is_identifier(s: str) -> bool:
    """A digest of a known length, a UUID, or letters and short numbers joined by separators."""
    return bool(_DIGEST.fullmatch(s) or _UUID.fullmatch(s)) or all(map(_PART.fullmatch, _SEPARATORS.split(s)))


def characters_per_token(s: str, path: str | None = None) -> float:
    tokens = encoding(path or default_path()).encode_ordinary
    return len(s) / max(1, sum(len(tokens(s[i : i + CHUNK])) for i in range(0, len(s), CHUNK)))


def _random(text: str, start: int, end: int, min_ratio: float, path: str | None) -> tuple[int, int] | None:
    """The random string that ``text[start:end]`` is without separators around it."""
    bare = text[start:end].lstrip(_EDGE)
    start, bare = end - len(bare), bare.rstrip(_EDGE)
    if len(bare) < MIN_LENGTH or not (re.search("[0-9]", bare) and re.search("[A-Za-z]", bare)) or is_identifier(bare):
        return None
    return (start, start + len(bare)) if characters_per_token(bare, path) < min_ratio else None


def _outside(start: int, end: int, taken: list[tuple[int, int]], starts: list[int]):
    """The parts of ``start..end`` that the sorted, disjoint ranges ``taken`` leave."""
    k = max(bisect_right(starts, start) - 1, 0)
    while k < len(taken) and taken[k][0] < end:
        a, b = taken[k]
        if start < a:
            yield start, a
        start, k = max(start, b), k + 1
    if start < end:
        yield start, end


def find_spans(text: str, min_ratio: float = MIN_RATIO, path: str | None = None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of a text, ordered by start and then kind."""
    found = []
    if ("=" in text or ":" in text) and _KEYWORD.search(text):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in _LONG_HEX.finditer(text)]
    taken: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in found):
        taken[-1:] = [(taken[-1][0], max(taken[-1][1], b))] if taken and a <= taken[-1][1] else [*taken[-1:], (a, b)]
    starts = [a for a, _ in taken]
    for m in _CANDIDATE.finditer(text):
        for start, end in _outside(m.start(), m.end(), taken, starts):
            hit = _random(text, start, end, min_ratio, path)
            if hit:
                found.append(("random", *hit))
                continue
            for gap in _SEPARATORS.finditer(text, start, end):
                part = _random(text, start, gap.start(), min_ratio, path) if gap.start() - start >= MIN_LENGTH else None
                found += [("random", *part)] if part else []
                start = gap.end()
            part = _random(text, start, end, min_ratio, path) if end - start >= MIN_LENGTH else None
            found += [("random", *part)] if part else []
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_ratio: float = MIN_RATIO, path: str | None = None) -> DataFrame:
    """Per row: id and ``spans``, an array of (kind, start, end) in code points.

    A base span is the whole match of its pattern. Null and empty texts have no
    spans; every row gives one row; other columns are ignored. No shuffle.
    """
    import pyarrow as pa

    def run(batch):
        rows = [
            [{"kind": k, "start": a, "end": b} for k, a, b in find_spans(batch.column(1)[i].as_py() or "", min_ratio, path)]
            for i in range(batch.num_rows)
        ]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield [batch.column(0), pa.array(rows, kind)]

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(rows, run, f"{id_col} {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
