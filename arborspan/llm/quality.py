"""Quality by Bradley-Terry ranking (operator 7).

A text's score is linear in its statistics. Pairs of a preferred and a rejected
text give logistic loss on the difference of their statistics; the threshold is
the quantile of the scores of all training rows at which their rejected share
lies. Only the weights are fitted on a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import CASED_SPACE, Words, bounded, buffer_of, drop_stage, map_texts, shingles, stage, steps

#: Bounds of the sample that a model is fitted on: rows of each label, and pairs.
MAX_ROWS, MAX_PAIRS = 4000, 40_000
#: Words in a window, for the statistics of a text's worst part.
WINDOW = 16

_B = np.arange(256)
_UPPER = ((_B >= 65) & (_B <= 90)).astype(np.float64)
_LETTER = (((_B | 32) >= 97) & ((_B | 32) <= 122) | (_B >= 128)).astype(np.float64)
_DIGIT = ((_B >= 48) & (_B <= 57)).astype(np.float64)
_STOP = np.isin(_B, [ord(c) for c in ".,;:'\"()-?"]).astype(np.float64)
_MARK = ((_B > 32) & (_B < 127)) * (1 - _LETTER) * (1 - _DIGIT) * (1 - _STOP)

NAMES = (
    "log_words", "word_length", "word_spread", "upper", "marks", "digits", "stops", "marked_words", "upper_words", "lone_marks",
    "distinct_words", "repeated_runs", "repeated_lines", "line_words", "worst_marks", "worst_upper", "worst_length", "marked_windows", "upper_windows",
)


def statistics(column) -> np.ndarray:
    """One row of ``NAMES`` for each text; zeros for a text without words."""
    raw, off = buffer_of(column)
    out = np.zeros((len(off) - 1, len(NAMES)))
    for i, j in steps(off):
        part, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        w = Words(part, o, CASED_SPACE)
        if not len(w.start):
            continue
        at = np.arange(i, j)
        n = np.diff(w.first)
        has = n > 0
        bounds = np.empty(2 * len(w.start), np.int64)
        bounds[0::2], bounds[1::2] = w.start, w.end

        def per_word(table):
            return np.diff(np.concatenate([[0.0], np.cumsum(table[part])])[bounds])[0::2]

        length = w.length.astype(np.float64)
        upper, mark, digit, stop = (per_word(t) for t in (_UPPER, _MARK, _DIGIT, _STOP))
        letter = per_word(_LETTER)

        def per_doc(x):
            return np.diff(np.concatenate([[0.0], np.cumsum(x)])[w.first])

        size = np.maximum(per_doc(length), 1)
        f = np.zeros((j - i, len(NAMES)))
        many = np.maximum(n, 1)
        mean = per_doc(length) / many
        f[:, 0] = np.log1p(n)
        f[:, 1] = mean
        f[:, 2] = np.sqrt(np.maximum(per_doc(length**2) / many - mean**2, 0))
        f[:, 3] = per_doc(upper) / size
        f[:, 4] = per_doc(mark) / size
        f[:, 5] = per_doc(digit) / size
        f[:, 6] = per_doc(stop) / size
        marked, shouted, lone = mark > 0, (upper > 1) & (upper >= 0.9 * letter), (mark > 0) & (letter + digit == 0)
        f[:, 7], f[:, 8], f[:, 9] = per_doc(marked) / many, per_doc(shouted) / many, per_doc(lone) / many
        # windows of words inside each text
        pos = np.arange(len(w.start)) - np.repeat(w.first[:-1], n)
        doc = np.repeat(np.arange(j - i), n)
        heads = np.flatnonzero(pos % WINDOW == 0)
        count = np.diff(np.append(heads, len(pos))).astype(np.float64)
        wd = doc[heads]
        m_share, u_share = (np.add.reduceat(x.astype(np.float64), heads) / count for x in (marked, shouted))
        l_mean = np.add.reduceat(length, heads) / count
        for k, x in ((14, m_share), (15, u_share), (16, l_mean)):
            np.maximum.at(f[:, k], wd, np.where(count >= 6, x, 0))
        wins = np.maximum(np.bincount(wd, minlength=j - i), 1)
        f[:, 17] = np.bincount(wd, m_share > 0.5, j - i) / wins
        f[:, 18] = np.bincount(wd, u_share > 0.5, j - i) / wins
        breaks = np.concatenate([[0], np.cumsum(part == 10)])
        lines = breaks[o[1:]] - breaks[o[:-1]] + 1
        f[:, 13] = np.log1p(n / lines)
        for d in np.flatnonzero(has):
            h = w.hash[w.first[d] : w.first[d + 1]]
            f[d, 10] = len(np.unique(h)) / len(h) * min(1.0, 0.35 + len(h) / 2000) if len(h) < 1300 else len(np.unique(h)) / len(h)
            s = shingles(h, 5)
            f[d, 11] = 1 - len(np.unique(s)) / len(s)
            if lines[d] > 1:
                text_lines = bytes(part[o[d] : o[d + 1]]).split(b"\n")
                f[d, 12] = 1 - len(set(text_lines)) / len(text_lines)
        out[at] = f
    return out


class QualityModel:
    """Weights of standardised statistics and the map from margin to score."""

    def __init__(self, mean, scale, weights, cut: float, slope: float):
        self.mean, self.scale, self.weights, self.cut, self.slope = mean, scale, weights, float(cut), float(slope)

    def margins(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -8, 8) @ self.weights

    def scores(self, column, threshold: float) -> np.ndarray:
        """0..1; exactly the margins from the quantile cut on reach ``threshold``."""
        base = np.log(threshold / (1 - threshold))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.margins(statistics(column)) - self.cut) + base, -40, 40)))


def fit_bradley_terry(stats: np.ndarray, good: np.ndarray, pairs: int = MAX_PAIRS, l2: float = 1e-3, rounds: int = 25) -> QualityModel:
    """Fit weights on statistics and 0/1 labels; the cut is left at 0. With one
    label only, no weight is learnt, and all texts are on that label's side."""
    mean, scale = (stats.mean(0), stats.std(0)) if len(stats) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    scale = np.where(scale > 1e-12, scale, 1.0)
    x = np.clip((stats - mean) / scale, -8, 8)
    hi, lo = np.flatnonzero(good == 1), np.flatnonzero(good != 1)
    beta = np.zeros(len(NAMES))
    if not len(hi) or not len(lo):
        return QualityModel(mean, scale, beta, 0.0 if len(hi) or not len(stats) else 1.0, 1.0)
    rng = np.random.default_rng(7)
    d = x[rng.choice(hi, pairs)] - x[rng.choice(lo, pairs)]
    for _ in range(rounds):  # Newton steps on the mean logistic loss of differences
        p = 1 / (1 + np.exp(-np.clip(d @ beta, -40, 40)))
        g = d.T @ (p - 1) / pairs + l2 * beta
        h = (d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(len(beta))
        move = np.linalg.solve(h, g)
        beta -= move * min(1.0, 5 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-7:
            break
    s = x @ beta
    return QualityModel(mean, scale, beta, 0.0, 8.0 / max(s[hi].mean() - s[lo].mean(), 1e-9))


def rejected_quantile(margins: DataFrame) -> float:
    """Of rows ``(y, margin)``: midway between the margins on either side of the
    quantile at which the share of the rows with ``y = 0`` lies."""
    share = margins.agg(F.avg((F.col("y") == 0).cast("double")).alias("share")).first()["share"]
    if share is None:
        return 0.0
    at = margins.agg(F.percentile_approx("margin", F.lit(float(share)), F.lit(100_000)).alias("at")).first()["at"]
    after = margins.where(F.col("margin") > F.lit(at)).agg(F.min("margin").alias("after")).first()["after"]
    return (at + (after if after is not None else at)) / 2


def train_quality(
    docs: DataFrame, labels: DataFrame, trainable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS,
) -> QualityModel:
    """Fit from ``labels (id, 0/1)`` on rows where ``trainable``.

    At most ``max_rows`` rows of each label are drawn for the weights, in the
    order of a hash of the id; the threshold's quantile is that of all rows with
    a label. Null ids, labels and texts are passed over.
    """
    trainable = F.lit(True) if trainable is None else trainable
    known = labels.select(id_col, (F.col(label_col) == 1).cast("int").alias("__y")).where(F.col(id_col).isNotNull() & F.col("__y").isNotNull()).where(trainable)
    rows = known.count()
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit("quality"))
    drawn = known.where("__y = 1").orderBy(order, id_col).limit(max_rows).unionByName(known.where("__y = 0").orderBy(order, id_col).limit(max_rows))
    texts = docs.select(id_col, F.col(text_col).alias("__text")).where("__text is not null")

    def run(batch):
        yield [batch.column(0), pa.array(list(statistics(batch.column(1))), pa.list_(pa.float64()))]

    got = map_texts(texts.join(F.broadcast(drawn), id_col).select("__y", "__text"), run, "y int, stats array<double>").toArrow()
    y = got["y"].to_numpy()
    stats = got["stats"].combine_chunks().values.to_numpy().reshape(-1, len(NAMES)) if len(y) else np.zeros((0, len(NAMES)))
    order = np.lexsort((*stats.T, y))  # the rows' order must not depend on the partitions
    y, stats = y[order], stats[order]
    model = fit_bradley_terry(stats, y)
    if len(np.unique(y)) < 2:
        return model

    def judge(batch):
        yield [batch.column(0), model.margins(statistics(batch.column(1)))]

    margins = stage(map_texts(texts.join(bounded(known, rows), id_col).select("__y", "__text"), judge, "y int, margin double"), "margins")
    model.cut = rejected_quantile(margins)
    drop_stage(margins)
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep_columns: bool = False) -> DataFrame:
    """Per row: id (or, with ``keep_columns``, every column of ``docs``), ``score``
    in 0..1 and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts are scored as texts without words; every row gives one
    row. Without ``keep_columns`` other columns are ignored; with it, columns of
    ``docs`` named score or predicted give way. No shuffle.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")] if keep_columns else [id_col]
    at = names.index(text_col) if keep_columns else 1

    def run(batch):
        s = model.scores(batch.column(at), threshold)
        yield [*(batch.column(k) for k in range(len(names))), s, (s >= threshold).astype(np.int32)]

    rows = docs.select(*names) if keep_columns else docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return map_texts(rows, run, f"{kinds}, score double, predicted int")
