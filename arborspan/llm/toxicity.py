"""Toxicity by non-negative positive-unlabelled learning (operator 4).

Confirmed toxic texts are the positives; any other text is unlabelled. With the
class prior ``pi``, the risk is ``pi*R_P(+) + max(0, R_U(-) - pi*R_P(-))``: the
unlabelled risk is corrected for the toxic share it hides and never counted
below zero. The learner is a numpy logistic model on the presence of words and
of word beginnings, which inflected forms share, once and in several words of a
text. Which of these it weighs follows from their counts in the positives and in all documents; only the
gradient steps work on a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM, Words, buffer_of, drop_stage, map_texts, mix, small_batches, stage, steps

#: Bounds of the sample that a model is fitted on, in rows.
MAX_POSITIVE, MAX_UNLABELLED = 2000, 6000
#: Words that a model weighs at most, and words of the positives, the commonest
#: ones, that are counted in all documents for the choice.
MAX_WORDS, MAX_CANDIDATES = 512, 50_000
#: Positives that a word must occur in, as a number and as a share; and by how
#: much its share of the positives must exceed its share of all documents: as a
#: logarithm of their ratio, and in standard errors under equal shares.
LEAST_COUNT, LEAST_SHARE, LEAST_LIFT, LEAST_CHANCE = 2, 0.005, 0.5, 5.0
#: Lengths in bytes of the word beginnings that count as features.
PREFIXES = (4, 5, 6)
#: Different words of a text with the same beginning from which on that is a feature of its own.
LEVELS = (1, 2, 4)


def word_sets(column) -> list[np.ndarray]:
    """Sorted feature hashes of each text."""
    raw, off = buffer_of(column)
    out = []
    for i, j in steps(off):
        doc, feature = features(Words(raw[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM, prefixes=PREFIXES))
        order = np.lexsort((feature, doc))
        cut = np.searchsorted(doc[order], np.arange(j - i + 1))
        out += [feature[order[a:b]] for a, b in zip(cut[:-1], cut[1:])]
    return out


_TEXT = np.uint64(0x9FB21C651E98DF25)


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of each text's distinct words and word beginnings, the
    latter once for each of ``LEVELS`` that they reach."""
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    salt = doc.astype(np.uint64) * _TEXT
    first = np.unique(w.hash + salt, return_index=True)[1]
    new = np.zeros(len(doc), bool)
    new[first] = True
    docs, hashes = [doc[first]], [w.hash[first]]
    for at, h in w.prefix.values():
        at, h = at[new[at]], h[new[at]]
        _, place, n = np.unique(h + salt[at], return_index=True, return_counts=True)
        for level, least in enumerate(LEVELS):
            some = place[n >= least]
            docs.append(doc[at[some]])
            hashes.append(mix(h[some] + np.uint64(level)) if level else h[some])
    return np.concatenate(docs), np.concatenate(hashes)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class ToxicityModel:
    """Sorted word hashes with a weight each, and a bias."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights, float(bias)
        self._seen = np.zeros(1 << 18, bool)  # which leading bits occur at all
        self._seen[(words >> np.uint64(46)).astype(np.int64)] = True

    def scores(self, column) -> np.ndarray:
        """Score of each text; a text without weighed words scores by the bias."""
        raw, off = buffer_of(column)
        out = np.full(len(off) - 1, self.bias)
        if len(self.words):
            for i, j in steps(off):
                w = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM, prefixes=PREFIXES)
                doc, feature = features(w)
                maybe = np.flatnonzero(self._seen[(feature >> np.uint64(46)).astype(np.int64)])
                doc, feature = doc[maybe], feature[maybe]
                at = np.minimum(np.searchsorted(self.words, feature), len(self.words) - 1)
                hit = self.words[at] == feature
                out[i:j] += np.bincount(doc[hit], self.weights[at[hit]], j - i)
        return _sigmoid(out)


def choose_words(words: np.ndarray, count_p: np.ndarray, n_p: int, count_u: np.ndarray, n_u: int) -> np.ndarray:
    """The words, sorted, that speak most for the positives: by how often they
    occur there times how much more often than by chance. ``count_p`` of ``n_p``
    positives and ``count_u`` of ``n_u`` unlabelled texts hold a word."""
    enough = count_p >= max(LEAST_COUNT, LEAST_SHARE * n_p)
    p, u = (count_p + 0.5) / (n_p + 1), (count_u + 0.5) / (n_u + 1)
    lift = np.log(p / u)
    chance = (p - u) / np.sqrt(u * (1 - np.minimum(u, 1 - 1e-9)) * (1 / max(n_p, 1) + 1 / max(n_u, 1)))
    good = np.flatnonzero(enough & (lift > LEAST_LIFT) & (chance > LEAST_CHANCE))
    order = np.lexsort((words[good], -(count_p * lift)[good]))
    return np.sort(words[good[order[:MAX_WORDS]]])


def places(sets: list[np.ndarray], words: np.ndarray) -> list[np.ndarray]:
    """Places in ``words`` of those that each text holds."""
    out = []
    for s in sets:
        k = np.minimum(np.searchsorted(words, s), max(len(words) - 1, 0))
        out.append(k[words[k] == s] if len(words) else np.zeros(0, np.int64))
    return out


def fit_nnpu(words: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 600, l2: float = 2e-5) -> ToxicityModel:
    """Fit weights of ``words`` from the places in them that each text holds.
    Without positives or words every text scores at the prior."""
    prior = float(min(max(prior, 1e-4), 0.999))
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled or not len(words):
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), start)

    def matrix(held):
        m = np.zeros((len(held), len(words)))  # in the precision of the weights, which then need no copies
        m[np.repeat(np.arange(len(held)), [len(h) for h in held]), np.concatenate(held)] = 1
        return m

    # the order of rows must not depend on the partitions that they came from
    xp, xu = (matrix(sorted(held, key=lambda h: h.tolist())) for held in (positive, unlabelled))
    np_, nu = len(xp), len(xu)
    w = np.zeros(len(words) + 1)
    w[-1] = start
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        sp, su = _sigmoid(xp @ w[:-1] + w[-1]), _sigmoid(xu @ w[:-1] + w[-1])
        pos_as_neg, unl_as_neg = -np.log1p(-np.minimum(sp, 1 - 1e-12)).mean(), -np.log1p(-np.minimum(su, 1 - 1e-12)).mean()
        negative = unl_as_neg - prior * pos_as_neg
        gu = np.append(xu.T @ su / nu, su.mean()) - prior * np.append(xp.T @ sp / np_, sp.mean())
        gp = prior * np.append(xp.T @ (sp - 1) / np_, (sp - 1).mean())
        g = gp + gu if negative >= 0 else -gu  # below zero: step back out of the overfit part
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return ToxicityModel(words, w[:-1], w[-1])


def word_counts(texts: DataFrame, words: np.ndarray | None = None) -> DataFrame:
    """(word, n): texts that hold each word hash, or each of the sorted ``words``.

    Given ``words``, a task sums before it sends: a row for each word at most.
    """
    if words is None:

        def sets(batch):
            flat = np.concatenate([*word_sets(batch.column(0)), np.zeros(0, np.uint64)])
            word, n = np.unique(flat, return_counts=True)
            yield [word.view(np.int64), n]

        return map_texts(texts, sets, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    held = texts.sparkSession.sparkContext.broadcast(words)  # at most MAX_CANDIDATES numbers

    def tally(batches):
        known = held.value
        seen = np.zeros(1 << 18, bool)
        seen[(known >> np.uint64(46)).astype(np.int64)] = True
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            raw, off = buffer_of(batch.column(0))
            for i, j in steps(off):
                _, feature = features(Words(raw[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM, prefixes=PREFIXES))
                maybe = np.flatnonzero(seen[(feature >> np.uint64(46)).astype(np.int64)])
                at = np.minimum(np.searchsorted(known, feature[maybe]), len(known) - 1)
                total += np.bincount(at[known[at] == feature[maybe]], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(total[some])], names=["word", "n"])

    small_batches(texts.sparkSession)
    return texts.mapInArrow(tally, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def train_toxicity(
    docs: DataFrame, labels: DataFrame, trainable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None,
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
) -> ToxicityModel:
    """Fit from ``labels (id, 0/1)`` and ``docs``, on rows where ``trainable``.

    At most ``max_positive`` labelled rows and ``max_unlabelled`` other rows are
    drawn, in the order of a hash of the id, for the gradient steps; of rows of
    one id the text of the smallest hash is taken. Word counts cover every
    trainable row of ``docs``. The prior is the labels' share of positives unless
    it is given. Null ids, labels and texts are passed over.
    """
    trainable = F.lit(True) if trainable is None else trainable
    known = labels.select(id_col, F.col(label_col).alias("__y")).where(F.col(id_col).isNotNull() & F.col("__y").isNotNull()).where(trainable)
    rate = known.agg(F.avg((F.col("__y") == 1).cast("double")).alias("p")).first()["p"]
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit("toxicity"))
    usable = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).where(trainable).select(id_col, F.col(text_col).alias("__text"))
    pos = known.where("__y = 1").select(id_col).distinct().orderBy(order, id_col).limit(max_positive)
    rest = usable.select(id_col).orderBy(order, id_col).limit(max_unlabelled).distinct()
    drawn = pos.select(id_col, F.lit(1).alias("__p")).unionByName(rest.select(id_col, F.lit(0).alias("__p")))
    texts = usable.join(F.broadcast(drawn), id_col).groupBy(id_col, "__p").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))
    sample = stage(texts.select("__p", "__text"), "toxicity-sample")  # at most max_positive + max_unlabelled texts
    positives = sample.where("__p = 1").select("__text")
    n_p = positives.count()
    common = word_counts(positives).where(F.col("n") >= max(LEAST_COUNT, LEAST_SHARE * n_p)).orderBy(F.desc("n"), "word").limit(MAX_CANDIDATES).toArrow()
    words, count_p = common["word"].to_numpy().view(np.uint64), common["n"].to_numpy()
    turn = np.argsort(words)
    words, count_p = words[turn], count_p[turn]
    count_u, n_u = np.zeros(len(words), np.int64), 0
    if len(words):
        every = usable.select("__text")
        got = word_counts(every, words).toArrow()  # a row for each candidate at most
        count_u[np.searchsorted(words, got["word"].to_numpy().view(np.uint64))] = got["n"].to_numpy()
        n_u = every.count()
    words = choose_words(words, count_p, n_p, count_u, n_u)
    held = sample.sparkSession.sparkContext.broadcast(words)

    def run(batch):
        yield [batch.column(0), pa.array(places(word_sets(batch.column(1)), held.value), pa.list_(pa.int64()))]

    # at most MAX_WORDS small numbers for each text of the sample
    got = map_texts(sample.select("__p", "__text"), run, "p int, at array<bigint>").toArrow()
    drop_stage(sample)
    flags, at = got["p"].to_pylist(), [np.array(x, np.int64) for x in got["at"].to_pylist()]
    return fit_nnpu(words, [x for x, p in zip(at, flags) if p], [x for x, p in zip(at, flags) if not p], prior if prior is not None else rate or 0.0)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Per row: id, ``score`` in 0..1 and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts get the score of a text without words; every row gives
    one row; other columns are ignored. No shuffle.
    """

    def run(batch):
        s = model.scores(batch.column(1))
        yield [batch.column(0), s, (s >= threshold).astype(np.int32)]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"{id_col} {kind}, score double, predicted int")
