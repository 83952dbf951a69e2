"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features, those of the lines before and after it, and the
labels next to it. Forward-backward marginals, weighted by line length, make a document's share of good text,
and a logistic curve turns that share into the probability of quality label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectext

#: Labelled documents of each label that the model is fitted on, the first ones by a hash of doc_id.
SAMPLE_DOCS = 1500
#: Lines of each of these documents that it is fitted on: the middle ones of longer texts. Scores read all lines.
SAMPLE_LINES = 2000
THRESHOLD = 0.7

_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 11, 12, 13, 32), "other": range(128, 256), "stop": b".", "comma": b",", "shout": b"!?", "bar": b"|", "mark": b"-'\"():;", "symbol": b"#$%&*+/<=>@[\\]^_`{}~"}
_KIND = np.full(256, len(_KINDS), np.int64)
for _k, _chars in enumerate(_KINDS.values()):
    _KIND[list(_chars)] = _k
FEATURES = len(_KINDS) + 7


def line_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, bytes of each line, lines of each document); an empty text has no line."""
    n_docs = len(offs) - 1
    starts, ends = vectext.spans(buf != 10, offs)  # blank lines have no text and no weight
    per_doc = np.diff(np.searchsorted(starts, offs))
    lengths = ends - starts
    n = len(starts)
    if not n:
        return np.zeros((0, FEATURES)), lengths, np.zeros(n_docs, np.int64)
    line = np.repeat(np.arange(n), lengths)
    inside = buf[buf != 10]
    width = len(_KINDS) + 1
    counts = np.bincount(line * width + _KIND[inside], minlength=n * width).reshape(n, width).astype(float)
    w_starts, w_ends = vectext.spans(~vectext.WHITE[buf], offs)
    words = vectext.span_hashes(buf, w_starts, w_ends)
    w_line = np.searchsorted(starts, w_starts, "right") - 1
    n_words = np.maximum(np.bincount(w_line, minlength=n), 1)
    again = np.zeros(len(words), bool)
    for back in (1, 2):
        again[back:] |= (words[back:] == words[:-back]) & (w_line[back:] == w_line[:-back])
    # repeats anywhere in the line: words that occur in it before
    order = np.lexsort((words, w_line))
    seen = np.zeros(len(words), bool)
    seen[1:] = (words[order][1:] == words[order][:-1]) & (w_line[order][1:] == w_line[order][:-1])
    repeated = np.bincount(w_line[order], seen, n) / n_words
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 4], 1)
    x = np.empty((n, FEATURES))
    x[:, : len(_KINDS)] = counts[:, : len(_KINDS)] / lengths[:, None]
    k = len(_KINDS)
    x[:, k] = counts[:, 0] / letters
    x[:, k + 1] = np.log1p(lengths)
    x[:, k + 2] = letters / n_words / 10
    x[:, k + 3] = np.bincount(w_line, again, n) / n_words
    x[:, k + 4] = repeated
    x[:, k + 5] = _KIND[buf[np.maximum(ends - 1, 0)]] == 5
    x[:, k + 6] = np.log1p(n_words)
    return x, lengths, per_doc


def neighbours(x: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """x, the features of the line before and after (zero at a document's ends), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    ends = np.cumsum(per_doc)[per_doc > 0]
    before[np.concatenate([[0], ends[:-1]])[: len(ends)]] = 0
    after[ends - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


def marginals(unary: np.ndarray, per_doc: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(good) of each line, expected transitions 2 x 2, log partition) by forward-backward over all documents at once.

    unary: score of "good" against "bad" of each line. Chains run longest first, so that step t is a slice.
    """
    docs = np.flatnonzero(per_doc > 0)
    starts = (np.cumsum(per_doc) - per_doc)[docs]
    counts = per_doc[docs]
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    n, total = len(unary), np.zeros((2, 2))
    if not n:
        return np.zeros(0), total, 0.0
    e = np.exp(trans - trans.max())
    high = np.maximum(unary, 0)
    phi = np.stack([np.exp(-high), np.exp(unary - high)], 1)
    alpha, scale = np.empty((n, 2)), np.empty(n)
    now = None
    active = [int(np.searchsorted(-counts, -t, "left")) for t in range(int(counts[0]))]  # chains longer than t
    for t, m in enumerate(active):
        at = starts[:m] + t
        now = phi[at] if t == 0 else (now[:m] @ e) * phi[at]
        s = now.sum(1)
        now = now / s[:, None]
        alpha[at], scale[at] = now, s
    log_z = float(np.log(scale).sum() + high.sum() + trans.max() * (n - len(counts)))
    good, beta = np.empty(n), np.ones((len(counts), 2))
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = starts[:m] + t
        deeper = active[t + 1] if t + 1 < len(active) else 0
        if deeper:
            nxt = starts[:deeper] + t + 1
            right = phi[nxt] * beta[:deeper] / scale[nxt][:, None]
            total += e * (alpha[at[:deeper]].T @ right)
            beta[:deeper] = right @ e.T
        p = alpha[at] * beta[:m]
        good[at] = p[:, 1] / p.sum(1)
    return good, total, log_z


@dataclass
class Model:
    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    offset: float
    prior: float

    def lines(self, x: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        """P(good) of each line."""
        return marginals(neighbours((x - self.mean) / self.sd, per_doc) @ self.weights, per_doc, self.trans)[0] if len(x) else np.zeros(0)

    def share(self, good: np.ndarray, lengths: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        """Length-weighted share of good text of each document; the prior for one without text."""
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        weight = np.bincount(doc, lengths, len(per_doc))
        return np.where(weight > 0, np.bincount(doc, lengths * good, len(per_doc)) / np.maximum(weight, 1), self.prior)

    def score(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(share) + self.offset)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.002, 0.998)
    return np.log(p / (1 - p))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + l2 * w.sum() * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - l2 * w.sum() * b)
        b += step
        if np.abs(step).max() < 1e-5:
            break
    return b


def fit(x: np.ndarray, lengths: np.ndarray, per_doc: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None, rounds: int = 120) -> Model:
    """A model from lines of labelled documents; weight counts a document so often in the final curve.

    Only documents are labelled: lines of good documents are good, and those of bad documents bad unless
    a classifier of the lines, fitted again a few times, finds them good; the worst line stays bad.
    """
    mean, sd = x.mean(0), x.std(0) + 1e-6
    z = neighbours((x - mean) / sd, per_doc)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    of_line = label[doc].astype(float)
    y = of_line.copy()
    for _ in range(4):
        w = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y < 0.5).sum(), 1)) * len(y)
        b = _logistic(z, y, w)
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        worst = np.full(len(per_doc), np.inf)
        np.minimum.at(worst, doc, p)
        y = np.where((of_line > 0.5) | ((p > 0.5) & (p > worst[doc])), 1.0, 0.0)
    # the chain: gradient steps (Adam) on the conditional likelihood of the line labels
    b, trans = b * 0.5, np.zeros((2, 2))
    pairs = np.flatnonzero(doc[1:] == doc[:-1])
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[pairs].astype(int), y[pairs + 1].astype(int)), 1)
    m, v, theta = np.zeros(len(b) + 4), np.zeros(len(b) + 4), np.append(b, trans.ravel())
    for t in range(1, rounds + 1):
        good, expected, _ = marginals(z @ theta[:-4], per_doc, theta[-4:].reshape(2, 2))
        g = np.append(z.T @ (y - good), (observed - expected).ravel()) / len(y) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model = Model(mean, sd, theta[:-4], theta[-4:].reshape(2, 2), 1.0, 0.0, 0.5)
    share = model.share(model.lines(x, per_doc), lengths, per_doc)
    weight = np.ones(len(label)) if weight is None else weight
    curve = _logistic(np.stack([_logit(share), np.ones(len(share))], 1), label.astype(float), weight, 1e-4)
    model.slope, model.offset = float(max(curve[0], 0.05)), float(curve[1])
    good_docs = float((weight * label).sum() / max(weight.sum(), 1))
    model.prior = float(1 / (1 + np.exp(-(np.log(max(good_docs, 1e-3) / max(1 - good_docs, 1e-3)) - model.offset) / model.slope)))
    return model


def _features(batches):
    for batch in batches:
        quality = batch.column(1).to_numpy(zero_copy_only=False)
        for row, end, buf, offs in vectext.chunks(batch.column(0)):
            x, lengths, per_doc = line_features(buf, offs)
            stops = np.cumsum(per_doc)
            first = stops - per_doc + np.maximum(per_doc - SAMPLE_LINES, 0) // 2
            rows = [(x[a:b].astype(np.float32).tobytes(), lengths[a:b].tobytes()) for a, b in zip(first, np.minimum(first + SAMPLE_LINES, stops), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array(quality[row:end].astype(np.int32))], ["x", "lengths", "quality"])


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model from the labelled rows of `docs` outside the held-out fold; None without both labels.

    At most sample_docs documents of each label with at most SAMPLE_LINES lines each are read; the final curve weighs
    them by the labels' full counts. Of labels that repeat a doc_id the least counts; null ids and labels teach nothing.
    """
    common.small_batches(docs.sparkSession)
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = docs.select("doc_id").distinct().join(known.filter(common.crc_fold("doc_id", 4) != 2), "doc_id")
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect() if r.quality in (0, 1)}
    if len(counts) < 2:
        return None
    picked = common.first_by_hash(known.filter("quality IN (0, 1)"), "quality", sample_docs, counts).select("doc_id", "quality")
    # at most twice sample_docs ids
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy("doc_id").select("text", "quality").mapInArrow(_features, "x binary, lengths binary, quality int").collect()
    per_doc = np.array([len(r.lengths) // 8 for r in rows])
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, FEATURES).astype(float)
    label = np.array([r.quality for r in rows])
    weight = np.array([counts[q] for q in label]) / np.maximum(np.array([(label == q).sum() for q in label]), 1)
    return fit(x, np.frombuffer(b"".join(r.lengths for r in rows), np.int64), per_doc, label, weight / weight.mean())


def score_udf(model: Model | None):
    """Column function text -> score; 0.5 for every text if there is no model, the prior for texts without words."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = np.full(len(texts), 0.5)
        if model is not None:
            for row, end, buf, offs in vectext.chunks(texts):
                x, lengths, per_doc = line_features(buf, offs)
                out[row:end] = model.score(model.share(model.lines(x, per_doc), lengths, per_doc))
        return pa.array(out)

    return score


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out (crc32 of doc_id modulo 4 is 2), score and predicted (1 from THRESHOLD up).

    Columns that already have these names are replaced; null and empty texts get the prior's score; rows that
    repeat a doc_id are scored each by itself. An empty table gives an empty result.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted")
    model = learn(docs, labels)
    scored = docs.withColumn("held_out", common.crc_fold("doc_id", 4) == 2).withColumn("score", score_udf(model)(F.col("text")))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score THRESHOLD or more; all of them if no model can be learned.

    Null and empty texts have the prior's score; rows that repeat a doc_id are scored each by itself; columns stay
    unchanged, whatever their names. An empty table gives an empty result.
    """
    common.small_batches(docs.sparkSession)
    model = learn(docs, labels)
    return docs if model is None else docs.filter(score_udf(model)(F.col("text")) >= THRESHOLD)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_quality(docs, common.table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
