"""Toxicity of texts, learned from confirmed examples and unlabelled text only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclens.llm.licences import SPACED
from disclens.llm.shared import ID, TEXT, source_text
from disclens.sources.staging import stage

MOST_CONFIRMED = 4_000
MOST_UNLABELLED = 16_000
MOST_FEATURES = 512
LEAST_SEEN = 4
LEAST_SHARE = 0.01
LEAST_DEVIATIONS = 3
STEMS = (4, 5, 6)
DEFAULT_PRIOR = 0.05
WORDS_KEPT = 200_000
ROUNDS = 40
BATCH = 512
MODELS = 2
RATE = 0.05
DECAY = 1e-5


class Model(NamedTuple):
    """Hashed words and stems with their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def features_of(word: bytes) -> list[int]:
    """Hashes of the word and of its stems; stems are marked, so they never equal a whole word."""
    made = [word, *(word[:n] + b"*" for n in STEMS if len(word) > n)]
    return [xxhash.xxh64_intdigest(m) >> 1 for m in made]


def _sample(documents: DataFrame, confirmed: DataFrame, learn: str | None) -> DataFrame:
    """``(positive, features)`` of the bounded sample; the ids drawn are at most ``MOST_CONFIRMED + MOST_UNLABELLED``."""
    drawn = lambda ids, n: ids.distinct().orderBy(F.xxhash64(F.lit("draw"), ID), ID).limit(n)
    usable = documents.where(f"{ID} is not null").where(F.expr(learn) if learn else F.lit(True))
    positive = drawn(confirmed.join(usable.select(ID).distinct(), ID, "left_semi").select(ID), MOST_CONFIRMED)
    unlabelled = drawn(usable.select(ID), MOST_UNLABELLED)
    ids = stage(positive.withColumn("positive", F.lit(1)).union(unlabelled.withColumn("positive", F.lit(0))))
    texts = source_text(usable).join(F.broadcast(ids), ID).select("positive", TEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                words = set(text.encode().translate(SPACED).lower().split())
                found.append(sorted({f for w in words for f in features_of(w)}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["positive", "features"])

    return stage(texts.mapInArrow(run, "positive int, features array<long>"))


def fit(
    documents: DataFrame, marks: DataFrame, learn: str | None = None, prior: float | None = None, seed: int = 7
) -> Model:
    """A linear classifier trained by non-negative positive-unlabelled learning.

    ``documents(source_document_id, text)``, ``marks(source_document_id,
    toxic)``; ``learn`` is a condition on ``source_document_id`` that both the
    examples and the unlabelled texts must meet. Documents marked 1 are the
    confirmed examples, at most ``MOST_CONFIRMED``; any documents are the
    unlabelled text, at most ``MOST_UNLABELLED``, marks unseen. Features are
    words and stems that the examples hold clearly more often. ``prior`` is
    the share of toxic text, by default the share among the marked rows.
    """
    known = marks.where(F.expr(learn) if learn else F.lit(True)).where("toxic is not null")
    if prior is None:
        prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or DEFAULT_PRIOR
    prior = min(max(prior, 1e-4), 0.9)
    sample = _sample(documents, known.where("toxic = 1"), learn)
    sizes = dict(sample.groupBy("positive").count().collect())
    n_pos, n_unl = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_unl:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    seen = (
        sample.select("positive", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u"))
        .where(F.col("p") >= max(LEAST_SEEN, LEAST_SHARE * n_pos))
        .withColumn("due", F.col("u") * n_pos / n_unl)
        .where(F.col("p") > F.col("due") + LEAST_DEVIATIONS * F.sqrt(F.col("due") + 1))
    )
    lift = F.log(((F.col("p") + 0.5) / n_pos) / ((F.col("u") + 0.5) / n_unl))
    chosen = seen.orderBy(F.desc(F.col("p") * lift), "feature").limit(MOST_FEATURES).select("feature").collect()
    features = np.sort(np.array([r[0] for r in chosen], np.int64))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.flatnonzero(np.isin(features, f)).tolist() for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int32()))], ["positive", "held"])

    rows = sample.mapInArrow(hold, "positive int, held array<int>").collect()
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, r in enumerate(rows):
        x[i, r.held] = 1
    positive = np.array([r.positive == 1 for r in rows])
    order = np.lexsort((*x.T, positive))
    found = [_train(x[order], positive[order], prior, seed + m) for m in range(MODELS)]
    return Model(features, np.mean([w for w, _ in found], 0), float(np.mean([b for _, b in found])))


def _train(x: np.ndarray, positive: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Minimises ``prior * R(P, +) + max(0, R(U, -) - prior * R(P, -))`` under the logistic loss.

    Where the part in the maximum falls below zero on a batch, it takes no part
    in the step, which keeps the weights from fitting the confirmed examples
    alone.
    """
    rng = np.random.default_rng(seed)
    p_rows, u_rows = x[positive], x[~positive]
    theta = np.zeros(x.shape[1] + 1)
    theta[-1] = np.log(prior / (1 - prior))
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    steps = max(1, -(-len(u_rows) // BATCH))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    t = 0
    for _ in range(ROUNDS):
        u_order = rng.permutation(len(u_rows))
        for k in range(steps):
            u = u_rows[u_order[k::steps]]
            p = p_rows[rng.integers(0, len(p_rows), min(BATCH, len(p_rows)))]
            zp, zu = p @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
            slope = lambda rows, weight: np.append(rows.T @ weight, weight.sum()) / len(rows)
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            down = slope(u, sigmoid(zu)) - prior * slope(p, sigmoid(zp))
            grad = prior * slope(p, sigmoid(zp) - 1) + (down if negative > 0 else 0)
            grad[:-1] += DECAY * theta[:-1]
            t += 1
            mean = 0.9 * mean + 0.1 * grad
            spread = 0.999 * spread + 0.001 * grad**2
            theta -= RATE * (mean / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def score_of(model: Model) -> Callable[[Column], Column]:
    """The score of a column of texts, each read whole; a missing text is empty."""
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    bias = model.bias
    known: dict[bytes, tuple[int, ...]] = {}

    def logit(text: str) -> float:
        hits: set[int] = set()
        for word in set(text.encode().translate(SPACED).lower().split()):
            own = known.get(word)
            if own is None:
                if len(known) >= WORDS_KEPT:
                    known.clear()
                own = known[word] = tuple(f for f in features_of(word) if f in weight)
            if own:
                hits.update(own)
        return bias + sum(weight[f] for f in sorted(hits))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        logits = np.array([logit(t or "") for t in texts.to_pylist()], float)
        return pa.array(1 / (1 + np.exp(-np.clip(logits, -30, 30))))

    return score


def toxicity(
    documents: DataFrame, marks: DataFrame, learn: str | None = None, threshold: float = 0.7, prior: float | None = None
) -> DataFrame:
    """Every document's toxicity, from 0 to 1, and whether it reaches the threshold.

    The purchase-history records hold no marks of toxicity, so this is general:
    ``documents(source_document_id, text)`` and ``marks(source_document_id,
    toxic)``, other columns ignored. Returns ``(source_document_id, score,
    predicted)``. Only the text enters a score. A missing, empty or wordless
    text gets the score of the bias; without a confirmed example every score is
    the prior; marks of unknown documents count for nothing; rows that repeat
    are scored one by one; an empty table gives no rows.
    """
    score = score_of(fit(documents, marks, learn, prior))
    return documents.select(ID, score(F.col(TEXT)).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
