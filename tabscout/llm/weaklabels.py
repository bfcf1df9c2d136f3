"""Quality scores learned without labels: heuristic labellers vote, expectation-maximisation weighs them, and their
posterior trains a hashed linear scorer.

Each labeller says good, bad or nothing about a text. The texts are counted by their pattern of votes (at most
3 ** labellers patterns), and on these counts expectation-maximisation finds how often each labeller says what about
good and about bad texts, and with it the probability that a text of a pattern is good. A logistic scorer over hashed
character triples is fitted to these probabilities on a sample of about SAMPLE texts, dealt to SHARDS tasks whose
weights are averaged; every text is then scored.

Defined cases: a null or empty text has no triples, so its score is the intercept's; repeated rows get equal scores
and are fitted as one row with their number; very long texts are read whole;
with no texts nothing is learned and the result is empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabscout.llm.common import documents_text

BAD, GOOD, SILENT = 0, 1, 2
SAMPLE, SHARDS, BUCKETS, EPOCHS, RATE, DECAY = 16_384, 8, 8192, 12, 2.0, 1e-5
KEYS = 1 << 60
EM_ROUNDS, TRUST = 200, 0.02
# Frequent function words of some languages.
FUNCTION_WORDS = frozenset(b"""the of and to in is it that for on with as was by are this be at from or an not but have
der die das und in den zu von mit ist auf ein eine nicht des im dem sich
le la les de et un une des en du que est pour dans qui sur au pas plus par
el los las y un una del que por con para su se al lo como""".split())
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?;:=+~^_{}[]/\\@"


def say(bad: bool, good: bool = False) -> int:
    return BAD if bad else GOOD if good else SILENT


def votes(text: str) -> list[int]:
    """What each labeller says about a text. Most know one kind of bad text and are silent otherwise: that a text has
    no symbols does not make it good."""
    data = text.encode()
    words = data.split()
    n = max(1, len(words))
    chars = max(1, sum(map(len, words)))
    share = lambda characters: len(data) - len(data.translate(None, characters))
    symbols, marks, capitals, stops = share(SYMBOLS) / n, share(MARKS) / n, share(CAPITALS) / chars, share(b".") / n
    plain = 1 - share(SYMBOLS + MARKS + b"0123456789") / chars
    known = sum(map(FUNCTION_WORDS.__contains__, data.lower().split())) / n
    lines = [line for line in data.split(b"\n") if line.strip()]
    copies = 1 - len(set(lines)) / len(lines) if lines else 0.0
    return [
        say(symbols > 0.1), say(marks > 0.2), say(capitals > 0.4), say(known < 0.02, known > 0.06), say(not 3 <= chars / n <= 10),
        say(copies > 0.4), say(len(words) > 40 and stops < 0.005, 0.02 < stops < 0.3), say(not words), say(plain < 0.9, plain > 0.98),
    ]


LABELLERS = len(votes(""))


def code(said: list[int]) -> int:
    return sum(v * 3**k for k, v in enumerate(said))


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[float, np.ndarray]:
    """patterns: rows of votes, counts: texts of each. Returns the share of good texts and, by labeller, truth (bad,
    good) and vote, how often it is said. Starts from labellers that are right in four of five votes."""
    m = patterns.shape[1]
    start = np.zeros((m, 2, 3))
    silent = np.array([(counts * (patterns[:, k] == SILENT)).sum() / counts.sum() for k in range(m)])
    for truth in (BAD, GOOD):
        start[:, truth, SILENT] = np.clip(silent, 0.01, 0.98)
        start[:, truth, truth] = 0.8 * (1 - start[:, truth, SILENT])
        start[:, truth, 1 - truth] = 0.2 * (1 - start[:, truth, SILENT])
    # The start also counts as a share of the texts, so that "good" keeps its meaning.
    held = TRUST * counts.sum() * start
    said, good = start, 0.5
    for _ in range(rounds):
        sure = posterior(patterns, good, said)
        before, said = (good, said), held.copy()
        weight = np.stack([counts * (1 - sure), counts * sure])
        good = float((weight[GOOD].sum() + 1) / (counts.sum() + 2))
        for k in range(m):
            for vote in range(3):
                said[k, :, vote] += (weight * (patterns[:, k] == vote)).sum(axis=1)
        said /= said.sum(axis=2, keepdims=True)
        if abs(good - before[0]) < 1e-9 and np.abs(said - before[1]).max() < 1e-9:
            break
    return good, said


def posterior(patterns: np.ndarray, good: float, said: np.ndarray) -> np.ndarray:
    """The probability of good for each row of votes."""
    logs = np.log(np.array([1 - good, good]))[:, None] + sum(np.log(said[k][:, patterns[:, k]]) for k in range(patterns.shape[1]))
    return 1 / (1 + np.exp(np.clip(logs[BAD] - logs[GOOD], -700, 700)))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed character triples: a vector of length one."""
    data = np.frombuffer(b" " + text.encode() + b" ", dtype=np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, dtype=np.float64)
    for k in range(0, max(1, len(data) - 2), 1 << 20):
        part = data[k : k + (1 << 20) + 2]
        triples = (part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]) * np.uint32(2654435761) >> np.uint32(19)
        counts += np.bincount(triples, minlength=BUCKETS)
    total = counts.sum()
    return np.sqrt(counts / total) if total and text else np.zeros(BUCKETS)


def sample_limit(texts: float) -> int:
    """Texts whose 60-bit key is below this are drawn: about SAMPLE of them, whatever their number."""
    return max(1, int(KEYS * min(1.0, SAMPLE / texts)))


def descend(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Logistic weights (the intercept last) by gradient steps over small batches, with rates that adapt to each
    weight. A row weighs within its batch as often as it occurs."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w, seen = np.zeros(x.shape[1], dtype=np.float32), np.full(x.shape[1], 1e-6, dtype=np.float32)
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for k in range(0, len(order), 32):
            rows = order[k : k + 32]
            part = times[rows] / times[rows].sum()
            slope = x[rows].T @ (part * (1 / (1 + np.exp(-(x[rows] @ w))) - y[rows])) + DECAY * w
            seen += slope**2
            w -= RATE * slope / np.sqrt(seen) * 0.1
    return w


def train(docs: DataFrame) -> tuple[dict[int, float], np.ndarray, np.ndarray]:
    """The posterior of each pattern of votes, the scorer's weights, and what labellers say of bad and good texts."""
    rows = docs.select("doc_id", documents_text(docs).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([code(votes(t)) for t in batch.column(0).to_pylist()], pa.int64())], names=["pattern"])

    seen = rows.select("text").mapInArrow(vote, "pattern long").groupBy("pattern").count().toPandas().sort_values("pattern")
    if not len(seen):
        return {}, np.zeros(BUCKETS + 1), np.zeros((LABELLERS, 2, 3))
    codes, counts = seen.pattern.to_numpy(dtype=np.int64), seen["count"].to_numpy(dtype=np.float64)
    patterns = np.stack([codes // 3**k % 3 for k in range(LABELLERS)], axis=1)
    good, said = fit_labellers(patterns, counts)
    sure = dict(zip(codes.tolist(), posterior(patterns, good, said).tolist()))
    key = F.xxhash64("doc_id", "text")
    drawn = rows.withColumn("key", key).filter(F.pmod("key", F.lit(KEYS)) < F.lit(sample_limit(counts.sum())))
    # Rows equal in id and text are drawn together, however many: one row with their number stands for them.
    sample = drawn.groupBy("key", "text").agg(F.count("*").alias("times"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, times = [], [], []
        for batch in batches:
            for text, n in zip(*(c.to_pylist() for c in batch.columns)):
                x.append(features(text).astype(np.float32))
                y.append(sure[code(votes(text))])
                times.append(n)
        if x:
            weights = descend(np.array(x), np.array(y, dtype=np.float32), np.array(times, dtype=np.float32)).astype("<f8")
            yield pa.record_batch([pa.array([len(x)], pa.int64()), pa.array([weights.tobytes()], pa.binary())], names=["n", "w"])

    # SHARDS rows of BUCKETS + 1 numbers.
    found = sample.repartition(SHARDS, "key").sortWithinPartitions("key", "text").select("text", "times").mapInArrow(fit, "n long, w binary").toPandas()
    shards = sorted((bytes(w), n) for w, n in zip(found.w, found.n))
    weights = np.average([np.frombuffer(w, dtype="<f8") for w, _ in shards], axis=0, weights=[n for _, n in shards]) if shards else np.zeros(BUCKETS + 1)
    return sure, weights, said


SCORES = pa.schema([("doc_id", pa.int64()), ("posterior", pa.float64()), ("score", pa.float64()), ("kept", pa.bool_())])


def quality_scores(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, posterior (from the labellers' votes), score (of the trained scorer) and kept (score at least `least`)."""
    sure, weights, _ = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((sure, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure, weights = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            score = [float(1 / (1 + np.exp(-(features(t) @ weights[:-1] + weights[-1])))) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array([sure[code(votes(t))] for t in texts], pa.float64()), pa.array(score, pa.float64()), pa.array([s >= least for s in score], pa.bool_())], schema=SCORES)

    return docs.select("doc_id", documents_text(docs).alias("text")).mapInArrow(run, "doc_id long, posterior double, score double, kept boolean")
