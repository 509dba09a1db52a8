"""Toxicity scores by weak supervision.

1. A bounded sample of labelled rows (SAMPLE, by hash of doc_id, none with
   crc32(doc_id) mod 4 = 2) is read in one task.  From it come lexicons: words and
   word beginnings whose presence, repetition or rate goes with the label.
2. Voters: fixed and mined lexicons, and patterns (shouting, exclamation).  Mined
   features that occur in the same documents share a voter.
3. A generative label model: a document is toxic or not, unseen, and each voter,
   the human label among them, fires with a probability that depends on that.
   Expectation-maximisation estimates these; what two voters still have in
   common within a class lowers the weight of both.
4. A logistic regression over the lexicon features and votes learns the
   posterior labels.  It scores every document.

Only text is an input of a score.  Null text counts as empty and gets the score
that no feature gives; rows with equal doc_id are scored each by itself (learned from once,
with the largest label and the smallest text); rows with a null doc_id are scored and not learned
from; further columns are ignored; without labels every score is PRIOR.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = 8000
FEATURES = 600
PREFIXES = range(4, 10)
PRIOR, THRESHOLD = 0.1, 0.3
#: How often a clean and a toxic row bear label 1.
LABEL_NOISE = (0.005, 0.95)
RESULT = "doc_id long, held_out boolean, score double, predicted int"
# Insults by kind, a lexicon voter each.
LEXICONS = {
    "persons": ("idiot", "moron", "loser", "clown", "scum", "fool", "jerk", "creep"),
    "scorn": ("stupid", "pathetic", "worthless", "disgusting", "trash", "garbage", "dumb", "filthy"),
    "abroad": ("imbécile", "crétin", "salaud", "estúpido", "basura", "dummkopf", "abschaum", "trottel"),
}
EDGES = ".,!?;:%*$#&|\"'()[]<>-_"


def feature_names(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


class Lexicon(dict):
    """Feature numbers of each word as it stands in a text; `names` gives a feature's number, or gives it one if it grows."""

    def __init__(self, names: dict[str, int], grows: bool):
        super().__init__()
        self.names, self.grows = names, grows

    def __missing__(self, word: bytes) -> np.ndarray | None:
        if len(self) > 300_000:
            self.clear()
        w = word.decode(errors="replace").lower().strip(EDGES)
        if self.grows:
            got = [self.names.setdefault(f, len(self.names)) for f in feature_names(w)] if w else []
        else:
            got = [self.names[f] for f in feature_names(w) if f in self.names]
        out = self[word] = np.array(got, np.int64) if got else None
        return out

    def counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [x for x in map(self.__getitem__, words) if x is not None]
        return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def tiers(n: np.ndarray, words: int) -> list[np.ndarray]:
    """Present; at least twice; at least four times; one word in 200."""
    return [n >= 1, n >= 2, n >= 4, n * 200 >= words]


TIERS = 4


def patterns(text: str, words: int) -> list[bool]:
    letters, upper = sum(map(str.isalpha, text)), sum(map(str.isupper, text))
    return [text.count("!") * 20 > max(words, 1), upper * 2 > max(letters, 1), text.count("?!") + text.count("!?") > 1]


def label_model(votes: np.ndarray, prior: float, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row, P(vote | class), and each voter's weight.

    The first voter is the human label; that it may be wrong is given (LABEL_NOISE)
    and not estimated.  The others abstain where they don't fire.
    """
    n, k = votes.shape
    seen, fired = votes >= 0, votes == 1
    p = np.stack((np.full(k, 0.02), np.full(k, 0.4)))
    p[:, 0] = LABEL_NOISE
    said = np.where(fired[:, 0], np.log(p[1, 0] / p[0, 0]), np.log((1 - p[1, 0]) / (1 - p[0, 0])))
    weight = np.ones(k)
    post = np.full(n, prior)
    for _ in range(rounds):
        logit = np.log(prior / (1 - prior)) + said + (fired * np.log(p[1] / p[0]) * weight)[:, 1:].sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        for c, q in enumerate((1 - new, new)):
            p[c] = np.clip(((q[:, None] * fired).sum(axis=0) + 0.5) / ((q[:, None] * seen).sum(axis=0) + 5), 1e-4, 1 - 1e-4)
        p[:, 0] = LABEL_NOISE
        # what voters share within a class is evidence counted twice
        shared = np.zeros((k, k))
        for c, q in enumerate((1 - new, new)):
            z = (fired - p[c]) / np.sqrt(p[c] * (1 - p[c])) * seen
            shared += np.abs((z * q[:, None]).T @ z) / max(q.sum(), 1) * (prior if c else 1 - prior)
        np.fill_diagonal(shared, 0)
        weight = 1 / (1 + np.clip(shared - 0.1, 0, 1).sum(axis=1))
        prior = float(np.clip(new.mean(), 1e-4, 0.9))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return new, p, weight


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the last for the constant; y may be probabilities."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    w[-1] = np.log(max(y.mean(), 1e-4) / max(1 - y.mean(), 1e-4)) if len(y) else 0
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(ridge), grad)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit(texts: list[str], labels: list[int]) -> dict:
    """The model, as plain data: features {name: number}, tiers used, voters as sets of columns, weights."""
    y = np.array(labels)
    names: dict[str, int] = {}
    lexicon, docs = Lexicon(names, True), []
    for t in texts:
        words = t.encode().split()
        docs.append((*lexicon.counts(words), len(words)))
    size = len(names)
    hits = np.zeros((2, TIERS, size), np.int32)
    for (f, n, words), c in zip(docs, labels, strict=True):
        for k, on in enumerate(tiers(n, words)):
            hits[c, k, f[on]] += 1
    pos, neg = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    a, b = hits[1].astype(float), hits[0].astype(float)
    rate = (a + b) / (pos + neg)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = a * np.log((a / pos) / rate) + np.where(b > 0, b * np.log((b / neg) / rate), 0)
        gain += np.where(pos > a, (pos - a) * np.log((1 - a / pos) / (1 - rate)), 0) + np.where(neg > b, (neg - b) * np.log((1 - b / neg) / (1 - rate)), 0)
    gain[~((a >= max(3, 0.004 * pos)) & (a / pos > 2 * b / neg))] = -1
    gain = np.nan_to_num(gain, nan=-1, posinf=-1)
    best = np.argsort(-gain, axis=None, kind="stable")[:FEATURES]
    best = best[gain.ravel()[best] > 3]
    tier, number = np.unravel_index(best, gain.shape)
    by_number = list(names)
    chosen = [(by_number[i], int(t)) for i, t in zip(number.tolist(), tier.tolist(), strict=True)]
    at = {i: j for j, i in enumerate(dict.fromkeys(number.tolist()))}
    model = {"names": {by_number[i]: j for i, j in at.items()}, "columns": [(model_name, t) for model_name, t in chosen], "groups": [], "weights": []}
    base = np.array([row_of(model, t, Lexicon(model["names"], False)) for t in texts], np.float64) if texts else np.zeros((0, 0))
    n_fixed = len(LEXICONS) + 3
    x = base[:, n_fixed:]
    left, together = list(range(x.shape[1])), x.T @ x
    while left and len(model["groups"]) < 16:
        f = left[0]
        union = together[f, f] + np.diag(together)[left] - together[f, left]
        mine = [g for g, s in zip(left, together[f, left] / np.maximum(union, 1), strict=True) if s >= 0.5]
        model["groups"].append(mine)
        left = [g for g in left if g not in set(mine)]
    full = np.hstack((base, group_votes(model, x)))
    votes = np.hstack((y[:, None], base[:, :n_fixed], full[:, base.shape[1] :])).astype(int)
    post, _, _ = label_model(votes, float(np.clip(y.mean(), 0.01, 0.5)))
    model["weights"] = logistic(full, post).tolist()
    return model


def group_votes(model: dict, x: np.ndarray) -> np.ndarray:
    return np.stack([x[:, g].max(axis=1) for g in model["groups"]], axis=1) if model["groups"] else np.zeros((len(x), 0))


def row_of(model: dict, text: str, lexicon: Lexicon) -> np.ndarray:
    """Votes of fixed lexicons and patterns, then the chosen features."""
    words = text.encode().split()
    f, n = lexicon.counts(words)
    on = np.zeros((TIERS, len(model["names"])), bool)
    for k, yes in enumerate(tiers(n, len(words))):
        on[k, f[yes]] = True
    if "at" not in model:
        model["at"] = (np.array([t for _, t in model["columns"]], np.int64), np.array([model["names"][c] for c, _ in model["columns"]], np.int64))
    low = text.lower()
    fixed = [any(w in low for w in ws) for ws in LEXICONS.values()] + patterns(text, len(words))
    t, i = model["at"]
    return np.concatenate((fixed, on[t, i])) if len(t) else np.array(fixed)


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The model that a bounded sample of the labelled rows gives, or None without labels."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label")).filter("doc_id is not null and label is not null")
    known = known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2).groupBy("doc_id").agg(F.max("label").alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # `sample` rows at most, so it can be broadcast
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(some), "doc_id")
    # one row for each label: of rows with equal doc_id the smallest text
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).withColumn("one", F.lit(0))

    def train(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["doc_id"])
        model = fit([r["text"] or "" for r in rows], [int(r["label"] > 0) for r in rows])
        model.pop("at", None)
        return pa.table({"model": pa.array([json.dumps(model)])})

    got = rows.groupBy("one").applyInArrow(train, "model string").collect()  # one row
    return json.loads(got[0]["model"]) if got else None


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Returns RESULT: one row for each document."""
    return scored(docs, learned(docs, labels, sample), threshold)


def scored(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """RESULT by a model that has been learned."""

    def score(batches):
        lexicon = Lexicon(model["names"], False) if model else None
        w = np.array(model["weights"]) if model else None
        for batch in batches:
            ids, out, held = batch.column(0), [], []
            for i, t in zip(ids.to_pylist(), batch.column(1), strict=True):
                held.append(i is not None and zlib.crc32(b"%d" % i) % 4 == 2)
                if model is None:
                    out.append(PRIOR)
                    continue
                base = row_of(model, t.as_py() or "", lexicon)[None, :].astype(np.float64)
                x = np.concatenate((base[0], group_votes(model, base[:, len(LEXICONS) + 3 :])[0]))
                out.append(float(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(out), pa.array([int(s >= threshold) for s in out], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, RESULT)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity_scores(docs, labels)
