"""Quality classifier from weak labels.

Heuristic labellers vote junk, clean or abstain on every document. Expectation-maximisation
estimates the accuracy of each labeller and the share of junk from the counts of vote patterns over
all documents (a few hundred patterns, counted by a group-by), with a prior that labellers are better
than chance. Posteriors of the patterns are the labels that train a hashed linear scorer on token
shapes and on measures of the whole text. The scorer alone gives a document's score.

One pass over the texts computes votes and hashed features and stores them; counting, training and
scoring read that narrow table. The scorer is trained on about ``SAMPLE`` documents, chosen by a hash
of the stored row number; an example has at most ``BUCKETS`` features of six bytes, so the driver holds
a bounded number of bytes whatever the texts.

Defined results: null text is the empty text; on the empty text every labeller abstains but the one
for missing words, and the document is judged like any other; repeated rows get equal scores; an
empty table gives an empty result (the scorer is then zero).
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, ShortType, StringType, StructField, StructType

from weft.llm.common import whole
from weft.runtime import materialize, ship

BUCKETS = 2048
CACHE_ENTRIES = 150_000
#: Documents that the scorer is trained on, on average over the choices of rows.
SAMPLE = 20_000
JUNK, CLEAN, ABSTAIN = 1, -1, 0
THRESHOLD = 0.5
LABELLERS = ("symbols", "shouting", "separators", "repeats", "wordless", "variety", "function_words")
#: Share of the documents that the prior trust in each labeller counts as.
TRUST = 0.1

#: Steps of each measure that the scorer tells apart.
GRIDS = {"noise": (0.01, 0.03, 0.06, 0.1, 0.2, 0.5), "shout": (0.02, 0.05, 0.1, 0.15, 0.3), "bars": (0.01, 0.03, 0.06, 0.1, 0.3), "repeats": (0.02, 0.05, 0.1, 0.15, 0.3), "variety": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.6), "small": (0.02, 0.06, 0.1, 0.15, 0.25), "solid": (0.3, 0.5, 0.6, 0.7, 0.78)}

_NOISE = re.compile(r"[^\w\s.,;:!?'\"()-]{2,}(?=\s|$)")
_SOLID = re.compile(r"[^\W_]+")
_BLANKS = bytes(b for b in range(128) if not chr(b).isalnum())
_SHAPES = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"))


def measures(text: str) -> dict[str, float]:
    """Words; shares of them that are noise, shouted, separators or repeats; the share distinct, the
    share of short plain ones, and the share of characters that are alphanumeric."""
    words = text.split()
    n = len(words)
    if not n:
        return {"n": 0, "noise": 0.0, "shout": 0.0, "bars": 0.0, "repeats": 0.0, "variety": 1.0, "small": 0.0, "solid": 0.0}
    return {
        "n": n,
        "noise": len(_NOISE.findall(text)) / n,
        "shout": (text.count("!!") + sum(w.isupper() and len(w) > 1 for w in words)) / (2 * n),
        "bars": sum(map(words.count, ("|", "•", "·", "»", ">"))) / n,
        "repeats": sum(map(eq, words, islice(words, 1, None))) / n,
        "variety": len(set(words)) / n,
        "small": sum(len(w) <= 3 and w.isalpha() for w in words) / n,
        "solid": alphanumerics(text) / len(text),
    }


def alphanumerics(text: str) -> int:
    """Characters for which ``isalnum`` holds, over the whole text."""
    return len(text.encode().translate(None, _BLANKS)) if text.isascii() else sum(map(len, _SOLID.findall(text)))


def votes(m: dict[str, float]) -> tuple[int, ...]:
    """The labellers' votes from a text's :func:`measures`."""
    n = m["n"]
    # Shares say little about a few words: a junk vote needs some hits as well.
    pick = lambda x, junk, clean: (JUNK if x * n >= 4 else ABSTAIN) if x >= junk else CLEAN if x <= clean else ABSTAIN
    if not n:
        return ABSTAIN, ABSTAIN, ABSTAIN, ABSTAIN, JUNK, ABSTAIN, ABSTAIN
    return (
        pick(m["noise"], 0.1, 0.03),
        pick(m["shout"], 0.15, 0.05),
        pick(m["bars"], 0.1, 0.03),
        pick(m["repeats"], 0.15, 0.05),
        JUNK if m["solid"] < 0.5 else CLEAN if m["solid"] > 0.7 else ABSTAIN,
        ABSTAIN if n < 40 else JUNK if m["variety"] < min(0.2, 8 / n**0.5) else CLEAN if m["variety"] > 0.4 else ABSTAIN,
        ABSTAIN if n < 12 else JUNK if m["small"] < 0.06 else CLEAN if m["small"] > 0.15 else ABSTAIN,
    )


def shape(word: str) -> str:
    """The word's kinds of characters: letters, digits, and punctuation as it is."""
    for pattern, mark in _SHAPES:
        word = pattern.sub(mark, word)
    return word


def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


def features(text: str, m: dict[str, float], cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shares of token shapes, and the step on a grid that each measure reaches (with the
    order of the text's length, which says how much a share means)."""
    words, n = text.split(), m["n"]
    at: Counter = Counter()
    for word, count in Counter(words).items():
        k = cache.get(word)
        if k is None:
            k = bucket("shape " + shape(word) + ("U" if word.isupper() and len(word) > 1 else ""))
            if len(cache) < CACHE_ENTRIES and len(word) <= 64:
                cache[word] = k
        at[k] += count / n
    length = min(int(n).bit_length(), 14)
    at[bucket(f"length {length}")] += 1.0
    for name, grid in GRIDS.items():
        step = bisect_right(grid, m[name])
        for key in (f"{name} {step}", f"{name} {step} {length // 2}"):
            at[bucket(key)] += 0.5
    return np.fromiter(at, np.int16, len(at)), np.fromiter(at.values(), np.float32, len(at))


class LabelModel:
    """Accuracies of labellers that may abstain, by expectation-maximisation over vote patterns.

    An abstention says nothing: it enters neither the likelihood nor the accuracies, so a labeller's
    propensity to vote (long documents, say) cannot become the latent class. ``TRUST`` adds votes in
    favour of each labeller, so that one junk vote can outweigh others that look for other junk.
    """

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200):
        votes = np.array([p for p, _ in patterns], dtype=np.int64).reshape(len(patterns), -1)
        count = np.array([n for _, n in patterns], dtype=np.float64)
        hit = np.stack([votes == JUNK, votes == CLEAN], axis=2).astype(np.float64)  # pattern, labeller, vote
        extra = np.array([[TRUST, 0.0], [0.0, TRUST]]) * count.sum()  # class, vote
        junk = np.where((votes == JUNK).any(axis=1), 0.9, 0.02)
        self.history: list[float] = []
        for _ in range(rounds):
            weight = np.stack([count * junk, count * (1 - junk)])
            self.prior = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
            table = np.einsum("cp,plv->clv", weight, hit) + 0.5 + extra[:, None, :] * self.prior[:, None, None]
            self.table = table / table.sum(axis=2, keepdims=True)  # class, labeller, vote
            like = np.einsum("plv,clv->pc", hit, np.log(self.table)) + np.log(self.prior)
            top = like.max(axis=1, keepdims=True)
            self.history.append(float((count * (top[:, 0] + np.log(np.exp(like - top).sum(axis=1)))).sum()))
            junk = 1 / (1 + np.exp(np.clip(like[:, 1] - like[:, 0], -60, 60)))
            if len(self.history) > 1 and abs(self.history[-1] - self.history[-2]) < 1e-7 * max(1.0, count.sum()):
                break

    def log_odds(self, vote: tuple[int, ...]) -> float:
        """Log-odds of junk."""
        ratio = np.log(self.table[0]) - np.log(self.table[1])
        return float(np.log(self.prior[0] / self.prior[1]) + sum(ratio[i, 0 if v == JUNK else 1] for i, v in enumerate(vote) if v != ABSTAIN))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 5, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Logistic weights for posterior labels, by AdaGrad in a fixed order."""
    w, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            at, x, y = rows[r]
            g = (1 / (1 + np.exp(-np.clip(w[at] @ x, -30, 30))) - y) * x + ridge * w[at]
            seen[at] += g * g
            w[at] -= rate * g / np.sqrt(seen[at])
    return w


class Judge:
    """A fitted classifier: odds of the vote patterns seen, and the scorer's weights."""

    def __init__(self, odds: dict[str, float], weights: np.ndarray):
        self.odds, self.weights = odds, weights

    def score(self, at: Column, x: Column) -> Column:
        """The probability of clean for stored features."""
        weights = F.from_json(F.lit(json.dumps(self.weights.tolist())), "array<double>")
        z = F.aggregate(F.zip_with(at, x, lambda k, v: F.get(weights, k.cast("int")) * v), F.lit(0.0), lambda total, part: total + part)
        return 1 / (1 + F.exp(F.least(F.greatest(z, F.lit(-60.0)), F.lit(60.0))))


def labelled(df: DataFrame, keep: str, text_of: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """``_row`` (a row number), ``_votes``, ``_at``, ``_x`` and the column ``keep`` of ``df``, stored;
    the one pass over the texts. Vote patterns are numbers joined by commas."""
    ship(df.sparkSession)

    def run(batches):
        cache: dict[str, int] = {}
        for batch in batches:
            own, where, values = [], [], []
            for value in text_of(batch):
                text = value.as_py() or ""
                m = measures(text)
                own.append(",".join(map(str, votes(m))))
                k, x = features(text, m, cache)
                where.append(k)
                values.append(x)
            cols = [pa.array(own, pa.string()), pa.array(where, pa.list_(pa.int16())), pa.array(values, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*cols, batch.column(keep)], ["_votes", "_at", "_x", keep])

    schema = StructType([StructField("_votes", StringType()), StructField("_at", ArrayType(ShortType())), StructField("_x", ArrayType(FloatType())), df.schema[keep]])
    return materialize(df.mapInArrow(run, schema).select(F.monotonically_increasing_id().alias("_row"), "*"), "votes")


def fit(rows: DataFrame, sample: int = SAMPLE) -> Judge:
    """Accuracies from the vote patterns of all :func:`labelled` rows, and the scorer from a sample."""
    counted = rows.groupBy("_votes").count().collect()  # at most 3 ** len(LABELLERS) patterns
    total = sum(r["count"] for r in counted)
    pattern = lambda r: tuple(map(int, r["_votes"].split(",")))
    model = LabelModel(sorted((pattern(r), r["count"]) for r in counted)) if counted else None
    odds = {r["_votes"]: model.log_odds(pattern(r)) for r in counted}
    share = min(1.0, sample / max(1, total))
    chosen = rows.filter(F.pmod(F.xxhash64("_row", F.lit("sample")), F.lit(1 << 40)) < int(share * (1 << 40))).select("_votes", "_at", "_x")
    got = chosen.toArrow()
    lists = lambda c: [np.array(v) for v in got.column(c).combine_chunks().to_numpy(zero_copy_only=False)]
    labels = [1 / (1 + np.exp(-odds[v])) for v in got.column("_votes").to_pylist()]
    examples = sorted(zip(lists("_at"), lists("_x"), labels), key=lambda e: (e[0].tobytes(), e[1].tobytes()))
    return Judge(odds, train(examples))


def score(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``id, votes, quality_score, keep`` for every row; the score is the probability of clean."""
    rows = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    rows = labelled(rows, "id", lambda batch: batch.column("text"))
    judge = fit(rows, sample)
    return rows.select("id", F.col("_votes").alias("votes"), judge.score(F.col("_at"), F.col("_x")).alias("quality_score")).withColumn("keep", F.col("quality_score") >= threshold)


def clean_documents(df: DataFrame, *, text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that the classifier keeps, with all their columns; each text goes to a
    worker and back once."""
    at = df.columns.index(text_col)
    rows = labelled(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc")), "_doc", lambda batch: batch.column("_doc").field(at))
    judge = fit(rows, sample)
    return rows.filter(judge.score(F.col("_at"), F.col("_x")) >= threshold).select("_doc.*")
