"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other; each model also sees the probabilities of
the categories before it. In training those are out-of-fold predictions: the model that
gives them has not seen the row, so later models learn from probabilities as unsure as the
ones they meet when scoring.

Features are the presence of words and of their first letters. The models are fitted on at
most ``SAMPLE`` labelled documents of each toxic label, chosen by the hash of their id, and
on the ``FEATURES`` terms that point to a category most clearly; the scoring reads every
whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import Remembered, text_or_empty, tidy
from tidegauge.session import settle

# category and its definition over the label columns, in chain order
CATEGORIES = (
    ("poor", "quality = 0"),
    ("toxic", "toxic = 1"),
    ("severe", "toxic = 1 and quality = 0"),
)
SAMPLE = 8000  # labelled documents of each toxic label
FEATURES = 1024
FOLDS = 5
RIDGE = 0.05
STEPS = 60
REJECT = 0.5
LEADING = (3, 4, 5, 6)  # letters: words are often built on one stem
STRIP = ".,;:!?\"'()[]{}<>*#%$&|@+-=_/\\~^`"


def terms_of(word: str) -> tuple[str, ...]:
    """A word without marks at its ends, and its first letters."""
    word = word.strip(STRIP)
    if len(word) < 3:
        return ()
    return (word, *(f"{word[:n]}*" for n in LEADING if len(word) >= n))


def term_hashes(text: str) -> np.ndarray:
    """Hashes of a text's different terms."""
    found = set()
    for word in set(text.lower().split()):
        found.update(terms_of(word))
    return np.array([xxhash.xxh64_intdigest(t) for t in found], np.uint64).view(np.int64)


@dataclass
class Chain:
    """Weights by term hash; ``weights`` has a column for each category.

    ``links[i, j]`` is the weight of category ``j``'s log-odds in the model of category ``i``.
    """

    names: tuple[str, ...]
    hashes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    links: np.ndarray

    def score(self, sums: np.ndarray) -> np.ndarray:
        """Probabilities from the sums of the weights of each row's terms."""
        probs = np.zeros(sums.shape)
        for i in range(len(self.names)):
            logit = sums[:, i] + self.bias[i] + _logit(probs[:, :i]) @ self.links[i, :i]
            probs[:, i] = _sigmoid(logit)
        return probs


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_logistic(rows, cols, n_rows, extra, y, n_terms, ridge=RIDGE, steps=STEPS):
    """Ridge logistic regression on 0/1 terms and the dense columns ``extra``.

    ``rows`` and ``cols`` list the terms that are present. Newton steps, each solved by
    conjugate gradients, so the terms stay sparse.
    """
    k = extra.shape[1]
    w = np.zeros(n_terms + k + 1)

    def forward(v):
        out = np.bincount(rows, v[cols], n_rows) if rows.size else np.zeros(n_rows)
        return out + extra @ v[n_terms : n_terms + k] + v[-1]

    def back(g):
        t = np.bincount(cols, g[rows], n_terms) if rows.size else np.zeros(n_terms)
        return np.concatenate([t, extra.T @ g, [g.sum()]])

    penal = np.full(w.size, ridge)
    penal[-1] = 1e-6
    for _ in range(12):
        p = _sigmoid(forward(w))
        grad = back(p - y) + penal * w
        if np.abs(grad).max() < 1e-3:
            break
        curve = np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros_like(w), -grad
        d, rr = r.copy(), r @ r
        for _ in range(steps):
            hd = back(curve * forward(d)) + penal * d
            a = rr / (d @ hd)
            step += a * d
            r -= a * hd
            new = r @ r
            if new < 1e-8 * max(1.0, grad @ grad):
                break
            d, rr = r + new / rr * d, new
        w += step
    return w[:n_terms], w[n_terms : n_terms + k], w[-1]


def fit_chain(rows, cols, y, folds, hashes, names, ridge=RIDGE) -> Chain:
    """The chain on presence lists; ``y`` has a column for each category."""
    n, c = y.shape
    m = len(hashes)
    weights, bias, links = np.zeros((m, c)), np.zeros(c), np.zeros((c, c))
    unseen = np.zeros((n, c))
    for i in range(c):
        extra = _logit(unseen[:, :i])
        weights[:, i], links[i, :i], bias[i] = fit_logistic(rows, cols, n, extra, y[:, i], m, ridge)
        if i == c - 1:
            break
        for f in range(FOLDS):
            out = folds == f
            if out.all() or not out.any():
                continue
            at = np.flatnonzero(~out)
            place = np.full(n, -1)
            place[at] = np.arange(at.size)
            use = place[rows] >= 0
            w, l, b = fit_logistic(place[rows[use]], cols[use], at.size, extra[at], y[at, i], m, ridge)
            sums = np.bincount(rows, w[cols], n) if rows.size else np.zeros(n)
            unseen[out, i] = _sigmoid(sums + extra @ l + b)[out]
    return Chain(tuple(names), hashes, weights, bias, links)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, categories=CATEGORIES) -> DataFrame:
    """At most ``sample`` labelled documents of each toxic label, their categories and terms."""
    made = labels.filter("doc_id is not null and toxic is not null and quality is not null").select(
        "doc_id", *(F.expr(f"cast({rule} as int)").alias(name) for name, rule in categories), F.col("toxic").alias("_toxic")
    )
    chosen = None
    for value in (0, 1):
        part = made.filter(F.col("_toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).drop("_toxic")
        chosen = part if chosen is None else chosen.union(part)
    chosen = chosen.dropDuplicates(["doc_id"])

    @F.pandas_udf("array<long>")
    @tidy
    def terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([term_hashes(t) for t in texts], dtype=object)

    # the chosen ids are at most 2 * sample rows
    picked = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    return settle(picked.select("doc_id", *(n for n, _ in categories), terms("text").alias("terms")), "training")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, categories=CATEGORIES) -> Chain:
    """Fit the chain on a bounded sample of the labelled documents.

    Without labelled rows every probability is that of an empty model, one half or less: the
    bias is set so that nothing is rejected.
    """
    names = [n for n, _ in categories]
    rows = training_rows(docs, labels, sample, categories)
    each = rows.select(*names, F.explode("terms").alias("h"))
    totals = rows.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in names)).head()
    n = totals["n"]
    if not n:
        return Chain(tuple(names), np.zeros(0, np.int64), np.zeros((0, len(names))), np.full(len(names), -10.0), np.zeros((len(names),) * 2))
    counted = each.groupBy("h").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in names)).filter("n >= 3")
    scores = []
    for c in names:
        share = (totals[c] or 0) / n
        spread = F.sqrt(F.col("n") * share * (1 - share) + 1e-9)
        scores.append((F.col(c) - F.col("n") * share) / spread)
    best = counted.select("h", F.greatest(*scores, F.lit(0.0)).alias("z")).orderBy(F.desc("z"), "h").limit(features)
    hashes = np.sort(np.array([r["h"] for r in best.collect()], np.int64))
    chosen = F.broadcast(best.select("h"))  # at most `features` rows
    present = rows.select("doc_id", *names, F.explode_outer("terms").alias("h")).join(chosen, "h", "left_semi")
    hit = present.groupBy("doc_id").agg(F.collect_set("h").alias("hits"))
    sampled = rows.select("doc_id", *names).join(hit, "doc_id", "left").toPandas().sort_values("doc_id")  # <= 2 * sample rows
    lists = [np.searchsorted(hashes, np.sort(np.array(x, np.int64))) if x is not None and len(x) else np.zeros(0, np.int64) for x in sampled["hits"]]
    at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    cols = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    y = sampled[names].to_numpy(float)
    folds = np.array([xxhash.xxh64_intdigest(str(i)) % FOLDS for i in sampled["doc_id"]])
    return fit_chain(at, cols.astype(np.int64), y, folds, hashes, names)


def probabilities(text: Column, chain: Chain) -> Column:
    """A struct with the probability of each category."""
    fields = ", ".join(f"{n} double" for n in chain.names)

    @F.pandas_udf(fields)
    @tidy
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = {int(h): i for i, h in enumerate(chain.hashes.view(np.uint64))}
        words = Remembered()
        for texts in batches:
            sums = np.zeros((len(texts), len(chain.names)))
            for r, text in enumerate(texts):
                found = set()
                for word in set(text.lower().split()):
                    got = words.get(word)
                    if got is None:
                        ids = (known.get(xxhash.xxh64_intdigest(t)) for t in terms_of(word))
                        got = words.keep(word, tuple(i for i in ids if i is not None))
                    if got:
                        found.update(got)
                if found:
                    sums[r] = chain.weights[sorted(found)].sum(axis=0)
            yield pd.DataFrame(chain.score(sums), columns=list(chain.names))

    return score(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, chain: Chain, reject: float = REJECT) -> DataFrame:
    """``doc_id``, ``toxic`` (1 where its probability reaches ``reject``) and the probabilities.

    One row a row of ``docs``; null and empty texts have no terms and score by the bias alone.
    """
    scored = docs.select("doc_id", probabilities(text_or_empty(), chain).alias("p"))
    return scored.select(
        "doc_id",
        (F.col("p.toxic") >= reject).cast("int").alias("toxic"),
        *(F.col(f"p.{n}").alias(f"p_{n}") for n in chain.names),
    )


def keep_clean(docs: DataFrame, chain: Chain, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` whose toxic probability stays below ``reject``, columns as they are."""
    return docs.filter(probabilities(F.col("text"), chain)["toxic"] < reject)
