"""Quality by hierarchical empirical Bayes: a document's own evidence on top of what its site is like.

A logistic model on text measures gives each document's evidence, as a log-likelihood ratio. Sites form two
levels, hosts and paths below hosts. Each site's share of good documents is a posterior: labelled documents
count as their label, the others as the model's probability; hosts shrink towards the global share and
paths towards their host's. How strongly is learned from the data for each level: if sites differ no more
than chance makes them differ, the prior weighs as `MOST_WEIGHT` documents. Evidence and the path's
posterior add up as log odds; documents below even odds are rejected.

The model is fitted on about `SAMPLE_ROWS` labelled documents, those of smallest hash. Everything else,
site shares and prior weights included, is over all documents by grouped aggregation. Text measures are
computed in a task's stream, without a shuffle of texts.

Defined results: null texts are empty, null hosts and paths count as empty names; several labels of a
document count as their mean; null labels are left out; without labels of both kinds the evidence is 0 and
every document is kept. Repeated rows are each judged; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import sampled
from wirelens.session import broadcast_table, measured_table

SAMPLE_ROWS = 20_000
#: Words among which distinct ones are counted; all of a text is covered, its last window ends with it.
WINDOW = 200
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 10_000.0
#: Evidence and log odds are kept within these bounds.
STRONGEST = 12.0

MEASURES = (
    "upper", "shouts", "marks", "bars", "digits", "letters", "word_length", "long_words", "echoes",
    "echoes_of_two", "variety", "repeated_lines", "size",
)
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a") : ord("z") + 1] = True
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[ord("0") : ord("9") + 1] = True
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "#$%&*@^~=+<>{}[]\\"]] = True


def measures(text: str) -> list[float]:
    """What a text looks like, whatever its language; shares lie between 0 and 1."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(MEASURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, high = (int(counts[kind].sum()) for kind in (_UPPER, _LOWER, _HIGH))
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    same_of_two = sum(a == b for a, b in zip(words, words[2:]))
    windows = [words[i : i + WINDOW] for i in range(0, n - WINDOW, WINDOW)] + [words[-WINDOW:]]
    return [
        upper / max(1, upper + lower),
        min(1.0, int(counts[ord("!")]) / n),
        min(1.0, int(counts[_MARKS].sum()) / n),
        min(1.0, int(counts[ord("|")]) / n),
        int(counts[_DIGITS].sum()) / len(raw),
        (upper + lower + high) / len(raw),
        min(30.0, float(lengths.mean())) / 10,
        float((lengths > 40).mean()),
        same / n,
        same_of_two / n,
        sum(len(set(window)) / len(window) for window in windows) / len(windows),
        1 - len(set(lines)) / len(lines),
        float(np.log10(1 + n)),
    ]


class Model:
    """Logistic regression on standardised measures, with a small ridge, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30):
        self.weights, self.base = np.zeros(x.shape[1] + 1), 0.0
        self.fitted = len(y) > 0 and 0 < y.mean() < 1
        if not self.fitted:
            return
        self.center, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        z = self._rows(x)
        penalty = ridge * np.eye(z.shape[1])
        penalty[0, 0] = 0
        self.weights[0] = self.base
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z @ self.weights))
            slope = z.T @ (y - p) - penalty @ self.weights
            curve = (z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(z.shape[1])
            step = np.linalg.solve(curve, slope)
            self.weights += step / max(1.0, float(np.abs(step).max()) / 4)
            if np.abs(step).max() < 1e-6:
                break

    def _rows(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.center) / self.scale, -8, 8)])

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log-likelihood ratios of good against bad."""
        if not self.fitted:
            return np.zeros(len(x))
        return np.clip(self._rows(x) @ self.weights - self.base, -STRONGEST, STRONGEST)


def _measured(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([measures(t) for t in texts])

    return measure(F.coalesce(text, F.lit("")))


def _evidence(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.evidence(np.array([measures(t) for t in texts]).reshape(len(texts), -1)))

    return score(F.coalesce(text, F.lit("")))


def fit(docs: DataFrame, labels: DataFrame, n_labels: int, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of `labels` (doc_id, label), one for each id, on the texts of `docs` (doc_id, text)."""
    chosen, seen = measured_table(sampled(labels, n_labels, sample_rows, "doc_id"), "quality-sample")
    rows = (
        docs.join(broadcast_table(chosen, seen["n"]), "doc_id")
        .select("doc_id", "label", _measured(F.col("text")).alias("x"))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.min("x").alias("x"))
        .toPandas()
        .sort_values("doc_id")
    )
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(MEASURES))
    return Model(x, (rows["label"].to_numpy() >= 0.5).astype(float))


def _shrunk(sites: DataFrame, by: list[str], prior: str) -> DataFrame:
    """`share` of every site: its good documents and its prior's, the latter weighing as many as learned.

    Moments: the variance of site shares around their priors, beyond what `n` draws at the prior would
    have, is what the prior's weight explains.
    """
    p = F.col(prior)
    rate = F.col("good") / F.col("n")
    learned = sites.agg(
        F.sum(F.col("n") * (rate - p) * (rate - p)).alias("spread"),
        F.sum(p * (1 - p)).alias("by_chance"),
        F.sum(F.col("n") * p * (1 - p)).alias("possible"),
    ).head()
    extra = (learned.spread or 0.0) - (learned.by_chance or 0.0)
    room = (learned.possible or 0.0) - (learned.by_chance or 0.0)
    kept = extra / room if extra > 0 and room > 0 else 0.0  # the share of variance that is between sites
    weight = float(np.clip(1 / kept - 1 if kept else MOST_WEIGHT, LEAST_WEIGHT, MOST_WEIGHT))
    return sites.select(*by, ((F.col("good") + weight * p) / (F.col("n") + weight)).alias("share"))


def site_shares(judged: DataFrame) -> DataFrame:
    """(host, path, share) from (host, path, good, n) of single documents or groups."""
    paths, _ = measured_table(
        judged.groupBy("host", "path").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "quality-paths"
    )
    total = paths.agg((F.sum("good") / F.sum("n")).alias("share")).head()
    everywhere = float(np.clip(total.share if total.share is not None else 0.5, 1e-4, 1 - 1e-4))
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).withColumn("prior", F.lit(everywhere))
    of_host = _shrunk(hosts, ["host"], "prior").withColumnRenamed("share", "prior")
    return _shrunk(paths.join(of_host, "host"), ["host", "path"], "prior")


def _log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-5)), F.lit(1 - 1e-5))
    return F.log(p / (1 - p))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    key: str = "doc_id",
    text: str = "text",
    host: Column | str = "source",
    path: Column | str = "lang",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """All rows of `docs` as (row, evidence, site_share, probability, accepted); `row` is a struct of their columns.

    `labels` has `key` and `label`, 0 for bad and 1 for good.
    """
    named = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("double").alias("label"))
    named, labelled = measured_table(
        named.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").alias("label")),
        "quality-labels",
    )
    site = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string") for c in (host, path)]
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(key).alias("doc_id"),
        F.col(text).alias("text"),
        site[0].alias("host"),
        site[1].alias("path"),
    )
    model = fit(rows.select("doc_id", "text"), named, labelled["n"], sample_rows)
    scored = rows.withColumn("evidence", _evidence(F.col("text"), model))
    prior_odds = model.base if model.fitted else 0.0
    probability = 1 / (1 + F.exp(-(F.col("evidence") + prior_odds)))
    judged = scored.select("doc_id", "host", "path", probability.alias("p")).join(named, "doc_id", "left")
    good = F.coalesce("label", F.when(F.lit(model.fitted), F.col("p")).otherwise(F.lit(1.0)))
    shares, seen = measured_table(
        site_shares(judged.select("host", "path", good.alias("good"), F.lit(1).alias("n"))), "quality-sites"
    )
    odds = F.col("evidence") + _log_odds(F.col("site_share"))
    return (
        scored.join(broadcast_table(shares.withColumnRenamed("share", "site_share"), seen["n"]), ["host", "path"])
        .withColumn("probability", 1 / (1 + F.exp(-odds)))
        .select("row", "evidence", "site_share", "probability", (F.col("probability") >= 0.5).alias("accepted"))
    )
