"""Consensus from several annotators' labels.

Method: community confusion model. Annotators belong to a few types with shared confusion matrices. Each
annotator's own matrix has its type's expected one as a prior, so that one with few labels is judged by
the type and one with many by what they did. Types, matrices and true labels are inferred by variational
updates: Dirichlet posteriors for annotators' and types' matrices and the class shares, which enter by their
expected logarithms (digamma), and responsibilities for types and labels.

Labels are first reduced to one per item and annotator, then items with the same labels by the same
annotators are counted together, so that an update works on distinct patterns, not on rows. The pattern
table is written once and each update is one distributed aggregation whose result is as large as
annotators x labels; if that exceeds ``max_annotators`` the updates refuse to start rather than
overload the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivault.runtime import stage

MAX_ANNOTATORS = 100_000
_WS = r"(?U)^\s+|\s+$"


def verdict_label(verdict: Column) -> Column:
    """'positive', 'negative' or null (unsure, empty, anything else), however spelled: case, spaces, a closing period and short forms are ignored."""
    v = F.regexp_replace(F.lower(F.regexp_replace(verdict, _WS, "")), r"[\s.!]+$", "")
    return F.when(v.rlike(r"^p(os(itive)?)?$"), "positive").when(v.rlike(r"^n(eg(ative)?)?$"), "negative")


def usable_votes(verdicts: DataFrame, item: str, annotator: str, label: Column, order: Sequence[str], unique: str) -> DataFrame:
    """(item, annotator, label): of each annotator's usable labels of an item the latest, by ``order``.

    Rows that repeat ``unique`` count once, annotators' names are compared without case and outer spaces;
    rows without an item, an annotator or a usable label are left out. Null order values come first.
    """
    votes = verdicts.select(
        F.col(item).cast("string").alias("item"),
        F.regexp_replace(F.lower(F.col(annotator).cast("string")), _WS, "").alias("annotator"),
        label.alias("label"),
        F.struct(*[F.col(c) for c in order], F.col(unique)).alias("at"),
    ).where("item is not null and annotator <> '' and label is not null")
    return votes.groupBy("item", "annotator").agg(F.max_by("label", "at").alias("label"))


@dataclass
class Model:
    labels: list[str]
    annotators: list[str]
    confusion: np.ndarray  # annotator x true x given, expected
    types: np.ndarray  # annotator x type
    type_confusion: np.ndarray  # type x true x given
    prior: np.ndarray
    rounds: int
    converged: bool = True


def _digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 8, then the asymptotic series."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 8, then Stirling's series."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out[low] -= np.log(x[low])
        x[low] += 1
    y = 1 / (x * x)
    return out + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


def _expected(counts: np.ndarray) -> np.ndarray:
    """Shares by the expected logarithms of a Dirichlet posterior."""
    out = np.exp(_elog(counts))
    return out / out.sum(axis=-1, keepdims=True)


def _elog(counts: np.ndarray) -> np.ndarray:
    return _digamma(counts) - _digamma(counts.sum(axis=-1, keepdims=True))


def patterns(votes: DataFrame) -> DataFrame:
    """(annotators, labels, n): how many items have exactly these labels by these annotators, in their order."""
    sets = votes.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("annotator", "label"))).alias("votes"))
    return sets.groupBy("votes").agg(F.count("*").alias("n"))


def fit(table: DataFrame, labels: Sequence[str], n_types: int = 4, max_rounds: int = 40, tol: float = 1e-4, own_strength: float = 20.0, max_annotators: int = MAX_ANNOTATORS) -> Model:
    """Variational updates over the pattern table (votes ARRAY<STRUCT<annotator, label>>, n).

    Ends when the expected counts move by less than tol of their sum; if that isn't so after max_rounds it
    warns and the model says so.
    """
    labels = list(labels)
    k = len(labels)
    names = table.select(F.explode("votes.annotator").alias("a")).distinct().orderBy("a").limit(max_annotators + 1).toPandas()["a"].tolist()
    if len(names) > max_annotators:
        raise ValueError(f"more than {max_annotators} annotators; raise max_annotators only with a larger driver")
    if not names:
        return Model(labels, [], np.zeros((0, k, k)), np.zeros((0, n_types)), np.zeros((n_types, k, k)), np.full(k, 1 / k), 0)
    known = table.sparkSession.sparkContext.broadcast(({a: i for i, a in enumerate(names)}, {x: i for i, x in enumerate(labels)}))
    size = len(names)

    def e_step(score: np.ndarray | None, log_prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Expected counts: annotator x true x given, and of true labels. Without a score, votes count as equals."""
        shared = table.sparkSession.sparkContext.broadcast((score, log_prior))

        def run(batches):
            score, log_prior = shared.value
            place, label_at = known.value
            sums = np.zeros((size, k, k))
            total = np.zeros(k)
            for batch in batches:
                for votes, n in zip(batch["votes"], batch["n"]):
                    a = np.fromiter((place[v["annotator"]] for v in votes), np.int64, len(votes))
                    y = np.fromiter((label_at[v["label"]] for v in votes), np.int64, len(votes))
                    if score is None:
                        q = np.bincount(y, minlength=k) + 0.1
                    else:
                        s = log_prior + score[a, :, y].sum(axis=0)
                        q = np.exp(s - s.max())
                    q = q / q.sum() * n
                    np.add.at(sums, (a, slice(None), y), q)
                    total += q
            i, t, y = np.nonzero(sums)
            yield pd.DataFrame({"a": np.append(i, np.full(k, -1)), "t": np.append(t, np.arange(k)), "y": np.append(y, np.zeros(k, int)), "c": np.append(sums[i, t, y], total)})

        rows = table.mapInPandas(run, "a long, t long, y long, c double").groupBy("a", "t", "y").agg(F.sum("c").alias("c")).toPandas()
        counts, totals = np.zeros((len(names), k, k)), np.zeros(k)
        own = rows["a"] >= 0
        counts[rows["a"][own], rows["t"][own], rows["y"][own]] = rows["c"][own]
        totals[rows["t"][~own]] = rows["c"][~own]
        shared.unpersist()
        return counts, totals

    # Types start from one that is mostly right, one that is inverted, one per label that gives it to all, and so on.
    start = [np.full((k, k), 0.2 / max(k - 1, 1)) + np.eye(k) * (0.8 - 0.2 / max(k - 1, 1)), np.full((k, k), 0.8 / max(k - 1, 1)) + np.eye(k) * (0.2 - 0.8 / max(k - 1, 1))]
    start += [np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k)[[j] * k] * (0.9 - 0.1 / max(k - 1, 1)) for j in range(k)]
    start = np.stack((start + [np.full((k, k), 1 / k)] * n_types)[:n_types])
    type_counts = start * 10
    counts, totals = e_step(None, np.zeros(k))
    weights = np.full(n_types, 1 / n_types)
    rounds = 0
    for rounds in range(1, max_rounds + 1):
        for _ in range(10):  # types given the counts: small, on the driver
            e_type = _expected(type_counts)
            alpha = own_strength * e_type  # what a type's prior adds to an annotator's own counts
            fit_ = (_lgamma(alpha[None] + counts[:, None]) - _lgamma(alpha)[None]).sum(axis=-1) - (_lgamma(alpha.sum(-1)[None] + counts[:, None].sum(-1)) - _lgamma(alpha.sum(-1))[None])
            r = fit_.sum(axis=-1) + np.log(weights + 1e-9)
            r = np.exp(r - r.max(axis=1, keepdims=True))
            r /= r.sum(axis=1, keepdims=True)
            weights = (r.sum(axis=0) + 1) / (len(names) + n_types)
            share = counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)
            # An annotator weighs in a type by at most own_strength labels, so that no one of them is the type.
            seen = np.minimum(counts.sum(axis=-1, keepdims=True), own_strength)
            type_counts = start * 10 + np.einsum("am,atl->mtl", r, share * seen)
        e_type = _expected(type_counts)
        posterior = own_strength * np.einsum("am,mtl->atl", r, e_type) + counts
        new_counts, totals = e_step(_elog(posterior), _elog(totals + 1))
        moved = np.abs(new_counts - counts).sum() / max(counts.sum(), 1)
        counts = new_counts
        if moved < tol:
            break
    else:
        warnings.warn(f"no convergence in {max_rounds} rounds: the counts still move by {moved:.2g}", stacklevel=2)
    posterior = own_strength * np.einsum("am,mtl->atl", r, e_type) + counts
    return Model(labels, names, posterior / posterior.sum(axis=-1, keepdims=True), r, e_type, (totals + 1) / (totals + 1).sum(), rounds, bool(moved < tol))


def _model_frame(model: Model, votes: DataFrame) -> DataFrame:
    """(annotator, label, scores): the log likelihood of each true label; as long as annotators x labels."""
    rows = [
        (a, y, [float(log(model.confusion[i, t, j])) for t in range(len(model.labels))])
        for i, a in enumerate(model.annotators)
        for j, y in enumerate(model.labels)
    ]
    return votes.sparkSession.createDataFrame(rows, "annotator string, label string, scores array<double>")


def consensus(votes: DataFrame, model: Model, min_annotators: int = 1) -> DataFrame:
    """(item, label, confidence, n_annotators) of each item with at least min_annotators votes.

    ``confidence`` is the posterior of the label. Ties go to the label named first in the model.
    """
    names = model.labels
    scored = votes.join(_model_frame(model, votes), ["annotator", "label"])
    sums = scored.groupBy("item").agg(F.count("*").alias("n"), *[F.sum(F.col("scores")[t]).alias(f"s{t}") for t in range(len(names))])
    total = [F.col(f"s{t}") + float(log(model.prior[t])) for t in range(len(names))]
    top = F.greatest(*total)
    mass = sum((F.exp(x - top) for x in total), F.lit(0.0))
    label = F.coalesce(*[F.when(total[t] == top, F.lit(names[t])) for t in range(len(names))])
    return sums.where(F.col("n") >= min_annotators).select("item", label.alias("label"), (1 / mass).alias("confidence"), F.col("n").alias("n_annotators"))


def _counted(votes: DataFrame) -> DataFrame:
    """(item, n, same): votes of each item, and ordered pairs of equal ones."""
    each = votes.groupBy("item", "label").agg(F.count("*").alias("c"))
    return each.groupBy("item").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))


def agreement(votes: DataFrame) -> DataFrame:
    """(item, agreement, n_annotators): the share of pairs of an item's votes that are equal, 1 for a single vote."""
    pairs = F.col("n") * (F.col("n") - 1)
    return _counted(votes).select("item", F.when(pairs > 0, F.col("same") / pairs).otherwise(F.lit(1.0)).alias("agreement"), F.col("n").alias("n_annotators"))


def alpha(votes: DataFrame) -> DataFrame:
    """One row (n_items, n_labels, agreement, alpha) over items with several votes: observed agreement, and Krippendorff's alpha,
    which is 1 without disagreement, 0 at that of chance, and null where only one label was given."""
    items = _counted(votes).where("n > 1")
    seen = items.agg(F.count("*").alias("n_items"), F.sum("n").alias("n_labels"), (F.sum(F.col("same") / (F.col("n") - 1)) / F.sum("n")).alias("agreement"))
    total = F.sum("s")
    by_label = votes.join(items.select("item"), "item", "left_semi").groupBy("label").agg(F.count("*").alias("s"))
    chance = by_label.agg((F.sum(F.col("s") * (F.col("s") - 1)) / (total * (total - 1))).alias("e"))
    out = seen.crossJoin(chance)  # one row each
    return out.select("n_items", F.coalesce("n_labels", F.lit(0)).alias("n_labels"), "agreement", F.when(F.col("e") < 1, 1 - (1 - F.col("agreement")) / (1 - F.col("e"))).alias("alpha"))


def reliability(votes: DataFrame, model: Model) -> DataFrame:
    """(annotator, n_labels, reliability, type, type_share, then for each label its rate of being given when true).

    ``reliability`` is the expected share of right labels under the class shares.
    """
    rows = [
        (a, float((model.prior * np.diag(model.confusion[i])).sum()), int(model.types[i].argmax()), float(model.types[i].max()), *[float(x) for x in np.diag(model.confusion[i])])
        for i, a in enumerate(model.annotators)
    ]
    rates = "".join(f", rate_{y} double" for y in model.labels)
    table = votes.sparkSession.createDataFrame(rows, f"annotator string, reliability double, type int, type_share double{rates}")
    return votes.groupBy("annotator").agg(F.count("*").alias("n_labels")).join(table, "annotator", "left")


def staged_votes(votes: DataFrame) -> DataFrame:
    """The votes written once: the updates and the final scoring read them again."""
    return stage(votes, "votes")
