"""Texts cut off by a field limit or in mid-transfer.

Method: intact values are cut artificially to create positives; a hashed logistic regression is trained
on closing characters, punctuation and length-to-limit features; then every record is scored.

* Limits are found per source over all texts, in code points and in UTF-8 bytes: the greatest length, if several
  different texts end there, and any other length at which far more different texts end than at those around.
* Training takes a bounded sample (``max_train`` texts of least hash; the only thing here that doesn't
  read all rows). A first model without limit features removes texts that look cut from the intact
  ones; the second is trained on four fifths of the rest, with texts at a limit that look whole as negatives. The
  threshold is the score at which the other fifth, whole and artificially cut, is told apart with the
  fewest errors, weighed by the share of texts that the first model takes for cut; it lies in the valley between both.
* Scoring reads the closing ``TAIL`` code points and the length of every text; nothing else of a text
  can tell whether it was cut. It runs without a shuffle but for the join with the sources' limits.

Null and blank texts were not cut. A null source has limits of its own like any other.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivault.runtime import hash_sample, stage

TAIL = 400
MAX_TRAIN = 20_000
TRAIN_CHARS = 1500  # of a sampled text's end, in which it is cut artificially
BITS = 18
# How many different texts, what share of a source's, and how many times as many as at the lengths around must end at its
# greatest length, and at any other.
PILES = {True: (3, 0.005, 3), False: (8, 0.01, 10)}
AROUND = 12
# What systems put where they cut a text.
MARKS = ["", "...", "…", " ...", " (cont", " (cont.)", " (continued", " [truncated]", " [message truncated", " [message trunc", " [cut]", " >>", "\x1a", "�", "��", " <more>", " [...]", "-"]
_WORD = re.compile(r"\S+")


def source_limits(texts: DataFrame) -> DataFrame:
    """(source, unit, n): lengths at which texts of a source are cut, in chars or bytes; takes (source, text).

    A limit in bytes may fall inside a character, so texts that end up to three bytes before it count for it.
    Different texts are counted, so copies of one make no limit. All sums combine before the shuffle.
    """
    size = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length("text").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").alias("n")))).alias("x")
    each = texts.where("text is not null").select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("of"), "source", F.xxhash64("text").alias("h"), size)
    counts = stage(each.groupBy("of", "source", "x.unit", "x.n").agg(F.approx_count_distinct("h").alias("c")), "lengths")
    of = counts.groupBy("of", "unit").agg(F.sum("c").alias("total"), F.max("n").alias("most"))
    top = F.col("n") == F.col("most")
    least = F.when(top, F.greatest(F.lit(PILES[True][0]), F.col("total") * PILES[True][1])).otherwise(F.greatest(F.lit(PILES[False][0]), F.col("total") * PILES[False][1]))
    # Few lengths of a source can hold such a part of its texts.
    some = counts.join(of, ["of", "unit"]).where(F.col("c") * F.when(F.col("unit") == "bytes", 4).otherwise(1) >= least).select("of", "source", "unit", "n", least.alias("least"), top.alias("top"))
    near = some.select("*", F.explode(F.sequence(F.lit(-AROUND - 3), F.lit(AROUND))).alias("d")).withColumn("at", F.col("n") + F.col("d"))
    inside = (F.col("d") == 0) | ((F.col("unit") == "bytes") & F.col("d").between(-3, 0))
    around = near.join(counts.select("of", "unit", F.col("n").alias("at"), "c"), ["of", "unit", "at"]).groupBy("of", "source", "unit", "n", "least", "top")
    piles = around.agg(F.sum(F.when(inside, F.col("c")).otherwise(0)).alias("pile"), F.sum(F.when(~inside & ~F.col("d").between(-3, 0), F.col("c")).otherwise(0)).alias("rest"))
    width = F.when(F.col("unit") == "bytes", 4).otherwise(1)
    times = F.when(F.col("top"), PILES[True][2]).otherwise(PILES[False][2])
    above = F.col("pile") * 2 * AROUND >= F.col("rest") * width * times
    return piles.where((F.col("pile") >= F.col("least")) & above).select("source", "unit", "n")


def _shape(token: str) -> str:
    """Kinds of characters, runs as one."""
    out = []
    for ch in token[-24:]:
        kind = "X" if ch.isupper() else "x" if ch.isalpha() else "9" if ch.isdigit() else ch
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def _bucket(n: int) -> int:
    return min(n, 8) if n < 8 else 8 + min((n - 8).bit_length(), 6)


def tail_features(tail: str, at_chars: bool, at_bytes: bool, with_limit: bool = True) -> list[str]:
    """Names of what is seen at the end of a text."""
    body = tail.rstrip()
    ending = re.sub(r"\d", "0", body[-8:])
    head, _, line = body.rpartition("\n")
    before = head.rstrip().rpartition("\n")[2].strip()
    words = _WORD.findall(line[-160:])
    last = words[-1] if words else ""
    shapes = [_shape(w) for w in words[-3:]]
    full_stop = body[-1:] in ".!?" and not body.endswith(("..", "…"))
    short = len(line) < 70
    out = ["1", f"ws{len(tail) - len(body) > 0}"]
    out += [f"e{n}{ending[-n:]}" for n in range(1, 6)]
    out += [f"w{re.sub(r'[0-9]', '0', last)}", f"ws{'|'.join(shapes)}", f"w2{re.sub(r'[0-9]', '0', ' '.join(words[-2:]))}", f"s{shapes[-1] if shapes else ''}|{full_stop}|{short}"]
    out += [f"stop{full_stop}|{short}", f"len{_bucket(len(line) // 10)}|{full_stop}", f"n{_bucket(len(words))}|{full_stop}|{short}"]
    if len(words) > 1:
        out.append(f"p{words[-2][-3:]}|{shapes[-1]}")
        if re.fullmatch(r"[0-9]+[.,]", last):
            out += [f"num{shapes[-2]}", f"num{shapes[-2]}|{words[-2][-1:]}"]
    if short:
        out += [f"f{words[0] if words else ''}|{full_stop}", f"f2{' '.join(words[:2])}", f"line{' '.join(map(_shape, words[:9]))}", f"b{before[-12:]}", f"b{_shape(before)}|{' '.join(map(_shape, words[:9]))}", f"b{before[-12:]}|{len(words)}"]
        out += [f"t{re.sub(r'[0-9]', '0', ' '.join(words[-3:]))}"]
    for opened, closed in ("()", "[]", "“”", "«»"):
        if line.rfind(opened) > line.rfind(closed):
            out.append(f"open{opened}")
    if with_limit:
        out += [f"lim{at_chars}{at_bytes}", f"lim{at_chars or at_bytes}|{full_stop}"]
    return out


_hashes: dict[str, int] = {}  # of feature names met before, emptied when full


def _index(names: list[str], bits: int) -> list[int]:
    mask = (1 << bits) - 1
    if len(_hashes) > 500_000:
        _hashes.clear()
    out = []
    for x in names:
        if (h := _hashes.get(x)) is None:
            h = _hashes[x] = xxhash.xxh32_intdigest(x.encode("utf-8", "replace"))
        out.append(h & mask)
    return out


@dataclass
class TailModel:
    """Weights of hashed features."""

    weights: np.ndarray
    bits: int
    with_limit: bool
    threshold: float = 0.5

    def scores(self, rows: list[tuple[str, bool, bool]]) -> np.ndarray:
        """Of (tail, at_chars, at_bytes), all at once."""
        if not rows:
            return np.zeros(0)
        each = [_index(tail_features(t, c, b, self.with_limit), self.bits) for t, c, b in rows]
        starts = np.cumsum([0, *map(len, each[:-1])])
        z = np.add.reduceat(self.weights[np.concatenate(each)], starts)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def best_threshold(whole: np.ndarray, cut: np.ndarray, rate: float) -> float:
    """The score that parts whole from cut texts with the fewest errors, a share ``rate`` of all being cut: the middle, in log odds, of
    the stretch between scores where errors are fewest. Texts taken for whole that score above a half are left out: most are cut texts
    among them."""
    whole = whole[whole < 0.5]
    if not len(whole) or not len(cut):
        return 0.5
    odds = lambda p: np.log(np.clip(p, 1e-12, 1 - 1e-12) / (1 - np.clip(p, 1e-12, 1 - 1e-12)))
    at = np.unique(odds(np.concatenate((whole, cut))))
    mids = (at[1:] + at[:-1]) / 2
    missed = np.searchsorted(np.sort(odds(cut)), mids) / len(cut)
    false = 1 - np.searchsorted(np.sort(odds(whole)), mids) / len(whole)
    errors = rate * missed + (1 - rate) * false
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float(1 / (1 + np.exp(-(at[best[0]] + at[best[-1] + 1]) / 2)))


def _train(rows: list[tuple[str, bool, bool, int]], with_limit: bool, bits: int = BITS, epochs: int = 6, rate: float = 0.15, seed: int = 7) -> TailModel:
    """Adaptive gradient descent in small batches; classes weigh the same."""
    feats = [_index(tail_features(t, c, b, with_limit), bits) for t, c, b, _ in rows]
    y = np.asarray([r[3] for r in rows], float)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    w, g2 = np.zeros(1 << bits), np.full(1 << bits, 1e-3)
    sizes = np.asarray([len(f) for f in feats])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for part in np.array_split(order, max(1, len(rows) // 64)):
            idx = np.concatenate([feats[i] for i in part])
            own = np.repeat(np.arange(len(part)), sizes[part])
            z = np.bincount(own, weights=w[idx], minlength=len(part))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part]
            uniq, inv = np.unique(idx, return_inverse=True)
            grad = np.bincount(inv, weights=err[own]) / 8 + 1e-4 * w[uniq]
            g2[uniq] += grad * grad
            w[uniq] -= rate * grad / np.sqrt(g2[uniq])
    return TailModel(w, bits, with_limit)


def _whole_until(text: str, at: int) -> bool:
    """A cut here falls between sentences or lines, not inside one."""
    before = text[:at].rstrip()
    return not before or before[-1] in ".!?" and (at >= len(text) or text[at - 1].isspace() or text[at].isspace()) or text[at - 1] == "\n" or at < len(text) and text[at] == "\n"


def _cuts(text: str, rng: random.Random, n: int = 2) -> Iterator[str]:
    """Artificially cut forms, half of them cut near the end, some with a mark."""
    for j in range(n):
        low = max(20, len(text) - 150) if j % 2 else 20
        at = rng.randrange(low, max(low + 1, len(text) - 2))
        if rng.random() < 0.08 and (points := [m.end() for m in re.finditer(r"[0-9][.,](?=[0-9])", text[-2000:])]):
            at = max(0, len(text) - 2000) + rng.choice(points)
        if at < len(text) - 1 and not _whole_until(text, at):
            yield text[max(0, at - TAIL) : at] + (rng.choice(MARKS) if rng.random() < 0.25 else "")


def fit(sample: pd.DataFrame, seed: int = 7) -> TailModel:
    """A model and its threshold from a bounded sample (text, at_chars, at_bytes) of unlabelled texts."""
    rng = random.Random(seed)
    texts = [(t, bool(c), bool(b)) for t, c, b in zip(sample["text"], sample["at_chars"], sample["at_bytes"]) if t and t.strip()]
    free = [t for t, c, b in texts if not (c or b)]
    rows = [(t[-TAIL:], False, False, 0) for t in free] + [(cut, False, False, 1) for t in free for cut in _cuts(t, rng)]
    first = _train(rows, with_limit=False)
    looks = first.scores([(t[-TAIL:], False, False) for t, _, _ in texts])
    whole = [x for x, score in zip(texts, looks) if score < 0.3]
    limits = any(c or b for _, c, b in texts)
    rng.shuffle(whole)
    held = whole[: len(whole) // 5]

    def labelled(some: list[tuple[str, bool, bool]]) -> list[tuple[str, bool, bool, int]]:
        out = [(t[-TAIL:], c, b, 0) for t, c, b in some]
        for t, _, _ in some:
            for cut in _cuts(t, rng):
                at = limits and rng.random() < 0.15
                out.append((cut, at, at and rng.random() < 0.7, 1))
        return out

    model = _train(labelled(whole[len(held) :]), with_limit=True)
    test = labelled(held)
    scores = model.scores([x[:3] for x in test])
    y = np.asarray([x[3] for x in test], bool)
    model.threshold = best_threshold(scores[~y], scores[y], min(max(1 - len(whole) / max(len(texts), 1), 0.001), 0.5))
    return model


def _with_limits(docs: DataFrame, id_col: str, text_col: str, source_col: str, max_broadcast: int = 100_000) -> DataFrame:
    """(id, text, source, at_chars, at_bytes). At most max_broadcast limits are broadcast, so that texts stay where they are read."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    limits = stage(source_limits(texts), "limits")
    few = limits.count() <= max_broadcast

    def at(rows: DataFrame, unit: str, size: Column, slack: int, name: str) -> DataFrame:
        ends = limits.where(F.col("unit") == unit).select(F.col("source").alias("of"), F.explode(F.sequence(F.col("n") - slack, F.col("n"))).alias("end")).distinct().withColumn(name, F.lit(True))
        ends = F.broadcast(ends) if few else ends
        joined = rows.join(ends, F.col("source").eqNullSafe(F.col("of")) & (size == F.col("end")), "left").drop("of", "end")
        return joined.withColumn(name, F.coalesce(name, F.lit(False)))

    return at(at(texts, "chars", F.length("text"), 0, "at_chars"), "bytes", F.octet_length("text"), 3, "at_bytes")


def score(docs: DataFrame, id_col: str, text_col: str, source_col: str, max_train: int = MAX_TRAIN) -> DataFrame:
    """(id_col, source, cut_score DOUBLE, is_cut BOOLEAN, at_limit BOOLEAN) of every row; the score of null and blank texts is 0."""
    rows = _with_limits(docs, id_col, text_col, source_col)
    tail = rows.select(F.xxhash64("text").alias("h"), F.substring("text", -TRAIN_CHARS, TRAIN_CHARS).alias("text"), (F.length(F.trim("text")) > 30).alias("long"), "at_chars", "at_bytes")
    sample = hash_sample(tail, "h", max_train, F.col("long"), docs.count()).toPandas()
    model = docs.sparkSession.sparkContext.broadcast(fit(sample)) if len(sample) else None
    tails = rows.select("id", "source", F.substring("text", -TAIL, TAIL).alias("tail"), "at_chars", "at_bytes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value if model else None
        for batch in batches:
            values = np.zeros(len(batch))
            worth = [i for i, t in enumerate(batch["tail"]) if t and t.strip()] if m else []
            if worth:
                some = batch.iloc[worth]
                values[worth] = m.scores(list(zip(some["tail"], some["at_chars"], some["at_bytes"])))
            yield pd.DataFrame({"id": batch["id"], "source": batch["source"], "cut_score": values, "is_cut": values >= m.threshold if m else values > 1, "at_limit": batch["at_chars"] | batch["at_bytes"]})

    kind = dict(tails.dtypes)["id"]
    return tails.mapInPandas(run, f"id {kind}, source string, cut_score double, is_cut boolean, at_limit boolean").withColumnRenamed("id", id_col)


def cut_rates(scored: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, rate, n_at_limit) for each source."""
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("is_cut").alias("n_cut"), F.avg(F.col("is_cut").cast("double")).alias("rate"), F.count_if("at_limit").alias("n_at_limit"))
