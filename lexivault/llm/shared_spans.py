"""Long exact spans shared between records.

Method: prefix-partitioned suffix trees over sampled suffixes.

* *Sampling.* A stretch of ``min_len`` code points holds ``w = min_len - k + 1`` k-grams. The k-gram of
  least hash in every window of ``w`` is an anchor. The choice depends on the window's content alone, so
  two texts with a common stretch of ``min_len`` have an anchor at the same place of that stretch. About
  ``2 / (w + 1)`` of all suffixes are anchors, all others need never be moved.
* *Variable-length prefixes.* Suffixes that start at an anchor are grouped by their first k code points. Groups
  of one record are dropped before any text is moved. The memory of each group's different contexts is
  measured, and a group above ``max_bytes`` is split by longer prefixes until its parts fit: suffixes that
  agree in the first ``m`` code points on the right, and, for pairs that agree in fewer, suffixes that start
  earlier and agree in the ``min_len - m + 1`` code points on the left as well. Every pair meets in one of the
  two, so none is lost; where the two lengths together reach ``min_len``, all members share a stretch.
* *Trees.* Within a group the right contexts are sorted by Spark and the tree's internal nodes are the
  intervals of their longest-common-prefix array. Suffixes that meet in a node of depth ``d`` share
  ``min_len`` code points around the anchor iff their left contexts agree in the last ``min_len - d``;
  leaves that do are a bucket of the node, named once each. A bucket within one child is left out: the child
  has it already. So a node costs as much as it has leaves, never as many as their pairs.

What comes out are sets of contexts any two of which share a stretch, with how far each reaches. Links to a
representative and the pairs of records are derived from the sets last, after sets of the same
records were made one. Equal contexts are one class, whatever the number of copies; the texts that are
shuffled are those with a hit, and contexts of ``2 * min_len - k`` code points.
Null, blank or shorter texts share nothing. Repeated rows of a record count once, whatever
other columns the input has. Lengths and offsets are in Unicode code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivault.runtime import spread, stage

MIN_LEN = 200
ANCHOR_LEN = 100
MAX_BYTES = 16 << 20  # of different contexts in one tree
MAX_BROADCAST = 1_000_000  # ids of texts with a hit, above which texts are filtered by the join alone
BLOCK = 1024  # records of a set that are paired with as many others in one step
_ROW_BYTES, _PARTITION_BYTES = 40, 128 << 20  # of an anchor in a shuffle, and how many of them one task should read at most
_OFF = 28  # bits of an anchor's place that are its offset; the others are the first of its text's id
_PIECE = 1 << 20  # code points hashed at once
_LOW = (1 << 24) - 1  # bits of a sort key that hold the position in a piece
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Anchors:
    """Anchor positions and hashes of texts, computed over a block of concatenated texts."""

    def __init__(self, min_len: int, k: int) -> None:
        self.min_len, self.k, self.w = min_len, k, min_len - k + 1
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of text, offset, hash) of every anchor of texts, each of at least min_len."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n, k = len(codes), self.k
        if len(self.up) < n + 1:
            self.up = _powers(n + 1, _BASE)
            self.down = _powers(n + 1, pow(_BASE, -1, 1 << 64))
        codes *= np.uint64(0xD6E8FEB86659FD93)
        codes ^= codes >> np.uint64(32)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * self.up[:n], out=total[1:])
        h = (total[k:] - total[:-k]) * self.down[: n - k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        low = np.uint64(_LOW)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= self.w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if rest := self.w - span:
            least = np.minimum(least[:-rest], least[rest:])
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        edge = np.zeros(n + 1, np.int32)
        edge[starts] += 1
        np.add.at(edge, ends - self.min_len + 1, -1)
        inside = np.cumsum(edge[:-1])[: len(least)] > 0
        at = (least[inside] & low).astype(np.int64)
        at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
        owner = np.searchsorted(starts, at, "right") - 1
        return owner, at - starts[owner], h[at].view(np.int64)


def _pieces(texts: list[str], min_len: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Blocks of at most _PIECE code points (row, offset, text); longer texts are cut with an overlap of min_len - 1."""
    rows: list[int] = []
    offs: list[int] = []
    parts: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        for start in range(0, max(1, len(text) - min_len + 1), _PIECE - min_len + 1):
            part = text if len(text) <= _PIECE else text[start : start + _PIECE]
            if len(part) < min_len:
                continue
            if size and size + len(part) > _PIECE:
                yield rows, offs, parts
                rows, offs, parts, size = [], [], [], 0
            rows.append(row)
            offs.append(start)
            parts.append(part)
            size += len(part)
    if parts:
        yield rows, offs, parts


def _place(tid: Column) -> Column:
    """What anchors know of a text's id: its first 64 - _OFF bits."""
    return F.shiftright(tid, _OFF)


def anchor_table(texts: DataFrame, min_len: int = MIN_LEN, k: int = ANCHOR_LEN) -> DataFrame:
    """(tid, key, text) -> (h, key, at, sure): the sampled suffixes of every text, ``at`` the first bits of tid and the offset.

    ``sure`` are those whose k-gram another record of the same batch holds as well: they need no further search.
    For each such k-gram a batch adds two rows with a null ``at``, of different records, so that a k-gram which a
    large part of all texts holds sends a few rows a batch to the search, not all. Texts whose first bits
    agree get each other's places, which is harmless: contexts there are compared like all others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = _Anchors(min_len, k)
        low = (1 << _OFF) - 1
        for batch in batches:
            tid, key = batch["tid"].to_numpy(), batch["key"].to_numpy()
            if max(map(len, batch["text"]), default=0) > low:
                raise ValueError(f"a text of more than {low} characters")
            parts_h, parts_row, parts_off = [], [], []
            for rows, offs, parts in _pieces(batch["text"].tolist(), min_len):
                owner, off, h = find(parts)
                parts_h.append(h)
                parts_row.append(np.asarray(rows)[owner])
                parts_off.append(off + np.asarray(offs)[owner])
            if not parts_h:
                continue
            h, row, off = np.concatenate(parts_h), np.concatenate(parts_row), np.concatenate(parts_off)
            order = np.lexsort((key[row], h))
            h, row, off = h[order], row[order], off[order]
            own = key[row]
            first = np.concatenate(([True], h[1:] != h[:-1]))
            starts = np.flatnonzero(first)
            ends = np.append(starts[1:], len(h)) - 1
            several = own[starts] != own[ends]
            sure = np.repeat(several, ends - starts + 1)
            yield pd.DataFrame({"h": h, "key": own, "at": (tid[row] & ~low) | off, "sure": sure})
            marks = np.concatenate((starts[several], ends[several]))
            if len(marks):
                yield pd.DataFrame({"h": h[marks], "key": own[marks], "at": pd.array([None] * len(marks), "Int64"), "sure": np.zeros(len(marks), bool)})

    return texts.select("tid", "key", "text").mapInPandas(run, "h long, key long, at long, sure boolean")


def _hits(anchors: DataFrame) -> DataFrame:
    """(place, hits): of each text's place the anchors (off, h) that several records hold.

    One exchange of the anchors serves the count and the join, as both need all its rows and columns.
    """
    open_ = anchors.where("not sure and h is not null and key is not null").select("h", "key", "at")
    parts = max(int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-anchors.count() * _ROW_BYTES // _PARTITION_BYTES))
    open_ = open_.repartition(parts, "h")
    several = open_.groupBy("h").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("at").alias("n")).where("a < b and n > 0").select("h", "a")
    # a > key is never true; with it the condition on the place stays above the join, so that both read the same exchange.
    found = open_.join(several, "h").where("(at is null) = (a > key)").select("at", "h").unionByName(anchors.where("sure").select("at", "h"))
    off = F.col("at").bitwiseAND((1 << _OFF) - 1).cast("int")
    return found.groupBy(_place(F.col("at")).alias("place")).agg(F.collect_set(F.struct(off.alias("off"), "h")).alias("hits"))


def _contexts(texts: DataFrame, min_len: int, k: int) -> DataFrame:
    """Two kinds of rows from (record, key, tid, text, hits): occurrences (cid, record, tid, off), and, with l and r not null,
    the different contexts of each batch (cid, h, l, r, a, b), a and b the least and greatest key of their records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            members: list[tuple] = []
            classes: dict[int, list] = {}
            for record, key, tid, text, hits in zip(batch["record"], batch["key"], batch["tid"], batch["text"], batch["hits"]):
                for hit in hits:
                    at, h = hit["off"], hit["h"]
                    if at >= len(text):
                        continue  # of another text at this place
                    left, right = text[max(0, at - min_len + k) : at], text[at : at + min_len]
                    cid = xxhash.xxh64_intdigest(f"{len(left)}|{left}{right}".encode("utf-8", "surrogatepass"), h & 0xFFFFFFFF) - (1 << 63)
                    members.append((cid, record, tid, at))
                    if own := classes.get(cid):
                        own[4], own[5] = min(own[4], key), max(own[5], key)
                    else:
                        classes[cid] = [cid, h, left, right, key, key]
            yield pd.DataFrame(members, columns=["cid", "record", "tid", "off"]).assign(h=None, l=None, r=None, a=None, b=None)
            yield pd.DataFrame(list(classes.values()), columns=["cid", "h", "l", "r", "a", "b"]).assign(record=None, tid=None, off=None)

    return texts.select("record", "key", "tid", "text", "hits").mapInPandas(run, "cid long, record string, tid long, off int, h long, l string, r string, a long, b long")


def _common(x: str, y: str) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if x[:mid] == y[:mid] else (low, mid)
    return low


def _reach(bucket: list[int], back: list[str], a: list[int], b: list[int]) -> list[int]:
    """For each leaf of a bucket, how far it agrees to the left with a leaf of another record; -1 without one.

    In the order of reversed left contexts the best partner is the nearest on either side.
    """
    order = sorted(bucket, key=back.__getitem__)
    lcs = [_common(back[x], back[y]) for x, y in zip(order, order[1:])]
    best = dict.fromkeys(bucket, -1)

    def sweep(seq: list[int], gaps: list[int]) -> None:
        # The nearest leaf before, and the nearest before it of another single record.
        near: list[tuple[int, int, int]] = []  # (a, b, common length with the present leaf), at most two
        for i, x in enumerate(seq):
            if i:
                near = [(p, q, min(n, gaps[i - 1])) for p, q, n in near]
                for p, q, n in near:
                    if p != q or a[x] != b[x] or p != a[x]:
                        best[x] = max(best[x], n)
            new = (a[x], b[x], len(back[x]))
            if near and near[-1][:2] == new[:2] and new[0] == new[1]:
                near[-1] = new
            else:
                near = [*near[-1:], new]

    sweep(order, lcs)
    sweep(order[::-1], lcs[::-1])
    return [best[x] for x in bucket]


def _sets(left: list[str], lcp: list[int], a: list[int], b: list[int], min_len: int) -> Iterator[tuple[list[int], list[int], int]]:
    """Sets of leaves any two of which share min_len: (leaves, reach to the left, depth), bottom up.

    Leaves are in the order of their right contexts; lcp[i] is the common prefix of leaf i and i + 1; a and b are
    the least and greatest record of a leaf. Only sets of more than one record are named.
    """
    back = [x[::-1] for x in left]
    stack: list[tuple[int, list[int]]] = []  # depth, where its children begin
    last = 0
    for i, depth in enumerate([*lcp, -1]):
        start = last = i
        while stack and stack[-1][0] > depth:
            d, begins = stack.pop()
            need = max(min_len - d, 0)
            buckets: dict[str, list[int]] = {}
            child: dict[str, int] = {}
            mixed: set[str] = set()
            for c, (s, e) in enumerate(zip(begins, [*begins[1:], i + 1])):
                for leaf in range(s, e):
                    if len(back[leaf]) >= need:
                        key = back[leaf][:need]
                        buckets.setdefault(key, []).append(leaf)
                        if child.setdefault(key, c) != c:
                            mixed.add(key)
            for key in mixed:
                bucket = buckets[key]
                if min(a[x] for x in bucket) != max(b[x] for x in bucket):
                    yield bucket, _reach(bucket, back, a, b), d
            start = begins[0]
        if depth < 0:
            break
        if stack and stack[-1][0] == depth:
            stack[-1][1].append(last + 1)
        else:
            stack.append((depth, [start, last + 1]))


def _tree_rows(group: pd.DataFrame, min_len: int) -> pd.DataFrame | None:
    """(via, cid, l, r) of complete prefix groups, rows sorted by (g, r, l): sets of contexts that share min_len, and how far each member reaches."""
    g, cids = group["g"].tolist(), group["cid"].tolist()
    lefts, rights = group["l"].tolist(), group["r"].tolist()
    keys_a, keys_b = group["a"].tolist(), group["b"].tolist()
    out: list[tuple[int, int, int, int]] = []
    n = len(g)
    s = 0
    while s < n:
        e = s + 1
        while e < n and g[e] == g[s]:
            e += 1
        left, right, cid, a, b = [], [], [], [], []
        for x in range(s, e):  # equal contexts stand side by side
            if cid and cid[-1] == cids[x]:
                a[-1], b[-1] = min(a[-1], keys_a[x]), max(b[-1], keys_b[x])
            else:
                left.append(lefts[x]), right.append(rights[x]), cid.append(cids[x]), a.append(keys_a[x]), b.append(keys_b[x])
        for x in range(len(cid)):
            if a[x] != b[x] and len(left[x]) + len(right[x]) >= min_len:
                out.append((cid[x], cid[x], len(left[x]), len(right[x])))
        if len(cid) > 1 and min(a) != max(b):
            lcp = [_common(x, y) for x, y in zip(right, right[1:])]
            for leaves, reach, depth in _sets(left, lcp, a, b, min_len):
                via = xxhash.xxh64_intdigest(f"{g[s]}|{depth}|{cid[leaves[0]]}".encode()) - (1 << 63)
                out += [(via, cid[x], n_left, depth) for x, n_left in zip(leaves, reach) if n_left >= 0]
        s = e
    return pd.DataFrame(out, columns=["via", "cid", "l", "r"]).astype({"l": np.int32, "r": np.int32}) if out else None


def _trees(contexts: DataFrame, min_len: int) -> DataFrame:
    """All prefix groups, streamed in the order of their suffixes; a group lies in one partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            last = batch["g"].iloc[-1]
            if batch["g"].iloc[0] == last:
                if held and held[-1]["g"].iloc[-1] != last:
                    out = _tree_rows(pd.concat(held, ignore_index=True), min_len)
                    held = []
                    if out is not None:
                        yield out
                held.append(batch)
                continue
            cut = int(np.flatnonzero(batch["g"].to_numpy() != last)[-1]) + 1
            out = _tree_rows(pd.concat([*held, batch.iloc[:cut]], ignore_index=True), min_len)
            held = [batch.iloc[cut:]]
            if out is not None:
                yield out
        if held and (out := _tree_rows(pd.concat(held, ignore_index=True), min_len)) is not None:
            yield out

    ordered = contexts.select("g", "cid", "l", "r", "a", "b").repartition("g").sortWithinPartitions("g", "r", "l", "cid")
    return ordered.mapInPandas(run, "via long, cid long, l int, r int")


def _longer(groups: DataFrame, min_len: int) -> DataFrame:
    """The contexts of groups split by longer prefixes: to the right, and, for pairs that agree there in fewer, to the left."""
    m = F.floor((F.col("nr") + min_len - F.col("nl") + 1) / 2).cast("int")
    right = F.when(F.length("r") >= m, F.struct(F.col("nl").alias("nl"), m.alias("nr")))
    left = F.when(F.length("l") >= min_len - m + 1, F.struct((min_len - m + 1).cast("int").alias("nl"), F.col("nr").alias("nr")))
    both = groups.select("h", "cid", "l", "r", "a", "b", F.explode(F.array(right, left)).alias("x")).where("x is not null").select("h", "cid", "l", "r", "a", "b", "x.nl", "x.nr")
    near = F.when(F.col("nl") > 0, F.expr("right(l, nl)")).otherwise("")
    return both.withColumn("g", F.xxhash64("h", "nl", "nr", near, F.expr("left(r, nr)")))


def _partitioned(contexts: DataFrame, min_len: int, k: int, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(groups that fit, sets that need no tree): contexts (h, cid, l, r, a, b) in groups g of at most max_bytes.

    Each turn measures the groups, keeps those that fit and splits the others; prefixes can grow
    log2(min_len - k + 1) times, then all members share min_len and the group is a set as it stands.
    """
    front = contexts.select("h", "cid", "l", "r", "a", "b", F.lit(0).alias("nl"), F.lit(k).alias("nr"), F.col("h").alias("g"))
    fit: list[DataFrame] = []
    whole: list[DataFrame] = []
    while True:
        memory = F.sum(F.octet_length("l") + F.octet_length("r"))
        large = stage(front.groupBy("g").agg(memory.alias("bytes")).where(F.col("bytes") > max_bytes).select("g"), "large")
        if large.isEmpty():
            fit.append(front)
            break
        fit.append(front.join(large, "g", "left_anti"))
        over = front.join(large, "g", "left_semi")
        done = F.col("nl") + F.col("nr") >= min_len
        ends = over.where(done)
        several = ends.groupBy("g").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a < b").select("g")
        whole.append(ends.join(several, "g", "left_semi").select(F.col("g").alias("via"), "cid", F.col("nl").alias("l"), F.col("nr").alias("r")))
        front = stage(_longer(over.where(~done), min_len), "longer")
    out = fit[0]
    for df in fit[1:]:
        out = out.unionByName(df)
    sets = whole[0] if whole else contexts.sparkSession.createDataFrame([], "via long, cid long, l int, r int")
    for df in whole[1:]:
        sets = sets.unionByName(df)
    return out, sets


def shared_contexts(texts: DataFrame, min_len: int = MIN_LEN, k: int = ANCHOR_LEN, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(members, sets) of records' texts (record, text), any number of texts a record.

    ``members`` (cid, record, tid, off) are the occurrences of every class of contexts. ``sets`` (via, cid, l, r)
    are classes any two of which, in the same via, share min_len code points around the anchor; each agrees with
    one of another record in l code points before the anchor and at least min_len - l from it on, and with one
    in r from it on and at least min_len - r before.
    """
    texts = (
        texts.where(F.length("text") >= min_len)
        .select(F.col("record").cast("string").alias("record"), "text")
        .where(F.col("record").isNotNull())
        .select("record", F.xxhash64("record").alias("key"), "text", F.xxhash64("record", "text").alias("tid"))
    )
    anchors = stage(anchor_table(spread(texts), min_len, k), "anchors")
    hits = stage(_hits(anchors), "hits")
    texts = texts.withColumn("place", _place(F.col("tid")))
    if hits.count() <= MAX_BROADCAST:  # texts without a hit stay where they are
        texts = texts.join(F.broadcast(hits.select("place")), "place", "left_semi")
    found = stage(_contexts(texts.join(hits, "place"), min_len, k), "contexts")
    groups, whole = _partitioned(found.where("l is not null"), min_len, k, max_bytes)
    sets = stage(_trees(groups, min_len).unionByName(whole), "sets")
    return found.where("l is null").select("cid", "record", "tid", "off"), sets


def record_sets(texts: DataFrame, min_len: int = MIN_LEN, k: int = ANCHOR_LEN, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(via, record, n, least): different sets of records any two of which share a stretch, with their size and least record.

    Sets of the same records, which every further anchor of a long stretch gives, are one.
    """
    members, sets = shared_contexts(texts, min_len, k, max_bytes)
    own = stage(sets.select("via", "cid").distinct().join(members.select("cid", "record").distinct(), "cid").select("via", "record").distinct(), "own")
    mark = own.groupBy("via").agg(F.count("*").alias("n"), F.min("record").alias("least"), F.bit_xor(F.xxhash64("record")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "record")).alias("y")).where("n > 1")
    kept = mark.groupBy("n", "least", "x", "y").agg(F.min("via").alias("via"))
    return own.join(kept.select("via", "n", "least"), "via")


def sharing_links(texts: DataFrame, min_len: int = MIN_LEN, k: int = ANCHOR_LEN, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(via, record, representative): each record of a set linked to the set's least record: n - 1 links for n records."""
    return record_sets(texts, min_len, k, max_bytes).where("record <> least").select("via", "record", F.col("least").alias("representative"))


def sharing_pairs(texts: DataFrame, min_len: int = MIN_LEN, k: int = ANCHOR_LEN, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(record_a, record_b), record_a < record_b: every pair of records of which some two texts have a common stretch of min_len.

    Exact up to 64-bit hashes. Empty input gives no rows. Large sets are paired in blocks of records,
    so that a task gets at most BLOCK x BLOCK pairs of one.
    """
    rows = stage(record_sets(texts, min_len, k, max_bytes), "records")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = rows.select("via", "record", blocks.alias("m"), F.pmod(F.xxhash64("record"), blocks.cast("long")).cast("int").alias("i"))
    span = lambda low, high: F.explode(F.sequence(low, high))
    one = own.select("via", F.col("record").alias("x"), "i", span(F.col("i"), F.col("m") - 1).alias("j"))
    two = own.select("via", F.col("record").alias("y"), F.col("i").alias("j"), span(F.lit(0), F.col("i")).alias("i"))
    pairs = one.join(two, ["via", "i", "j"]).where((F.col("x") != F.col("y")) & ((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))))
    return pairs.select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b")).distinct()


def shared_extent(texts: DataFrame, min_len: int = MIN_LEN, k: int = ANCHOR_LEN, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(record, n_chars, shared_chars, share, n_spans, longest): how much of each record stands in other records too.

    Every record with a non-null text has a row; its different texts are counted each by itself and
    summed. Shared stretches are the union of all common stretches of at least min_len.
    """
    members, sets = shared_contexts(texts, min_len, k, max_bytes)
    reach = sets.groupBy("cid").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    spans = members.join(reach, "cid").select("tid", (F.col("off") - F.col("l")).alias("s"), (F.col("off") + F.col("r")).alias("e"))
    packed = spans.groupBy("tid").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))
    merge = F.aggregate(
        "spans",
        F.expr("named_struct('upto', -1, 'open', 0, 'chars', 0, 'n', 0, 'longest', 0)"),
        lambda acc, x: F.struct(
            F.greatest(acc.upto, x.e).alias("upto"),
            F.when(x.s > acc.upto, x.s).otherwise(acc.open).alias("open"),
            (acc.chars + F.greatest(x.e - F.greatest(x.s, acc.upto), F.lit(0))).alias("chars"),
            (acc.n + F.when(x.s > acc.upto, 1).otherwise(0)).alias("n"),
            F.greatest(acc.longest, F.greatest(acc.upto, x.e) - F.when(x.s > acc.upto, x.s).otherwise(acc.open)).alias("longest"),
        ),
    )
    found = packed.select("tid", merge.alias("m")).select("tid", "m.chars", "m.n", "m.longest")
    sizes = (
        texts.where(F.col("text").isNotNull() & F.col("record").isNotNull())
        .select(F.col("record").cast("string").alias("record"), F.length("text").alias("n_chars"), F.xxhash64(F.col("record").cast("string"), "text").alias("tid"))
        .dropDuplicates(["tid"])
    )
    return (
        sizes.join(found, "tid", "left")
        .groupBy("record")
        .agg(
            F.sum("n_chars").alias("n_chars"),
            F.coalesce(F.sum("chars"), F.lit(0)).alias("shared_chars"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_spans"),
            F.coalesce(F.max("longest"), F.lit(0)).alias("longest"),
        )
        .withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))
    )


def record_texts(notes: DataFrame, generations: DataFrame) -> DataFrame:
    """(record, text): a note's Note; a generation's generation and each memorized_spans.text, every one by itself."""
    own = notes.select(F.col("record_uid").alias("record"), F.col("Note").alias("text"))
    made = generations.select(F.col("record_uid").alias("record"), F.col("generation").alias("text"))
    quoted = generations.select(F.col("record_uid").alias("record"), F.explode("memorized_spans.text").alias("text"))
    return own.unionByName(made).unionByName(quoted)
