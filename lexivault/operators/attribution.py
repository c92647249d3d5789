"""Where regions of generated text stand in the corpus.

Regions are a stated query set that is searched for in every note. Their different texts, the needles, go to
each task as one index: of each needle ``STEP_BYTES`` windows of ``WINDOW`` bytes in a row, the rarest there are. Wherever a needle
stands in a text, one of them begins at a multiple of ``STEP_BYTES``, so only those places are hashed and looked up, a whole batch of
notes at once, and only where one is known the needle itself is compared. Needles of fewer bytes are looked up at every place, those
under ``NARROW`` bytes by an automaton (Aho-Corasick). That finds all occurrences of all of them, of any length, in one pass
over a note, so no note is shuffled. The index is built only from seeds of measured size (the first ``SEED`` characters of the needles), at
most ``MAX_NEEDLES`` characters, and needles of at most ``WHOLE`` times that. Beyond that, needles of some words are joined with the corpus by their rarest word
gram and verified, and those too short for one are searched for block after block of that size. All
ways give the same rows.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivault.functions.text import offsets, strip, words
from lexivault.runtime import spread, stage

ANCHOR = 3
MAX_NEEDLES = 4_000_000  # characters of an automaton, some 60 bytes each in a task's memory
SEED = 32  # characters of a needle that count for the size of an index
WHOLE = 16  # characters of needles, as strings, for one of their seeds
WINDOW, STEP_BYTES, NARROW = 16, 8, 8  # bytes of a window, from one to the next, and of a window at every place
TABLE_BITS, COUNT_BITS = 24, 20  # of the table that tells hashes of no window, and of the one that counts them among needles
MAX_PLACES, MAX_PAIRS = 1_000_000, 1_000_000  # places that are hashed, and pairs of a place and a needle that are compared, at once
STEP = 16  # prefixes of a multiple of this are searched for first, then those between
LEAST = 6  # shorter prefixes stand nearly everywhere and are looked up one by one
FEW = 4096  # pairs of a text and a note that are compared one by one
MAX_SMALL = 256  # needles under NARROW that are looked up one by one
MAX_PREFIXES = 4096  # characters of a text whose prefixes are words of an automaton; longer texts are searched for one by one
MAX_OWN = 200_000  # pairs of a needle and a key of its own that are broadcast
MAX_PARTS, MAX_NOTES = 400_000, 4_000_000  # characters of parts and of notes that meet in one row
SEPARATOR = "\ud800"  # in no valid text
MIN_PIECE = 30
MAX_DEPTH = 4


def span_hits(records: DataFrame, spans: str = "spans", stripped: bool = True) -> DataFrame:
    """(id, s, e): all, also overlapping, occurrences in ``text`` of each of the record's span texts.

    ``stripped`` takes spans without outer white space. Null and empty spans have no occurrences.
    """
    each = spread(records.where(F.size(spans) > 0)).select("id", "text", F.explode(spans).alias("t"))
    needle = strip(F.col("t")) if stripped else F.col("t")
    return each.select("id", "text", needle.alias("t")).where("t <> ''").distinct().select("id", F.length("t").alias("n"), F.explode(offsets(F.col("text"), F.col("t"))).alias("s")).select("id", "s", (F.col("s") + F.col("n")).alias("e"))


def needle_of(text: Column | str) -> Column:
    """The id of a needle: a hash of its text."""
    return F.xxhash64(text)


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _hashes(data: np.ndarray, width: int, step: int) -> np.ndarray:
    """Of the windows of width bytes (NARROW, or WINDOW of two such words) that begin at multiples of step: the i-th at i * step."""
    count = max(0, (len(data) - width) // step + 1)
    at = lambda shift: np.ndarray((count,), "<u8", data, shift, (step,))
    if not count:
        return np.zeros(0, np.uint64)
    h = at(0) * _MIX[0]
    for shift in range(8, width, 8):
        h = (h ^ (h >> np.uint64(29))) * _MIX[1] + at(shift) * _MIX[0]
    return (h ^ (h >> np.uint64(32))) * _MIX[1]


class _Windows:
    """Windows of needles of at least width + step - 1 bytes, step of each: the rarest in a row among the needles' own."""

    def __init__(self, which: np.ndarray, needles: list[bytes], width: int, step: int) -> None:
        self.width, self.step = width, step
        sizes = np.array([len(needles[i]) for i in which], np.int64)
        blocks = np.split(np.arange(len(which)), np.flatnonzero(np.diff(np.cumsum(sizes) // MAX_PLACES)) + 1)

        def hashed(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The needles of a block one after another: hashes of all windows, how many places are left to each one's needle, starts of needles."""
            ends = np.cumsum(sizes[block])
            data = np.frombuffer(b"".join([needles[which[k]] for k in block]), np.uint8)
            h = _hashes(data, width, 1)
            return h, (np.repeat(ends, sizes[block]) - np.arange(len(data)))[: len(h)], ends - sizes[block]

        shift = np.uint64(64 - COUNT_BITS)
        often = np.zeros(1 << COUNT_BITS, np.int64)
        for block in blocks:
            h, left, _ = hashed(block)
            often += np.bincount((h[left >= width] >> shift).astype(np.int64), minlength=1 << COUNT_BITS)
        grams, offsets_ = np.zeros((len(which), step), np.uint64), np.zeros((len(which), step), np.int64)
        for block in blocks:
            h, left, starts = hashed(block)
            total = np.concatenate(([0], np.cumsum(often[(h >> shift).astype(np.int64)])))
            row = total[step:] - total[:-step]
            row[left[: len(row)] < width + step - 1] = np.iinfo(np.int32).max
            best = np.minimum.reduceat((np.minimum(row, np.iinfo(np.int32).max) << 32) + np.arange(len(row)), starts) & 0xFFFFFFFF
            at = best[:, None] + np.arange(step)
            grams[block], offsets_[block] = h[at], at - starts[:, None]
        order = np.argsort(grams.ravel(), kind="stable")
        self.needle, self.offset = np.repeat(which, step)[order], offsets_.ravel()[order]
        self.grams, self.first, self.count = np.unique(grams.ravel()[order], return_index=True, return_counts=True)
        self.known = np.zeros(1 << TABLE_BITS, bool)
        self.known[(self.grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def places(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(needle, start): where the needles may stand in data, about MAX_PAIRS at a time."""
        for begin in range(0, len(data), MAX_PLACES * self.step):
            h = _hashes(data[begin : begin + (MAX_PLACES - 1) * self.step + self.width], self.width, self.step)
            at = np.flatnonzero(self.known[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            h = h[at]
            gram = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
            same = self.grams[gram] == h
            at, gram = begin + at[same] * self.step, gram[same]
            ends = np.cumsum(self.count[gram])
            begun = 0
            while begun < len(at):
                done = ends[begun - 1] if begun else 0
                stop = max(begun + 1, int(np.searchsorted(ends, done + MAX_PAIRS, "right")))
                n = self.count[gram[begun:stop]]
                entry = np.repeat(self.first[gram[begun:stop]] - (ends[begun:stop] - n - done), n) + np.arange(n.sum())
                yield self.needle[entry], np.repeat(at[begun:stop], n) - self.offset[entry]
                begun = stop


class _Search:
    """All occurrences of needles in batches of texts."""

    def __init__(self, needles: list[tuple[int, str]], first: bool) -> None:
        self.ids = np.array([i for i, _ in needles], np.int64)
        self.needles = [t.encode("utf-8", "surrogatepass") for _, t in needles]
        self.sizes = np.array([len(t) for t in self.needles], np.int64)
        self.first = first
        wide = self.sizes >= WINDOW + STEP_BYTES - 1
        narrow = (self.sizes >= NARROW) & ~wide
        self.windows = [_Windows(np.flatnonzero(m), self.needles, w, s) for m, w, s in ((wide, WINDOW, STEP_BYTES), (narrow, NARROW, 1)) if m.any()]
        self.last = np.array([int.from_bytes(t[-NARROW:].rjust(NARROW, b"\0"), "little") for t in self.needles], np.uint64)
        # What stands at nearly every place is looked up once a note where one place is enough.
        tiny = np.flatnonzero(self.sizes < NARROW).tolist()
        self.small = tiny if first and len(tiny) <= MAX_SMALL else []
        self.automaton = None
        if len(tiny) > len(self.small):
            self.automaton = ahocorasick.Automaton()
            for i in tiny:
                self.automaton.add_word(needles[i][1], i)
            self.automaton.make_automaton()

    def _tiny(self, raw: bytes, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """(needle, start) of needles under NARROW bytes."""
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            for i in self.small:
                if (at := raw.find(self.needles[i], s, e)) >= 0:
                    yield i, at
            if self.automaton:
                text = raw[s:e].decode("utf-8", "surrogatepass")
                plain = len(text) == e - s
                for end, i in self.automaton.iter(text):
                    yield i, s + (end + 1 if plain else len(text[: end + 1].encode("utf-8", "surrogatepass"))) - int(self.sizes[i])

    def run(self, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, needle, position in characters), in order; the k-th text is raw[bounds[k] : bounds[k + 1]]."""
        data = np.frombuffer(raw, np.uint8)
        found = [np.array(list(self._tiny(raw, bounds)), np.int64).reshape(-1, 2)] if self.small or self.automaton else []
        for windows in self.windows:
            for needle, start in windows.places(data):
                end = start + self.sizes[needle]
                text = np.searchsorted(bounds, start, "right") - 1
                inside = (start >= bounds[0]) & (end <= bounds[np.minimum(text + 1, len(bounds) - 1)])
                needle, start, end = needle[inside], start[inside], end[inside]
                tail = np.ascontiguousarray(data[(end - NARROW)[:, None] + np.arange(NARROW)]).view("<u8").ravel()
                near = np.flatnonzero(tail == self.last[needle])
                same = [k for k, i, s, e in zip(near.tolist(), needle[near].tolist(), start[near].tolist(), end[near].tolist()) if raw[s:e] == self.needles[i]]
                found.append(np.stack((needle[same], start[same]), 1))
        needle, start = np.concatenate(found).T if found else np.zeros((2, 0), np.int64)
        text = np.searchsorted(bounds, start, "right") - 1
        order = np.lexsort((start, needle, text))
        text, needle, start = text[order], needle[order], start[order]
        inner = np.flatnonzero((data & 0xC0) == 0x80)  # bytes that begin no character
        chars = lambda at: at - np.searchsorted(inner, at)
        return text, needle, chars(start) - chars(bounds[text])


_built: dict[str, _Search] = {}  # the last one that this worker process built


def _search(name: str, needles: list[tuple[int, str]], first: bool) -> _Search:
    """Built once in a worker process, whatever the number of its tasks."""
    if name not in _built:
        _built.clear()
        _built[name] = _Search(needles, first)
    return _built[name]


def _by_windows(needles: DataFrame, notes: DataFrame, first: bool, keep: Sequence[str] = ()) -> DataFrame:
    """(needle, row_idx, keep, positions): all notes against needles (needle, text) that fit one index."""
    shared = notes.sparkSession.sparkContext.broadcast([tuple(r) for r in needles.select("needle", "text").collect()])
    name = uuid.uuid4().hex
    carried = ["row_idx", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(name, shared.value, first)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").cast(pa.large_string())
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = texts.buffers()[2].slice(bounds[0], bounds[-1] - bounds[0]).to_pybytes() if bounds[-1] else b""
            text, needle, position = search.run(raw, bounds - bounds[0])
            opens = np.flatnonzero(np.diff(text, prepend=-1) | np.diff(needle, prepend=-1))
            kept = [batch.column(c).take(pa.array(text[opens])) for c in carried]
            ends = np.arange(len(opens) + 1) if first else np.append(opens, len(text))
            positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(position[opens] if first else position, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(search.ids[needle[opens]]), *kept, positions], ["needle", *carried, "positions"])

    kinds = dict(notes.dtypes)
    return notes.select("text", *carried).mapInArrow(run, f"needle long, {', '.join(f'{c} {kinds[c]}' for c in carried)}, positions array<int>")


def _grams(df: DataFrame, keep: list[str], k: int, inner: bool) -> DataFrame:
    """keep and gram: the different word grams of a text, without the outer words where they may be cut (inner)."""
    w = F.transform(words("text"), lambda x: F.xxhash64(x))
    w = F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))) if inner else w
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.xxhash64(F.slice("w", i, k))))
    return df.withColumn("w", w).where(F.size("w") >= k).select(*keep, F.explode(grams).alias("gram"))


def _by_grams(needles: DataFrame, notes: DataFrame, k: int) -> DataFrame:
    """(needle, row_idx, positions) of needles with an inner word gram: those whose rarest one a note holds are verified in it."""
    grams = stage(_grams(needles, ["needle"], k, True), "needle-grams")
    near = stage(_grams(notes, ["row_idx"], k, False).join(grams.select("gram").distinct(), "gram", "left_semi"), "note-grams")
    seen = near.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = grams.join(seen, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0").select("needle", "g.gram")
    pairs = near.join(rarest, "gram").select("row_idx", "needle").join(needles, "needle").select("row_idx", "needle", F.col("text").alias("wanted"))
    found = notes.select("row_idx", "text").join(pairs, "row_idx")
    return found.select("needle", "row_idx", offsets(F.col("text"), F.col("wanted")).alias("positions")).where(F.size("positions") > 0)


def occurrences(needles: DataFrame, notes: DataFrame, k: int = ANCHOR, max_needles: int = MAX_NEEDLES, first: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """(needle, row_idx, keep, positions): every note that holds a needle, with all its offsets, overlapping ones too; ``first`` asks for no more than the least.

    needles: (text), notes: (row_idx, text, keep). Equal needles are one; empty and null texts have no occurrences.
    """
    once = stage(needles.where("text <> ''").select(needle_of("text").alias("needle"), "text").dropDuplicates(["needle"]), "needles")
    notes = spread(notes.where("text is not null").select("row_idx", "text", *keep))
    n = F.length("text")
    seeds, size = once.agg(F.coalesce(F.sum(F.least(n, F.lit(SEED))), F.lit(0)), F.coalesce(F.sum(n), F.lit(0))).first()
    if seeds <= max_needles and size <= WHOLE * max_needles:
        return _by_windows(once, notes, first, keep)
    worth = F.size(words("text")) >= k + 2
    out = _by_grams(once.where(worth), notes, k)
    out = out.join(notes.select("row_idx", *keep), "row_idx").select("needle", "row_idx", *keep, "positions") if keep else out
    short = once.where(~worth)
    blocks = -(-short.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0] // max_needles)
    for b in range(blocks):
        out = out.unionByName(_by_windows(short.where(F.pmod("needle", F.lit(blocks)) == b), notes, first, keep))
    return out


def corpus_occurrences(regions: DataFrame, notes: DataFrame, k: int = ANCHOR, max_needles: int = MAX_NEEDLES) -> DataFrame:
    """(region, row_idx, position): every occurrence, overlapping ones too, of each region's text in every note.

    regions: (region, text), notes: (row_idx, text). Empty and null texts have none.
    """
    found = occurrences(regions.select("text"), notes, k, max_needles)
    named = regions.where("text <> ''").select("region", needle_of("text").alias("needle"))
    return found.join(named, "needle").select("region", "row_idx", F.explode("positions").alias("position"))


def holders(needles: DataFrame, notes: DataFrame, k: int = ANCHOR, max_needles: int = MAX_NEEDLES) -> DataFrame:
    """(needle, note_key, n_notes, row_idx, position): keys with a note that holds a needle, how many of theirs do, and, where it
    is a key of the needle's own, the one of greatest (note_date, row_idx), a null date the least, with its first offset.

    needles: (key, text), notes: (row_idx, key, note_date, text). Short needles stand in nearly every note: what is found is counted
    by hash, and only what is of the needle's own key is put in order.
    """
    own = needles.where("text <> '' and key is not null").select(needle_of("text").alias("needle"), F.col("key").alias("note_key")).distinct()
    own = stage(own, "own-keys")
    found = stage(occurrences(needles.select("text"), notes, k, max_needles, first=True, keep=("key", "note_date")).withColumnRenamed("key", "note_key"), "found")
    counts = found.groupBy("needle", "note_key").agg(F.count("*").alias("n_notes"))
    best = F.max(F.struct(F.col("note_date").isNotNull().alias("dated"), "note_date", "row_idx", F.array_min("positions").alias("position"))).alias("b")
    mine = found.join(F.broadcast(own) if own.count() <= MAX_OWN else own, ["needle", "note_key"], "left_semi")
    first = mine.groupBy("needle", "note_key").agg(best).select("needle", "note_key", "b.row_idx", "b.position")
    return counts.join(first, ["needle", "note_key"], "left")


def located(regions: DataFrame, found: DataFrame) -> DataFrame:
    """regions (region, key, text, ...) with k_corpus and k_within (keys whose notes hold the text, notes of its own key that
    do), and row_idx and position of the note it is attributed to, null without one. ``found`` is what ``holders`` gives.
    """
    named = regions.withColumn("needle", needle_of("text"))
    keys = found.groupBy("needle").agg(F.count("*").alias("k_corpus"))
    own = found.select("needle", F.col("note_key").alias("key"), F.col("n_notes").alias("k_within"), "row_idx", "position")
    out = named.join(keys, "needle", "left").join(own, ["needle", "key"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*regions.columns, zero("k_corpus"), zero("k_within"), "row_idx", "position")


def _longest(piece: str, text: str, from_start: bool) -> int:
    """Length of the longest prefix (or suffix) of piece that text contains; containment only shrinks with length."""
    low, high = 0, len(piece)
    while low < high:
        mid = (low + high + 1) // 2
        if (piece[:mid] if from_start else piece[len(piece) - mid :]) in text:
            low = mid
        else:
            high = mid - 1
    return low


def _longest_seen(texts: list[str], lengths: list[range], joined: str) -> list[int]:
    """For each text the longest prefix of the lengths asked for that stands in joined, 0 for none: one pass over joined for all of them."""
    words = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    paths = []
    for text, asked in zip(texts, lengths):
        path = []
        for n in asked:
            if (word := words.get(text[:n], 0)) == 0:
                words.add_word(text[:n], word := len(words) + 1)
            path.append(word)
        paths.append(path)
    if not len(words):
        return [0] * len(texts)
    words.make_automaton()
    seen = {word for _, word in words.iter(joined)}
    # Where a longer prefix stands, a shorter one does too.
    return [asked[n - 1] if (n := bisect_left(path, True, key=lambda word: word not in seen)) else 0 for path, asked in zip(paths, lengths)]


def _reaches(texts: list[str], notes: list[str], from_start: bool) -> list[int]:
    """Length of the longest prefix (or suffix) of each text that one of the notes contains; many notes are read twice, whatever the number of texts."""
    if len(texts) * len(notes) <= FEW:
        return [max(_longest(t, n, from_start) for n in notes) for t in texts]
    joined = SEPARATOR.join(notes)
    if not from_start:
        texts, joined = [t[::-1] for t in texts], joined[::-1]
    short = [t if len(t) <= MAX_PREFIXES else "" for t in texts]
    coarse = _longest_seen(short, [range(STEP, len(t) + 1, STEP) for t in short], joined)
    fine = _longest_seen(short, [range(max(n + 1, LEAST), min(n + STEP, len(t) + 1)) for n, t in zip(coarse, short)], joined)
    return [_longest(t, joined, True) if t != s else max(c, f) or _longest(t[: LEAST - 1], joined, True) for t, s, c, f in zip(texts, short, coarse, fine)]


def _splits(texts: list[str], notes: list[str], min_piece: int, max_depth: int) -> list[tuple[int, int, int, bool, str]]:
    """(index of text, start, end, attributed, split_origin) of the parts of texts that notes of their key explain; see ``split_regions``."""
    out: list[tuple[int, int, int, bool, str]] = []
    parts = [(i, 0, t, False) for i, t in enumerate(texts)]
    for depth in range(max_depth + 2):
        if not parts:
            break
        wanted = [t for _, _, t, _ in parts]
        heads, tails = (_reaches(wanted, notes, start) if notes else [0] * len(parts) for start in (True, False))
        left = []
        for (i, at, text, tiny), head, tail in zip(parts, heads, tails):
            n = len(text)
            kept = min(tail, n - head)
            head2, tail2 = (head if head >= min_piece else 0), (kept if kept >= min_piece else 0)
            origin = lambda other: "split_attributed_tiny" if tiny and other == "split_attributed" else "split_residual_tiny" if tiny else other if depth else "original"
            if head == n:
                out.append((i, at, at + n, True, origin("split_attributed")))
            elif tiny or depth >= max_depth or n < min_piece or not (head or tail):
                out.append((i, at, at + n, False, origin("split_residual")))
            elif not (head2 or tail2):  # splitting again would find the same
                out.append((i, at, at + n, False, "split_residual"))
            else:
                if head2:
                    out.append((i, at, at + head2, True, "split_attributed"))
                if tail2:
                    out.append((i, at + n - tail2, at + n, True, "split_attributed"))
                if rest := n - head2 - tail2:
                    left.append((i, at + head2, text[head2 : head2 + rest], rest < min_piece))
        parts = left
    return out


def _more(df: DataFrame, column: str, most: int, name: str) -> DataFrame:
    """(key, name): of keys of more than about most characters, by how many rows they take more than one; they are few, at most all characters by most."""
    return F.broadcast(stage(df.groupBy("key").agg((F.sum(F.length(column)) / most).cast("long").alias(name)).where(f"{name} > 0"), name.replace("_", "-")))


def _packed(parts: DataFrame, struct: Sequence[str], most: int) -> DataFrame:
    """(key, parts): a key's parts together, in rows of about most characters."""
    chunk = F.pmod(F.xxhash64(struct[0]), F.coalesce("more_parts", F.lit(0)) + 1).alias("chunk")
    return parts.join(_more(parts, "text", most, "more_parts"), "key", "left").groupBy("key", chunk).agg(F.collect_list(F.struct(*struct)).alias("parts")).drop("chunk")


def _split_whole(regions: DataFrame, notes: DataFrame, min_piece: int, max_depth: int, most: int = MAX_PARTS) -> DataFrame:
    """The parts of regions whose keys' notes travel in one row: such a row has all there is to know, so no rounds are needed."""
    held = notes.groupBy("key").agg(F.collect_set("note").alias("notes"))
    pairs = _packed(regions, ["region", "gen_start", "text"], most).join(held, "key", "left").select("parts", "notes")
    kind = dict(regions.dtypes)["region"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for wanted, own in zip(batch["parts"], batch["notes"]):
                for i, s, e, attributed, origin in _splits([x["text"] for x in wanted], [] if own is None else list(own), min_piece, max_depth):
                    rows.append((wanted[i]["region"], wanted[i]["gen_start"] + s, wanted[i]["gen_start"] + e, attributed, origin))
            yield pd.DataFrame(rows, columns=["region", "gen_start", "gen_end", "attributed", "split_origin"])

    return pairs.mapInPandas(run, f"region {kind}, gen_start long, gen_end long, attributed boolean, split_origin string")


def _sliced(notes: DataFrame, slices: DataFrame) -> DataFrame:
    """(key, slice, notes): the notes of keys of slices (key, more_notes), in so many rows more than one."""
    at = F.pmod(F.xxhash64("note"), F.col("more_notes") + 1).alias("slice")
    return notes.join(slices, "key").groupBy("key", at).agg(F.collect_set("note").alias("notes"))


def _reach(parts: DataFrame, held: DataFrame, slices: DataFrame, most: int = MAX_PARTS) -> DataFrame:
    """(part, holds, head, tail): whether a note of the part's key contains it, and its longest prefix and suffix in any one.

    Each row of notes, held (key, slice, notes), meets the key's parts, in rows of about most characters. A row's notes are read once for all
    its parts, so that the work grows with both, not with their product.
    """
    packed = _packed(parts, ["part", "text"], most).join(slices, "key").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("more_notes"))).alias("slice"), "parts")
    # Rows of notes are few and much work each: as many partitions as named, not as few as their bytes need.
    wide = held.repartition(4 * held.sparkSession.sparkContext.defaultParallelism, "key", "slice")
    pairs = wide.join(packed, ["key", "slice"]).select("notes", "parts")
    kind = dict(parts.dtypes)["part"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for own, wanted in zip(batch["notes"], batch["parts"]):
                own, texts = list(own), [x["text"] for x in wanted]
                for x, head, tail in zip(wanted, _reaches(texts, own, True), _reaches(texts, own, False)):
                    rows.append((x["part"], head == len(x["text"]), head, tail))
            yield pd.DataFrame(rows, columns=["part", "holds", "head", "tail"])

    found = pairs.mapInPandas(run, f"part {kind}, holds boolean, head int, tail int")
    return found.groupBy("part").agg(F.max("holds").alias("holds"), F.max("head").alias("head"), F.max("tail").alias("tail"))


def split_regions(regions: DataFrame, notes: DataFrame, min_piece: int = MIN_PIECE, max_depth: int = MAX_DEPTH, most_notes: int = MAX_NOTES) -> DataFrame:
    """(region, gen_start, gen_end, attributed, split_origin) for every part of every region.

    regions: (region, key, gen_start, text), notes: (key, note). A region that a note of its key contains is
    ``original``. Else its longest prefix and suffix that notes contain, if of min_piece, are parts by
    themselves (``split_attributed``) and what lies between is split again, up to max_depth; what remains is
    ``split_residual``; a middle shorter than min_piece is looked up once (``..._tiny``). Where prefix and
    suffix overlap, the suffix is shortened before short ones are given up. Regions of keys with at most about
    most_notes characters of notes are split in one pass; of other keys, all open parts of all regions take one round
    together, over notes that are gathered once. Empty and null regions have no parts.
    """
    kind = dict(regions.dtypes)["region"]
    asked = regions.where("text <> ''").select("region", "key", F.col("gen_start").cast("long").alias("gen_start"), "text")
    # The notes of regions' keys are read, not the corpus.
    notes = stage(notes.where("note is not null").join(asked.select("key").distinct(), "key", "left_semi"), "own-notes")
    slices = _more(notes, "note", most_notes, "more_notes")
    keyless = asked.where("key is null").select("region", "gen_start", (F.col("gen_start") + F.length("text")).alias("gen_end"), F.lit(False).alias("attributed"), F.lit("original").alias("split_origin"))
    done: list[DataFrame] = [_split_whole(asked.where("key is not null").join(slices, "key", "left_anti"), notes.join(slices, "key", "left_anti"), min_piece, max_depth), keyless]
    parts = asked.join(slices, "key", "left_semi").withColumnRenamed("gen_start", "at").withColumn("tiny", F.lit(False))
    for depth in range(max_depth + 2):
        open_ = stage(parts.withColumn("part", F.concat_ws("|", F.col("region").cast("string"), F.col("at").cast("string"), F.length("text").cast("string"))), f"parts-{depth}")
        if open_.isEmpty():
            break
        if not depth:
            held = stage(_sliced(notes, slices), "held")
        reach = _reach(open_.select("part", "key", "text"), held, slices)
        n = F.length("text")
        got = open_.join(reach, "part", "left").select("*", n.alias("n")).fillna({"holds": False, "head": 0, "tail": 0})
        tail = F.least("tail", F.col("n") - F.col("head"))
        got = stage(
            got.withColumn("tail2", F.when(tail >= min_piece, tail).otherwise(0)).withColumn("head2", F.when(F.col("head") >= min_piece, F.col("head")).otherwise(0)),
            f"reach-{depth}",
        )
        part = lambda df, s, e, ok, origin: df.select("region", F.col("at") + s, F.col("at") + e, F.lit(ok), origin).toDF("region", "gen_start", "gen_end", "attributed", "split_origin")
        named = lambda kept, other: F.when(F.col("tiny"), f"{kept if kept != 'original' else 'split_attributed'}_tiny").otherwise(other if depth else "original")
        zero = F.lit(0)
        done.append(part(got.where("holds"), zero, F.col("n"), True, named("split_attributed", "split_attributed")))
        lost = ~F.col("holds")
        nothing = (F.col("head") == 0) & (F.col("tail") == 0)
        ends = lost & (F.col("tiny") | F.lit(depth >= max_depth) | (F.col("n") < min_piece) | nothing)
        done.append(part(got.where(ends), zero, F.col("n"), False, named("split_residual", "split_residual")))
        # Without an end of min_piece, splitting again would find the same.
        stuck = lost & ~ends & (F.col("head2") == 0) & (F.col("tail2") == 0)
        done.append(part(got.where(stuck), zero, F.col("n"), False, F.lit("split_residual")))
        cut = got.where(lost & ~ends & ~stuck)
        done.append(part(cut.where("head2 > 0"), zero, F.col("head2"), True, F.lit("split_attributed")))
        done.append(part(cut.where("tail2 > 0"), F.col("n") - F.col("tail2"), F.col("n"), True, F.lit("split_attributed")))
        left = F.col("n") - F.col("head2") - F.col("tail2")
        parts = cut.where(left > 0).select("region", "key", (F.col("at") + F.col("head2")).alias("at"), F.substring("text", F.col("head2") + 1, left).alias("text"), (left < min_piece).alias("tiny"))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.withColumn("region", F.col("region").cast(kind))


def pieces(regions: DataFrame, notes: DataFrame, min_piece: int = MIN_PIECE, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Regions cut into the parts that notes explain, each with its note and how often it recurs.

    regions: (region, key, gen_start, text), notes: (row_idx, key, note_date, text). Returns (region, piece, key,
    gen_start, gen_end, text, split_origin, attributed, k_corpus, k_within, row_idx, position), written once.
    """
    # Most regions are whole in some note of their patient: the pass that counts holders of all regions tells which, only the rest is split.
    held = stage(holders(regions, notes), "holders")
    named = regions.where("text <> ''").withColumn("needle", needle_of("text"))
    own = held.select("needle", F.col("note_key").alias("key"))
    start = F.col("gen_start").cast("long")
    kept = named.join(own, ["needle", "key"], "left_semi").select("region", start.alias("gen_start"), (start + F.length("text")).alias("gen_end"), F.lit(True).alias("attributed"), F.lit("original").alias("split_origin"))
    rest = stage(named.join(own, ["needle", "key"], "left_anti").select(*regions.columns), "not-whole")
    parts = kept.unionByName(split_regions(rest, notes.select("key", F.col("text").alias("note")), min_piece, max_depth))
    whole = regions.select("region", "key", F.col("gen_start").alias("at"), F.col("text").alias("whole"))
    cut = stage(
        parts.join(whole, "region").select(
            "region", F.concat_ws("+", "region", (F.col("gen_start") - F.col("at")).cast("string")).alias("piece"), "key", "gen_start", "gen_end", F.expr("substring(whole, cast(gen_start - at + 1 as int), cast(gen_end - gen_start as int))").alias("text"), "split_origin"
        ),
        "pieces",
    )
    new = stage(cut.where("split_origin <> 'original'").select(needle_of("text").alias("needle"), "key", "text").join(named.select("needle").distinct(), "needle", "left_anti"), "new-texts")
    found = held if new.isEmpty() else held.unionByName(holders(new, notes))
    out = located(cut, found)
    return stage(out.withColumn("attributed", F.col("row_idx").isNotNull()), "located")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of greatest order per key; ties go to the order's later columns, nulls come last."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
