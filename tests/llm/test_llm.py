"""Operators of the subpackage against brute force, exact round trips and held-out accuracy."""

import itertools
import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from lexivault.llm import consensus, packing, pii, repetition, shared_spans, tokenizer, truncation  # noqa: E402

# ---- long spans shared between records ----------------------------------------------------------------


def brute_pairs(texts, n):
    grams = {}
    for record, text in texts:
        if record is not None and text:
            for i in range(len(text) - n + 1):
                grams.setdefault(text[i : i + n], set()).add(record)
    return {p for rs in grams.values() for p in itertools.combinations(sorted(rs), 2)}


def mosaic(rng, k, alphabet="abcdé😀 "):
    base = ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(8)]
    out = []
    for i in range(k):
        parts = [b[s : s + rng.randrange(5, 45)] for b in rng.choices(base, k=4) for s in [rng.randrange(20)]]
        out.append((f"r{i % (k * 3 // 4)}", "".join(parts)))
    return out


@pytest.mark.parametrize(("n", "k", "most", "seed"), [(30, 15, 1 << 20, 1), (25, 10, 1 << 20, 2), (25, 10, 400, 2), (20, 8, 1, 3), (40, 39, 100, 4)])
def test_sharing_pairs(spark, n, k, most, seed):
    """With a small ``most`` prefix groups are split by longer prefixes, down to sets without a tree; all ways are exact."""
    rng = random.Random(seed)
    texts = mosaic(rng, 60) + [("x", None), ("y", ""), ("z", "ab"), (None, "a" * 99), ("p", "q" * 70), ("o", "q" * 50), ("p", "q" * 70)]
    df = spark.createDataFrame([(*t, 1) for t in texts], "record string, text string, tid int")
    got = [tuple(r) for r in shared_spans.sharing_pairs(df, n, k, most).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs(texts, n)


@pytest.mark.parametrize("most", [1 << 20, 300, 1])
def test_shared_extent(spark, most):
    rng = random.Random(9)
    texts = list(dict(mosaic(rng, 40)).items()) + [("e", "")]
    n = 20
    grams = {}
    for record, text in texts:
        for i in range(len(text) - n + 1):
            grams.setdefault(text[i : i + n], set()).add(record)
    want = {r: sum(any(len(grams[t[i : i + n]]) > 1 for i in range(max(0, p - n + 1), min(p, len(t) - n) + 1)) for p in range(len(t))) for r, t in texts}
    df = spark.createDataFrame(texts, "record string, text string")
    got = {r["record"]: r for r in shared_spans.shared_extent(df, n, 10, most).collect()}
    assert {r: x["shared_chars"] for r, x in got.items()} == want
    assert got["e"]["share"] == 0.0


def test_sharing_copies_and_empty(spark):
    copies = [(f"c{i:03}", "lorem ipsum " * 5 + "end") for i in range(40)]
    assert shared_spans.sharing_pairs(spark.createDataFrame(copies, "record string, text string"), 30, 15).count() == 40 * 39 // 2
    assert shared_spans.sharing_pairs(spark.createDataFrame([], "record string, text string"), 30, 15).count() == 0


def test_sharing_links(spark, monkeypatch):
    """A set of n records has n - 1 links, and a node names each leaf once, not each pair."""
    n = 4096
    left = ["x" * 100] * n
    ((leaves, reach, depth),) = list(shared_spans._sets(left, [200] * (n - 1), list(range(n)), list(range(n)), 200))
    assert leaves == list(range(n)) and set(reach) == {100} and depth == 200
    copies = [(f"c{i:03}", "lorem ipsum " * 5 + "end") for i in range(40)] + [("other", "dolor " * 30)]
    df = spark.createDataFrame(copies, "record string, text string")
    links = shared_spans.sharing_links(df, 30, 15)
    assert sorted(tuple(r) for r in links.select("record", "representative").distinct().collect()) == [(f"c{i:03}", "c000") for i in range(1, 40)]
    monkeypatch.setattr(shared_spans, "BLOCK", 7)  # sets are paired in blocks
    assert shared_spans.sharing_pairs(df, 30, 15).count() == 40 * 39 // 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=4), st.integers(0, 3), st.integers(0, 3)), min_size=2, max_size=9))
def test_reach_to_the_left(leaves):
    back = [t for t, _, _ in leaves]
    a = [min(x, y) for _, x, y in leaves]
    b = [max(x, y) for _, x, y in leaves]
    common = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    want = [max([common(back[i], back[j]) for j in range(len(back)) if j != i and not a[i] == b[i] == a[j] == b[j]], default=-1) for i in range(len(back))]
    assert shared_spans._reach(list(range(len(back))), back, a, b) == want


def test_long_text_is_cut_into_pieces(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdef") for _ in range(5000))
    find = shared_spans._Anchors(40, 20)
    _, whole, _ = find([text])
    monkeypatch.setattr(shared_spans, "_PIECE", 300)
    pieces = set()
    for _, offs, parts in shared_spans._pieces([text], 40):
        owner, off, _ = find(parts)
        pieces |= set((off + np.asarray(offs)[owner]).tolist())
    assert pieces == set(whole.tolist())


# ---- repetition -----------------------------------------------------------------------------------------


def brute_repeated(text, n):
    words = [w.lower() for w in re.findall(r"[^\W\d_]+", text or "")]
    seen, out = set(), set()
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if g in seen:
            out |= set(range(i, i + n))
        seen.add(g)
    return len(out), len(words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab cÉ1.\n", max_size=60), max_size=8), st.integers(1, 5))
def test_repeated_words(texts, n):
    block = repetition._Block([*texts, None])
    got = block.by_doc(block.repeated(n)).astype(int)
    assert [(g, c) for g, c in zip(got, block.counts)] == [brute_repeated(t, n) for t in [*texts, None]]


def test_repetitive(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 30))) for _ in range(80)]
    rows = [(f"g{i}", t) for i, t in enumerate(texts)] + [("g0", texts[0]), ("n", None), ("b", " 12 "), (None, "a b c a b c"), ("long", "one two three four five six " * 40_000)]
    df = spark.createDataFrame(rows, "id string, text string")
    want = {i for i, t in rows if i and (x := brute_repeated(t, 3))[0] * 3 >= x[1] and x[0]}
    got = [r[0] for r in repetition.repetitive(df, "id", "text", 3).collect()]
    assert sorted(got) == sorted(want)
    shares = {r["id"]: r for r in repetition.repetition(df, "id", "text", (2, 3)).collect()}
    assert shares["n"]["repeated_share_3"] == 0 and shares["long"]["repeated_share_3"] > 0.99
    assert repetition.repetition(df.limit(0), "id", "text").count() == 0


# ---- encoding --------------------------------------------------------------------------------------------

VOCABULARY = Path(tokenizer.VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary files")


@pytest.fixture(scope="module")
def coder():
    return tokenizer.transducer(str(VOCABULARY))


@pytest.fixture(scope="module")
def reference():
    import tokenizers

    t = tokenizers.Tokenizer.from_file(str(VOCABULARY.with_suffix(".json")))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def ids_of(t, text):
    return [i for part in t.encode(text) for i in part]


@needs_vocabulary
@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=200))
def test_encoding_equals_reference(coder, reference, text):
    assert ids_of(coder, text) == reference(text)
    assert "".join(coder.decode(ids_of(coder, text))) == text


@needs_vocabulary
def test_encoding_of_hard_texts(coder, reference):
    rng = random.Random(1)
    tokens = [t for t in coder.ranks if len(t) > 1]
    texts = ["<|endoftext|> it's we'll \x1c\x1d    x", " " * 9000 + "a", "a" * 70_000, "=-" * 40_000, "\n \t" * 30_000, "ab 'sl 're" * 20_000]
    texts += [b"".join(rng.choice(tokens) for _ in range(3000)).decode("utf-8", "ignore") for _ in range(15)]
    texts += ["".join(rng.choice(a) for _ in range(20_000)) for a in ("ab", "aeiou", "0123456789", "!?.-", "éàü", "日本語")]
    for text in texts:
        assert ids_of(coder, text) == reference(text)
        assert "".join(coder.decode(ids_of(coder, text))) == text


@needs_vocabulary
def test_long_words_in_windows(coder):
    rng = random.Random(7)
    tokens = [t for t in coder.ranks if len(t) > 1]
    for _ in range(40):
        word = b"".join(rng.choice(tokens) for _ in range(1200))
        assert coder.encode_word(word) == [coder.ranks[t] for t in coder._merge(word)]


@needs_vocabulary
def test_encode_table(spark, coder):
    df = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (2, None, 0), (3, "", 0), (None, "ü" * 5000, 0)], "id int, text string, ids int")
    got = tokenizer.encode(df, "id", "text")
    assert dict(got.dtypes)["ids"] == "array<int>"
    rows = sorted((r["id"] or 0, r["ids"]) for r in got.collect())
    assert rows == sorted([(1, ids_of(coder, "a b"))] * 2 + [(2, []), (3, []), (0, ids_of(coder, "ü" * 5000))])
    back = {r["id"]: r["text"] for r in tokenizer.decode(got, "id", "ids").collect()}
    assert back[1] == "a b" and back[2] == ""
    assert {r["id"]: r["n_tokens"] for r in tokenizer.token_counts(df, "id", "text").collect()}[3] == 0


@needs_vocabulary
def test_kept_ids(spark, coder, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    out = str(tmp_path / "ids")
    tokenizer.write_ids(tokenizer.encode(df, "id", "text"), out)
    assert {r["id"]: r["ids"] for r in tokenizer.read_ids(spark, out).collect()} == {1: ids_of(coder, "a b"), 2: []}
    other = tmp_path / "other"
    other.write_text("x")
    with pytest.raises(ValueError, match="vocabulary"):
        tokenizer.read_ids(spark, out, str(other))
    with pytest.raises(FileNotFoundError):
        tokenizer.encode(df, "id", "text", str(tmp_path / "none"))


def test_decode_of_broken_bytes():
    t = tokenizer.Transducer({bytes([i]): i for i in range(256)})
    for raw in (b"\xff", b"\xc3", b"\xe2\x82", b"a\xc3b", b"\xf0\x9f\x98\x80", b"\xc0\x80"):
        got = "".join(t.decode(list(raw)))
        assert "".join(c for c in got if c != "�") == raw.decode("utf-8", "ignore")


# ---- packing ----------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=9))
def test_bounds(sizes):
    x = np.asarray(sizes, np.int64)
    bins, free = packing.best_fit_decreasing(x, 50)
    loads = Counter()
    for b, s in zip(bins.tolist(), sizes):
        loads[b] += s
    assert all(v <= 50 for v in loads.values()) and all(50 - loads[b] == f for b, f in enumerate(free))
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j, r in enumerate(rooms):
            if r >= sizes[i]:
                place(i + 1, rooms[:j] + [r - sizes[i]] + rooms[j + 1 :])
        place(i + 1, [*rooms, 50 - sizes[i]])

    if sizes:
        place(0, [])
    assert packing.lower_bound(x, 50) <= best <= len(free)


def test_pack(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 3, 17, 40, 60, 99, 100, 101, 250, 300])) for i in range(600)] + [(7, 40), (None, 20), (700, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id int, n int, bin string")
    got = packing.pack(df, "id", "n", 100, group_bins=8)
    out = got.collect()
    for (i, n), k in Counter(rows).items():
        mine = [r for r in out if r["id"] == i]
        total = sum(c * (m or 0) for (j, m), c in Counter(rows).items() if j == i)
        assert sum(r["size"] for r in mine) == total
        if not n:
            assert any(r["bin"] is None for r in mine)
        if n and n <= 100 and k == 1 and sum(j == i for j, _ in rows) == 1:
            assert len(mine) == 1
    loads = Counter()
    for r in out:
        if r["bin"]:
            loads[r["bin"]] += r["size"]
    assert max(loads.values()) <= 100
    cert = packing.certificate(got, 100).first()
    assert cert["lower_bound"] <= cert["bins"] == len(loads) <= cert["lower_bound"] * 1.05 + 1
    sizes = np.asarray([r["size"] for r in out if r["size"]])
    assert cert["lower_bound"] == packing.lower_bound(sizes, 100)


def test_groups_at_their_bound_are_left(spark):
    """Items that never share a bin are at their bound at once; a null id shared by most rows is no hot group."""
    df = spark.createDataFrame([(i if i % 4 == 0 else None, 4097) for i in range(4000)], "id int, n int")
    got = packing.pack(df, "id", "n", group_bins=64).groupBy("round").count().collect()
    assert [tuple(r) for r in got] == [(1, 4000)]
    dealt = df.withColumn("row", F.monotonically_increasing_id()).groupBy(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(16)).alias("g")).count()
    assert dealt.agg(F.max("count")).first()[0] < 2 * 4000 / 16


def test_rounds_only_lower_the_count(spark):
    """Sizes that pack badly in small groups: every item stays whole and a later round is kept only where it gains."""
    rng = random.Random(3)
    rows = [(i, rng.choice([34, 35, 51, 52, 26, 27, 41])) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, n int")
    out = packing.pack(df, "id", "n", 100, group_bins=4).collect()
    assert sorted((r["id"], r["size"]) for r in out) == sorted(rows)
    first = packing.pack(df, "id", "n", 100, group_bins=10_000).select("bin").distinct().count()
    loads = Counter()
    for r in out:
        loads[r["bin"]] += r["size"]
    assert max(loads.values()) <= 100 and len(loads) <= first * 1.15
    assert {r["round"] for r in out} != {1}


def test_pack_empty(spark):
    got = packing.pack(spark.createDataFrame([], "id long, n int"), "id", "n")
    assert got.count() == 0 and got.columns == ["id", "piece", "size", "bin", "round"]
    assert packing.certificate(got).first()["bins"] == 0


# ---- consensus --------------------------------------------------------------------------------------------


def test_verdict_label(spark):
    df = spark.createDataFrame([("Pos. ",), ("p",), ("NEGATIVE",), ("n",), ("unsure",), ("",), (None,), ("\tneg",), ("pending",)], "v string")
    assert [r[0] for r in df.select(consensus.verdict_label(F.col("v"))).collect()] == ["positive", "positive", "negative", "negative", None, None, None, "negative", None]


def test_usable_votes(spark):
    rows = [(1, "g", "A ", "p", 1), (1, "g", "A ", "p", 1), (2, "g", "a", "n", 5), (3, "g", "a", "u", 9), (4, "g", "b", "p", None), (5, "g", "b", "n", 0), (6, None, "b", "p", 1), (7, "g", None, "p", 1), (8, "g", " ", "p", 1)]
    df = spark.createDataFrame(rows, "id int, item string, who string, v string, t int")
    got = sorted(tuple(r) for r in consensus.usable_votes(df, "item", "who", consensus.verdict_label(F.col("v")), ["t"], "id").collect())
    assert got == [("g", "a", "negative"), ("g", "b", "negative")]


def test_consensus_finds_types(spark):
    """Good, inverted and constant annotators, several with few labels: better than the majority."""
    rng = random.Random(3)
    rate = {f"good{i}": (0.9, 0.9) for i in range(4)} | {"rev0": (0.1, 0.1), "rev1": (0.15, 0.1), "pos0": (0.98, 0.03), "rare0": (0.9, 0.9), "rare1": (0.1, 0.1)}
    truth, votes = {}, []
    for i in range(900):
        y = rng.random() < 0.4
        truth[f"i{i}"] = "positive" if y else "negative"
        for a in rng.sample([x for x in rate if not x.startswith("rare")], 4) + (["rare0", "rare1"] if i < 12 else []):
            right = rng.random() < rate[a][0 if y else 1]
            votes.append((f"i{i}", a, ("positive" if y else "negative") if right else ("negative" if y else "positive")))
    df = spark.createDataFrame(votes, "item string, annotator string, label string")
    model = consensus.fit(consensus.patterns(df), ["positive", "negative"])
    got = {r["item"]: r["label"] for r in consensus.consensus(df, model, 3).collect()}
    tally = {}
    for i, _, y in votes:
        tally.setdefault(i, Counter())[y] += 1
    majority = sum(tally[i].most_common(1)[0][0] == y for i, y in truth.items())
    right = sum(got[i] == y for i, y in truth.items())
    assert len(got) == 900 and right > majority + 80 and right > 800
    rel = {r["annotator"]: r for r in consensus.reliability(df, model).collect()}
    assert rel["good0"]["reliability"] > 0.8 > 0.4 > rel["rev0"]["reliability"]
    assert rel["rare0"]["reliability"] > 0.6 > 0.4 > rel["rare1"]["reliability"]


def test_consensus_empty_and_agreement(spark):
    none = spark.createDataFrame([], "item string, annotator string, label string")
    model = consensus.fit(consensus.patterns(none), ["positive", "negative"])
    assert consensus.consensus(none, model).count() == 0 and consensus.reliability(none, model).count() == 0
    few = spark.createDataFrame([("a", "x", "positive"), ("a", "y", "positive"), ("a", "z", "negative"), ("b", "x", "negative")], "item string, annotator string, label string")
    got = {r["item"]: r for r in consensus.agreement(few).collect()}
    assert got["a"]["agreement"] == pytest.approx(1 / 3) and got["b"]["agreement"] == 1.0
    # Observed disagreement 2/3, expected 1 - (2 * 1 + 1 * 0) / (3 * 2) = 2/3: no better than chance.
    row = consensus.alpha(few).first()
    assert (row["n_items"], row["n_labels"]) == (1, 3) and row["alpha"] == pytest.approx(0)
    assert consensus.alpha(none).first()["alpha"] is None
    x = np.asarray([0.05, 0.5, 1, 3.7, 40, 1e5])
    assert consensus._lgamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-9, rel=1e-12)
    with pytest.warns(UserWarning, match="convergence"):
        assert not consensus.fit(consensus.patterns(few), ["positive", "negative"], max_rounds=1, tol=0.0).converged
    with pytest.raises(ValueError, match="annotators"):
        consensus.fit(consensus.patterns(few), ["positive", "negative"], max_annotators=2)


# ---- cut texts ----------------------------------------------------------------------------------------------


def clinic(rng):
    what = ["cough", "nausea", "dizziness", "headache"]
    lines = [f"{rng.choice(['Reports', 'Denies', 'Describes'])} {rng.choice(what)} and {rng.choice(what)} after {rng.choice(['meals', 'work', 'lifting'])} for {rng.randrange(2, 50)} days." for _ in range(rng.randrange(3, 9))]
    end = rng.choice(["", "", "\n\nSigned: Ana Roe", "\n\ncc: chart", "\n\n-- end of report --", "\nmedications:\nalphine 20 mg daily\nbetol 5 mg nightly"])
    return " ".join(lines) + end


def test_cut_texts(spark):
    rng = random.Random(8)
    rows, cut = [], set()
    for i in range(1500):
        t, source = clinic(rng), rng.choice(["free", "capped"])
        if source == "capped" and len(t) > 300:
            t = t[:300]
            if not truncation._whole_until(t + "x", 300):
                cut.add(i)
        elif rng.random() < 0.05:
            at = rng.randrange(30, 120)
            if not truncation._whole_until(t, at):
                cut.add(i)
            t = t[:at]
        rows.append((i, t, source))
    rows += [(5000, None, "free"), (5001, "  ", None), (5002, "", "capped")]
    out = truncation.score(spark.createDataFrame(rows, "id int, text string, source string"), "id", "text", "source")
    scored = out.collect()
    scores = {r["id"]: r["cut_score"] for r in scored}
    assert len(scores) == len(rows) and scores[5000] == scores[5001] == scores[5002] == 0
    found = {r["id"] for r in scored if r["is_cut"]}
    assert len(found & cut) > 0.95 * len(cut) and len(found & cut) > 0.95 * len(found)
    rates = {r["source"]: r for r in truncation.cut_rates(out).collect()}
    assert rates["capped"]["n_at_limit"] > 0 and rates["free"]["n_at_limit"] == 0


def test_source_limits(spark):
    """The greatest length, a second lower limit, and one in bytes; copies of one text and chance make none."""
    rng = random.Random(4)
    word = lambda n, a="abcdef ": "".join(rng.choice(a) for _ in range(n))
    rows = [("two", word(rng.randrange(50, 900))) for _ in range(400)] + [("two", word(n)) for n in (500, 900) for _ in range(12)]
    rows += [("copies", "same text " * 9)] * 50 + [("copies", word(n)) for n in range(100, 400)]
    rows += [("bytes", word(400, "aé☃").encode()[:600].decode(errors="ignore")) for _ in range(60)] + [("bytes", word(n)) for n in range(20, 320)]
    rows += [(None, word(70)) for _ in range(5)] + [(None, word(n)) for n in range(10, 60)] + [("none", None), ("none", "")]
    got = {(r["source"], r["unit"], r["n"]) for r in truncation.source_limits(spark.createDataFrame(rows, "source string, text string")).collect()}
    assert {x for x in got if x[1] == "chars"} == {("two", "chars", 500), ("two", "chars", 900), (None, "chars", 70)}
    assert ("bytes", "bytes", 600) in got and not any(x[0] in ("copies", "none") for x in got)


def test_threshold():
    whole, cut = np.asarray([0.01, 0.02, 0.1, 0.9]), np.asarray([0.3, 0.8, 0.95])
    t = truncation.best_threshold(whole, cut, 0.3)
    assert 0.1 < t < 0.3
    assert truncation.best_threshold(whole[:0], cut, 0.3) == 0.5


def test_cut_empty(spark):
    assert truncation.score(spark.createDataFrame([], "id int, text string, source string"), "id", "text", "source").count() == 0


# ---- personal information -----------------------------------------------------------------------------------

GIVEN = [a + b for a in ("Tov", "Mar", "Lin", "Sel", "Kas", "Dri") for b in ("ana", "ora", "wyn", "emir", "eka", "isko")]
FAMILY = [a + b for a in ("Esk", "Dun", "Grim", "Lor", "Oak", "Ved") for b in ("dale", "more", "ett", "quist", "by", "well")]


PHONES = ["({}) {}-{}", "{}-{}-{}"]
OTHER_PHONES = ["{}.{}.{}", "{} {} {}", "+1 {} {} {}", "({}) {} {}"]


def ordinary(spark, texts):
    return [r[0] for r in pii.ordinary_words(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]


def letter(rng, phones=PHONES):
    g, f = rng.choice(GIVEN), rng.choice(FAMILY)
    name = rng.choice([f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{g} {rng.choice('ABK')}. {f}"])
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    phone = rng.choice([rng.choice(phones).format(digits(3), digits(3), digits(4)), "two three four six seven eight " + rng.choice(["two", "nine"])])
    mail = rng.choice([f"{g}.{f}@mail.example".lower(), f"{g}{f} at mail dot test".lower(), f"{g}_{f}@BOX.TEST".upper(), f"{g}-{f}(at)box.example".lower()])
    number, street = f"{digits(3)}-{digits(2)}-{digits(4)}", rng.choice([f"{rng.randrange(1, 3000)} {rng.choice(FAMILY)} {rng.choice(['St', 'Road', 'Lane'])}, Apt {rng.randrange(1, 40)}", f"Calle {rng.choice(FAMILY)} {rng.randrange(1, 900)}"])
    parts = [
        (f"Spoke with {name} about the plan. ", ("person_name", name)),
        (f"Call back on {phone} please. ", ("phone", phone)),
        (f"Send results to {mail}. ", ("email", mail)),
        (f"Checked SSN {number} verified. ", ("identity_number", number)),
        (f"Lives at {street}. ", ("street_address", street)),
        (f"Seen at {rng.choice(FAMILY)}brook Family Practice in May for cough, order {digits(3)}-{digits(3)}-{digits(2)}. ", None),
        (f"The {rng.choice(FAMILY)} sign was negative, given alphine 20 mg @ nightly. ", None),
        ("Denies nausea and reports cough after meals; plan to walk. ", None),
        ("The cough and nausea settled well, yet we denies reports of seen orders. ", None),
    ]
    rng.shuffle(parts)
    return "".join(t for t, _ in parts), {x for _, x in parts if x}


@pytest.mark.parametrize("phones", [PHONES, OTHER_PHONES])
def test_pii_held_out(spark, phones):
    """Half of the names are on no list; all of the text is new, and so are the other formats of phone numbers."""
    rng = random.Random(6)
    names = [(n, "given") for n in GIVEN[::2]] + [(n, "family") for n in FAMILY[::2]]
    texts = [letter(rng)[0] for _ in range(500)]
    model = pii.fit(texts, names, ordinary(spark, texts))
    right = found = true = 0
    for _ in range(150):
        text, want = letter(rng, phones)
        got = {(k, text[s:e]) for s, e, k in model.decode(text)}
        right, found, true = right + len(got & want), found + len(got), true + len(want)
    assert right / found > 0.93 and right / true > 0.93
    assert model.decode(None) == model.decode(" ") == []


def test_pii_candidates_of_any_script():
    lex = pii.Lexicon(frozenset(), frozenset(), frozenset(["the"]))
    for text, name in [("Saw Łukasz Żak today", "Łukasz Żak"), ("сказал Иван Петров вчера", "Иван Петров"), ("患者王小明来院", "王小明"), ("قال محمد علي", "محمد علي"), ("with Ægir Ólafsson.", "Ægir Ólafsson")]:
        assert name in {text[c.start : c.end] for c in pii.candidates(text, lex) if c.kind == "person_name"}
    for text in ("Call two three four six seven eight nine", "ring nine-eight-seven-six-five-four-three"):
        assert any(c.kind == "phone" for c in pii.candidates(text, lex))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(1, 5), st.sampled_from(["phone", "email"]), st.floats(-3, 3)), max_size=7, unique_by=lambda x: x[:3]), st.floats(-2, 2), st.floats(-2, 2))
def test_lattice_against_enumeration(items, stay, change):
    """Best path, span marginals and transition counts of the field, by listing all sets of spans."""
    text = "ab, cd ef,gh ij kl mn"
    w = {"Tphphs": stay, "Tphphc": stay, "Tphems": change, "Temphc": change}
    spans = sorted(((s, s + n, k) for s, n, k, _ in items), key=lambda x: (x[1], x[0], x[2]))
    score = {(s, s + n, k): v for s, n, k, v in items}
    scores = [score[x] for x in spans]
    before, adjacent = pii._follows(text, spans)
    paths = []
    for r in range(len(spans) + 1):
        for ids in itertools.combinations(range(len(spans)), r):
            if all(spans[a][1] <= spans[b][0] for a, b in itertools.pairwise(ids)):
                moves = [n for a, b in itertools.pairwise(ids) for j, n in adjacent[b] if j == a]
                paths.append((sum(scores[i] for i in ids) + sum(w.get(n, 0) for n in moves), ids, moves))
    total = sum(np.exp(v) for v, _, _ in paths)
    share, moved = pii._marginals(before, adjacent, scores, w)
    for i, p in enumerate(share):
        assert p == pytest.approx(sum(np.exp(v) for v, ids, _ in paths if i in ids) / total, abs=1e-9)
    for name in w:
        assert moved.get(name, 0) == pytest.approx(sum(np.exp(v) * m.count(name) for v, _, m in paths) / total, abs=1e-9)
    ids = pii._best(text, spans, scores, w)
    got = sum(scores[i] for i in ids) + sum(w.get(n, 0) for a, b in itertools.pairwise(ids) for j, n in adjacent[b] if j == a)
    assert got == pytest.approx(max(v for v, _, _ in paths), abs=1e-9)


def test_scores_are_sums_of_features():
    rng = random.Random(2)
    text, _ = letter(rng)
    lex = pii.Lexicon(*pii.listed_names([(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY]))
    cs = pii.candidates(text, lex)
    weights = {x: rng.random() for c in cs for x in pii.features(text, c)}
    model = pii.Field(weights, lex)
    for _ in range(2):  # the second time from the caches
        assert model.scores(text, cs) == pytest.approx([sum(weights[x] for x in pii.features(text, c)) for c in cs])


def test_pii_tables(spark):
    rng = random.Random(6)
    texts = [letter(rng)[0] for _ in range(200)]
    names = spark.createDataFrame([(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY] + [(None, None)], "name string, kind string")
    rows = [(f"r{i}", t) for i, t in enumerate(texts)] + [("r0", texts[0]), ("n", None), ("b", ""), (None, texts[1])]
    df = spark.createDataFrame(rows, "record string, text string")
    model = pii.train(df, names)
    got = pii.find(df, model)
    assert got.count() == got.distinct().count() > 800
    assert got.where("record is null or record in ('n', 'b')").count() == 0
    red = {r["record"]: r for r in pii.redact(df.where("record is not null"), "record", "text", model).collect()}
    assert red["n"]["redacted"] is None and red["b"]["redacted"] == ""
    assert "[PERSON_NAME]" in red["r5"]["redacted"] and "Spoke with" in red["r5"]["redacted"]
    assert pii.find(df.limit(0), model).count() == 0


def test_pii_refuses_long_lists(spark):
    texts = spark.createDataFrame([("r", "Ana Roe")], "record string, text string")
    with pytest.raises(ValueError, match="names"):
        pii.train(texts, spark.createDataFrame([("a", "given"), ("b", "given")], "name string, kind string"), max_names=1)


def test_pii_small_letters(spark):
    """Names in small letters: on the list, with no part on it, and of three words; rare words elsewhere are none."""
    rng = random.Random(6)
    names = [(n, "given") for n in GIVEN[::2]] + [(n, "family") for n in FAMILY[::2]]

    def small(rng, given, family):
        name = f"{rng.choice(given)} {rng.choice(['', '', 'van '])}{rng.choice(family)}".lower()
        rest = rng.choice(["Denies nausea after meals.", f"Lives at {rng.randrange(1, 900)} {rng.choice(family)[:3]}{rng.choice(['mark', 'gate'])} street.".lower()])
        return f"Reports cough. caller was {name}, who left no message. {rest}", name

    texts = [letter(rng)[0] for _ in range(500)] + [small(rng, GIVEN, FAMILY)[0] for _ in range(200)]
    model = pii.fit(texts, names, ordinary(spark, texts))
    cases = [small(rng, GIVEN[1::2], FAMILY[1::2]) for _ in range(40)] + [small(rng, GIVEN, FAMILY) for _ in range(40)]
    got = [{text[s:e] for s, e, k in model.decode(text) if k == "person_name"} for text, _ in cases]
    assert sum(name in found for (_, name), found in zip(cases, got)) >= 76
    assert sum(found == {name} for (_, name), found in zip(cases, got)) >= 76
    text = "Lisinavo tabsy taken; caller was vesodo van ebrick, who waits. uses tabsy rolvex nightly."
    found = {text[c.start : c.end] for c in pii.candidates(text, model.lex)}
    assert {"vesodo", "vesodo van ebrick", "van ebrick"} <= found


def test_pii_repeated_name(spark):
    """A looping text: every occurrence is found, and the work grows with the text only."""
    rng = random.Random(6)
    model = pii.fit([letter(rng)[0] for _ in range(300)], [(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY])
    texts = ["Spoke with " + ", ".join(["Tovora Eskdale"] * n) + " today." for n in (3, 20, 400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in pii.redact(df, "id", "text", model).collect():
        assert "Tovora" not in r["redacted"] and "Eskdale" not in r["redacted"]
        assert r["n_found"] == (3, 20, 400)[r["id"]]
    assert len(pii.candidates(texts[2], model.lex)) < 400 * 12
    assert pii._copies("S a b a b a b c c".split()) == [-1, 0, 0, 1, 1, 2, 2, -1, -1]
    assert pii._copies(["a"] * 3 + ["b"]) == [0, 1, 2, -1]
