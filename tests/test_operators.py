"""Core operators against brute force on small cases."""

import bisect
import itertools
import json
import math
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivault.functions.text import age_at, alnum_count, is_missing, iso_timestamp, offsets, parse_date, pretty, to_boolean, to_int
from lexivault.__main__ import main
from lexivault.functions.tokens import Offsets, token_count, token_spans
from lexivault.operators import annotation, attribution, cohort, grams, intervals, judge, matching, metrics, review, sections, selection
from lexivault.sources import files
from lexivault.streaming.incremental import score_stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_offsets(spark):
    cases = [("aaaa", "aa"), ("abc", ""), ("ab", "abc"), ("", "a"), (None, "a"), ("aXa", "a")]
    df = spark.createDataFrame(cases, "t string, n string")
    got = [r[0] for r in df.select(offsets(F.col("t"), F.col("n"))).collect()]
    assert got == [[0, 1, 2], [], [], [], None, [0, 2]]


def test_scalars(spark):
    df = spark.createDataFrame([("13/02/1990",), ("01/02/1990",), (" NaN ",), (None,), ("yes",)], "x string")
    assert [str(r[0]) for r in df.select(parse_date(F.col("x"))).collect()] == ["1990-02-13", "1990-01-02", "None", "None", "None"]
    assert [r[0] for r in df.select(is_missing(F.col("x"))).collect()] == [False, False, True, True, False]
    assert df.select(to_boolean(F.col("x"))).collect()[4][0] is True
    dates = spark.createDataFrame([("05-Mar-1990",), ("05-MAR-1990",), ("1990-03-05",), ("3-5-1990",), ("1990/3/5",), ("5 Mar 1990",)], "x string")
    assert [str(r[0]) for r in dates.select(parse_date(F.col("x"))).collect()] == ["1990-03-05"] * 5 + ["None"]
    odd = spark.createDataFrame([(" 12 ",), ("3.5",), ("x1",), ("",), (None,)], "x string")
    assert [r[0] for r in odd.select(to_int(F.col("x"))).collect()] == [12, None, None, None, None]
    assert odd.select(to_int(F.lit(3.7)), alnum_count(F.lit("aé1 ?"))).first() == (3, 2)
    assert [r[0] for r in spark.createDataFrame([("a_b",), ("x",)], "x string").select(pretty(F.col("x"), {"x": "Ex"})).collect()] == ["A B", "Ex"]
    assert df.select(age_at(F.lit("01/01/1800"))).first()[0] is None


@pytest.mark.parametrize("tau", [2, 3])
def test_grams(spark, tau):
    rng = random.Random(tau)
    text = lambda: " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 9)))
    made = [(i, rng.choice("xy"), text()) for i in range(30)] + [(99, "x", None), (98, None, "a b c")]
    held = [(rng.choice("xyz"), text()) for _ in range(12)] + [("x", None)]
    known = {k: {tuple(w[i : i + tau]) for k2, t in held if k2 == k and t for w in [t.split()] for i in range(len(w) - tau + 1)} for k in "xyz"}
    c, s = spark.createDataFrame(made, "id int, key string, text string"), spark.createDataFrame(held, "key string, text string")
    for r in grams.gram_coverage(c, s, tau).collect():
        _, key, t = next(m for m in made if m[0] == r["id"])
        w = (t or "").split()
        hit = {p for i in range(len(w) - tau + 1) if tuple(w[i : i + tau]) in known.get(key, ()) for p in range(i, i + tau)}
        assert (r["covered"], r["total"]) == (len(hit), len(w))


def test_repetition_cut(spark):
    df = spark.createDataFrame([(1, "a b c a b c d"), (2, "a b c"), (3, None), (4, "a b c d e f")], "id int, t string")
    assert rows(grams.repetition_cut(df, "id", "t", 3)) == [(1, 7, 3), (2, 3, 3), (3, 0, 0), (4, 6, 6)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20), st.integers(0, 6)), max_size=25), st.booleans())
def test_merge(spark, data, touching):
    items = sorted({(k, s, s + n) for k, s, n in data})
    want = []
    for k, group in itertools.groupby(items, lambda x: x[0]):
        merged = []
        for _, s, e in group:
            if merged and (s <= merged[-1][1] if touching else s < merged[-1][1]):
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want += [(k, *m) for m in merged]
    df = spark.createDataFrame(items, "k int, s int, e int")
    assert rows(intervals.merge_intervals(df, ["k"], touching=touching)) == sorted(want)


def test_runs_fill_overlap(spark):
    df = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 6, 7)], "k int, s int, e int")
    assert [r["run"] for r in intervals.contiguous_runs(df, ["k"]).orderBy("s").collect()] == [1, 1, 2]
    f = spark.createDataFrame([(1, 0, None), (1, 1, "a"), (1, 2, None), (1, 3, "b")], "k int, o int, v string")
    assert [r["v"] for r in intervals.fill_nearest(f, ["k"], "o", "v").orderBy("o").collect()] == ["a", "a", "a", "b"]
    t = spark.createDataFrame([(1, 0, 2), (1, 2, 4), (2, 0, 1)], "k int, ts int, te int")
    s = spark.createDataFrame([(1, 1, 2, 0, "x"), (1, 0, 3, 1, "y")], "k int, s int, e int, ord int, rule string")
    assert rows(intervals.count_overlapping(t, s, ["k"])) == [(1, 2, 2), (2, 1, 0)]
    assert [r["rule"] for r in intervals.first_overlap(t, s, ["k"]).orderBy("k", "ts").collect()] == ["y", "y", None]


def brute_split(at, text, notes, depth=0, least=5, deepest=4):
    """The definition, one step after another."""
    holds = lambda s: any(s in n for n in notes)
    if holds(text):
        return [(at, at + len(text), True, "split_attributed" if depth else "original")]
    rest = [(at, at + len(text), False, "split_residual" if depth else "original")]
    if depth >= deepest or len(text) < least:
        return rest
    head = max((k for k in range(len(text) + 1) if holds(text[:k])), default=0)
    tail = max((k for k in range(len(text) + 1) if holds(text[len(text) - k :])), default=0)
    tail = min(tail, len(text) - head)
    if not head and not tail:
        return rest
    head, tail = (head if head >= least else 0), (tail if tail >= least else 0)
    out = [(at, at + head, True, "split_attributed")] if head else []
    middle = text[head : len(text) - tail]
    if len(middle) >= least:
        out += brute_split(at + head, middle, notes, depth + 1, least, deepest)
    elif middle:
        ok = holds(middle)
        out.append((at + head, at + head + len(middle), ok, "split_attributed_tiny" if ok else "split_residual_tiny"))
    return out + ([(at + len(text) - tail, at + len(text), True, "split_attributed")] if tail else [])


def test_split_regions(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    notes = [("k", text(60)) for _ in range(4)] + [("j", text(40))]
    regions = []
    for i in range(25):
        parts = [n[s : s + rng.randrange(4, 20)] if rng.random() < 0.7 else text(rng.randrange(1, 8)) for _ in range(3) for _, n in [rng.choice(notes)] for s in [rng.randrange(40)]]
        regions.append((i, "k", 10, "".join(parts)))
    regions += [(100, "none", 0, "abcdabcd"), (101, "k", 0, ""), (102, "k", 0, None)]
    df = spark.createDataFrame(regions, "region int, key string, gen_start int, text string")
    got = rows(attribution.split_regions(df, spark.createDataFrame(notes, "key string, note string"), 5, 4))
    want = sorted((i, *p) for i, k, at, t in regions if t for p in brute_split(at, t, [n for q, n in notes if q == k]))
    assert got == want


@pytest.mark.parametrize("most", [10_000, 40])
def test_corpus_occurrences(spark, most):
    """With a small ``most`` long needles are found by grams and short ones in blocks."""
    rng = random.Random(5)
    notes = [(i, " ".join(rng.choice(["ab", "abc", "b", "cab"]) for _ in range(rng.randrange(0, 25)))) for i in range(40)] + [(99, None)]
    regions = []
    for i in range(20):
        n = rng.choice([n for _, n in notes if n])
        s = rng.randrange(len(n))
        regions.append((i, n[s : s + rng.randrange(1, 30)]))
    regions += [(50, ""), (51, None), (52, regions[0][1]), (53, "\U0001f600")]
    notes += [(100, "a \U0001f600\U0001f600 b")]
    r, n = spark.createDataFrame(regions, "region int, text string"), spark.createDataFrame(notes, "row_idx int, text string")
    got = rows(attribution.corpus_occurrences(r, n, max_needles=most))
    want = sorted((r, i, p) for r, t in regions if t for i, n in notes if n for p in range(len(n)) if n.startswith(t, p))
    assert got == want
    assert attribution.corpus_occurrences(r.limit(0), n).count() == 0


def test_pieces(spark):
    """Winner: the latest date, then the greater row; a null date is least. Recurrence counts keys and own notes."""
    long = "abcdefghij klmnopqrst uvwxyz 0123"
    notes = [(5, "k", "2020-01-01", f"x {long}"), (6, "k", "2020-01-01", f"{long} {long}"), (9, "k", None, long), (7, "j", "2024-01-01", f"- {long}"), (8, "j", None, None)]
    regions = [("a", "k", 10, long), ("b", "none", 0, long), ("c", "k", 0, long + "#" * 40), ("d", "k", 3, "")]
    got = attribution.pieces(spark.createDataFrame(regions, "region string, key string, gen_start long, text string"), spark.createDataFrame(notes, "row_idx int, key string, note_date string, text string"))
    out = sorted(tuple(r) for r in got.select("piece", "gen_start", "gen_end", "split_origin", "attributed", "k_corpus", "k_within", "row_idx", "position").collect())
    n = len(long)
    assert out == [
        ("a+0", 10, 10 + n, "original", True, 2, 3, 6, 0),
        ("b+0", 0, n, "original", False, 2, 0, None, None),
        ("c+0", 0, n, "split_attributed", True, 2, 3, 6, 0),
        (f"c+{n}", n, n + 40, "split_residual", False, 0, 0, None, None),
    ]


@pytest.mark.parametrize("few", [0, 4096])
def test_reaches(monkeypatch, few):
    """Prefixes and suffixes by one pass over notes equal those of pairs, texts beyond MAX_PREFIXES too."""
    monkeypatch.setattr(attribution, "FEW", few)
    monkeypatch.setattr(attribution, "MAX_PREFIXES", 60)
    rng = random.Random(7)
    for letters in ("ab", "abcdefg \U0001f600"):
        text = lambda n: "".join(rng.choice(letters) for _ in range(n))
        notes = [text(rng.randrange(120)) for _ in range(20)]
        texts = ["".join(rng.choice(notes)[s : s + rng.randrange(50)] for _ in range(3) for s in [rng.randrange(60)]) + text(1) for _ in range(30)]
        for start in (True, False):
            assert attribution._reaches(texts, notes, start) == [max(attribution._longest(t, n, start) for n in notes) for t in texts]


@pytest.mark.parametrize("most", [150, 4_000_000])
def test_split_regions_in_one_pass_or_rounds(spark, monkeypatch, most):
    """Keys whose notes fit one row are split there, whole, and take no rounds; others give the same parts by rounds."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    notes = [("k", text(60)) for _ in range(6)] + [("j", text(50)), ("j", None)]
    regions = [(i, k, i, "".join(rng.choice([n for q, n in notes if q == k and n])[s : s + 12] + text(rng.randrange(4)) for s in (3, 20, 31))) for i in range(20) for k in [rng.choice("jk")]]
    regions += [(100, None, 5, "abcd"), (101, "none", 0, "dcba"), (102, "j", 0, "")]
    rounds, reach = [], attribution._reach
    monkeypatch.setattr(attribution, "_reach", lambda *x: rounds.append(1) or reach(*x))
    df = spark.createDataFrame(regions, "region int, key string, gen_start int, text string")
    got = rows(attribution.split_regions(df, spark.createDataFrame(notes, "key string, note string"), 5, 4, most))
    assert got == sorted((i, *p) for i, k, at, t in regions if t for p in brute_split(at, t, [n for q, n in notes if q == k and n]))
    assert bool(rounds) == (most == 150)


@pytest.mark.parametrize("first", [False, True])
def test_search_of_batches(monkeypatch, first):
    """Windows of every width, blocks of few places and few pairs, characters of several bytes; no automaton for needles of some bytes."""
    monkeypatch.setattr(attribution, "MAX_PLACES", 40)
    monkeypatch.setattr(attribution, "MAX_PAIRS", 7)
    rng = random.Random(3)
    for letters in ("ab", "abcdefgh \u00e9\U0001f600"):
        texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 20, 300]))) for _ in range(30)]
        cut = [t[s : s + rng.randrange(1, 90)] for _ in range(60) for t in [rng.choice(texts)] if t for s in [rng.randrange(len(t))]]
        needles = list(enumerate(sorted({x for t in cut for x in (t, t[:-1] + "b", t[:6])})))
        raw = [t.encode() for t in texts]
        search = attribution._Search(needles, first)
        found = list(zip(*(x.tolist() for x in search.run(b"".join(raw), np.cumsum([0] + [len(t) for t in raw])))))
        want = [(k, i, p) for k, t in enumerate(texts) for i, x in needles for p in range(len(t)) if t.startswith(x, p)]
        least = lambda hits: sorted({(k, i): p for k, i, p in sorted(hits, reverse=True)}.items())
        assert least(found) == least(want) if first else found == sorted(want)
        assert {w.width for w in search.windows} == {attribution.NARROW, attribution.WINDOW}
    assert attribution._Search([(1, "of eight"), (2, "of more than a window's bytes")], first).automaton is None


def test_whole_regions_meet_no_notes(spark, monkeypatch):
    """Only regions that no note of their patient holds are split; the others' notes are read once, for their holders."""
    met, split = [], attribution.split_regions
    monkeypatch.setattr(attribution, "split_regions", lambda regions, *x: met.extend(r[0] for r in regions.select("region").collect()) or split(regions, *x))
    text = "abcdefghij klmnopqrst uvwxyz 0123"
    regions = spark.createDataFrame([("a", "k", 0, text), ("b", "k", 0, text + "#" * 9), ("c", "j", 0, text)], "region string, key string, gen_start long, text string")
    notes = spark.createDataFrame([(1, "k", None, f"x {text} y")], "row_idx int, key string, note_date string, text string")
    got = attribution.pieces(regions, notes).select("piece", "attributed", "k_corpus")
    assert sorted(met) == ["b", "c"]
    assert rows(got) == [("a+0", True, 1), ("b+0", True, 1), ("b+33", False, 0), ("c+0", False, 1)]


def test_single_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 3)], "k string, v int")
    assert rows(cohort.single_rows(df, "k")) == [("b", 1)]


def test_exact_interval():
    assert metrics.exact_interval(0, 0) == (None, None)
    lo, hi = metrics.exact_interval(0, 10)
    assert lo == 0 and hi == pytest.approx(0.30849710781876083, abs=1e-9)
    assert metrics.exact_interval(10, 10)[1] == 1
    tail = lambda p, ks: sum(math.comb(10, k) * p**k * (1 - p) ** (10 - k) for k in ks)
    lo, hi = metrics.exact_interval(4, 10)
    assert tail(lo, range(4, 11)) == pytest.approx(0.025, abs=1e-9) and tail(hi, range(5)) == pytest.approx(0.025, abs=1e-9)


def test_rates_and_kappa(spark):
    t = spark.createDataFrame([("a", True, True)] * 3 + [("a", False, True)] + [("a", True, False)] + [("a", False, False)] * 2 + [("b", None, True), ("b", True, None)], "k string, truth boolean, mention boolean")
    r = {x["k"]: x for x in metrics.rates(metrics.confusion(t, ["k"])).collect()}
    assert (r["a"]["tp"], r["a"]["fp"], r["a"]["fn"], r["a"]["tn"]) == (3, 1, 1, 2)
    assert r["a"]["auroc"] == pytest.approx((3 * 2 + 0.5 * (3 * 1 + 1 * 2)) / 12)
    assert r["b"]["auroc"] is None and r["b"]["auroc_lo"] is None and r["b"]["ppv"] is None
    k = metrics.kappa(t, [], "truth", "mention").first()
    assert k["n"] == 7 and k["agreement"] == pytest.approx(5 / 7)
    same = spark.createDataFrame([("x", "x")], "a string, b string")
    assert metrics.kappa(same, [], "a", "b").first()["kappa"] is None


def test_selection(spark):
    df = spark.createDataFrame([(f"k{i}", i % 3, 10) for i in range(50)], "key string, s int, n int")
    assert selection.sample_per_stratum(df, ["s"], "key", 4, 1).groupBy("s").count().where("count <> 4").count() == 0
    taken = selection.fill_budget(df, "key", "n", 95, 7)
    assert taken.count() == 10 and taken.agg(F.max("tokens_before")).first()[0] == 90
    a = spark.createDataFrame([("k1",), ("k2",)], "key string")
    assert selection.top_up(a, df, "key", 5, 1).distinct().count() == 5
    assert rows(selection.by_priority([("x", a), ("y", df.limit(3))], "key"))[0] == ("k0", "y")
    assert selection.not_done(df, a, ["key"]).count() == 48


def test_classified_segments(spark):
    """In a blanket section all is templated: what rules found first, then the rest; the stretches of each rule are kept."""
    rows_ = [("a", 0, "hpi", "Pain. see HPI now."), ("b", 0, sections.BLANKET[0], "Pain. see HPI now."), ("c", 0, None, None), ("d", 0, None, "")]
    got = {r["region"]: r for r in sections.classify_segments(spark.createDataFrame(rows_, "region string, segment int, section string, text string")).collect()}
    a, b = got["a"], got["b"]
    assert a["rule_matched"] == b["rule_matched"] == {"SEE_REFERENCE": ["see HPI now."]} and a["n_revealing"] > 0 and not a["blanket_section"]
    assert b["blanket_section"] and b["n_revealing"] == 0 and b["revealing_text"] == "" and b["templated_text"] == a["templated_text"] + a["revealing_text"]
    assert got["c"]["n_tokens"] == got["d"]["n_tokens"] == 0
    rules = spark.createDataFrame([(True, {"A": 1}), (False, {"B": 1, "A": 2}), (False, {})], "b boolean, r map<string,int>")
    assert [r[0] for r in rules.select(sections.rule_summary(F.col("b"), F.col("r"))).collect()] == ["BLANKET_SECTION", "A|B", None]


def test_only_wanted_notes_are_shuffled(spark):
    """Segments meet the notes that parts are attributed to; the others' texts stay where they are read."""
    from lexivault.plans.sections import _segments

    cut = spark.createDataFrame([("a", "cc: x", 1, 5), ("b", "zz", None, None)], "piece string, text string, row_idx int, position int")
    notes = spark.createDataFrame([(1, "hpi: cc: x"), (2, "other")], "row_idx int, text string")
    got = _segments(cut, notes)
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
    assert rows(got) == [("a", 0, "cc", 0, 5, True, "cc: x"), ("b", 0, None, 0, 2, True, "zz")]


def test_sections():
    t = sections.NoteTemplate()
    note = "hpi: cough\nros: \nconstitutional: Negative for fever, chills.\ncardiovascular: none\nphysical exam: cardiovascular: fine bp: 120\nfoo: x"
    ends, names = t.sections_of(note)
    at = lambda word: names[bisect.bisect_right(ends, note.index(word) + len(word)) - 1]
    assert [h for _, _, h in t.headers_of(note)] == ["hpi", "ros", "constitutional", "cardiovascular", "physical exam", "cardiovascular", "bp"]
    assert at("cough") == "hpi" and at("fever") == "ros/constitutional" and at("none") == "ros/cardiovascular" and at("fine") == "pe/cardiovascular" and at("120") == "bp"
    assert t.segments("ough", note, 0) == [(None, 0, 4, True)] and t.segments("ough", None, 9) == [(None, 0, 4, True)]
    assert t.segments("", note, 5) == []
    assert [s[1:] for s in t.segments("ough\nros: x", note, 6)] == [(0, 5, True), (5, 11, False)]
    spans = t.boilerplate_spans("general: Negative for a, b.\nlast reviewed 01/02/2020 by X\n03/04/2021 x\nby Dr. Roe\nsee HPI now.")
    assert [r for _, _, r in spans] == ["HEADER_PREFIX", "NEGATIVE_ROS", "LAST_REVIEWED", "DATE_TIME_LINE", "BY_NAME_LINE", "SEE_REFERENCE"]
    tokens = t.classify("Negative for a.\nPain, left")
    assert "".join(p for p, made, _ in tokens if not made) == "Pain, left"
    assert all(made for _, made, _ in t.classify(" - "))


@pytest.mark.parametrize(
    "text",
    [
        '{"a": true, "b": false}', 'Sure:\n```json\n{"a": true, "b": false}\n```', 'x {"a": true, "b": false} y', '{"a": true, "b": false,}', "{a: true, b: False}", "{'a': true, 'b': false}", "a: true and b = false", '{“a”: true,\n “b”: false}',
    ],
)
def test_parse_answer(text):
    assert judge.parse_answer(text, ["a", "b"], booleans=True) == {"a": True, "b": False}


def test_parse_answer_rejects():
    assert judge.parse_answer('{"a": true}', ["a", "b"]) is None
    assert judge.parse_answer('{"a": 1, "b": 2, "c": 3}', ["a", "b"]) is None
    assert judge.parse_answer('{"a": 1, "b": 2}', ["a", "b"], booleans=True) is None
    assert judge.parse_answer(None, ["a"]) is None and judge.parse_answer(" ", ["a"]) is None


class Fake:
    def __init__(self):
        self.calls = []

    def send(self, user, system, model):
        self.calls.append(model)
        if model == "gone":
            raise judge.JudgeError("no such model", 404)
        if model == "busy" and self.calls.count("busy") < 3:
            raise judge.JudgeError("busy", 429)
        return json.dumps({"ok": "yes" in user})


def test_ask():
    f, slept = Fake(), []
    assert judge.ask(f, "yes", "", ["gone", "busy"], sleep=slept.append) == ('{"ok": true}', "busy", None)
    assert f.calls == ["gone", "busy", "busy", "busy"] and slept == [2.0, 4.0]
    assert judge.ask(Fake(), "x", "", ["gone"])[2] == "no such model"


def test_judge_records(spark):
    class FakeYes:
        def send(self, user, system, model):
            return json.dumps({"ok": "yes" in user})

    df = spark.createDataFrame([(1, "yes"), (2, "no"), (3, ""), (4, None), (5, "yes" * 10_000)], "id int, t string")
    got = {r["id"]: r for r in judge.judge_records(df, "id", "t", FakeYes, "", ["m"], ["ok"]).collect()}
    assert set(got) == {"1", "2", "5"}
    assert json.loads(got["2"]["answer"]) == {"ok": False} and got["5"]["judge_truncated"]


def test_spacing():
    now, slept = [0.0], []
    gate = judge.Spacing(2.0, lambda: now[0], slept.append)
    for t in (0.0, 0.5, 10.0):
        now[0] = t
        gate.wait()
    assert slept == [1.5]
    judge.Spacing(0.0, sleep=slept.append).wait()
    assert slept == [1.5]


def test_numbered(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("x")).repartition(7)
    assert [r["n"] for r in selection.numbered(df, ["x"], "n").orderBy("x").collect()] == list(range(1, 1001))
    assert selection.numbered(df.limit(0), ["x"], "n").count() == 0


def test_column_helpers(spark):
    df = spark.createDataFrame([("positive", True, ["a"], [], "Take Alphine now", ["alphine", "", "beta", None]), ("other", True, [], [], None, None), (None, None, None, None, "", [])], "l string, m boolean, dx array<string>, sx array<string>, t string, r array<string>")
    assert [r[0] for r in df.select(judge.known_label(F.col("l"), ["positive", "negative"])).collect()] == ["positive", None, None]
    assert [r[0] for r in df.select(judge.evidence_types(F.col("m"), {"diagnosis": F.col("dx"), "symptoms": F.col("sx")})).collect()] == [["diagnosis"], ["other"], []]
    assert [r[0] for r in df.select(annotation.verify_removals(F.col("r"), F.col("t"))).collect()] == [["alphine"], [], []]
    ref = spark.createDataFrame([("b", ["y", "z"]), ("a", None), (None, ["q"])], "n string, v array<string>")
    assert annotation.reference_text(ref, "n", {"values": "v"}).first()["text"] == "- a\n  values: \n- b\n  values: y; z"
    with pytest.raises(ValueError, match="more than 2"):
        annotation.reference_text(ref, "n", {"values": "v"}, most=2)
    assert annotation.reference_text(ref.limit(0), "n", {"values": "v"}).first()["text"] == ""
    times = spark.sql("select timestamp_ntz '2024-01-02 03:04:05' as t union all select timestamp_ntz '2024-01-02 03:04:05.25' union all select null")
    assert sorted(r[0] or "" for r in times.select(iso_timestamp(F.col("t"))).collect()) == ["", "2024-01-02T03:04:05", "2024-01-02T03:04:05.250000"]
    lines = spark.createDataFrame([('{"a": {"b": 1}, "c": "x"}',), ("junk",)], "v string")
    assert [r[0] for r in lines.select(files.peek("v", "c")).collect()] == ["x", None]


def test_greedy_pairs():
    assert matching.greedy_pairs([("a", 1.0), ("b", 1.1)], [("x", 1.05), ("y", 5.0), ("w", 1.05)]) == [("a", "w"), ("b", "x")]
    assert matching.greedy_pairs([("a", 1.0)], []) == []


def pool(rng, stratum, group, n, shift=0.0):
    return [(stratum, group, f"{group}{i}", rng.gauss(shift, 1), None if i % 17 == 0 else rng.gauss(0, 1)) for i in range(n)]


def test_matched_arms(spark):
    """Pairs where both arms are large enough, a random sample where one has fewer than five or no model fits, topped up to n."""
    rng = random.Random(2)
    rows_ = [("big", True, f"t{i}", rng.gauss(1, 1), 0.0) for i in range(12)] + [("big", False, f"c{i}", rng.gauss(0, 1), 0.0) for i in range(60)]
    rows_ += [("small", True, f"t{i}", 1.0, 0.0) for i in range(3)] + [("small", False, f"c{i}", 1.0, 0.0) for i in range(9)]
    rows_ += [("nulls", True, f"t{i}", None, 0.0) for i in range(8)] + [("nulls", False, f"c{i}", 1.0, 0.0) for i in range(8)] + [("nulls", True, None, 1.0, 0.0)]
    df = spark.createDataFrame(rows_, "s string, treated boolean, id string, x double, y double")
    got = matching.matched_arms(df, ["s"], "id", 10, ["x", "y"]).collect()
    tally = {}
    for r in got:
        tally[r["s"], r["treated"], r["how"]] = tally.get((r["s"], r["treated"], r["how"]), 0) + 1
    assert tally == {("big", True, "matched"): 10, ("big", False, "matched"): 10, ("small", True, "filled"): 3, ("small", False, "filled"): 9, ("nulls", True, "filled"): 8, ("nulls", False, "filled"): 8}
    assert len({(r["s"], r["id"]) for r in got}) == len(got)
    pairs = {r["treated_id"]: r["control_id"] for r in matching.match(df, ["s"], "id", 12, ["x", "y"]).collect()}
    x = {r[2]: r[3] for r in rows_ if r[0] == "big"}
    assert len(set(pairs.values())) == 12 and sum(abs(x[a] - x[b]) for a, b in pairs.items()) / 12 < 0.6
    many = matching.matched_arms(df, ["s"], "id", 40, ["x", "y"]).where("s = 'big'").groupBy("treated", "how").count().collect()
    assert {(r["treated"], r["how"]): r["count"] for r in many} == {(True, "matched"): 12, (False, "matched"): 12, (False, "filled"): 28}
    assert matching.matched_arms(df.limit(0), ["s"], "id", 3, ["x"]).count() == 0


def test_four_groups(spark):
    """Ids shared by pools end in one group, which is filled again; a stratum with too few positives is left out."""
    rng = random.Random(4)
    rows_ = [r for g, n in (("pos_train", 15), ("pos_nontrain", 20), ("neg_train", 30), ("neg_nontrain", 30)) for r in pool(rng, "a", g, n)]
    rows_ += [("a", "neg_train", f"pos_train{i}", 0.0, 0.0) for i in range(10)] + pool(rng, "b", "pos_train", 3) + pool(rng, "b", "pos_nontrain", 20)
    df = spark.createDataFrame(rows_, "dx string, `group` string, id string, x double, y double")
    got = matching.four_groups(df, "dx", "id", 8, ["x", "y"]).collect()
    sizes = {}
    for r in got:
        sizes[r["dx"], r["group"]] = sizes.get((r["dx"], r["group"]), 0) + 1
    assert sizes == {("a", g): 8 for g in matching.GROUPS}
    assert len({r["id"] for r in got}) == 32


def test_files(spark, tmp_path):
    p = str(tmp_path / "in.jsonl")
    open(p, "w").write('{"a": 1, "b": "x"}\n\nnot json\n{"a": 2}\n')
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    assert files.read_lines(spark, p, schema, "drop").count() == 2
    kept = files.read_lines(spark, p, schema, "keep").collect()
    assert sum(r["_corrupt"] is not None for r in kept) == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_lines(spark, p, schema).collect()
    numbered = files.number_lines(spark, p)
    assert rows(numbered.select("row_idx")) == [(0,), (1,), (2,), (3,)]
    parsed = {r["row_idx"]: r for r in files.parse_lines(numbered, schema).collect()}
    assert parsed[3]["a"] == 2 and parsed[2]["a"] is None and parsed[2]["_corrupt"] == "not json" and parsed[1]["_corrupt"] is None
    df = spark.createDataFrame([(1, 'x "q", y\nz')], schema)
    files.write_table(df, str(tmp_path / "t"), ["b", "a"])
    back = files.read_table(spark, str(tmp_path / "t"), T.StructType([schema["b"], schema["a"]]), multiline=True)
    assert tuple(back.first()) == ('x "q", y\nz', 1)


def test_markers_summaries_and_tables(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert not files.is_done(spark, f"{root}/x", model="a")
    files.write_done(spark, f"{root}/x", model="a", n=3)
    assert files.is_done(spark, f"{root}/x", model="a", n=3) and not files.is_done(spark, f"{root}/x", model="b", n=3)
    df = spark.createDataFrame([(1, None), (2, "é")], "a int, b string")
    files.write_summary(df, f"{root}/s.json")
    assert json.load(open(tmp_path / "s.json")) == [{"a": 1, "b": None}, {"a": 2, "b": "é"}]
    with pytest.raises(ValueError, match="more than 1"):
        files.write_summary(df, f"{root}/s.json", most=1)
    with pytest.raises(ValueError, match="name"):
        files.create_table(df, "x; drop")
    for _ in range(2):
        files.create_table(df, "made_here")
    assert spark.table("made_here").count() == 2
    spark.sql("drop table made_here")


def test_command_line(spark, tmp_path, capsys):
    tables = tmp_path / "tables"
    spark.createDataFrame([(i, f"r{i}") for i in range(20)], "row_idx long, record_uid string").write.parquet(str(tables / "notes.parquet"))
    out = str(tmp_path / "out")
    assert main(["list"]) == 0 and "first_rows" in capsys.readouterr().out
    assert main(["sql", "first_rows"]) == 0 and "select" in capsys.readouterr().out
    assert main(["sql", "nothing"]) == 2 and main(["run", "first_rows", "--data", str(tables), "--apply"], spark) == 2
    run = ["run", "first_rows", "--data", str(tables), "--out", out]
    assert main(run, spark) == 0 and not (tmp_path / "out").exists()
    assert main([*run, "--apply"], spark) == 0 and spark.read.parquet(out).count() == 10
    capsys.readouterr()
    assert main([*run, "--apply"], spark) == 0 and "is done" in capsys.readouterr().out
    assert main(["run", "first_rows", "--data", str(tables), "--out", out + ".json", "--apply", "--format", "summary"], spark) == 0
    assert len(json.load(open(out + ".json"))) == 10


def test_staged_tables_are_removed(spark):
    from lexivault.runtime import scratch, scratch_dir, spread, stage

    folder = f"{scratch_dir(spark)}/scratch-{spark.sparkContext.applicationId}".replace("file:", "")
    with scratch(spark):
        staged = stage(spark.range(5), "five")
        assert staged.count() == 5
        inside = set(os.listdir(folder))
    assert any(n.startswith("five") for n in inside) and not any(n.startswith("five") for n in os.listdir(folder))
    tracker, shuffled = spark.sparkContext.statusTracker(), spark.range(100).groupBy("id").count()
    before = len(tracker.getJobIdsForGroup(None))
    assert spread(shuffled) is shuffled and len(tracker.getJobIdsForGroup(None)) == before


def test_other_tokenizers(spark):
    """Grams, coverage and cuts over tokens of any function that gives offsets."""
    letters = Offsets(lambda t: [(i, i + 1) for i, c in enumerate(t) if c != " "])
    c = spark.createDataFrame([(1, "k", "ab cd"), (2, "k", ""), (3, "k", None)], "id int, key string, text string")
    s = spark.createDataFrame([("k", "xabcy")], "key string, text string")
    got = {r["id"]: (r["covered"], r["total"]) for r in grams.gram_coverage(c, s, 2, letters).collect()}
    assert got == {1: (3, 4), 2: (0, 0), 3: (0, 0)}
    assert rows(grams.gram_texts(c, s, 2, letters)) == [(1, 0, "a b"), (1, 1, "b c")]
    assert {(r["tau"], r["id"]): r["covered"] for r in grams.gram_coverages(c, s, [2, 3], letters).collect()}[3, 1] == 3
    assert rows(grams.repetition_cut(spark.createDataFrame([(1, "abab")], "id int, t string"), "id", "t", 2, letters)) == [(1, 4, 2)]
    assert c.select(token_spans("text")).collect()[0][0][1]["e"] == 5 and [r[0] for r in c.select(token_count("text", letters)).collect()] == [4, 0, 0]


def test_review(spark):
    assert review.modes(None, None) == ["original"]
    j = spark.createDataFrame([("a", True, True), ("b", False, None), ("c", True, True), (None, True, False)], "k string, truth boolean, mention boolean")
    assert review.corrected(j, None, None, "k").select("mode").distinct().count() == 1
    gold, flips = spark.createDataFrame([("b", True), ("a", False)], "k string, fixed boolean"), spark.createDataFrame([("b",), ("c",)], "k string")
    got = {r["k"]: (r["truth"], r["mention"]) for r in review.corrected(j, gold, flips, "k").where("mode = 'adjudication'").collect()}
    assert got == {"a": (False, True), "b": (False, False), "c": (False, False), None: (True, False)}
    with pytest.raises(ValueError, match="incomplete"):
        review.require_complete(spark.createDataFrame([("x", 1)], "p string, missing int"), "missing")
    with pytest.raises(ValueError, match="shared"):
        review.require_disjoint(j, flips, "k")
    review.require_disjoint(j, flips.where("k = 'z'"), "k")
    with pytest.raises(ValueError, match="repeated"):
        review.require_unique(j.unionByName(j), ["k"])
    assert [r[0] for r in j.select(review.first_present(j, ["none", "k"])).collect()] == ["a", "b", "c", None]
    assert j.select(review.first_present(j, ["none"]).alias("x")).first()[0] is None
    rep = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), (None, 3, "z")], "k string, o int, v string")
    assert rows(review.first_per_key(rep, "k", ["o"])) == [("a", 1, "x")] and rows(review.first_per_key(rep, "k", ["o"], last=True)) == [("a", 2, None)]
    assert metrics.metric_pivot(j, "k", "truth", {"n": F.count(F.lit(1))}).columns == ["k", "false", "true"]
    with pytest.raises(ValueError, match="more than 1"):
        metrics.metric_pivot(j, "k", "truth", {"n": F.count(F.lit(1))}, most=1)


def test_snapshot_and_audit(spark, tmp_path):
    root = f"file://{tmp_path}"
    for n in (1, 2):
        files.write_snapshot(spark.range(n), root, "ds")
        assert files.read_snapshot(spark, root, "ds").count() == n
    a = spark.createDataFrame([("x", 1), ("y", 2)], "p string, v int")
    files.append_audit(a, f"{root}/audit", "p", "overwrite")
    files.append_audit(a.where("p = 'x'"), f"{root}/audit", "p", "overwrite")
    assert spark.read.parquet(f"{root}/audit").count() == 2
    assert files.partition_filter(spark.read.parquet(f"{root}/audit"), p=["x"]).count() == 1
    wide = spark.createDataFrame([(True, False)], "a_present boolean, b_present boolean")
    assert wide.select(files.named_columns(wide, "_present")).first()[0] == {"a": True, "b": False}


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a b a b a b"), (2, "x")], "id int, t string").write.parquet(src)
    run = lambda: score_stream(spark.readStream.schema("id int, t string").parquet(src), lambda b: grams.repetition_cut(b, "id", "t", 2), str(tmp_path / "out"), str(tmp_path / "cp"), "id").awaitTermination()
    run()
    spark.createDataFrame([(3, "y")], "id int, t string").write.mode("append").parquet(src)
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_nothing_imports_llm():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "lexivault"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"lexivault\.llm|from \.+llm", f.read_text()), f
