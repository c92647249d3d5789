"""Records judged by an outside model: requests with retries and fallback, and tolerant reading of its answers.

The client is a protocol; nothing here knows a provider. Requests are made per partition, a bounded number at
a time, and a failed record is a row with an error, so a lost task repeats only its own records.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 20_000


class JudgeClient(Protocol):
    """What sends one message and returns the answer's text; raises JudgeError."""

    def send(self, user: str, system: str, model: str) -> str: ...


class JudgeError(Exception):
    """A failed request; ``final`` ones aren't worth repeating (bad request, no access, no such model)."""

    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.status = status

    @property
    def final(self) -> bool:
        return self.status in (400, 401, 404)


def ask(client: JudgeClient, user: str, system: str, models: Sequence[str], retries: int = 6, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, str | None]:
    """(answer, model, error): each model in turn, each with growing pauses between its tries."""
    error = "no model"
    for model in models:
        for attempt in range(retries):
            try:
                return client.send(user, system, model), model, None
            except JudgeError as e:
                error = str(e)
                if e.final:
                    break
                if attempt + 1 < retries:
                    sleep(base * 2**attempt)
    return None, None, error


_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)
# Repairs tried in turn on text that isn't quite JSON.
_REPAIRS = (
    (re.compile(r"[“”]"), '"'),
    (re.compile(r"//[^\n\"]*$", re.M), ""),
    (re.compile(r",\s*([}\]])"), r"\1"),
    (re.compile(r"([{,]\s*)([A-Za-z_]\w*)\s*:"), r'\1"\2":'),
    (re.compile(r"'([^'\"]*)'(?=\s*[,:}\]])"), r'"\1"'),
    (re.compile(r":\s*(?:True|TRUE)\b"), ": true"),
    (re.compile(r":\s*(?:False|FALSE)\b"), ": false"),
    (re.compile(r":\s*(?:None|NULL|NaN)\b"), ": null"),
)


def _balanced(text: str) -> Iterator[str]:
    """Each stretch from an opening brace to its closing one, braces in strings aside."""
    start, depth, quoted, escaped = -1, 0, False, False
    for i, ch in enumerate(text):
        if quoted:
            escaped, quoted = (ch == "\\" and not escaped), not (ch == '"' and not escaped)
        elif ch == '"' and depth:
            quoted, escaped = True, False
        elif ch == "{":
            start, depth = (i, 1) if not depth else (start, depth + 1)
        elif ch == "}" and depth:
            depth -= 1
            if not depth:
                yield text[start : i + 1]


def parse_answer(text: str | None, fields: Sequence[str], booleans: bool = False) -> dict | None:
    """The object in an answer that has exactly the fields (all booleans, if asked), or null.

    Tried in turn: the text as it is, fenced blocks, balanced braces, from first to last brace, the same
    repaired, and at last the booleans field by field.
    """
    if not text or not text.strip():
        return None

    def fits(value: object) -> bool:
        return isinstance(value, dict) and set(value) == set(fields) and (not booleans or all(isinstance(v, bool) for v in value.values()))

    trimmed = text[text.find("{") : text.rfind("}") + 1] if "{" in text else ""
    tries = [text, *_FENCE.findall(text), *_balanced(text), trimmed]
    repaired = []
    for t in filter(None, tries[1:] or [text]):
        for pattern, by in _REPAIRS:
            t = pattern.sub(by, t)
        repaired += [t, " ".join(t.splitlines())]
    for t in tries + repaired:
        try:
            value = json.loads(t)
        except ValueError:
            continue
        if fits(value):
            return value
    if booleans:
        found = {f: m.group(1).lower() == "true" for f in fields if (m := re.search(rf"[\"']?{re.escape(f)}[\"']?\s*[:=]\s*[\"']?(true|false)\b", text, re.I))}
        if len(found) == len(fields):
            return found
    return None


class Spacing:
    """Lets callers of several threads through one after the other, at least ``seconds`` apart."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.seconds, self.clock, self.sleep = seconds, clock, sleep
        self.lock, self.next = Lock(), 0.0

    def wait(self) -> None:
        if self.seconds <= 0:
            return
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + self.seconds
        if at > now:
            self.sleep(at - now)


def judge_records(
    df: DataFrame, id_col: str, text_col: str, client: Callable[[], JudgeClient], system: str, models: Sequence[str], fields: Sequence[str], at_once: int = 5, retries: int = 6, base: float = 2.0, spacing: float = 0.0
) -> DataFrame:
    """(id_col, answer JSON, judge_model, judge_truncated, judge_error) of each row with a text.

    Texts are cut to MAX_CHARS and flagged. ``client`` makes one client a partition, which sends at most at_once requests
    at a time and starts them at least ``spacing`` seconds apart.
    """
    src = df.where(F.col(text_col) != "").select(F.col(id_col).cast("string").alias("id"), F.substring(text_col, 1, MAX_CHARS).alias("text"), (F.length(text_col) > MAX_CHARS).alias("cut"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, gate = client(), Spacing(spacing)

        def one(text: str) -> tuple[str | None, str | None, str | None]:
            gate.wait()
            return ask(own, text, system, models, retries, base)

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                rows = []
                for id_, cut, (answer, model, error) in zip(batch["id"], batch["cut"], pool.map(one, batch["text"])):
                    parsed = parse_answer(answer, fields) if error is None else None
                    rows.append((id_, json.dumps(parsed) if parsed is not None else None, model, bool(cut), error or (None if parsed is not None else "unreadable answer")))
                yield pd.DataFrame(rows, columns=[id_col, "answer", "judge_model", "judge_truncated", "judge_error"])

    return src.mapInPandas(run, f"{id_col} string, answer string, judge_model string, judge_truncated boolean, judge_error string")


def evidence_types(mentioned: Column, spans: dict[str, Column]) -> Column:
    """Names of the non-empty span lists; ['other'] if mentioned without any; empty if not mentioned."""
    named = F.filter(F.array(*[F.when(F.size(c) > 0, F.lit(n)) for n, c in spans.items()]), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    return F.when(~F.coalesce(mentioned, F.lit(False)), none).when(F.size(named) == 0, F.array(F.lit("other"))).otherwise(named)


def known_label(c: Column, allowed: Sequence[str]) -> Column:
    """The label if it is one of those allowed, else null."""
    return F.when(c.isin(*allowed), c)
