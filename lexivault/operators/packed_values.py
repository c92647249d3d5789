"""Several values packed in one field.

Method: dialects by minimum description length. A dialect is a set of delimiters and whether quotes
enclose values. Every different cell is parsed in each candidate dialect. Spelled-out lengths choose a
first dialect for each cell; the values of those parses are counted over all cells, distributed, and a
value's code length is then what its count in other cells gives or, if less, that of spelling it out. Each cell is parsed with the dialect of least total length.

A slash divides only with white space on both sides. What stands in quotes or brackets isn't divided;
a quote or bracket that is never closed is an ordinary character. Null and blank cells and those that
hold only a placeholder have no values. Rows that repeat an id and its cells count once, rows of a null id each;
repeated values stay, each at its position. Equal cells are parsed once, however many rows hold them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivault.runtime import stage

# The delimiters looked for, and the cells that stand for no value.
DELIMITERS = (";", ",", "|", "•", "\t", "\n", "/")
PLACEHOLDERS = ("nan", "n/a", "-")

_QUOTED = r'"(?:[^"]|"")*"|“[^”]*”'
_BRACKETED = r"\([^()]*\)|\[[^\[\]]*\]"
_SLASH = r"\s+/\s+"
_TOKENS = {
    True: re.compile(f"{_QUOTED}|{_BRACKETED}|{_SLASH}|[;,|•\t\n]|[^;,|•\t\n\"“(\\[/\\s]+|.", re.S),
    False: re.compile(f"{_BRACKETED}|{_SLASH}|[;,|•\t\n]|[^;,|•\t\n\"“”(\\[/\\s]+|.", re.S),
}
_ENCLOSED = re.compile(_QUOTED)
_QUOTES = ('"', "“", "”")

# Bits: a letter spelled out, a delimiter or quote as a mere character, an unknown value, each value, each delimiter of a dialect.
_LETTER, _LITERAL, _UNKNOWN, _VALUE, _DIALECT = 5.0, 24.0, 8.0, 3.0, 2.0


def _delimiter(token: str) -> str | None:
    """The delimiter that a token is, if it is one."""
    if token in DELIMITERS:
        return None if token == "/" else token
    return "/" if token[0].isspace() and token.strip() == "/" else None


def unquote(value: str) -> str:
    """A value without outer white space and enclosing quotes; doubled quotes inside those become single."""
    value = value.strip()
    if len(value) > 1 and _ENCLOSED.fullmatch(value):
        value = value[1:-1].replace('""', '"').strip() if value[0] == '"' else value[1:-1].strip()
    return value


def _parts(cell: str, delimiters: Sequence[str], quotes: bool) -> Iterator[tuple[str, float]]:
    """The non-empty values of a cell in order, each with the bits of spelling it out.

    A delimiter or quote costs more as a mere character than inside quotes or brackets, which protect it.
    """
    part: list[str] = []
    bits = 0.0
    for token in [*_TOKENS[quotes].findall(cell), None]:
        d = _delimiter(token) if token else None
        if token is None or d and d in delimiters:
            value = "".join(part)
            value = unquote(value) if quotes else value.strip()
            if value:
                yield value, _UNKNOWN + bits
            part, bits = [], 0.0
        else:
            part.append(token)
            bits += _LITERAL if d or token in _QUOTES else _LETTER * len(token)


def parse(cell: str, delimiters: Sequence[str], quotes: bool) -> list[str]:
    """The non-empty values of a cell in order."""
    return [value for value, _ in _parts(cell, delimiters, quotes)]


def dialects(cell: str) -> list[tuple[str, bool]]:
    """Candidates for a cell: every set of the delimiters in it, larger ones first; with and without quoting where it has quotes."""
    found = sorted({d for t in _TOKENS[False].findall(cell) if (d := _delimiter(t))})
    sets = [c for n in range(len(found), -1, -1) for c in combinations(found, n)]
    quotes = (True, False) if '"' in cell or "“" in cell else (True,)
    return [("".join(s), q) for s in sets for q in quotes]


def _candidates(cells: DataFrame) -> DataFrame:
    """(field, cell_id, dialect, fixed, pos, item, spelled) for every candidate parse of every different cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for field, cell_id, cell in zip(batch["field_name"], batch["cell_id"], batch["cell"]):
                options = dialects(cell)
                for rank, (delimiters, quotes) in enumerate(options):
                    values = list(_parts(cell, delimiters, quotes))
                    fixed = _DIALECT * (len(delimiters) + quotes) + len(values) * (_VALUE + len(delimiters).bit_length())
                    rows += [(field, cell_id, rank, fixed, pos, v, bits) for pos, (v, bits) in enumerate(values, 1)]
            yield pd.DataFrame(rows, columns=["field_name", "cell_id", "dialect", "fixed", "pos", "item", "spelled"])

    return cells.mapInPandas(run, "field_name string, cell_id long, dialect int, fixed double, pos int, item string, spelled double")


def _cheapest(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("cell_id").agg(F.min(F.struct("bits", "dialect")).alias("best")).select("cell_id", F.col("best.dialect").alias("dialect"))


def split_values(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(id_col, field_name, pos INT, item): one row per value of each of the fields' cells. Rows of one id with different cells are parsed each."""
    if not fields:
        raise ValueError("name at least one field")
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("cell")) for f in fields])).alias("x")
    empty = F.lower(F.regexp_replace("cell", r"(?U)^\s+|\s+$", ""))
    long = (
        df.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{f}`") for f in fields])
        .withColumn("own", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
        .dropDuplicates()
        .select("id", named)
        .select("id", "x.*")
        .where(F.col("cell").isNotNull() & ~empty.isin("", *PLACEHOLDERS))
        .withColumn("cell_id", F.xxhash64("field_name", "cell"))
    )
    cells = long.groupBy("field_name", "cell_id").agg(F.first("cell").alias("cell"))
    options = stage(_candidates(cells), "dialects")
    first = _cheapest(options.groupBy("cell_id", "dialect").agg((F.sum("spelled") + F.first("fixed")).alias("bits")))
    own = options.join(first, ["cell_id", "dialect"]).groupBy("field_name", "item", "cell_id").agg(F.count("*").alias("own"))
    total = own.groupBy("field_name", "item").agg(F.sum("own").alias("seen"))
    volume = own.groupBy("field_name").agg(F.sum("own").alias("volume"))
    code = total.join(F.broadcast(volume), "field_name")
    # What a cell's own first parse adds to the counts doesn't count for that cell.
    others = F.col("seen") - F.coalesce("own", F.lit(0))
    value = F.when(others > 0, -F.log2(others / (F.col("volume") + 1)))
    length = (
        options.join(code, ["field_name", "item"], "left")
        .join(own.select("cell_id", "item", "own"), ["cell_id", "item"], "left")
        .groupBy("cell_id", "dialect")
        .agg((F.sum(F.least(F.coalesce(value, F.col("spelled")), F.col("spelled"))) + F.first("fixed")).alias("bits"))
    )
    best = _cheapest(length)
    parsed = options.join(best, ["cell_id", "dialect"]).groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("items"))
    return long.join(parsed, "cell_id").select("id", "field_name", F.explode("items").alias("v")).select(F.col("id").alias(id_col), "field_name", "v.pos", "v.item")
