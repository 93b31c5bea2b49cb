"""Identifiers derived from recognised text."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a clock time, and the marks of an order list.
CLOCK = r"\b(?:[01]?\d|2[0-3]):[0-5]\d\b"
YEAR_MONTH = re.compile(r"([0-9]{4})年([0-9]{1,2})月")
MONTH_DAY = re.compile(r"([0-9]{1,2})月([0-9]{1,2})日")
TIME_AMOUNT = re.compile(r"((?:[01]?[0-9]|2[0-3]):[0-5][0-9])[^\n]{0,40}?[0-9]+(?:\.[0-9]+)?元")


def reg_ids(text: Column, patterns: Sequence[str]) -> Column:
    """At most one id: what the patterns find in the text without clock times, joined by ``-``.

    Of a match the first group that isn't blank counts, else the whole.
    """
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), CLOCK, "")
    empty = F.array().cast("array<string>")
    found = empty
    for p in (p.strip() for p in patterns if p.strip()):
        groups = re.compile(p).groups
        ways = [F.regexp_extract_all(plain, F.lit(p), F.lit(i)) for i in range(groups + 1)]
        if groups:
            rows = F.arrays_zip(*(w.alias(f"g{i}") for i, w in enumerate(ways)))
            named = [f"g{i}" for i in range(1, groups + 1)]
            found = F.concat(found, F.transform(rows, lambda r: F.coalesce(*(F.when(F.trim(r[g]) != "", r[g]) for g in named), r["g0"])))  # noqa: B023
        else:
            found = F.concat(found, ways[0])
    return F.when(F.size(found) > 0, F.array(F.array_join(found, "-"))).otherwise(empty)


def order_ids(text: str | None) -> list[str]:
    """``YYMM-MMDD-HHMM`` for each time and amount that stands between its month-and-day mark and the next one.

    An amount that runs over the next mark is looked at again from there, and
    then is behind its start, so it counts for neither. Hours keep their digits.
    """
    month = YEAR_MONTH.search(text or "")
    if not month:
        return []
    head = month[1][-2:] + month[2].zfill(2)
    marks = list(MONTH_DAY.finditer(text))
    times = [(m.start(), m.end(), m[1].replace(":", "")) for m in TIME_AMOUNT.finditer(text)]
    out = []
    for mark, limit in zip(marks, [*(m.start() for m in marks[1:]), len(text)]):
        while times and times[0][0] <= mark.start():
            times.pop(0)
        while times and times[0][1] <= limit:
            out.append(f"{head}-{mark[1].zfill(2)}{mark[2].zfill(2)}-{times.pop(0)[2]}")
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def order_list_ids(text: pd.Series) -> pd.Series:
    """order_ids() over Arrow batches: which amounts count depends on the marks before them."""
    return text.map(order_ids)


def clean_ids(ids: Column) -> Column:
    return F.filter(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


ID_STRATEGIES = {"RegStrategy": reg_ids, "OrderListStrategy": lambda text, patterns: order_list_ids(text)}


def register_id_strategy(name: str, make) -> None:
    """make(text, patterns) gives a Column of array<string>."""
    ID_STRATEGIES[name] = make


def page_ids(text: Column, strategy: str | None, patterns: Sequence[str]) -> Column:
    return clean_ids(ID_STRATEGIES.get(strategy or "", reg_ids)(text, patterns))
