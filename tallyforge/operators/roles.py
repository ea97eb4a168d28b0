"""Roles read off the experience section: dates, headings, bullets. Order-dependent, so a fold over each text's lines."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
NOW = ("present", "current", "now", "today", "ongoing")

_TOKEN = r"(?:[A-Za-z]{3,9}\.? (?:19|20)\d\d|\d{1,2}/(?:19|20)\d\d|(?:19|20)\d\d)"
_RANGE = re.compile(rf"({_TOKEN})\s*(?:-|–|—|to|until)\s*({_TOKEN}|{'|'.join(NOW)})", re.I)
_BULLET = re.compile(r"^\s*(?:[•▪*\-–◦·]|\d{1,2}[.)]|o|\(cid:\d+\))\s+")
_SPLITS = (r", ", r"\s+at\s+", r"\s+\|\s+", r"\s+–\s+", r"\s+-\s+", r"\s+—\s+")


def parse_date(token: str) -> dt.date | None:
    """"Mar 2020", "3/2020" (months held between 1 and 12) or "2020" (January); None for anything else."""
    if m := re.fullmatch(r"([A-Za-z]{3})[a-z]*\.? (\d{4})", token.strip()):
        month = MONTHS.get(m[1].lower())
        return dt.date(int(m[2]), month, 1) if month else None
    if m := re.fullmatch(r"(\d{1,2})/(\d{4})", token.strip()):
        return dt.date(int(m[2]), min(12, max(1, int(m[1]))), 1)
    return dt.date(int(token), 1, 1) if re.fullmatch(r"\d{4}", token.strip()) else None


def split_heading(line: str) -> tuple[str, str, dt.date | None, dt.date | None, bool]:
    """(title, company, start, end, is_current) of a heading; the first separator in order of precedence splits it."""
    m = _RANGE.search(line)
    start = parse_date(m[1]) if m else None
    current = bool(m) and m[2].lower() in NOW
    end = parse_date(m[2]) if m and not current else None
    name = (f"{line[: m.start()]} {line[m.end() :]}" if m else line).strip(" \t,|–—-()")
    for pattern in _SPLITS:
        if len(parts := re.split(pattern, name, maxsplit=1)) > 1:
            return parts[0].strip(), parts[1].strip(), start, end, current
    return name, "", start, end, current


def fold_roles(lines: list[str], first: int = 0) -> list[dict]:
    """Roles of a section's lines. A dated line opens a role, and so does an undated one right before a bullet; a plain
    line after the heading is the subtitle, an indented one after a bullet continues it; others are passed over."""
    roles: list[dict] = []
    for i, line in enumerate(lines):
        text = line.strip()
        if not text:
            continue
        if m := _BULLET.match(line):
            if roles:
                roles[-1]["bullets"].append(line[m.end() :].strip())
            continue
        following = next((x for x in lines[i + 1 :] if x.strip()), "")
        blank_before = i == 0 or not lines[i - 1].strip()
        if _RANGE.search(text) or (blank_before and _BULLET.match(following)):
            title, company, start, end, current = split_heading(text)
            roles.append({"heading": text, "title": title, "company": company, "subtitle": "", "start_date": start, "end_date": end, "is_current": current, "bullets": [], "line_index": first + i})
        elif roles and roles[-1]["bullets"] and line[:1] in " \t":
            roles[-1]["bullets"][-1] += " " + text
        elif roles and not roles[-1]["bullets"] and not roles[-1]["subtitle"]:
            roles[-1]["subtitle"] = text
    return roles


def parsed_roles(df: DataFrame, key: str, text: str, opens: str = r"^(?:WORK )?EXPERIENCE$|^EMPLOYMENT$", closes: str = r"^[A-Z][A-Z &]{3,}$") -> DataFrame:
    """Rows (key, role_ix, heading, title, company, subtitle, start_date, end_date, is_current, bullets, line_index): the
    roles of each distinct text, from the line that matches `opens` to the next that matches `closes`."""
    begin, end = re.compile(opens), re.compile(closes)
    shape = "k long, role_ix int, heading string, title string, company string, subtitle string, start_date date, end_date date, is_current boolean, bullets array<string>, line_index int"
    names = [c.split(" ")[0] for c in shape.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["k"], b["t"]):
                lines = re.split(r"\r\n|\n|\r", t)
                a = next((i + 1 for i, x in enumerate(lines) if begin.match(x.strip())), None)
                if a is not None:
                    z = next((i for i in range(a, len(lines)) if end.match(lines[i].strip())), len(lines))
                    out += [{"k": k, "role_ix": n, **r} for n, r in enumerate(fold_roles(lines[a:z], a))]
            yield pd.DataFrame(out, columns=names)

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("t IS NOT NULL").distinct()
    return rows.mapInPandas(scan, shape).withColumnRenamed("k", key)
