"""Cleaning text taken from PDF pages: lines are normalised, classified and reassembled."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprov.functions.text import SPACE, let, trimmed

# Lines that carry no content, as case-insensitive patterns, and repeated phrases.
STRUCTURAL = [r"^Contents\s+Page$", r"^Reference number$"]
NOISE = [
    r"^SNV\s*/\s*licensed to\s+", r"^COPYRIGHT PROTECTED DOCUMENT$", r"^ISO copyright office$", r"^CP\s*401\b", r"^CH-?1214\b",
    r"^Phone:\s*\+", r"^Email:\s*", r"^Website:\s*", r"^Published in Switzerland$", r"^Price based on \d+ pages$",
    r"^INTERNATIONAL\s+STANDARD$", r"^ICS\s+[0-9.;\s\t-]+$", r"^Table\s+A\.1\s*\(continued\)", r"^©\s*ISO/IEC\s*20\d{2}\s*[–-]\s*All rights reserved$",
]
PAGE = [r"^\d{1,3}$", r"^[ivxlcdm]{1,8}$"]
CONTENTS = [r"\.{3,}\s*\d+\s*$", r"^(?:[A-Za-z]\s+)?\d+(?:\.\d+)*\s+.+\s+\d{1,3}$", r"^(?:Annex|Bibliography|Foreword|Introduction|Scope|Normative references|Terms and definitions)\b.*\d{1,3}\s*$"]
REPEATED = ["iso/iec 27001:2022", "snv / licensed to", "all rights reserved"]
# End of the fixed values.
OFTEN = 3
RULES = ("structural", "known_noise", "page_marker", "table_of_contents", "repeated_header_footer")


BLANK = SPACE.replace(r"[\s\x0B", r"[ \t\f\x0B")


def normalised(text: Column) -> Column:
    """Lines of a text with spaces of one kind, letters set apart joined (four or more), annexes and clause numbers set right."""
    out = F.regexp_replace(F.replace(F.regexp_replace(text, "\r\n?", "\n"), F.lit("\xa0"), F.lit(" ")), r"[\t\f\x0B]+", " ")
    # A blank goes if a run of at least four single letters stands around it.
    run = r"(?<![A-Za-z0-9_])(?:[A-Za-z] +){3,}[A-Za-z](?![A-Za-z0-9_])"

    def joined(t: Column) -> Column:
        pieces = F.zip_with(F.split(t, run), F.regexp_extract_all(t, F.lit(f"({run})"), 1), lambda g, p: F.concat(F.coalesce(g, F.lit("")), F.coalesce(F.replace(p, F.lit(" "), F.lit("")), F.lit(""))))
        return F.when(t.rlike(run), F.array_join(pieces, "")).otherwise(t)

    out = let(out, joined)
    out = F.regexp_replace(out, r"(?<![A-Za-z0-9_])Annex([A-Z])(?![A-Za-z0-9_])", "Annex $1")
    out = F.regexp_replace(out, r"(\d\.) +(\d)", "$1$2")
    return F.regexp_replace(F.regexp_replace(out, rf"{BLANK}{{2,}}", " "), rf"{BLANK}+(?=\n|\z)", "")


def any_of(text: Column, patterns: list[str], flags: str = "(?i)") -> Column:
    """Whether one of the patterns is found. Those that hold at the beginning share its test, so that other places are passed over quickly."""
    first, others = [f"(?:{p[1:]})" for p in patterns if p[0] == "^"], [f"(?:{p})" for p in patterns if p[0] != "^"]
    return text.rlike(flags + "|".join([f"^(?:{'|'.join(first)})"] * bool(first) + others))


def ruled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lines, rules): the lines of each document, and for each the first rule that removes it, or null. All
    within the row."""
    bare = lambda whole: F.transform(F.split(F.regexp_replace(whole, BLANK.replace("[ ", "["), " "), "\n"), lambda x: F.trim(x))  # noqa: E731  # no two stand together by now
    # Both in one expression, so that the text is normalised once.
    rows = docs.select(key, let(normalised(F.col(text)), lambda whole: F.struct(F.split(whole, "\n").alias("lines"), bare(whole).alias("bare"))).alias("own"))
    rows = rows.select(key, "own.lines", "own.bare")
    phrase = lambda x: functools.reduce(operator.or_, [F.lower(x).contains(p) for p in REPEATED])
    rows = rows.withColumn("marked", F.array_sort(F.transform(F.filter("bare", phrase), F.lower)))
    often = F.array_distinct(F.filter("marked", lambda x, i: F.get("marked", i + (OFTEN - 1)) == x))
    rows = rows.withColumn("often", often)

    def rule(b: Column, often: Column) -> Column:
        fixed = (
            F.when(any_of(b, STRUCTURAL), RULES[0])
            .when(any_of(b, NOISE), RULES[1])
            .when(any_of(b, PAGE), RULES[2])
            .when(any_of(b, CONTENTS[::2]) | any_of(b, CONTENTS[1:2], ""), RULES[3])
        )
        # Most lines meet no rule, which one test tells.
        told = let(F.when(any_of(b, [*STRUCTURAL, *NOISE, *PAGE, *CONTENTS]), fixed), lambda own: F.coalesce(own, F.when((F.size(often) > 0) & F.array_contains(often, F.lower(b)), RULES[4])))
        return F.when(b != "", told)

    # What is asked for line by line is worked out before: a lambda would work out again, for each line, what stands in it.
    return rows.select(key, "lines", let(F.col("often"), lambda often: F.transform("bare", lambda b: rule(b, often))).alias("rules"))


def classified(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at, line, rule): every line with the first rule that removes it, or null."""
    both = ruled(docs, key, text).select(key, F.posexplode_outer(F.arrays_zip("lines", "rules")).alias("at", "x"))
    return both.select(key, "at", F.col("x.lines").alias("line"), F.col("x.rules").alias("rule"))


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: the text that is left and what was removed, by rule and in all."""
    size = F.length(F.regexp_replace(F.col(text), "\r\n?", "\n")).alias("original_chars")
    named = docs.select(F.struct(F.col(key), size).alias("of"), F.col(text).alias("text"))
    rows = ruled(named, "of", "text")
    # Worked out before the lines are gone through, or it would be once a line.
    kept = F.array_join(let(F.col("rules"), lambda rules: F.filter("lines", lambda x, i: F.get(rules, i).isNull())), "\n")
    removed = lambda rule: F.size(F.filter("rules", lambda x: x == rule)).cast("long").alias(rule)
    counts = [removed(r) for r in RULES]
    out = rows.select(F.col(f"of.{key}"), trimmed(F.regexp_replace(kept, r"\n{3,}", "\n\n")).alias("cleaned_text"), F.size("lines").cast("long").alias("original_lines"), *counts, "of.original_chars")
    out = out.withColumn("cleaned_chars", F.length("cleaned_text")).withColumn("cleaned_lines", F.when(F.col("cleaned_text") == "", 0).otherwise(F.size(F.split("cleaned_text", "\n"))))
    out = out.withColumn("removed_chars", F.greatest(F.lit(0), F.col("original_chars") - F.col("cleaned_chars"))).withColumn("removed_lines", F.greatest(F.lit(0), F.col("original_lines") - F.col("cleaned_lines")))
    return out.withColumn("removed_char_ratio", F.coalesce(F.try_divide(F.col("removed_chars").cast("double"), F.col("original_chars")), F.lit(0.0)))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = OFTEN) -> DataFrame:
    """(key, line, times) of lines that a document repeats, ignoring case and white space."""
    lines = docs.select(key, F.explode(F.split(F.col(text), "\n")).alias("raw"))
    folded = lines.select(key, F.lower(trimmed(F.regexp_replace("raw", f"{SPACE}+", " "))).alias("line")).where("line <> ''")
    return folded.groupBy(key, "line").agg(F.count("*").alias("times")).where(F.col("times") >= least)


def page_rows(glyphs: DataFrame, tolerance: float = 2.0, gap: float = 1.5) -> DataFrame:
    """Lines of text from placed glyphs (doc_id, page, x, y, width, str): rows from the top
    down, glyphs closer in height than `tolerance` to the row's first in one row, a blank where the gap is wider than `gap`."""
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["y", "x"], ascending=[False, True], kind="stable")
        row_no, first = [], None
        for y in group["y"]:
            if first is None or first - y > tolerance:
                first = y
                row_no.append((row_no[-1] if row_no else -1) + 1)
            else:
                row_no.append(row_no[-1])
        group = group.assign(row=row_no).sort_values(["row", "x"], kind="stable")
        lines = []
        for no, own in group.groupby("row"):
            out, end = "", None
            for x, width, s in zip(own["x"], own["width"], own["str"], strict=True):
                out += (" " if end is not None and x - end > gap and not out.endswith(" ") else "") + s
                end = x + width
            lines.append((group["doc_id"].iloc[0], group["page"].iloc[0], no, out.strip()))
        return pd.DataFrame(lines, columns=["doc_id", "page", "row", "line"])

    return glyphs.groupBy("doc_id", "page").applyInPandas(run, "doc_id long, page long, row long, line string")
