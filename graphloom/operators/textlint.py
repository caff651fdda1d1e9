"""Checks of technical text: Markdown blocks, sentences, and findings (severity, rule, path, line, message, text).

Blocks come from a state machine over lines, which needs Python; everything after it is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import clean_inline, excerpt, first_word, sentences, word_count

# Word lists and patterns of the rules.
PROCEDURAL = "configuration|deployment|getting started|installation|instructions|operation|operations|procedure|procedures|quick start|runbook|setup|steps|troubleshooting|usage"
IMPERATIVE = "add apply attach check choose clean click close connect continue copy create delete disable disconnect download enable enter examine install keep make move open press put read record remove replace restart run save select set start stop type update upload use verify wait write".split()
CONTRACTIONS = "aren't can't couldn't didn't doesn't don't hadn't hasn't haven't he's here's i'd i'll i'm i've isn't it's let's mustn't shan't she's shouldn't that's there's they'd they'll they're they've wasn't we'd we'll we're we've weren't what's where's who's won't wouldn't you'd you'll you're you've".split()
BRITISH = "behaviour centre colour defence fibre licence organise organisation programme recognise".split()
LATIN = r"e\.g\.|i\.e\.|etc\."
BE = "am|are|be|been|being|is|was|were"
RISK = "cause|damage|death|injury|prevent|result|risk"
LIMITS = {"procedural": 20, "descriptive": 25}
MOST_SENTENCES = 6
SUFFIXES = (".adoc", ".md", ".mdx", ".rst", ".text", ".txt")
EXCLUDED = (".git", ".hg", ".svn", ".venv", "build", "dist", "node_modules", "vendor", "venv")

_fence = re.compile(r"\s*(`{3,}|~{3,})").match
_heading = re.compile(r"#{1,6}\s+(.*)").match
_item = re.compile(r"\s*(?:[-+*]|\d+[.)]|[A-Za-z][.)])\s+").match
_procedural = re.compile(rf"\b(?:{PROCEDURAL})\b", re.IGNORECASE).search
_no_prose = re.compile(r"[|>]|<!--|\[[^\]]+\]:\s+|[-:| ]{3,}$").match

BLOCK = "path string, block long, line long, text string, is_list boolean, procedural boolean"


def markdown_blocks(text: str) -> Iterator[tuple[int, int, str, bool, bool]]:
    """(number, first line, text, is a list item, stands in a procedural section). Front matter, fences, headings, tables,
    quotes, comments, link definitions and indented lines are no blocks, but end one."""
    lines = text.splitlines()
    start = 0
    if lines and lines[0].strip() == "---":
        start = next((i + 1 for i, x in enumerate(lines) if i and x.strip() == "---"), len(lines))
    fence, procedural, held, first, made = "", False, [], 0, 0
    for number, line in enumerate(lines[start:], start + 1):
        bare, mark = line.strip(), _fence(line)
        if fence:
            fence = "" if mark and mark[1][0] == fence else fence
            continue
        item = None
        heading = None if mark else _heading(line)
        prose = bool(bare) and not (mark or heading or line.startswith(("    ", "\t")) or _no_prose(bare))
        if prose:
            item = _item(line)
        if held and (item or not prose):
            yield made, first, " ".join(held), False, procedural
            held, made = [], made + 1
        if mark:
            fence = mark[1][0]
        elif heading:
            procedural = bool(_procedural(heading[1]))
        elif item:
            if rest := line[item.end() :].strip():
                yield made, number, rest, True, procedural
                made += 1
        elif prose:
            first = first if held else number
            held.append(bare)
    if held:
        yield made, first, " ".join(held), False, procedural


def blocks(docs: DataFrame, mode: str = "auto") -> DataFrame:
    """(path, block, line, text, mode, is_list) of ``docs`` (path, text); a null text is empty. ``mode``: auto, descriptive or procedural."""
    if mode not in ("auto", *LIMITS):
        raise ValueError(f"no such mode: {mode}")

    def run(frames):
        for pdf in frames:
            rows = [(p, *b) for p, t in zip(pdf["path"], pdf["text"], strict=True) for b in markdown_blocks(t or "")]
            yield pd.DataFrame(rows, columns=["path", "block", "line", "text", "is_list", "procedural"])

    found = docs.select("path", "text").mapInPandas(run, BLOCK)
    inferred = F.when(F.col("procedural") | first_word("text").isin(IMPERATIVE), "procedural").otherwise("descriptive")
    return found.withColumn("mode", inferred if mode == "auto" else F.lit(mode)).select("path", "block", "line", "text", "mode", "is_list")


def sentence_rows(found: DataFrame) -> DataFrame:
    """(path, block, line, mode, n, sentence, words) of blocks."""
    rows = found.select("path", "block", "line", "mode", F.posexplode(sentences("text")).alias("n", "sentence"))
    return rows.withColumn("n", F.col("n").cast("long")).withColumn("words", word_count("sentence").cast("long"))


def _finding(rows: DataFrame, severity: str, rule: Column | str, message: Column | str, text: str) -> DataFrame:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(F.lit(severity).alias("severity"), as_column(rule).alias("rule"), "path", "line", as_column(message).alias("message"), excerpt(text).alias("text"))


def _whole(words: str) -> str:
    return rf"(?iU)\b(?:{words})\b"


def findings(docs: DataFrame, mode: str = "auto") -> DataFrame:
    """All rules over ``docs`` (path, text); ``line`` is the first line of the block."""
    return block_findings(blocks(docs, mode))


def block_findings(found: DataFrame) -> DataFrame:
    clean = found.withColumn("clean", clean_inline("text"))
    said = sentence_rows(found)
    verbs = "|".join(IMPERATIVE)

    def each(words: list[str]) -> DataFrame:
        return clean.withColumn("hit", F.explode(F.regexp_extract_all("clean", F.lit(_whole("|".join(words))), F.lit(0))))

    limit = F.when(F.col("mode") == "procedural", LIMITS["procedural"]).otherwise(LIMITS["descriptive"])
    long = F.format_string("%s sentence has %d words; maximum is %d.", F.initcap("mode"), "words", limit)
    many = found.withColumn("n", F.size(sentences("text")))
    upper = F.upper("text")
    parts = [
        _finding(clean.filter(F.contains("clean", F.lit(";"))), "error", "STE-8.1", "Semicolons are not permitted.", "text"),
        _finding(each(CONTRACTIONS), "error", "STE-4.2", F.format_string("Write the contraction '%s' in full.", "hit"), "text"),
        _finding(each(BRITISH), "warning", "STE-1.14", F.format_string("Check '%s' against the controlling spelling directive.", "hit"), "text"),
        _finding(clean.filter(F.col("clean").rlike(rf"(?iU)\b(?:{LATIN})")), "warning", "STE-GR-6", "Replace or review the Latin abbreviation.", "text"),
        _finding(said.filter(F.col("words") > limit), "error", F.when(F.col("mode") == "procedural", "STE-5.1").otherwise("STE-6.3"), long, "sentence"),
        _finding(said.filter(F.col("sentence").rlike(rf"(?iU)\b(?:{BE})\s+(?:\w+ly\s+)?[A-Za-z]+(?:ed|en)\b")), "warning", "STE-3.6", "Review likely passive voice; it is permitted only in a limited descriptive case.", "sentence"),
        _finding(said.filter((F.col("mode") == "procedural") & F.col("sentence").rlike(rf"(?iU)\b(?:and|then)\s+(?:{verbs})\b")), "warning", "STE-5.2", "Review possible multiple instructions; keep them together only if they occur at the same time.", "sentence"),
        _finding(many.filter((F.col("mode") == "descriptive") & ~F.col("is_list") & (F.col("n") > MOST_SENTENCES)), "error", "STE-6.6", F.format_string(f"Paragraph has %d sentences; maximum is {MOST_SENTENCES}.", "n"), "text"),
        _finding(found.filter(F.startswith(upper, F.lit("NOTE:")) & first_word(F.substring("text", 6, 1 << 30)).isin(IMPERATIVE)), "error", "STE-5.5", "A note must give information, not an instruction.", "text"),
        _finding(found.filter(upper.rlike("^(WARNING|CAUTION):") & ~F.col("text").rlike(_whole(RISK))), "warning", "STE-7.3", "Check that the safety instruction states the risk or possible result.", "text"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verdict(found: DataFrame, fail_on_warning: bool = False) -> DataFrame:
    """One row: errors, warnings, exit_code (1 with an error, or with a warning if those fail too)."""
    n = lambda s: F.count_if(F.col("severity") == s)
    failed = (F.col("errors") > 0) | (F.lit(fail_on_warning) & (F.col("warnings") > 0))
    return found.agg(n("error").alias("errors"), n("warning").alias("warnings")).withColumn("exit_code", F.when(failed, 1).otherwise(0))


def read_texts(spark, paths: list[str]) -> DataFrame:
    """(path, text) of files as given and, of folders, of all files below with a documentation suffix, but for excluded folders; each once."""
    import os

    found = []
    for path in paths:
        if os.path.isdir(path):
            for folder, inner, names in os.walk(path):
                inner[:] = sorted(x for x in inner if x not in EXCLUDED)
                found += [os.path.join(folder, n) for n in sorted(names) if n.lower().endswith(SUFFIXES)]
        elif os.path.isfile(path):
            found.append(path)
        else:
            raise FileNotFoundError(path)
    once = sorted({os.path.realpath(p) for p in found})
    if not once:
        return spark.createDataFrame([], "path string, text string")
    raw = spark.read.format("binaryFile").load(once)
    return raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode("content", "UTF-8").alias("text"))

