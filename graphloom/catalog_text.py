"""Text-lint queries over documents, conversations and Markdown rows, and SQL written from the rules themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import textlint as X
from graphloom.session import table

Q, O = {}, {}

MARKDOWN = {
    "guide.md": "---\ntitle: It's front matter; skip\n---\n# Installation steps\n\nDon't open the cover; it isn't safe, and then remove the plug.\nThe colour of the licence was quickly taken.\n\n- Press the button and hold it for 10 s (see Fig. 3) until the long low tone of the main unit ends and the red lamp on the left panel goes out again.\n- \n1. Record the value e.g. 5 mm.\n\n```\ncan't; code\n```\n\n| a | b; c |\n> quoted; text\n\n[ref]: http://x.y\n-----\n    indented; line\n## Behaviour\nOne. Two. Three. Four. Five. Six. Seven.\n\nNOTE: Remove the cover first.\n\nNOTE: The cover is hot.\n\nWARNING: Keep clear of the fan.\n\nCAUTION: Heat can cause damage.\n",
    "plain.md": "The unit is small. It has one lamp.\n\nUse `a;b` and [label](http://a.b/c;d) at https://x.y/z;w today.\n\nDr. A.B. Smith wrote No. 5. The value is 3.5 mm. It was removed by hand. This sentence has a great many words in it so that the count goes well above the limit of twenty-five for descriptive text, as it should, here \"quoted words count as one\" and (so do these).\n",
    "open.md": "---\nnever closed; it's all front matter\n",
    "fence.md": "before\n~~~\nit's inside; never closed\n\nmore",
}
QUOTED = lambda t: t.replace("'", "''")
ROWS = ", ".join(f"('{p}', '{QUOTED(t)}')" for p, t in MARKDOWN.items())
W = r"\p{L}\p{N}_"
#: Letters and digits beyond ASCII, as far as the tables hold any.
BEYOND = r"\x{AA}\x{B2}\x{B3}\x{B5}\x{B9}\x{BA}\x{BC}-\x{BE}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"


def _re(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{QUOTED(pattern)}', '{by}', 'g')"


def _clean(x: str) -> str:
    for pattern, by in ((r"\[([^\]]+)\]\([^\)]+\)", r"\1"), ("`[^`]*`", " CODE "), (r"https?://\S+", " URL "), (r"!\[([^\]]*)\]", r"\1"), ("[*_~]", "")):
        x = _re(x, pattern, by)
    return x


def _holds(x: str, words: str) -> str:
    return f"regexp_matches({x}, '(?i)(^|[^{W}])({QUOTED(words)})($|[^{W}])')"


def _strip(x: str) -> str:
    return _re(x, r"^\s+|\s+$", "")


def _excerpt(x: str) -> str:
    line = _strip(_re(x, r"\s+", " "))
    return f"CASE WHEN length({line}) <= 140 THEN {line} ELSE substr({line}, 1, 139) || '…' END"


def _first_word(x: str) -> str:
    return f"lower(regexp_extract({_clean(x)}, '[A-Za-z]+', 0))"


VERBS = "(" + ", ".join(f"'{v}'" for v in X.IMPERATIVE) + ")"
_held = _re(_clean("text"), r"\b([A-Za-z])\.([A-Za-z])\.", r"\1§\2§")
_held = _re(_held, r"\b(Mr|Mrs|Ms|Dr|No|Fig|Eq)\.", r"\1§")
SENTENCES = f"list_filter(list_transform(string_split(" + _re(_held, r"([.!?])\s+([A-Z0-9])", r"\1' || chr(31) || '\2") + f", chr(31)), lambda x: {_strip('replace(x, ' + chr(39) + '§' + chr(39) + ', ' + chr(39) + '.' + chr(39) + ')')}), lambda x: x <> '')"
_counted = _clean("sentence")
for _p, _by in ((r"\([^()]*\)", " PAREN "), ('“[^”]*”|"[^"]*"', " QUOTED "), (r"(?i)\b\d+(?:\.\d+)?\s*(?:°[CF]|cm|ft|g|h|Hz|in|kg|km|kPa|L|lb|m|mA|mg|min|mm|Nm|ohm|psi|s|V|W|A)\b|\b\d+(?:\.\d+)?\s*[%°]\b", " MEASURE "), (rf"[A-Za-z0-9]*[_{BEYOND}][{W}]*", "\x02")):
    _counted = _re(_counted, _p, _by)
WORDS = f"len(regexp_extract_all({_counted}, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*'))"

#: CTEs ``blocks`` (path, block, line, text, mode, is_list) and ``said`` (its sentences with their words).
LINT = f"""WITH corpus AS (SELECT 'doc:' || doc_id AS path, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'conv:' || conv_id || ':' || turn, coalesce(text, '') FROM conversations UNION ALL SELECT * FROM (VALUES {ROWS})),
split AS (SELECT path, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS a FROM corpus),
raws AS (SELECT path, unnest(range(1, len(a) + 1)) AS n, unnest(a) AS raw FROM split),
bare AS (SELECT *, {_strip("raw")} AS s, first_value({_strip("raw")}) OVER (PARTITION BY path ORDER BY n) = '---' AS front FROM raws),
ended AS (SELECT *, CASE WHEN front THEN coalesce(min(CASE WHEN n > 1 AND s = '---' THEN n END) OVER (PARTITION BY path), 1000000000) ELSE 0 END AS front_end FROM bare),
fenced AS (SELECT *, regexp_matches(raw, '^\\s*(`{{3,}}|~{{3,}})') AS fence, sum(CASE WHEN regexp_matches(raw, '^\\s*(`{{3,}}|~{{3,}})') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY n) AS fences FROM ended WHERE n > front_end),
kinds AS (SELECT *, CASE WHEN fence THEN 'fence' WHEN fences % 2 = 1 THEN 'code' WHEN regexp_matches(raw, '^#{{1,6}}\\s') THEN 'heading' WHEN s = '' THEN 'blank'
  WHEN regexp_matches(raw, '^(    |\\t)') OR regexp_matches(s, '^([|>]|<!--|\\[[^\\]]+\\]:\\s|[-:| ]{{3,}}$)') THEN 'skip'
  WHEN regexp_matches(raw, '^\\s*([-+*]|\\d+[.)]|[A-Za-z][.)])\\s+') THEN 'item' ELSE 'text' END AS kind FROM fenced),
headed AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'heading' THEN {_holds("raw", X.PROCEDURAL)} END IGNORE NULLS) OVER (PARTITION BY path ORDER BY n), false) AS procedural,
  sum(CASE WHEN kind = 'text' THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY n) AS grp FROM kinds),
found AS (SELECT path, min(n) AS line, string_agg(s, ' ' ORDER BY n) AS text, false AS is_list, bool_or(procedural) AS procedural FROM headed WHERE kind = 'text' GROUP BY path, grp
  UNION ALL SELECT path, n, {_strip(_re("raw", r"^\s*([-+*]|\d+[.)]|[A-Za-z][.)])\s+", ""))}, true, procedural FROM headed WHERE kind = 'item'),
blocks AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY line) - 1 AS block, line, text, CASE WHEN procedural OR {_first_word("text")} IN {VERBS} THEN 'procedural' ELSE 'descriptive' END AS mode, is_list FROM found WHERE text <> ''),
listed AS (SELECT *, {SENTENCES} AS sentences FROM blocks),
apart AS (SELECT path, block, line, mode, unnest(range(len(sentences))) AS n, unnest(sentences) AS sentence FROM listed),
said AS (SELECT *, {WORDS} AS words FROM apart)"""


def _token_findings(severity: str, rule: str, words: list[str], before: str, after: str, keep: str) -> str:
    held = ", ".join(f"'{QUOTED(w)}'" for w in words)
    return f"SELECT '{severity}', '{rule}', path, line, '{QUOTED(before)}' || hit || '{QUOTED(after)}', {_excerpt('text')} FROM (SELECT path, line, text, unnest(regexp_split_to_array({_clean('text')}, '[^{W}{keep}]+')) AS hit FROM blocks) WHERE lower(hit) IN ({held})"


FOUND = " UNION ALL ".join(
    [
        f"SELECT 'error' AS severity, 'STE-8.1' AS rule, path, line, 'Semicolons are not permitted.' AS message, {_excerpt('text')} AS text FROM blocks WHERE contains({_clean('text')}, ';')",
        _token_findings("error", "STE-4.2", X.CONTRACTIONS, "Write the contraction '", "' in full.", "''"),
        _token_findings("warning", "STE-1.14", X.BRITISH, "Check '", "' against the controlling spelling directive.", ""),
        f"SELECT 'warning', 'STE-GR-6', path, line, 'Replace or review the Latin abbreviation.', {_excerpt('text')} FROM blocks WHERE regexp_matches({_clean('text')}, '(?i)(^|[^{W}])({X.LATIN})')",
        f"SELECT 'error', CASE WHEN mode = 'procedural' THEN 'STE-5.1' ELSE 'STE-6.3' END, path, line, upper(mode[1]) || mode[2:] || ' sentence has ' || words || ' words; maximum is ' || (CASE WHEN mode = 'procedural' THEN 20 ELSE 25 END) || '.', {_excerpt('sentence')} FROM said WHERE words > CASE WHEN mode = 'procedural' THEN 20 ELSE 25 END",
        f"SELECT 'warning', 'STE-3.6', path, line, 'Review likely passive voice; it is permitted only in a limited descriptive case.', {_excerpt('sentence')} FROM said WHERE " + _holds("sentence", rf"(?:{X.BE})\s+(?:[{W}]+ly\s+)?[A-Za-z]+(?:ed|en)"),
        f"SELECT 'warning', 'STE-5.2', path, line, 'Review possible multiple instructions; keep them together only if they occur at the same time.', {_excerpt('sentence')} FROM said WHERE mode = 'procedural' AND " + _holds("sentence", rf"(?:and|then)\s+(?:{'|'.join(X.IMPERATIVE)})"),
        f"SELECT 'error', 'STE-6.6', path, line, 'Paragraph has ' || len(sentences) || ' sentences; maximum is 6.', {_excerpt('text')} FROM listed WHERE mode = 'descriptive' AND NOT is_list AND len(sentences) > 6",
        f"SELECT 'error', 'STE-5.5', path, line, 'A note must give information, not an instruction.', {_excerpt('text')} FROM blocks WHERE upper(text) LIKE 'NOTE:%' AND {_first_word('substr(text, 6)')} IN {VERBS}",
        f"SELECT 'warning', 'STE-7.3', path, line, 'Check that the safety instruction states the risk or possible result.', {_excerpt('text')} FROM blocks WHERE regexp_matches(upper(text), '^(WARNING|CAUTION):') AND NOT " + _holds("text", X.RISK),
    ]
)


def corpus(spark, d):
    """(path, text) of documents, conversations and the Markdown rows above."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("path"), "text")
    talk = table(spark, d, "conversations").select(F.concat_ws(":", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), "text")
    return docs.unionByName(talk).unionByName(spark.createDataFrame(list(MARKDOWN.items()), "path string, text string"))


def txt_blocks(spark, d):
    return X.blocks(corpus(spark, d))


def txt_sentences(spark, d):
    return X.sentence_rows(X.blocks(corpus(spark, d)))


def txt_findings(spark, d):
    return X.findings(corpus(spark, d))


def txt_severity(spark, d):
    return X.verdict(X.findings(corpus(spark, d)))


def txt_word_count(spark, d):
    return X.sentence_rows(X.blocks(corpus(spark, d))).groupBy("path").agg(F.sum("words").alias("words"))


Q |= {f.__name__: f for f in (txt_blocks, txt_sentences, txt_findings, txt_severity, txt_word_count)}
O |= {
    "txt_blocks": LINT + " SELECT path, block, line, text, mode, is_list FROM blocks",
    "txt_sentences": LINT + " SELECT path, block, line, mode, n, sentence, words FROM said",
    "txt_findings": LINT + " " + FOUND,
    "txt_severity": LINT + f" SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, 1 AS exit_code FROM ({FOUND})",
    "txt_word_count": LINT + " SELECT path, CAST(sum(words) AS BIGINT) AS words FROM said GROUP BY path",
}
RULES = {"txt_semicolon": "STE-8.1", "txt_contractions": "STE-4.2", "txt_spelling": "STE-1.14", "txt_latin": "STE-GR-6", "txt_long_command": "STE-5.1", "txt_long_sentence": "STE-6.3", "txt_passive": "STE-3.6", "txt_multi_command": "STE-5.2", "txt_long_paragraph": "STE-6.6", "txt_note": "STE-5.5", "txt_safety": "STE-7.3"}
for _name, _rule in RULES.items():
    Q[_name] = lambda spark, d, rule=_rule: X.findings(corpus(spark, d)).filter(F.col("rule") == rule).drop("rule")
    O[_name] = LINT + f" SELECT severity, path, line, message, text FROM ({FOUND}) WHERE rule = '{_rule}'"
