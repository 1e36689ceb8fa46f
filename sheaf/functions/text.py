"""Text functions as Column expressions, with the same in DuckDB SQL for the oracles."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of a token, whole tokens that carry no content, and endings a stem loses.
TOKEN = r"[\p{L}\p{N}_\x{0900}-\x{0963}\x{0966}-\x{0D7F}]+"
STOPWORDS = """
a an the of in on at to for from by with and or as that this these those it its
i you we they he she me my your our can could should would will shall may might
what who whom whose which when where why how does did do is are was were be been
being has have had tell please give show explain describe about any there if then
than so not no also into over under between during per via
है हैं था थी थे क्या कौन कब कहाँ कैसे क्यों का की के को में से पर और या यह वह ये वो कि तो भी ही नहीं
hai hain tha thi kya kaun kab kahan kaise kyun ka ki ke ko mein se par aur ya yeh woh ye vo bhi nahi
mujhe batao bataiye
kitne kitna kitni tak rakhe rakha rakhi jaate jaata jata jati milta milti milte hota hoti hote karna karne kare karein
liye lie wala wali wale kuch koi kis kisi kaisa kaisi kyon hum aap tum apna apni mera meri hamara hamari sab saare
""".split()
SUFFIXES = ("ing", "ed", "es", "s")


def tokenize(text: Column) -> Column:
    """Lower-case tokens in order; null text has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def stem(token: Column) -> Column:
    """Light stripping of one ending, the first that leaves three letters; only of ASCII tokens of four or more (numbers have none of
    these endings). ASCII: as many bytes as characters."""
    out = F.when((F.length(token) < 4) | (F.octet_length(token) != F.length(token)), token)
    for s in SUFFIXES:
        out = out.when(token.endswith(s) & (F.length(token) - len(s) >= 3), F.left(token, F.length(token) - len(s)))
    return out.otherwise(token)


def content_terms(text: Column) -> Column:
    """Stems of the tokens that aren't stopwords; single characters only if digits."""
    keep = lambda t: ~t.isin(STOPWORDS) & ((F.length(t) > 1) | t.rlike(r"^\p{Nd}$"))
    return F.transform(F.filter(tokenize(text), keep), stem)


def coverage(query_terms: Column, text_terms: Column) -> Column:
    """Share of the query's distinct terms that the text has; 0 if the query has none."""
    q = F.array_distinct(query_terms)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, text_terms)) / F.size(q))


OVERVIEW = (
    r"(?i)\b(summari[sz]e|summary|overview|gist|tl;?dr)\b",
    r"(?i)^\s*(what|whats|what's)(\s+is|\s+are)?\s+(this|the|that)\s+(document|file|pdf|doc|report|paper|sheet|spreadsheet|presentation|deck|image|audio|recording)s?(\s+about|\s+contain\w*)?\s*[?.!]*\s*$",
    r"(?i)\bwhat\s+(does|do)\s+(this|the|that|it)\s+\w*\s*(document|file|pdf|doc|report|sheet|presentation|image|audio)?\s*(contain|say|cover|include|have)\b",
    r"(?i)\b(what|tell me|explain)\b.{0,20}\b(document|file|pdf)\b.{0,12}\babout\b",
    r"(?i)सारांश|saransh",
)  # fixed values: requests that mean a whole document


def is_overview(question: Column) -> Column:
    q = F.trim(F.coalesce(question, F.lit("")))
    found = F.lit(False)
    for p in OVERVIEW:
        found = found | q.rlike(p)
    return (q != "") & found


#: Every character that stands for a digit, in any script, and the plain digit at the same place.
DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isdigit())
PLAIN_DIGITS = "".join(str(unicodedata.digit(c)) for c in DIGITS)


def numbers(text: Column) -> Column:
    """Numbers without thousands separators or needless zeros; digits of all scripts count."""
    raw = F.regexp_extract_all(F.translate(text, DIGITS, PLAIN_DIGITS), F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0))
    return F.array_distinct(F.transform(raw, plain_number))


def plain_number(n: Column) -> Column:
    v = F.replace(n, F.lit(","), F.lit(""))
    return F.when(F.contains(v, F.lit(".")), F.regexp_replace(F.regexp_replace(v, "0+$", ""), r"\.$", "")).otherwise(v)


def format_clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("int")
    short = F.format_string("%02d:%02d", F.expr("0") + (s / 60).cast("int"), s % 60)
    return F.when(s < 3600, short).otherwise(F.format_string("%d:%02d:%02d", (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), s % 60))


# ---- the same in DuckDB SQL -------------------------------------------------------------------

STOPS_SQL = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def sql_tokens(text: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({text}, ''), '{TOKEN}'), lambda x: lower(x))"


def sql_stem(t: str) -> str:
    cases = " ".join(f"WHEN ends_with({t}, '{s}') AND length({t}) - {len(s)} >= 3 THEN left({t}, length({t}) - {len(s)})" for s in SUFFIXES)
    return rf"CASE WHEN length({t}) < 4 OR NOT regexp_full_match({t}, '[\x00-\x7F]+') OR regexp_full_match({t}, '[0-9]+') THEN {t} {cases} ELSE {t} END"


def sql_terms(text: str) -> str:
    keep = rf"list_filter({sql_tokens(text)}, lambda t: NOT list_contains({STOPS_SQL}, t) AND (length(t) > 1 OR regexp_full_match(t, '\p{{Nd}}')))"
    return f"list_transform({keep}, lambda t: {sql_stem('t')})"


def sql_numbers(text: str) -> str:
    plain = "replace(x, ',', '')"
    trimmed = f"regexp_replace(regexp_replace({plain}, '0+$', ''), '\\.$', '')"
    found = rf"regexp_extract_all(translate({text}, '{DIGITS}', '{PLAIN_DIGITS}'), '[0-9][0-9,]*(?:\.[0-9]+)?')"
    return f"list_transform({found}, lambda x: CASE WHEN contains({plain}, '.') THEN {trimmed} ELSE {plain} END)"
