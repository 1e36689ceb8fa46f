"""Which questions ask for a computation over tables, told by wording and by the tables' own names and values.

Questions are met with the words of a catalog by a join on the words' first letters, so no question is compared with all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import content_terms, tokenize
from sheaf.functions.values import header_words, same_term, term_key

from .dialogue import has_phrase

# Whole words and phrases, in English, Hindi and Hinglish, that ask for a computation; what ranks; what groups;
# what filters; what names tables as such.
STRONG_WORDS = """
total sum average avg mean median count maximum minimum max min highest lowest most least top bottom largest smallest
biggest greatest best worst fewest rank ranking percentage percent ratio distribution breakdown
कुल औसत कितने कितनी कितना अधिकतम न्यूनतम सर्वाधिक गिनती प्रतिशत
kul ausat kitne kitni kitna adhiktam nyuntam gintee pratishat
""".split()
STRONG_PHRASES = ("how many", "number of", "no. of", "how much", "count of", "sum of", "average of", "group by", "सबसे ज्यादा", "सबसे अधिक", "सबसे कम", "sabse zyada", "sabse jyada", "sabse kam")
HIGHEST = ("highest", "most", "top", "maximum", "max", "largest", "biggest", "greatest", "best", "सबसे ज्यादा", "सबसे अधिक", "अधिकतम", "सर्वाधिक", "sabse zyada", "sabse jyada", "adhiktam")
LOWEST = ("lowest", "least", "minimum", "min", "smallest", "worst", "bottom", "fewest", "सबसे कम", "न्यूनतम", "sabse kam", "nyuntam")
GROUP_WORDS = ("by", "per", "each", "wise", "across")
FILTER_PHRASES = ("more than", "less than", "greater than", "fewer than", "at least", "at most", "above", "below", "over", "under", "between", "where", "list all", "show all", "list the", "show the")
TABLE_WORDS = ("row", "rows", "record", "records", "entry", "entries", "sheet", "sheets", "spreadsheet", "table", "column", "columns", "csv", "excel", "workbook")

CATALOG = "table_name string, filename string, sheet string, column string, original string, kind string, values array<string>"


def catalog_terms(catalog: DataFrame) -> DataFrame:
    """(table_name, column, term): words of the tables' names (column null), of the columns' names, and of the values of text columns."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    of_table = F.concat(header_words(F.col("table_name")), header_words(F.col("sheet")), header_words(stem))
    of_column = F.concat(header_words(F.col("original")), header_words(F.col("column")))
    of_values = F.when(F.col("kind") == "text", F.flatten(F.transform(F.coalesce("values", F.array().cast("array<string>")), content_terms))).otherwise(F.array().cast("array<string>"))
    tables = catalog.select("table_name", F.lit(None).cast("string").alias("column"), F.explode(of_table).alias("term"))
    columns = catalog.select("table_name", "column", F.explode(F.concat(of_column, of_values)).alias("term"))
    return tables.union(columns).distinct()


def mentions(questions: DataFrame, catalog: DataFrame, question: str, text: str) -> DataFrame:
    """(question, tables, columns): what of the catalog a question names, by word or value; columns as table.column. Questions that name nothing aren't in it."""
    terms = questions.select(question, F.explode(F.array_distinct(content_terms(F.col(text)))).alias("q")).withColumn("k", term_key(F.col("q")))
    named = catalog_terms(catalog).withColumn("k", term_key(F.col("term")))  # as large as the catalog's names
    met = terms.join(named, "k").where(same_term(F.col("q"), F.col("term")))
    full = F.when(F.col("column").isNotNull(), F.concat_ws(".", "table_name", "column"))
    return met.groupBy(question).agg(F.array_sort(F.collect_set("table_name")).alias("tables"), F.array_sort(F.collect_set(full)).alias("columns"))


def ranking(tokens: Column) -> Column:
    """highest or lowest, if the words ask for just one of them; "at least" and "at most" don't."""
    padded = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    plain = F.split(F.trim(F.replace(F.replace(padded, F.lit(" at least "), F.lit(" ")), F.lit(" at most "), F.lit(" "))), " ")
    low, high = has_phrase(plain, LOWEST), has_phrase(plain, HIGHEST)
    return F.when(low & ~high, "lowest").when(high & ~low, "highest")


def analyze(questions: DataFrame, catalog: DataFrame, other_documents: bool, question: str = "question_id", text: str = "question") -> DataFrame:
    """(question, analytical, strong, ranking, tables, columns) of each question.

    Analytical: strong wording that mentions tables (or with nothing but tables there), or a named column with a word of grouping
    or a filter. Without tables no question is.
    """
    t = tokenize(F.col(text))
    strong = F.exists(t, lambda w: w.isin(STRONG_WORDS)) | has_phrase(t, STRONG_PHRASES)
    digits = F.exists(t, lambda w: w.rlike(r"^\p{Nd}+$"))
    filters = has_phrase(t, FILTER_PHRASES) & (digits | has_phrase(t, ("where", "list", "show")))
    q = questions.select(
        question, strong.alias("strong"), F.exists(t, lambda w: w.isin(*GROUP_WORDS)).alias("groups"), filters.alias("filters"),
        F.exists(t, lambda w: w.isin(*TABLE_WORDS)).alias("of_tables"), ranking(t).alias("ranking"), (F.size(t) > 0).alias("said"),
    )
    both = q.join(mentions(questions, catalog, question, text), question, "left")
    none = F.array().cast("array<string>")
    both = both.withColumn("tables", F.coalesce("tables", none)).withColumn("columns", F.coalesce("columns", none))
    some = F.lit(not catalog.isEmpty())
    mentioned = (F.size("tables") > 0) | F.col("of_tables") | F.lit(not other_documents)
    yes = some & F.col("said") & ((F.col("strong") & mentioned) | ((F.size("columns") > 0) & (F.col("groups") | F.col("filters"))))
    return both.select(question, yes.alias("analytical"), "strong", F.when(yes, F.col("ranking")).alias("ranking"), "tables", "columns")
