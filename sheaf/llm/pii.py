"""Personal data: patterns, and terms that give protected entities away; in DataFrame functions only.

The values the patterns find are the protected entities, and so are the domains of addresses and the /24 networks of IP numbers: an
entity of too few texts for an estimate backs off to what it belongs to. Terms of the texts that hold them, wherever they stand there, are weighed by what the corpus says: with N texts,
the pointwise mutual information of term and entity, log2(c(t,e) N / (c(t) c(e))), as a share of what the entity's name itself
would tell, log2(N / c(e)). Where a term of enough support reaches `remove_at` of that share it is removed from texts that
hold the entity, from `generalise_at` on it is generalised to its first letters. Counts are of distinct texts, all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir_set, count_kind, joined

# Kinds in their order, with patterns that say the same as the plain ones, in forms that neither backtrack nor
# recurse. Runs of digits that miss a length limit are left out by the pattern itself.
KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9](?:[\x20().-]*+[0-9]){7,14}(?![\x20().-]*+[0-9])"
BYTE_PARTS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"

BROADCAST_ROWS = 200_000
SPAN = "struct<kind:string,start:bigint,end:bigint,value:string>"


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has been counted (its source is a checkpoint) and is small; else joins shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def bound(value: Column, then) -> Column:
    """then(value), with the value worked out once however often it is used in there."""
    return F.element_at(F.transform(F.array(value), then), 1)


def matches(text: Column, pattern: Column | str, kind: str, block: int = 256) -> Column:
    """Spans of a pattern's matches; positions come from the lengths of matches and of what lies between them, summed up within
    blocks and then over blocks, so that the work grows with the matches and not with their square."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    zero = F.lit(0).cast("bigint")

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["m"]).cast("bigint")
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["m"].alias("value")).cast(SPAN)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def over(acc, x):
        moved = F.transform(x["out"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value")).cast(SPAN))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def spans(pairs):
        firsts = F.when(F.size(pairs) > 0, F.sequence(F.lit(1), F.size(pairs), F.lit(block))).otherwise(F.array().cast("array<int>"))
        none = F.struct(zero.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        blocks = F.transform(firsts, lambda i: F.aggregate(F.slice(pairs, i, F.lit(block)), none, step))
        return F.aggregate(blocks, F.struct(zero.alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out")), over, lambda acc: F.flatten(acc["out"]))

    def paired(found):
        return F.zip_with(found, F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda m, gap: F.struct(m.alias("m"), F.length(gap).cast("bigint").alias("gap")))

    return bound(bound(F.regexp_extract_all(text, pattern, F.lit(0)), paired), spans)


def luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total, i):
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four patterns, by kind as listed and then by start."""
    none = F.array().cast(f"array<{SPAN}>")
    when = lambda c, x: F.when(c, x).otherwise(none)
    return F.concat(
        when(F.contains(text, F.lit("@")), matches(text, EMAIL, "email")),
        when(text.rlike(r"[0-9]\.[0-9]"), F.filter(matches(text, IP, "ip"), lambda s: s["value"].rlike(BYTE_PARTS))),
        when(text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), F.filter(matches(text, CARD, "card"), lambda s: luhn(s["value"]))),
        when(F.contains(text, F.lit("+")), matches(text, PHONE, "phone")),
    )


def entities_of(spans: Column) -> Column:
    """What a text's spans protect: each value, and the domain of an address or the first three parts of an IP number."""
    value = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"])))
    wider = F.transform(
        F.filter(spans, lambda s: s["kind"].isin("email", "ip")),
        lambda s: F.when(s["kind"] == "email", F.concat(F.lit("domain:"), F.lower(F.substring_index(s["value"], "@", -1)))).otherwise(F.concat(F.lit("net:"), F.substring_index(s["value"], ".", 3))),
    )
    return F.array_distinct(F.concat(value, wider))


def find_private(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = 4, min_support: int = 3,
    generalise_at: float = 0.8, remove_at: float = 0.95,
) -> DataFrame:
    """One row per input row: doc_id, spans (kind, start, end, value; by kind, then start) and actions (term -> generalise or remove).

    Null and empty texts have no spans; repeated rows are treated each, but copies of a text count once in the statistics; a null
    doc_id stays; an empty table gives an empty result; other columns are ignored. What is kept between the steps is written to
    the checkpoint folder: the rows, and texts only of rows that hold personal data.
    """
    checkpoint_dir_set(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    all_texts = docs.select(F.xxhash64(text).alias("copy"), text.alias("text"))
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("text")).select("doc_id", "text", base_spans(F.col("text")).alias("spans"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text")).checkpoint()
    held = rows.where(F.col("text").isNotNull()).select("row", "text", F.xxhash64("text").alias("copy"), "spans")

    # one row for each distinct text, and the entities of enough texts: a term can't share more texts with an entity than there are
    first = held.groupBy("copy").agg(F.min("row").alias("row")).select("row").checkpoint()
    single = held.join(small(first), "row", "left_semi")
    holds = single.select("copy", F.explode(entities_of(F.col("spans"))).alias("entity"))
    n = all_texts.agg(F.count_distinct("copy")).first()[0]
    entities = holds.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= min_support)
    # A term in too many texts can't reach the threshold: c(t) <= c(t,e) (N / c(e)) ** (1 - generalise_at) must hold, and c(t,e) <= c(e).
    # Texts with personal data alone give a lower bound of c(t), so most terms needn't be counted in the whole corpus.
    widening = F.pow(F.lit(float(n)) / F.col("n_entity"), F.lit(1 - generalise_at))
    entities = entities.withColumn("most", F.col("n_entity") * widening + 0.5).checkpoint()
    holds = holds.join(small(entities), "entity").checkpoint()
    most = entities.agg(F.max("most")).first()[0] or 0.0

    # terms of the texts that hold each entity: whole words, none of an address
    word_runs = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(rf"\p{{L}}{{{min_letters},}}"), F.lit(0)))
    distinct_words = lambda texts: texts.select("copy", F.explode(word_runs(F.col("text"))).alias("term"))
    at_least = distinct_words(single).groupBy("term").agg(F.count("*").alias("at_least")).where(F.col("at_least").between(min_support, most)).checkpoint()
    plain = F.regexp_replace(F.regexp_replace("text", EMAIL, " "), r"(?<!\S)\S*@\S*", " ")
    able = single.join(small(holds.select("copy").distinct().checkpoint()), "copy", "left_semi")
    terms = able.select("copy", F.explode(word_runs(plain)).alias("term")).join(small(at_least), "term")
    both = (
        terms.join(small(holds), "copy").where(F.col("at_least") <= F.col("most"))
        .groupBy("term", "entity").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("at_least").alias("at_least"))
        .where(F.col("n_both") >= min_support)
    )
    open_ = both.where(F.col("at_least") <= F.col("n_both") * widening + 0.5).checkpoint()

    # what the whole corpus says about those that are left
    words = distinct_words(all_texts).join(small(open_.select("term").distinct()), "term", "left_semi")
    n_term = words.groupBy("term").agg(F.count_distinct("copy").alias("n_term"))
    told = (
        open_.join(n_term, "term")
        .select("term", "entity", F.log2(F.col("n_both") * F.lit(n) / (F.col("n_term") * F.col("n_entity"))).alias("pmi"), F.log2(F.lit(n) / F.col("n_entity")).alias("ic"))
        .where((F.col("ic") > 0) & (F.col("pmi") >= generalise_at * F.col("ic")))
        .select("term", "entity", (F.col("pmi") >= remove_at * F.col("ic")).alias("remove"))
        .checkpoint()
    )

    # their places in the texts that hold the entity
    own = held.select("row", F.explode(entities_of(F.col("spans"))).alias("entity"))
    marked = own.join(small(told), "entity").groupBy("row", "term").agg(F.max("remove").alias("remove"))
    marked = marked.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", F.when(F.col("remove"), "remove").otherwise("generalise")))).alias("actions")).checkpoint()  # terms of one text
    whole_word = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.map_keys("actions"), "|"), F.lit(r")(?!\p{L})"))
    places = F.filter(
        matches(F.col("text"), whole_word, "term"),
        lambda p: ~F.exists("spans", lambda s: (s["start"] < p["end"]) & (p["start"] < s["end"])),
    )
    found = held.join(small(marked), "row").select("row", "actions", places.alias("places")).where(F.size("places") > 0).checkpoint()
    values = F.array_distinct(F.transform("places", lambda p: p["value"]))
    found = found.select("row", "places", F.map_filter("actions", lambda term, _: F.array_contains(values, term)).alias("actions"))
    added = F.coalesce("places", F.array().cast(f"array<{SPAN}>"))
    return rows.select("row", "doc_id", "spans").join(found, "row", "left").select("doc_id", F.concat("spans", added).alias("spans"), F.coalesce("actions", F.create_map().cast("map<string,string>")).alias("actions"))


def sanitise(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_letters: int = 2) -> DataFrame:
    """doc_id and text with spans replaced: patterns by [KIND], generalised terms by their first letters and *, removed ones by nothing.

    `docs` must hold each doc_id once; `found` is what find_private() returned for it. Overlapping spans: the first one counts.
    """
    some = found.where(F.size("spans") > 0).withColumnRenamed("doc_id", "_id")
    joined_ = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).join(some, F.col("doc_id") == F.col("_id"), "left")
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        word = F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(F.element_at("actions", s["value"]) == "remove", F.lit("")).otherwise(F.concat(F.substring(s["value"], 1, keep_letters), F.lit("*")))
        gap = F.substr(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, word).alias("out")))

    clean = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"))))
    return joined_.select("doc_id", F.when(F.col("_id").isNull(), F.col("text")).otherwise(clean).alias("text"))


def private_report(docs: DataFrame, **options) -> DataFrame:
    """Counts and digests per document, derived from the spans."""
    found = find_private(docs, **options)
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select("doc_id", *(count_kind(F.col("spans"), k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
