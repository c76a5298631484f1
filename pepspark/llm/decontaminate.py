"""Benchmark decontamination with a distributed positional inverted index (DataFrame operations only).

The token store holds every document's words.  Test phrases are windows of benchmark items; the corpus frequency of
their terms gives each window its rarest terms, the anchors.  The index holds the postings (term, document, position)
of all anchors.  A window's posting lists are intersected from the rarest, each moved by its term's offset, and what
is left is compared with the stored words.  No posting of a frequent word is stored unless a window has no rarer one.

Sides are broadcast only when counted and small (``BROADCAST_ROWS``); beyond that the same joins shuffle.

Sides are small by their bytes as written, not by their rows, since one row may hold a phrase of many items.

Null or wordless texts have no words and no hits.  An item without words has no window; items with equal windows are
all reported.  Every row is a document of its own, whatever its id: rows with equal or null ids get each their own
result.  Repeated items with the same id count once.  Texts of any length are one row of the token store.  Columns
besides the named ones are not read, so their names clash with nothing.  An empty benchmark gives zero hits; an empty
corpus gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pepspark.llm.common import free_shuffles, lower_ascii, staged, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
ANCHORS = 2
BROADCAST_BYTES = 16 << 20
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of letters, digits and characters beyond ASCII."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(text.rlike(r"[^\x00-\x7F]"), lower_ascii(text)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def size_of(columns: list[str], schema) -> Column:
    """Bytes of a row's strings and lists, and some for the rest."""
    total = F.lit(16 * len(columns))
    for c in columns:
        kind = schema[c].dataType.simpleString()
        if kind == "string":
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind == "array<string>":
            total = total + F.coalesce(F.octet_length(F.array_join(c, "  ")), F.lit(0)) + 24 * F.greatest(F.size(c), F.lit(0))
    return total.cast("long")


def checked(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its rows and bytes are counted to be few."""
    found = df.select(size_of(df.columns, df.schema).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if found["n"] <= BROADCAST_ROWS and found["b"] <= BROADCAST_BYTES else df


def windows(items: DataFrame, id_col: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """``phrase_id, phrase array<string>, items array``: the distinct windows and the items that have them."""
    each = items.select(F.col(id_col).cast("string").alias("_item"), words(F.col(text_col)).alias("_words")).where(F.size("_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - (size - 1), F.lit(1)))
    return (
        each.select("_item", F.explode(F.transform(starts, lambda i: F.slice("_words", i, F.lit(size)))).alias("phrase"))
        .groupBy("phrase")
        .agg(F.collect_set("_item").alias("items"))
        .withColumn("phrase_id", F.monotonically_increasing_id())
    )


def term_frequencies(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, term_id, cf``: occurrences in the whole corpus of the given terms; absent terms have no row."""
    counts = tokens.select(F.explode("words").alias("term")).join(checked(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    return counts.withColumn("term_id", F.monotonically_increasing_id())


def anchors(phrases: DataFrame, frequencies: DataFrame, count: int = ANCHORS) -> DataFrame:
    """``phrase_id, rank, term, term_id, offset, n_anchors``: the rarest places of each phrase all of whose terms occur."""
    places = phrases.select("phrase_id", F.size("phrase").alias("_n"), F.posexplode("phrase").alias("offset", "term"))
    ranked = Window.partitionBy("phrase_id").orderBy("cf", "offset")
    return (
        places.join(frequencies, "term")
        .withColumn("rank", F.row_number().over(ranked))
        .withColumn("_known", F.count(F.lit(1)).over(Window.partitionBy("phrase_id")))
        .where(f"_known = _n and rank <= {count}")
        .select("phrase_id", "rank", "term", "term_id", "offset", F.least("_n", F.lit(count)).alias("n_anchors"))
    )


def build_index(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """``term_id, doc, pos``: the stored postings of the terms (``term, term_id``)."""
    postings = tokens.select("doc", F.posexplode("words").alias("pos", "term")).join(checked(terms), "term")
    return staged(postings.select("term_id", "doc", "pos").sortWithinPartitions("term_id", "doc", "pos"), "postings")


def phrase_candidates(index: DataFrame, marks: DataFrame, count: int = ANCHORS) -> DataFrame:
    """``phrase_id, doc, start``: where all anchors of a phrase stand at their offsets.

    The list of a phrase's rarest term is moved by its offset; what it asks of the next rarest term's list is an equality
    of document, term and position.
    """
    mine = marks.where("rank = 1").select("term_id", "phrase_id", "offset", "n_anchors")
    found = index.join(checked(mine), "term_id").select("phrase_id", "doc", (F.col("pos") - F.col("offset")).alias("start"), "n_anchors").where("start >= 0")
    for rank in range(2, count + 1):
        wanted = marks.where(F.col("rank") == rank).select("phrase_id", "term_id", "offset")
        asked = found.join(checked(wanted), "phrase_id").withColumn("pos", F.col("start") + F.col("offset"))
        terms = checked(wanted.select("term_id").distinct())
        met = asked.join(index.join(terms, "term_id", "left_semi"), ["doc", "term_id", "pos"]).select(found.columns)
        found = met.unionByName(found.where(F.col("n_anchors") < rank))
    return found.select("phrase_id", "doc", "start").distinct()


def phrase_matches(tokens: DataFrame, index: DataFrame, marks: DataFrame, phrases: DataFrame) -> DataFrame:
    """``doc, start, length, items``: every occurrence of a phrase, compared word by word with the token store."""
    candidates = staged(phrase_candidates(index, marks), "candidates")
    free_shuffles(tokens.sparkSession)
    held = candidates.join(checked(phrases.select("phrase_id", "phrase", "items")), "phrase_id").select("doc", "start", "phrase", "items")
    some = tokens.select("doc", "words").join(checked(candidates.select("doc").distinct()), "doc", "left_semi")
    return (
        some.join(held, "doc")
        .where(F.slice("words", F.col("start") + 1, F.size("phrase")) == F.col("phrase"))
        .select("doc", "start", F.size("phrase").alias("length"), "items")
    )


def proximity_matches(index: DataFrame, phrases: DataFrame, frequencies: DataFrame, slop: int = 5) -> DataFrame:
    """``phrase_id, doc, end``: places where all terms of a phrase stand, in any order, within its length plus ``slop``.

    ``index`` has the postings of all terms of the phrases.  One ordered pass over each document's postings of a
    phrase; no pairs are made.
    """
    terms = phrases.select("phrase_id", F.size(F.array_distinct("phrase")).alias("_n"), (F.size("phrase") + slop).alias("_span"), F.explode(F.array_distinct("phrase")).alias("term"))
    found = index.join(checked(terms.join(frequencies.select("term", "term_id"), "term")), "term_id")
    spans = [r[0] for r in terms.select("_span").distinct().collect()]  # at most one for each phrase length
    out = index.sparkSession.createDataFrame([], f"phrase_id long, doc {index.schema['doc'].dataType.simpleString()}, end {index.schema['pos'].dataType.simpleString()}")
    for span in spans:
        near = Window.partitionBy("phrase_id", "doc").orderBy("pos").rangeBetween(-(span - 1), 0)
        part = found.where(F.col("_span") == span).withColumn("_seen", F.size(F.collect_set("term").over(near))).where("_seen = _n").select("phrase_id", "doc", F.col("pos").alias("end"))
        out = out.unionByName(part)
    return out


def covered(spans: Column) -> Column:
    """How many positions the (start, length) spans cover, overlaps once."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(state, span):
        start, end = F.greatest(span["start"], state["end"]), span["start"] + span["length"]
        return F.struct(F.greatest(end, state["end"]).alias("end"), (state["n"] + F.greatest(end - start, F.lit(0))).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, add, lambda s: s["n"])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slop: int | None = None) -> DataFrame:
    """``id_col, n_words, n_hit, n_items, items``: hits of all windows of the items in all documents.

    With ``slop``, also ``near_items``: items all of whose words of a window stand near each other, in any order, within the
    window's length and that many words more.  The index then holds the postings of all terms of the windows.
    """
    tokens = staged(docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("words")), "tokens")
    phrases = staged(windows(items, item_col, item_text_col), "phrases")
    terms = phrases.select(F.explode("phrase").alias("term")).distinct()
    frequencies = staged(term_frequencies(tokens, terms), "frequencies")
    marks = staged(anchors(phrases, frequencies), "anchors")
    index = build_index(tokens, (marks if slop is None else frequencies).select("term", "term_id").distinct())
    hits = (
        phrase_matches(tokens, index, marks, phrases)
        .groupBy("doc")
        .agg(F.collect_set(F.struct("start", "length")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"))
        .select("doc", covered(F.col("_spans")).alias("n_hit"), "_items")
    )
    more = []
    if slop is not None:
        met = proximity_matches(index, phrases, frequencies, slop).select("phrase_id", "doc").distinct()
        near = met.join(phrases.select("phrase_id", F.explode("items").alias("_item")), "phrase_id").groupBy("doc").agg(F.array_sort(F.collect_set("_item")).alias("_near"))
        hits = hits.join(near, "doc", "full")
        more = [F.coalesce("_near", F.array().cast("array<string>")).alias("near_items")]
    return tokens.select("doc", "id", F.size("words").cast("long").alias("n_words")).join(hits, "doc", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("items"),
        *more,
    )


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """Per document: words, words hit by benchmark windows, and the items hit."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same by joining every window of 10 document words with the items' windows.
OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS ph, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT n FROM p),
o AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, g WHERE len(w) >= n),
h AS (SELECT o.r, o.i, o.n, p.item_id FROM o JOIN p ON p.n = o.n AND p.ph = array_to_string(o.w[o.i:o.i + o.n - 1], ' ')),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS ids FROM h GROUP BY r)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(c.n_hit, 0)::bigint AS n_hit, coalesce(t.n_items, 0)::bigint AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
