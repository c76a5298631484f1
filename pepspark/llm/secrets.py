"""Secret scans with multipart credential linking (DataFrame operations only).

One pass over the texts finds strong parts (assignments, access identifiers, long hex runs) and weak ones (bare
40-character keys, endpoints) with their code point spans.  Weak parts are joined by interval with the strong ones:
a bare key counts only within ``SCOPE`` code points of an access identifier, an endpoint only near an access
identifier or an assignment.  The join is a range frame over each document's parts in order of position, so its work
is linear in the parts and no pair is made.  Only documents with both kinds of parts are shuffled, without texts.

Null text counts as empty.  Every row is scanned by itself, repeated rows, repeated ids and null ids included.  Texts are
scanned whole, of any length.  Spans that start at one place are in order of their kinds.  ``scan_secrets`` reads no columns
but the id and the text; ``redact_secrets`` keeps all columns as they are.  An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pepspark.functions.columns import bound
from pepspark.llm.common import staged, table

#: The patterns of the strong parts and of the weak ones, in the order in which kinds are listed.
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BARE_KEY = r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/]))(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?[^\x00-\x20\x22\x27<>]*"
KINDS = ("assign", "access", "hex", "key", "endpoint")
STRONG = ("assign", "access", "hex")
SCOPE = 256
LEAST_VALUE = 6
BLOCK = 256

SPANS = "array<struct<start:int,end:int>>"


def spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """(start, end) of the leftmost matches, in code points; those whose ``group`` is shorter than ``least`` drop.

    A match starts where the gaps and matches before it end: ``split`` gives the gaps, ``regexp_extract_all`` the matches.
    Sums run over ``BLOCK`` matches at a time, and then over the blocks, so the work is near linear in the matches.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else hits
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def add(state, x):
        start = state["at"] + x["gap"]
        end = start + x["hit"]
        one = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["size"] >= least, F.concat(state["out"], F.array(one))).otherwise(state["out"]).alias("out"))

    rows = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    rows = F.zip_with(rows, sizes, lambda r, s: F.struct(r["hit"].alias("hit"), r["gap"].alias("gap"), s.alias("size")))

    def whole(rows):
        count = F.ceil(F.size(rows) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.aggregate(F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)), zero, add))
        return bound(blocks, _placed)

    few = F.aggregate(rows, zero, add, lambda s: s["out"])
    found = F.when(F.size(hits) <= BLOCK, few).otherwise(bound(rows, whole))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def _placed(blocks: Column) -> Column:
    """The spans of all blocks, each block's moved by the lengths of those before it."""
    begins = F.aggregate(blocks, F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + b["at"])))

    def moved(block, by):
        return F.transform(block["out"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end")))

    return F.flatten(F.zip_with(blocks, F.slice(begins, F.lit(1), F.size(blocks)), moved))


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row, _id`` and an array of spans for each kind; staged, so that ``_row`` stays as it is."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), text.alias("_text")).select(
        "_row",
        "_id",
        spans(F.col("_text"), ASSIGN, 2, LEAST_VALUE).alias("assign"),
        spans(F.col("_text"), ACCESS).alias("access"),
        spans(F.col("_text"), HEX).alias("hex"),
        spans(F.col("_text"), BARE_KEY).alias("key"),
        spans(F.col("_text"), ENDPOINT).alias("endpoint"),
    )
    return staged(found, "parts")


def _tagged(kinds) -> Column:
    """One array of (start, kind number, end) of the kinds' spans."""

    def tagged(kind: str) -> Column:
        number = F.lit(KINDS.index(kind)).alias("kind")
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), number, s["end"].alias("end")))

    return reduce(F.concat, map(tagged, kinds))


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``_row, linked``: the weak parts with a complementary part within the scope."""
    both = parts.where("(size(key) > 0 and size(access) > 0) or (size(endpoint) > 0 and (size(access) > 0 or size(assign) > 0))")
    rows = both.select("_row", F.explode(_tagged(("assign", "access", "key", "endpoint"))).alias("part"))
    near = Window.partitionBy("_row").orderBy("_at").rangeBetween(-scope, scope)
    rows = rows.select("_row", "part", F.col("part.start").alias("_at"), F.col("part.kind").alias("_kind"))
    seen = rows.withColumn("_access", F.max(F.col("_kind") == KINDS.index("access")).over(near)).withColumn("_assign", F.max(F.col("_kind") == KINDS.index("assign")).over(near))
    kept = seen.where(f"(_kind = {KINDS.index('key')} and _access) or (_kind = {KINDS.index('endpoint')} and (_access or _assign))")
    return kept.groupBy("_row").agg(F.collect_list("part").alias("linked"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``id_col, assign, access, hex, base, spans``: strong spans by kind and all in order, and with the linked weak ones."""
    parts = find_parts(docs, id_col, text_col)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    base = F.array_sort(_tagged(STRONG))
    return parts.join(link_parts(parts, scope), "_row", "left").select(
        F.col("_id").alias(id_col), "assign", "access", "hex", base.alias("base"), F.array_sort(F.concat(base, F.coalesce("linked", none))).alias("spans")
    )


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span of the text replaced by its kind in brackets; overlapping spans are one.

    Rows meet their spans by (id, text digest), so that rows sharing an id keep their own; texts without spans are
    not changed, and null stays null.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    named = docs.select(F.struct(F.col(id_col).alias("id"), key.alias("digest")).alias("_key"), F.col(text_col).alias("_text"))
    found = scan_secrets(named, "_key", "_text", scope).where("size(spans) > 0").select("_key.*", "spans").dropDuplicates(["id", "digest"])
    found = found.select(F.col("id").alias("_id"), F.col("digest").alias("_found"), F.col("spans").alias("_spans"))
    text = F.col("_text")
    names = F.array(*map(F.lit, KINDS))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(state, s):
        start = F.greatest(s["start"], state["at"])
        gap = F.substr(text, state["at"] + 1, start - state["at"])
        label = F.when(s["start"] >= state["at"], F.concat(F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap, label).alias("out"))

    rest = F.aggregate("_spans", zero, cut, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_own"), F.col(text_col).alias("_text"), key.alias("_digest"))
    rows = rows.join(found, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_found")), "left")
    cleared = F.when(F.col("_spans").isNotNull(), rest).otherwise(text)
    return rows.select(*[(cleared if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans."""
    return scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in STRONG),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
