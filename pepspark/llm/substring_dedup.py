"""Substring deduplication on a compacted De Bruijn graph of word k-mers.

Edges are the windows of ``size`` words.  Each window's least ``node``-word hash, its minimizer, is the node it belongs
to; runs of windows that share a minimizer are the graph's compacted paths, one row instead of one for each window.

1. Paths of all documents are staged (no text), and aggregated by node: first and last document, least and largest path.
   A node that is in one document only cannot repeat and goes.
2. Paths join the remaining nodes.  If a node has one path only (it doesn't branch), all of the path's windows are in
   the node's first document: its later occurrences are repeated spans, found without looking at windows.
3. Where nodes branch, the paths' windows are compared one by one by 128-bit hashes: first document of each, joined back.
4. The spans of a document meet its text once.

Every aggregate combines before it shuffles and every join can be split by AQE, so a passage that a third of the
documents share is no hot task.  Each phase is staged and the one before it dropped, so disk holds one phase.

Null text has no words.  Every row is a document of its own, found by its own number where ids repeat; a window is
repeated where a smaller id has it, so rows with equal ids don't take from each other.  Rows with a null id are kept as
they are and take from nobody.  Texts of any length are taken whole, some at a time.  No
columns but the id and the text are read.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pepspark.llm.common import by_row, drop_staged, free_shuffles, map_arrow, mix, ngram_hashes, staged, table, text_bytes, word_chunks

WINDOW = 13
NODE = 4


def _starts(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place in the chunk, place in the text) of each window that lies in one text."""
    counts = np.maximum(0, lengths - size + 1)
    text = np.repeat(np.arange(len(lengths)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, inside + np.repeat(np.cumsum(lengths) - lengths, counts), inside


def _paths(hashes: np.ndarray, lengths: np.ndarray, size: int, node: int):
    """The compacted paths of a chunk: text, node, path hash, first window, number of windows."""
    text, at, inside = _starts(lengths, size)
    if not len(at):
        return None
    windows, nodes = ngram_hashes(hashes, size), ngram_hashes(hashes, node)
    span = size - node + 1
    best, where = nodes[at].copy(), np.zeros(len(at), dtype=np.int64)
    for k in range(1, span):
        other = nodes[at + k]
        less = other < best
        best[less], where[less] = other[less], k
    place = at + where
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    count = np.diff(np.r_[first, len(at)])
    with np.errstate(over="ignore"):
        path = mix(windows[at[first]] * np.uint64(31) + windows[at[first] + count - 1])
        path = mix(path + (where[first] * 64 + count).astype(np.uint64))
    return text[first], best[first].view(np.int64), path.view(np.int64), inside[first], count


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``doc, text``: the key of a row is its id, or (id, number of the row) where ids repeat or are null."""
    rows, ids = by_row(docs, id_col, text_col)
    if ids is None:
        return rows, False
    return staged(rows.join(ids, "doc").select(F.struct("id", "doc").alias("doc"), "text"), "numbered"), True


def _id(key: str, paired: bool):
    return F.col(f"{key}.id" if paired else key)


def graph_paths(source: DataFrame, size: int, node: int, paired: bool) -> DataFrame:
    """``node, path, doc, start, n``: every compacted path of every document."""
    source = source.select("doc", text_bytes(F.col("text")).alias("text")).where(_id("doc", paired).isNotNull())

    def rows(batch):
        for numbers, hashes, lengths in word_chunks(batch):
            found = _paths(hashes, lengths, size, node)
            if found:
                text, nodes, path, start, count = found
                docs_of = batch.column(0).take(pa.array(np.array(numbers)[text]))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(path), docs_of, pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], names=["node", "path", "doc", "start", "n"])

    return map_arrow(source, rows, f"node long, path long, doc {source.schema[0].dataType.simpleString()}, start int, n int")


def repeated_nodes(paths: DataFrame, paired: bool = False) -> DataFrame:
    """``node, first_doc, single``: nodes of two or more documents; ``single`` if they have one path only."""
    return (
        paths.groupBy("node")
        .agg(F.min(_id("doc", paired)).alias("first_doc"), F.max(_id("doc", paired)).alias("_last"), F.min("path").alias("_low"), F.max("path").alias("_high"))
        .where("first_doc < _last")
        .select("node", "first_doc", (F.col("_low") == F.col("_high")).alias("single"))
    )


def edge_hashes(source: DataFrame, branching: DataFrame, size: int) -> DataFrame:
    """``doc, pos, h1, h2``: the windows of the branching paths (``doc, paths array<struct<start,n>>``)."""
    source = source.select("doc", text_bytes(F.col("text")).alias("text")).join(branching, "doc").select("doc", "text", "paths")

    def rows(batch):
        for numbers, hashes, lengths in word_chunks(batch):
            one, two = ngram_hashes(hashes, size), ngram_hashes(hashes, size, seed=1)
            begins = np.cumsum(lengths) - lengths
            ids, places = [], []
            for k, number in enumerate(numbers):
                runs = batch.column(2)[number].values
                start, count = runs.field("start").to_numpy(), runs.field("n").to_numpy()
                pos = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
                ids.append(np.full(len(pos), number)), places.append((pos, begins[k] + pos))
            pos, at = np.concatenate([p for p, _ in places]).astype(np.int32), np.concatenate([a for _, a in places]).astype(np.int64)
            if len(pos):
                docs_of = batch.column(0).take(pa.array(np.concatenate(ids).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([docs_of, pa.array(pos), pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64))], names=["doc", "pos", "h1", "h2"])

    return map_arrow(source, rows, f"doc {source.schema[0].dataType.simpleString()}, pos int, h1 long, h2 long")


def repeated_spans(source: DataFrame, paired: bool, size: int = WINDOW, node: int = NODE) -> DataFrame:
    """``doc, spans array<struct<start,n>>``: runs of windows that an earlier document (by id) has too."""
    spark, own = source.sparkSession, _id("doc", paired)
    paths = staged(graph_paths(source, size, node, paired), "paths")
    nodes = staged(repeated_nodes(paths, paired), "nodes")
    free_shuffles(spark)
    met = paths.drop("path").join(nodes, "node").where(~F.col("single") | (own > F.col("first_doc")))
    flags = staged(
        met.groupBy("doc").agg(
            F.collect_list(F.when(F.col("single"), F.struct("start", "n"))).alias("spans"), F.collect_list(F.when(~F.col("single"), F.struct("start", "n"))).alias("paths")
        ),
        "flags",
    )
    drop_staged(paths), drop_staged(nodes)
    edges = edge_hashes(source, flags.where("size(paths) > 0").select("doc", "paths"), size)
    edges = staged(edges, "edges")
    free_shuffles(spark)
    first = edges.groupBy("h1", "h2").agg(F.min(own).alias("_first"), F.max(own).alias("_last")).where("_first < _last").drop("_last")
    first = staged(first, "first")  # a table of its own, so that the join below is split where one window is in many documents
    free_shuffles(spark)
    later = edges.join(first, ["h1", "h2"]).where(own > F.col("_first")).groupBy("doc").agg(F.collect_list(F.struct(F.col("pos").alias("start"), F.lit(1).alias("n"))).alias("spans"))
    spans = flags.select("doc", "spans").unionByName(later).groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans")).where("size(spans) > 0")
    out = staged(spans, "spans")
    drop_staged(edges), drop_staged(flags)
    return out


def removed_words(length: int, starts, counts, size: int) -> np.ndarray:
    """Which of ``length`` words the windows starting in [start, start + count) cover."""
    edge = np.zeros(length + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(length, starts + counts + size - 1), -1)
    return np.cumsum(edge[:-1]) > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, node: int = NODE) -> DataFrame:
    """``id_col, n_words, n_removed, kept``: each text without the words of windows that an earlier document has."""
    rows_of, paired = numbered(docs, id_col, text_col)
    spans = repeated_spans(rows_of, paired, size, node)
    source = rows_of.select("doc", text_bytes(F.col("text")).alias("text")).join(spans, "doc", "left").select(_id("doc", paired).alias(id_col), "text", "spans")

    def rows(batch):
        total, gone, kept = [], [], []
        for text, found in zip(batch.column(1), batch.column(2), strict=True):
            words = text.as_py().split()
            total.append(len(words))
            if found.is_valid:
                start, count = found.values.field("start").to_numpy(), found.values.field("n").to_numpy()
                cut = removed_words(len(words), start, count, size)
                gone.append(int(cut.sum()))
                words = [w for w, c in zip(words, cut.tolist(), strict=True) if not c]
            else:
                gone.append(0)
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=[id_col, "n_words", "n_removed", "kept"])

    out = map_arrow(source, rows, f"{id_col} {source.schema[0].dataType.simpleString()}, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of each document, words removed, and the digest of what is kept."""
    kept = dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT h, min(doc_id) AS first FROM v GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM v JOIN f USING (h) WHERE doc_id > first),
g AS (SELECT doc_id, list(k) AS ks FROM c GROUP BY doc_id),
e AS (SELECT doc_id, k, w[k] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
r AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS kept FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = e.doc_id AND c.k = e.k) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(len(g.ks), 0)::bigint AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN r USING (doc_id)
"""
