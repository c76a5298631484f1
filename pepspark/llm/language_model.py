"""Katz backoff language model over a whole corpus.

Words are 63-bit hashes.  Every training word is a symbol of its own, and so are an end and one class for words that
training never had.  The ``CACHED`` most frequent words have short numbers that are in every task, which is for speed alone:
the others keep their hashes, and what the model knows of them meets them in joins by word.  With a ``bound``, only that
many words are symbols, and the class has all others; within it, words keep their own exact corpus counts.

    P(w | h) = d_r r / (c(h) + 1)          the pair (h, w) is in the training text r > 0 times
             = alpha(h) P1(w)              else; P1(w) = (c(w) + 1) / (N + S) over the S symbols
    P(word)  = P(class | h) (c(word) + 1) / (N_class + V_class + 1)     for words of the class, unknown ones included

d_r are Good-Turing discounts for r <= 5, 1 beyond; alpha(h) makes each history's sum exactly 1 (the 1 in c(h) + 1 is
mass for backing off even where nothing is discounted).  The first word's history is a start symbol.

Pair counts are packed: each batch sends, to each bucket of pairs, one block of its distinct pairs with their counts, and
one of (pair, document, times).  A bucket's task adds up the counts, its part of the stored model, then walks the
documents' blocks one at a time.  A pair that every document has is one entry of a count block, so no key makes a hot
task; frequent histories are spread over buckets by their next word.  Buckets follow the number of tokens.  A history
or next word without a short number is left open where a pair is new to the model, and its terms are added by a join.

Null text counts as empty: one end token.  Every row is a text of its own, for training and for its score, also where ids
repeat or are null (a null id is the empty text to the hash that holds rows out).  Texts of any length are taken
whole, some at a time.  Ties between words of equal counts change which have short numbers, not the scores.  No columns
but the id and the text are read.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pepspark.llm.common import by_row, drop_staged, free_shuffles, map_arrow, map_batches, mix, staged, table, text_bytes, word_chunks

CACHED = 131_072
BITS = 20  # of a short number in a pair
BATCH_TOKENS = 1_000_000
TEXT_BITS = 23  # of a document's number in a batch
START, CLASS, END, FIRST = 0, 1, 2, 3
DISCOUNTED = 5
BUCKET_TOKENS = 1_000_000
TOP = np.uint64(1 << 63)  # set in every word's hash, so that a hash is below zero and a short number is not


def held_out(id_col: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def _source(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """``doc, text, held`` of rows with unique keys; ``ids`` (``doc, id``) where the key isn't the id."""
    if ids is None:
        return rows.select("doc", text_bytes(F.col("text")).alias("text"), held_out(F.col("doc")).alias("held"))
    named = rows.join(ids.select("doc", held_out(F.col("id")).alias("held")), "doc")
    return staged(named.select("doc", text_bytes(F.col("text")).alias("text"), "held"), "named")


def _word_chunks(batch: pa.RecordBatch):
    for numbers, hashes, lengths in word_chunks(batch, lower=True):
        yield numbers, hashes | TOP, lengths


def word_counts(source: DataFrame) -> DataFrame:
    """``word, c``: training counts of word hashes; the row of the null word has the number of training documents, and
    that of word 0 in ``all`` the tokens of all documents."""

    def rows(batch):
        held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        train, size = [np.empty(0, np.uint64)], 0
        for numbers, hashes, lengths in _word_chunks(batch):
            train.append(hashes[np.repeat(~held[numbers], lengths)])
            size += int(lengths.sum())
        words, count = np.unique(np.concatenate(train), return_counts=True)
        words, count = pa.array(words.view(np.int64)), pa.array(count.astype(np.int64))
        yield pa.RecordBatch.from_arrays([words, count, pa.nulls(len(words), pa.int64())], names=["word", "c", "tokens"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([int((~held).sum())], pa.int64()), pa.array([size], pa.int64())], names=["word", "c", "tokens"])

    counts = map_arrow(source, rows, "word long, c long, tokens long")
    return staged(counts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("tokens").alias("tokens")), "words")


class Lexicon:
    """What every task gets: hashes and counts of the words with short numbers (at most ``bound``, or else ``cached``),
    and corpus totals."""

    def __init__(self, counts: DataFrame, bound: int | None = None, cached: int = CACHED):
        self.open = bound is None
        bound = cached if self.open else bound
        known = counts.where("word is not null")
        ends = counts.where("word is null").first()
        self.documents, others = (ends["c"], ends["tokens"]) if ends else (0, 0)
        total = known.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
        # the least count at which the words that have it or more fit the bound; only the histogram's top is looked at
        least, size = 1, total["v"]
        if size > bound:
            top = known.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).limit(bound).collect()
            size = 0
            for r in top:
                if size + r["n"] > bound:
                    break
                size, least = size + r["n"], r["c"]
            if not size:
                least = top[0]["c"] + 1
        chosen = known.where(F.col("c") >= least).select("word", "c").toPandas()
        order = np.argsort(chosen["word"].to_numpy(np.int64).view(np.uint64))
        self.words = chosen["word"].to_numpy(np.int64).view(np.uint64)[order]
        inside = chosen["c"].to_numpy(np.int64)[order]
        self.tokens = total["n"] + self.documents  # N: an end for each training document
        self.distinct = total["v"] + (1 if self.documents else 0)  # V
        self.least = least
        self.class_tokens, self.class_distinct = (0, 0) if self.open else (total["n"] - int(inside.sum()), total["v"] - len(inside))
        self.all_tokens = others
        self.counts = np.r_[self.documents, self.class_tokens, self.documents, inside].astype(np.int64)
        # N + S: the start is never predicted
        self.unit = self.tokens + (total["v"] + 2 if self.open else len(self.counts) - 1)
        self.log_p1 = np.log10((self.counts + 1) / self.unit)
        self.buckets = max(1, math.ceil(self.all_tokens / BUCKET_TOKENS))
        share = max(1, self.tokens // (4 * self.buckets))
        self.splits = np.maximum(1, -(-self.counts // share))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        others = hashes.view(np.int64) if self.open else np.full(len(hashes), CLASS, np.int64)
        if not len(self.words):
            return others
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + FIRST, others)

    def bucket(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        splits = np.where(h >= 0, self.splits[np.maximum(h, 0)], 1)
        return (mix((h * 1_000_003 + w % splits).view(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)


def apart(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pairs of short numbers packed, others as 63-bit hashes below zero."""
    keys = (h << BITS) | w
    rest = np.flatnonzero((h < 0) | (w < 0))
    keys[rest] = (mix(h[rest].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(w[rest].view(np.uint64))) | TOP).view(np.int64)
    return keys


def _pairs(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, history, word) for each token of a chunk and each text's end."""
    text = np.repeat(np.arange(len(lengths)), lengths + 1)
    stops = np.cumsum(lengths + 1)
    following = np.full(len(text), END, np.int64)
    words = np.ones(len(text), bool)
    words[stops - 1] = False
    following[words] = symbols
    history = np.r_[START, following[:-1]]
    history[stops[:-1]] = START
    return text, history, following


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays' bytes plane by plane, compressed."""
    planes = lambda a: np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    data = b"".join(struct.pack("<4sI", a.dtype.str.encode().ljust(4), len(a)) + planes(a) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        kind, n = struct.unpack_from("<4sI", data, at)
        kind = np.dtype(kind.decode().strip())
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at + 8).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += 8 + n * kind.itemsize
    return out


def word_scores(source: DataFrame, counts: DataFrame, lexicon) -> DataFrame:
    """``doc, n_tokens, n_known, n_other, base, rare, log_h`` of every row.

    ``base`` sums log10(c + 1) over tokens; ``rare`` over words without a short number alone; ``log_h`` log10(c(h) + 1)
    over histories with one.  Frequent words' counts are in every task; the others meet the corpus counts in a join.
    """
    kind = source.schema["doc"].dataType.simpleString()

    def rows(batch):
        lex = lexicon.value
        log_c = np.log10(lex.counts + 1)
        words, texts, times = [], [], []
        for numbers, hashes, lengths in _word_chunks(batch):
            symbols = lex.symbols(hashes)
            text = np.repeat(np.arange(len(lengths)), lengths)
            rare = (symbols == CLASS) | (symbols < 0)
            symbols = np.where(rare, CLASS, symbols)
            value = np.where(rare, 0.0, log_c[symbols])
            known = np.bincount(text[~rare], minlength=len(lengths)) + (lex.documents > 0)
            base = np.bincount(text, value, minlength=len(lengths)) + log_c[END]
            history = np.bincount(text, log_c[symbols], minlength=len(lengths)) + log_c[START]
            other = np.bincount(text[rare], minlength=len(lengths))
            docs = batch.column(0).take(pa.array(numbers))
            m = len(numbers)
            yield pa.RecordBatch.from_arrays(
                [docs, pa.nulls(m, pa.int64()), pa.array(np.ones(m, np.int32)), *(pa.array(x.astype(np.int64)) for x in (lengths + 1, known, other)), pa.array(base), pa.array(history)],
                names=["doc", "word", "times", "tokens", "known", "other", "base", "log_h"],
            )
            words.append(hashes[rare]), texts.append(np.array(numbers)[text[rare]])
        if not words:
            return
        word, text = np.concatenate(words), np.concatenate(texts)
        order = np.lexsort((word, text))
        word, text = word[order], text[order]
        first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (text[1:] != text[:-1])]) if len(word) else np.empty(0, np.int64)
        times = np.diff(np.r_[first, len(word)])
        m = len(first)
        if m:
            docs = batch.column(0).take(pa.array(text[first]))
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array(word[first].view(np.int64)), pa.array(times.astype(np.int32)), *(pa.nulls(m, pa.int64()) for _ in range(3)), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())],
                names=["doc", "word", "times", "tokens", "known", "other", "base", "log_h"],
            )

    both = staged(map_arrow(source, rows, f"doc {kind}, word long, times int, tokens long, known long, other long, base double, log_h double"), "word_scores")
    rare = both.where("word is not null").select("doc", "word", "times").join(counts.select("word", "c"), "word", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + 1) * F.col("times")
    rare = rare.groupBy("doc").agg(F.sum(log).alias("rare"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    rare = rare.select("doc", "known", F.col("rare").alias("base"), "rare")
    plain = both.where("word is null").select("doc", F.col("tokens").alias("n_tokens"), "known", F.col("other").alias("n_other"), "base", "log_h")
    sums = plain.unionByName(rare, allowMissingColumns=True).groupBy("doc").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "known", "n_other", "base", "rare", "log_h")))
    done = staged(sums.withColumn("rare", F.coalesce("rare", F.lit(0.0))).withColumnRenamed("known", "n_known"), "by_document")
    drop_staged(both)  # a row for each document and rare word: gone before pairs need the disk
    return done


def _column(values, kind: str) -> pa.Array:
    return pa.array(values, {"i": pa.int64(), "b": pa.binary()}[kind])


#: kinds of rows between the tasks
COUNTS, TIMES, IDS, PARTS, HISTORIES, SIZES, RARE_HISTORIES, RARE_NEXT, RARE_GONE = range(9)
SHAPE = "chunk long, bucket long, kind long, blob binary"


def _rows(chunk, bucket, kind, blobs) -> pa.RecordBatch:
    n = len(blobs)
    spread = [x if isinstance(x, list) else [x] * n for x in (chunk, bucket, kind)]
    return pa.RecordBatch.from_arrays([*(_column(x, "i") for x in spread), _column(blobs, "b")], names=["chunk", "bucket", "kind", "blob"])


def pair_blocks(source: DataFrame, lexicon) -> DataFrame:
    """Packed counts and occurrences of pairs by bucket, and the ids of each batch's documents (as text)."""

    def run(batches):
        from pyspark import TaskContext

        lex = lexicon.value
        chunk = (TaskContext.get().partitionId() << 24) - 1
        for batch in batches:
            chunk += 1
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            ids = json.dumps(["" if x is None else str(x) for x in batch.column(0).to_pylist()]).encode()
            yield _rows(chunk, -1 - chunk % lex.buckets, IDS, [zstandard.ZstdCompressor(level=1).compress(ids)])
            waiting, size = [], 0
            for numbers, hashes, lengths in _word_chunks(batch):
                text, h, w = _pairs(lex.symbols(hashes), lengths)
                waiting.append((np.array(numbers, np.int64)[text], h, w))
                size += len(text)
                if size >= BATCH_TOKENS:
                    yield from blocks_of(chunk, waiting, held, lex)
                    waiting, size = [], 0
            if waiting:
                yield from blocks_of(chunk, waiting, held, lex)

    return map_batches(source, run, SHAPE)


def blocks_of(chunk: int, waiting: list[tuple[np.ndarray, ...]], held: np.ndarray, lex: Lexicon):
    """The blocks of some documents' tokens, each a pair and the number of its text."""
    text, h, w = (np.concatenate(x) for x in zip(*waiting, strict=True))
    short = (h >= 0) & (w >= 0)
    tokens = np.sort((((h[short] << BITS) | w[short]) << TEXT_BITS) | text[short])
    rest = np.flatnonzero(~short)
    rest = rest[np.lexsort((text[rest], w[rest], h[rest]))]
    both = apart(tokens >> TEXT_BITS)
    h, w, text = np.r_[both[0], h[rest]], np.r_[both[1], w[rest]], np.r_[tokens & ((1 << TEXT_BITS) - 1), text[rest]]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]) | (text[1:] != text[:-1])])
    times = np.diff(np.r_[first, len(text)]).astype(np.uint32)
    h, w, text = h[first], w[first], text[first].astype(np.int32)
    bucket = lex.bucket(h, w)
    order = np.argsort(bucket, kind="stable")
    text, h, w, times, bucket = text[order], h[order], w[order], times[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(lex.buckets + 1))
    for b in range(lex.buckets):
        a, z = cuts[b], cuts[b + 1]
        if a == z:
            continue
        p, q, t, n = h[a:z], w[a:z], text[a:z], times[a:z]
        start = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
        train = np.add.reduceat(np.where(held[t], 0, n), start).astype(np.uint32)
        kinds = np.diff(np.r_[start, len(t)]).astype(np.uint32)
        seen = train > 0
        p, q = p[start], q[start]
        yield _rows(
            chunk, b, [COUNTS, TIMES],
            [pack(np.diff(np.r_[0, p[seen]]), q[seen], train[seen]), pack(np.diff(np.r_[0, p]), q, kinds, t.astype(np.uint16 if len(held) < 65536 else np.uint32), held[t].astype(np.uint8), n.astype(np.uint8 if n.max() < 256 else np.uint32))],
        )


def pair_parts(blocks: DataFrame, lexicon, buckets: int) -> DataFrame:
    """By bucket: the model's pair counts, and what they say of each batch's documents and of each history."""
    dealt = blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")

    def run(batches):
        lex = lexicon.value
        now, keys, counts, waiting = None, None, None, []

        def summed():
            key, h, w, count = (np.concatenate(x) for x in zip(*waiting, strict=True)) if waiting else np.empty((4, 0), np.int64)
            key, first, at = np.unique(key, return_index=True, return_inverse=True)
            return key, h[first], w[first], np.bincount(at, count, minlength=len(key)).astype(np.int64)

        def close():
            nonlocal keys, counts
            keys, h, w, counts = summed()
            waiting.clear()
            ids, at = np.unique(h, return_inverse=True)
            n_r = np.zeros((len(ids), DISCOUNTED + 1))
            small = counts <= DISCOUNTED
            np.add.at(n_r, (at[small], counts[small]), 1)
            n_r[:, 0] = np.bincount(at[~small], counts[~small], minlength=len(ids))
            seen = np.bincount(at, np.where(w < 0, 0.0, 10.0 ** lex.log_p1[np.maximum(w, 0)]), minlength=len(ids))
            cut = np.searchsorted(ids, 0)
            return [
                _rows(-1, now, HISTORIES, [pack(ids[cut:], n_r[cut:].ravel(), seen[cut:])]),
                _rows(-1, now, RARE_HISTORIES, [pack(ids[:cut], n_r[:cut].astype(np.int64).ravel(), seen[:cut])]),
                _rows(-1, now, RARE_NEXT, [pack(h[w < 0], w[w < 0])]),
                _rows(-1, now, SIZES, [pack(np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3))]),
            ]

        for batch in batches:
            for i in range(batch.num_rows):
                chunk, bucket, kind, blob = (batch.column(k)[i].as_py() for k in range(4))
                if kind == IDS:
                    yield _rows(chunk, bucket, kind, [blob])
                    continue
                if bucket != now:
                    if waiting:
                        yield from close()
                    now, keys = bucket, None
                if kind == COUNTS:
                    step, w, train = unpack(blob)
                    h = np.cumsum(step)
                    waiting.append((pair_keys(h, w), h, w, train))
                    if len(waiting) % 64 == 0:  # add up now and then, so that memory follows the distinct pairs
                        waiting[:] = [summed()]
                    continue
                if keys is None:
                    yield from close()
                step, w, kinds, text, held, times = unpack(blob)
                h = np.cumsum(step)
                pair = pair_keys(h, w)
                at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
                r = np.repeat(np.where(keys[at] == pair, counts[at], 0) if len(keys) else np.zeros(len(pair), np.int64), kinds)
                docs, place = np.unique(text, return_inverse=True)
                hist = np.zeros((len(docs), DISCOUNTED + 1), np.uint32)
                small = (r > 0) & (r <= DISCOUNTED)
                np.add.at(hist, (place[small], r[small]), times[small])
                sums = np.bincount(place, np.where(r > DISCOUNTED, np.log10(np.maximum(r, 1)), 0.0) * times, minlength=len(docs))
                gone = r == 0
                h, w, text, times, place = np.repeat(h, kinds)[gone], np.repeat(w, kinds)[gone], text[gone], times[gone], place[gone]
                sums += np.bincount(place, np.where(w < 0, 0.0, lex.log_p1[np.maximum(w, 0)]) * times, minlength=len(docs))
                sums += np.bincount(place, np.where(h < 0, 0.0, np.log10(lex.counts[np.maximum(h, 0)] + 1)) * times, minlength=len(docs))
                yield _rows(chunk, bucket, PARTS, [pack(docs, hist[:, 1:].ravel(), sums, text[h >= 0], h[h >= 0].astype(np.int32), times[h >= 0])])
                if (h < 0).any() or (w < 0).any():
                    yield _rows(chunk, bucket, RARE_GONE, [pack(text[h < 0], h[h < 0], times[h < 0], text[w < 0], w[w < 0], times[w < 0])])
        if waiting:
            yield from close()

    return staged(map_batches(dealt, run, SHAPE), "parts")


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's Good-Turing discounts d_0..d_5 from the numbers of pairs seen r times; (r - 0.5) / r where the formula
    gives none in (0, 1]."""
    k, out = DISCOUNTED, np.ones(DISCOUNTED + 1)
    top = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top != 1 else 0.0
        out[r] = d if 0 < d <= 1 else (r - 0.5) / r
    return out


class Backoff:
    """Discounts, and log10 alpha of every history with a short number.

    ``rare_next`` (``h, seen``) has the sums of P1 over the seen next words that are without one.
    """

    def __init__(self, parts: DataFrame, lex: Lexicon, rare_next: DataFrame):
        size, n = len(lex.counts), np.zeros(DISCOUNTED + 3)
        for r in parts.where(f"kind = {SIZES}").select("blob").toLocalIterator():
            n += unpack(r["blob"])[0]
        self.sizes, self.discounts = n, discounts(n)
        mass, seen = np.zeros(size), np.zeros(size)
        self.weight = self.discounts * np.arange(DISCOUNTED + 1)
        self.weight[0] = 1.0
        for r in parts.where(f"kind = {HISTORIES}").select("blob").toLocalIterator():  # a bucket at a time
            ids, n_r, p = unpack(r["blob"])
            mass[ids] += n_r.reshape(-1, DISCOUNTED + 1) @ self.weight
            seen[ids] += p
        for r in rare_next.where("h >= 0").toLocalIterator():
            seen[r["h"]] += r["seen"]
        left = 1 - mass / (lex.counts + 1)
        self.log_alpha = np.log10(np.maximum(left, 1e-300) / np.maximum(1 - seen, 1e-12))


def _blobs(parts: DataFrame, kind: int, rows, schema: str) -> DataFrame:
    """The rows that ``rows(chunk, arrays)`` makes of each blob of a kind, as columns of the schema."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from pa.table(rows(batch.column(0)[i].as_py(), unpack(batch.column(1)[i].as_py()))).to_batches()

    return map_batches(parts.where(f"kind = {kind}").select("chunk", "blob"), run, schema)


def rare_next(parts: DataFrame, rare: DataFrame, lex: Lexicon) -> DataFrame:
    """``h, seen``: by history, the sum of P1 over its seen next words that have no short number."""
    pairs = _blobs(parts, RARE_NEXT, lambda _, x: {"h": x[0], "word": x[1]}, "h long, word long")
    return staged(pairs.join(rare, "word").groupBy("h").agg(F.sum((F.col("c") + 1) / F.lit(float(lex.unit))).alias("seen")), "rare_next")


def rare_scores(parts: DataFrame, rare: DataFrame, nexts: DataFrame, backoff, lex: Lexicon) -> DataFrame:
    """``chunk, text, pairs``: what words without a short number add to the new pairs of each document."""

    def histories(_, x):
        return {"word": x[0], "mass": x[1].reshape(-1, DISCOUNTED + 1) @ backoff.value.weight, "own": x[2]}

    def gone(chunk, x):
        n, m = len(x[0]), len(x[3])
        parts = {"text": (x[0], x[3]), "word": (x[1], x[4]), "times": (x[2], x[5])}
        return {"chunk": np.full(n + m, chunk), **{k: np.concatenate(v).astype(np.int64) for k, v in parts.items()}, "history": np.arange(n + m) < n}

    left = 1 - F.col("mass") / (F.col("c") + 1)
    after = 1 - F.col("own") - F.coalesce("seen", F.lit(0.0))
    alpha = F.log10(F.greatest(left, F.lit(1e-300)) / F.greatest(after, F.lit(1e-12)))
    known = (
        rare.join(_blobs(parts, RARE_HISTORIES, histories, "word long, mass double, own double"), "word")
        .join(nexts.where("h < 0").withColumnRenamed("h", "word"), "word", "left")
        .select("word", (alpha + F.log10(F.col("c") + 1)).alias("_as_history"), F.log10(F.col("c") + 1).alias("_as_next"))
    )
    asked = _blobs(parts, RARE_GONE, gone, "chunk long, text long, word long, times long, history boolean")
    # a word that training never had: alpha is 1 and the count 0
    term = F.when(F.col("history"), F.coalesce("_as_history", F.lit(0.0))).otherwise(F.coalesce("_as_next", F.lit(0.0)) - math.log10(lex.unit))
    return asked.join(known, "word", "left").groupBy("chunk", "text").agg(F.sum(term * F.col("times")).alias("pairs"))


def pair_scores(parts: DataFrame, backoff) -> DataFrame:
    """``chunk, text, doc (text), pairs``: sum over a document's pairs of log10 of their probability times (c(h) + 1)."""
    dealt = parts.where(f"kind in ({IDS}, {PARTS})").repartition("chunk").sortWithinPartitions("chunk", "kind")

    def run(batches):
        model = backoff.value
        weight = np.log10(model.discounts[1:] * np.arange(1, DISCOUNTED + 1))
        now, ids, sums = None, [], None

        def done():
            n = len(ids)
            return pa.RecordBatch.from_arrays([pa.array([now] * n, pa.int64()), pa.array(np.arange(n)), pa.array(ids, pa.string()), pa.array(sums)], names=["chunk", "text", "doc", "pairs"])

        for batch in batches:
            for i in range(batch.num_rows):
                chunk, kind, blob = batch.column(0)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                if chunk != now:
                    if sums is not None:
                        yield done()
                    now = chunk
                if kind == IDS:
                    ids = json.loads(zstandard.ZstdDecompressor().decompress(blob))
                    sums = np.zeros(len(ids))
                    continue
                docs, hist, part, text, h, times = unpack(blob)
                sums[docs] += hist.reshape(-1, DISCOUNTED) @ weight + part
                np.add.at(sums, text, model.log_alpha[h] * times)
        if sums is not None:
            yield done()

    return map_batches(dealt, run, "chunk long, text long, doc string, pairs double")


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int | None = None, cached: int = CACHED) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    spark = docs.sparkSession
    rows, ids = by_row(docs, id_col, text_col)
    source = _source(rows, ids)
    counts = word_counts(source)
    lex = Lexicon(counts, bound, cached)
    shared = spark.sparkContext.broadcast(lex)
    words = word_scores(source, counts, shared)
    parts = pair_parts(pair_blocks(source, shared), shared, lex.buckets)
    free_shuffles(spark)
    rare = counts.where("word is not null").where(F.col("c") < lex.least).select("word", "c")
    nexts = rare_next(parts, rare, lex)
    free_shuffles(spark)
    model = spark.sparkContext.broadcast(Backoff(parts, lex, nexts))
    pairs = pair_scores(parts, model)
    if lex.open:
        added = staged(rare_scores(parts, rare, nexts, model, lex), "rare_scores")
        free_shuffles(spark)
        pairs = pairs.unionByName(added, allowMissingColumns=True).groupBy("chunk", "text").agg(F.max("doc").alias("doc"), F.sum("pairs").alias("pairs"))
    pairs = pairs.groupBy("doc").agg(F.sum("pairs").alias("pairs"))
    unit = math.log10(lex.tokens + lex.distinct + 1)
    inside = math.log10(lex.class_tokens + lex.class_distinct + 1)
    found = words.withColumn("_key", F.col("doc").cast("string")).join(pairs.withColumnRenamed("doc", "_key"), "_key", "left")
    found = found.select(
        "doc",
        "n_tokens",
        "n_known",
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * unit).alias("base_score"),
        (F.col("pairs") - F.col("log_h") - F.col("rare") if lex.open else F.col("pairs") - F.col("log_h") + F.col("rare") - F.col("n_other") * inside).alias("score"),
    )
    if ids is None:
        found = found.withColumn("id", F.col("doc"))
    else:
        found = found.join(ids, "doc")
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_language_model(spark, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, and that of the add-one unigram base."""
    return score_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))
