"""N-gram Jaccard join over a distributed prefix tree of globally ordered shingle sets.

All sets are sorted by one order: shingles that are frequent come last, the rest by hash.  Two sets of similarity
``PERCENT`` share a shingle among the first ``n - ceil(n * PERCENT / 100) + 1`` of each, the top branches of a prefix
tree; these are stored as rows (shingle, document, size, depth).

1. Equal sets are one class, led by its least document; only leaders go on.
2. The tree's top branches are dealt and sorted by shingle once.  In each, every document meets the branch's least one.
   Pairs are pruned by sizes, by the remaining length below the branch, and by an upper bound of the overlap from
   histograms of ``BUCKETS`` hash buckets; those left are verified on whole texts: the documents that meet one leader are
   walked in tree order, so a shared beginning's partial overlap is counted once, and a walk stops where the remaining
   length can't reach the threshold.  Links give components.
3. Branches that still hold several components compare what is left: only pairs of different components, not yet
   compared, pruned in the same way.  So a group of near copies is not expanded into its pairs, and no link between
   components is missed.

The order is a heuristic (any order gives the same result): shingles that occur in several documents of some thousands are
counted over the corpus and the ``MAX_FREQUENT`` most frequent go last.  Branches of more than ``SALTED`` documents by
that count are dealt in parts; each part's least document meets the branch's.  That list is the only thing broadcast
without a count; it is bounded by that number.

Every row is a document of its own, found by its number where ids repeat or are null; a component's name is the least id
in it that isn't null, or null.  Null or wordless texts have empty sets, link with nothing and form their own component.
Texts of any length are taken whole.  No columns but the id and the text are read.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pepspark.llm.common import by_row, drop_staged, free_shuffles, map_arrow, map_batches, mix, ngram_hashes, staged, table, text_bytes, word_chunks
from pepspark.llm.components import connected_components

WORDS = 5
PERCENT = 80
BUCKETS = 256
LEAST_FREQUENT = 3
MAX_FREQUENT = 65_536
BROADCAST_ROWS = 200_000
COUNTED = 2_000_000  # shingles that are counted together before the frequent ones are sent
SALTED = 100_000  # documents of a branch beyond which it is dealt in parts
BLOCK = 2_048  # rows of a branch that are compared in one task with as many others
GROUP = 256  # documents that one task compares with one leader at a time


def _shingles(hashes: np.ndarray, lengths: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of a chunk, sorted, each once a text; a text of fewer words is one shingle."""
    counts = np.maximum(0, lengths - words + 1)
    text = np.repeat(np.arange(len(lengths)), counts)
    begins = np.cumsum(lengths) - lengths
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins, counts)
    values = ngram_hashes(hashes, words)[at] if len(at) else np.empty(0, np.uint64)
    for n in range(1, words):
        short = np.flatnonzero(lengths == n)
        if len(short):
            text = np.r_[text, short]
            values = np.r_[values, ngram_hashes(hashes, n, seed=n)[begins[short]]]
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    first = np.r_[True, (text[1:] != text[:-1]) | (values[1:] != values[:-1])] if len(text) else np.empty(0, bool)
    return text[first], values[first]


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select("doc", text_bytes(F.col("text")).alias("text"))


def describe_sets(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """``doc, n, k1, k2, bins`` (size, 128-bit digest and histogram of each set), and ``shingle, df`` of the shingles
    that are in several documents counted together; one pass over the texts."""
    source = _texts(docs)
    kind = source.schema[0].dataType.simpleString()
    names = ["kind", "doc", "n", "k1", "k2", "bins"]

    def counted(frequent, ids):
        values, df = np.unique(np.concatenate(frequent), return_counts=True)
        often = df >= LEAST_FREQUENT
        m = int(often.sum())
        columns = [pa.array(np.ones(m, np.int32)), pa.nulls(m, ids), pa.array(df[often].astype(np.int64)), pa.array(values[often].view(np.int64)), pa.array(np.zeros(m, np.int64)), pa.nulls(m, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        frequent, size, ids = [], 0, None
        for batch in batches:
            ids = batch.column(0).type
            for numbers, hashes, lengths in word_chunks(batch, lower=True):
                text, values = _shingles(hashes, lengths, words)
                n = np.bincount(text, minlength=len(lengths))
                one, two = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.uint64)
                with np.errstate(over="ignore"):
                    if len(text):
                        has, first = np.flatnonzero(n), np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
                        one[has], two[has] = np.add.reduceat(mix(values), first), np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), first)
                bins = np.bincount(text * BUCKETS + (values & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=len(lengths) * BUCKETS).reshape(-1, BUCKETS)
                bins = np.minimum(bins, 255).astype(np.uint8)
                m = len(numbers)
                columns = [pa.array(np.zeros(m, np.int32)), batch.column(0).take(pa.array(numbers)), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([x.tobytes() for x in bins], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                frequent.append(values)
                size += len(values)
                if size >= COUNTED:
                    yield counted(frequent, ids)
                    frequent, size = [], 0
        if frequent:
            yield counted(frequent, ids)

    both = staged(map_batches(source, run, f"kind int, doc {kind}, n long, k1 long, k2 long, bins binary"), "sets")
    return both.where("kind = 0").drop("kind"), both.where("kind = 1").groupBy(F.col("k1").alias("shingle")).agg(F.sum("n").alias("df"))


def tops(docs: DataFrame, words: int, percent: int, frequent: list[tuple[int, int]]) -> DataFrame:
    """``shingle, salt, doc, place``: the tops of all ordered sets; ``place`` is size * 2^32 + depth.  ``frequent`` (shingle,
    documents) go last, in that order; those of very many documents have a salt, others -1."""
    last = np.array([x for x, _ in frequent], dtype=np.int64).view(np.uint64)
    parts = np.array([-(-df // SALTED) for _, df in frequent], dtype=np.int64)
    by = np.argsort(last)
    shared = docs.sparkSession.sparkContext.broadcast((last[by], (by + 1).astype(np.int64), parts[by]))  # at most MAX_FREQUENT
    source = _texts(docs)

    def rows(batch):
        known, rank_of, parts_of = shared.value
        for numbers, hashes, lengths in word_chunks(batch, lower=True):
            text, values = _shingles(hashes, lengths, words)
            if not len(text):
                continue
            rank, parts = np.zeros(len(values), np.int64), np.ones(len(values), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                found = known[at] == values
                rank, parts = np.where(found, rank_of[at], 0), np.where(found, parts_of[at], 1)
            order = np.lexsort((values, rank, text))
            n = np.bincount(text, minlength=len(lengths))
            depth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
            size = np.repeat(n, n)
            top = depth <= size - (percent * size + 99) // 100
            order, text = order[top], text[top]
            salt = np.where(parts[order] > 1, np.array(numbers)[text] % parts[order], -1).astype(np.int32)
            docs_of = batch.column(0).take(pa.array(np.array(numbers)[text]))
            yield pa.RecordBatch.from_arrays([pa.array(values[order].view(np.int64)), pa.array(salt), docs_of, pa.array((size[top] << 32) + depth[top])], names=["shingle", "salt", "doc", "place"])

    return map_arrow(source, rows, f"shingle long, salt int, doc {source.schema[0].dataType.simpleString()}, place long")


def branches(rows: DataFrame) -> DataFrame:
    """``shingle, salt, doc, n, depth, first, m, other``: each branch (or salted part of one) of several documents, with its
    least document's id, size and depth.  Rows are dealt and sorted once, and a branch of any length streams by."""
    kind = rows.schema["doc"].dataType.simpleString()
    dealt = rows.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "doc")

    def run(batches):
        held = None  # the last row so far, with its branch's first one, until the next shows whether it is alone
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held[0], rows])
            rows = rows.combine_chunks()
            shingle, salt, place = (rows.column(c).to_numpy() for c in ("shingle", "salt", "place"))
            new = np.r_[True, (shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1])]
            begins = np.flatnonzero(new)
            leads = np.repeat(begins, np.diff(np.r_[begins, len(new)]))
            first = rows.column("doc").combine_chunks().take(pa.array(leads))
            top = place[leads]
            if held is not None and held[1] is not None:  # the branch began in an earlier batch
                going = leads == 0
                first = pa.concat_arrays([pa.array([held[1]] * int(going.sum()), first.type), first.filter(pa.array(~going))])
                top = np.where(going, held[2], top)
            alone = new & np.r_[new[1:], True] & (salt < 0)
            if held is not None and held[1] is not None:
                alone[0] = False
            out = ~alone
            out[-1] = False
            carried = len(new) - 1
            held = (rows.slice(carried), None if new[-1] and not (carried == 0 and held is not None and held[1] is not None) else first[carried].as_py(), top[carried])
            yield made(rows.filter(pa.array(out)), first.filter(pa.array(out)), top[out])
        if held is not None and (held[1] is not None or held[0].column("salt")[0].as_py() >= 0):
            rows = held[0].combine_chunks()
            first = rows.column("doc").combine_chunks() if held[1] is None else pa.array([held[1]], rows.schema.field("doc").type)
            yield made(rows, first, np.array([held[2]]))

    def made(rows, first, top):
        place = rows.column("place").to_numpy()
        parts = [rows.column("shingle"), rows.column("salt"), rows.column("doc")]
        numbers = [(place >> 32).astype(np.int32), (place & 0xFFFFFFFF).astype(np.int32), first, (top >> 32).astype(np.int32), (top & 0xFFFFFFFF).astype(np.int32)]
        parts = [x.combine_chunks() if len(rows) else pa.array([], x.type) for x in parts]
        return pa.RecordBatch.from_arrays([*parts, *(x if isinstance(x, pa.Array) else pa.array(x) for x in numbers)], names=["shingle", "salt", "doc", "n", "depth", "first", "m", "other"])

    return map_batches(dealt.select("shingle", "salt", "doc", "place"), run, f"shingle long, salt int, doc {kind}, n int, depth int, first {kind}, m int, other int")


def possible(percent: int) -> str:
    """Whether sizes and depths of a shared shingle (n, depth and m, other) let two sets reach the threshold."""
    size = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    left = f"{100 + percent} * (least(depth, other) + 1 + least(n - depth, m - other) - 1) >= {percent} * (n + m)"
    return f"{size} and {left}"


def overlap_bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most that sets with these histograms can share; a full bucket (255 or more) bounds nothing."""
    least = np.minimum(x, y)
    return np.where((least == 255).any(-1), 1 << 40, least.sum(-1, dtype=np.int64))


def open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of different components in one branch that sizes, depths and histograms allow.

    ``rows``: shingle, doc, n, depth, component, bins.  Large branches are cut in blocks, and each pair of blocks is a
    group of its own; only pairs that pass leave a task.
    """
    sizes = rows.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    sizes = staged(sizes, "sizes")
    cut = rows.join(sizes, "shingle").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("_blocks")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cut = cut.withColumns({"low": F.least("own", "_other").cast("int"), "high": F.greatest("own", "_other").cast("int")})
    dealt = cut.select("shingle", "low", "high", "own", "doc", "n", "depth", "component", "bins").repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high", "n")

    def group(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(parts).combine_chunks()
        component = t.column("component").to_numpy()
        if len(t) < 2 or (component == component[0]).all():
            return None
        n, depth, own = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "depth", "own"))
        bins = np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(-1, BUCKETS)
        same_block = t.column("low")[0].as_py() == t.column("high")[0].as_py()
        ends = np.searchsorted(n, 100 * n // percent, "right")
        a, b = [], []
        for i in range(len(n) - 1):
            j = np.arange(i + 1, ends[i])
            j = j[component[j] != component[i]]
            if not same_block:
                j = j[own[j] != own[i]]
            if len(j):
                least = np.minimum(depth[j], depth[i]) + 1 + np.minimum(n[i] - depth[i], n[j] - depth[j]) - 1
                j = j[(100 + percent) * least >= percent * (n[i] + n[j])]
            if len(j):
                j = j[(100 + percent) * overlap_bound(bins[j], bins[i]) >= percent * (n[i] + n[j])]
                a += [i] * len(j)
                b += j.tolist()
        if not a:
            return None
        x, y = t.column("doc").take(pa.array(a)), t.column("doc").take(pa.array(b))
        return pa.RecordBatch.from_arrays([x.combine_chunks(), y.combine_chunks()], names=["a", "b"])

    def run(batches):
        now, parts = None, []
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(3)]
            cuts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0), True])
            for x, y in zip(cuts, cuts[1:], strict=False):
                key = tuple(k[x] for k in keys)
                if key != now:
                    if parts and (found := group(parts)) is not None:
                        yield found
                    now, parts = key, []
                parts.append(batch.slice(x, y - x))
        if parts and (found := group(parts)) is not None:
            yield found

    kind = rows.schema["doc"].dataType.simpleString()
    found = map_batches(dealt, run, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def prune_by_bins(pairs: DataFrame, bins: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose histograms allow the overlap."""
    both = pairs.join(bins.select(F.col("doc").alias("a"), F.col("n").alias("_n"), F.col("bins").alias("_x")), "a").join(bins.select(F.col("doc").alias("b"), F.col("n").alias("_m"), F.col("bins").alias("_y")), "b")

    def rows(batch):
        n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BUCKETS) for i in (4, 5))
        most = overlap_bound(x, y)
        keep = pa.array((100 + percent) * np.minimum(most, np.minimum(n, m)) >= percent * (n + m))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return map_arrow(both.select("a", "b", "_n", "_m", "_x", "_y"), rows, f"a {kind}, b {kind}")


def walk(leader: np.ndarray, members: list[tuple[int, np.ndarray]], percent: int) -> list[int]:
    """Which members' sets reach the threshold with the leader's.  Members are walked in tree order: the overlap of the
    path shared with the one before is known, and a walk ends where what remains can't suffice."""
    out, path, sums = [], np.empty(0, np.uint64), np.zeros(1, np.int64)
    for number, own in sorted(members, key=lambda x: x[1].astype(">u8").tobytes()):
        least = -(-percent * (len(leader) + len(own)) // (100 + percent))
        short = min(len(path), len(own))
        apart = np.flatnonzero(path[:short] != own[:short])
        same = int(apart[0]) if len(apart) else short
        reach = np.searchsorted(leader, own[same - 1], "right") if same else 0
        path, sums = path[:same], sums[: same + 1]
        if sums[same] + min(len(own) - same, len(leader) - reach) < least:
            continue
        rest = own[same:]
        at = np.minimum(np.searchsorted(leader, rest), len(leader) - 1)
        path, sums = own, np.r_[sums, sums[same] + np.cumsum(leader[at] == rest)]
        if sums[-1] >= least:
            out.append(number)
    return out


def verify(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity.  ``a`` leads: documents go to their leaders in groups of
    ``GROUP`` or so, each with a copy of the leader's text, so that a leader of any number of documents is many tasks."""
    sizes = staged(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")), "met")
    salted = staged(pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("_n") / GROUP).cast("int")).alias("salt")), "salted")
    places = salted.select(F.col("b").alias("doc"), "a", "salt").unionByName(salted.select(F.col("a").alias("doc"), "a", "salt").distinct())
    needed = places.groupBy("doc").agg(F.collect_list(F.struct("a", "salt")).alias("places"))
    some = staged(needed, "needed")
    ids = some.select("doc")
    texts = _texts(docs).join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc", "left_semi")
    sent = texts.join(some, "doc").select("doc", "text", F.explode("places").alias("p")).select("doc", "text", "p.a", "p.salt")
    grouped = sent.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("doc") != F.col("a"))

    def run(batches):
        now, leader, members = None, None, []

        def done():
            found = walk(leader, list(enumerate(s for _, s in members)), percent) if members else []
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(found), kind), pa.array([members[k][0] for k in found], kind)], names=["a", "b"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for numbers, hashes, lengths in word_chunks(batch, lower=True):
                text, values = _shingles(hashes, lengths, words)
                cut = np.searchsorted(text, np.arange(len(numbers) + 1))
                for k, number in enumerate(numbers):
                    doc, key = batch.column(0)[number].as_py(), (batch.column(2)[number].as_py(), batch.column(3)[number].as_py())
                    own = values[cut[k] : cut[k + 1]]
                    if key != now or len(members) >= GROUP:
                        if members:
                            yield done()
                        members = []
                    if key != now:
                        now, leader = key, own
                    else:
                        members.append((doc, own))
        if members:
            yield done()

    id_kind = pairs.schema["a"].dataType.simpleString()
    return map_batches(grouped, run, f"a {id_kind}, b {id_kind}")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc, n, component`` for every row: its id, the size of its set, and the least id reachable by links."""
    rows, ids = by_row(docs, id_col, text_col)
    out = _components(rows, words, percent)
    if ids is None:
        return out
    named = staged(out.join(ids, "doc"), "named")
    least = staged(named.groupBy("component").agg(F.min("id").alias("_least")), "least")
    return named.join(least, "component").select(F.col("id").alias("doc"), "n", F.col("_least").alias("component"))


def _components(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The same for rows with unique keys (``doc, text``)."""
    spark = rows.sparkSession
    sets, counted = describe_sets(rows, words)
    frequent = [(r["shingle"], r["df"]) for r in counted.orderBy(F.desc("df"), "shingle").limit(MAX_FREQUENT).collect()][::-1]
    keyed = sets.where("n > 0")
    first = staged(keyed.groupBy("k1", "k2", "n").agg(F.min("doc").alias("leader"), F.max("doc").alias("_last")).where("leader < _last").drop("_last"), "first")
    classes = staged(keyed.join(first, ["k1", "k2", "n"]).select("doc", "leader"), "classes")
    copies = classes.where("doc <> leader")
    few = copies.select("doc")
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    leaders = staged(keyed.join(few, "doc", "left_anti").select("doc", "n", "bins"), "leaders")
    met = staged(branches(tops(rows.join(few, "doc", "left_anti"), words, percent, frequent)), "met")
    free_shuffles(spark)

    pairs = met.where("doc <> first").where(possible(percent)).select(F.col("first").alias("a"), F.col("doc").alias("b"))
    parts_of = met.where("salt >= 0 and doc = first").select("shingle", "doc", "n", "depth")
    tip = staged(parts_of.groupBy("shingle").agg(F.min(F.struct("doc", "n", "depth")).alias("f")), "tip")
    between = parts_of.join(tip, "shingle").select("doc", "n", "depth", F.col("f.doc").alias("first"), F.col("f.n").alias("m"), F.col("f.depth").alias("other"))
    pairs = pairs.unionByName(between.where("doc <> first").where(possible(percent)).select(F.col("first").alias("a"), F.col("doc").alias("b"))).distinct()
    pairs = staged(prune_by_bins(pairs, leaders, percent), "pairs")
    links = staged(verify(rows, pairs, words, percent), "links")
    free_shuffles(spark)
    parts = connected_components(links)

    placed = met.where("doc <> first or salt >= 0").join(parts.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    placed = staged(placed.select("shingle", "doc", "n", "depth", "component"), "placed")
    drop_staged(met)
    mixed = staged(placed.groupBy("shingle").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").select("shingle"), "mixed")
    open_rows = staged(placed.join(mixed, "shingle").join(leaders.select("doc", "bins"), "doc"), "open")
    drop_staged(placed)
    more = staged(open_pairs(open_rows, percent), "more")
    drop_staged(open_rows)
    links2 = staged(verify(rows, more, words, percent), "links2")
    free_shuffles(spark)
    parts = connected_components(links.unionByName(links2).unionByName(copies.select(F.col("leader").alias("a"), F.col("doc").alias("b"))))
    out = sets.join(parts.withColumnRenamed("node", "doc"), "doc", "left")
    return out.select("doc", "n", F.coalesce("component", "doc").alias("component"))


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Size of each document's set of 4-word shingles, and the component of its links of 85 % or more."""
    found = near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
