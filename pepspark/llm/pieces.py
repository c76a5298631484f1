"""SentencePiece encoding and decoding.

A model is its pieces with their scores; texts are units, a run of white space marks and what follows it, that no piece
crosses.  ``encode_units`` is the relational form: explode the units' substrings of bounded length, join them to the piece
table, group the edges by unit, and fold each unit's lattice with ``aggregate``: the best path by the sum of scores for
unigram models, best-scored merges of neighbours first for BPE models.  Distinct units come out with their piece ids.

``encode`` runs over whole texts.  The most frequent units (at most ``MAX_FREQUENT``, the documented bound of what is
broadcast besides the fixed piece table) are encoded by the relational form and go to all tasks; the rest are folded where
they stand, since joining every unit of every text with its encoding would shuffle the corpus several times over.  Texts
themselves are never shuffled.  Characters that no piece has become byte pieces.

Null and empty texts have no pieces; null stays null.  Every row is encoded by itself, so ids may repeat or be null.  Texts
of any length are folded unit by unit, a unit of any length by a heap; of pieces with equal scores the leftmost merges
first.  ``encode`` reads no columns but the id and the text; ``decode`` keeps all columns of its table and replaces one
that is called ``decoded``.  An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
import re
from array import array
from collections import Counter
from functools import cached_property
from itertools import chain
from operator import add
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pepspark.llm.common import map_arrow, map_batches, staged, table, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MAX_FREQUENT = 65_536
LEAST_FREQUENT = 8
KNOWN_UNITS = 80_000
LONG_UNIT = 48
RELATIONAL_LENGTH = 24
LATTICE_TASKS = 48
CHUNK_CHARS = 500_000
SIDE_BY_SIDE = 4_096
GONE = -(1 << 40)
DECODED_PIECES = 300_000


NO_PIECE = float("-inf")


class Scores(dict):
    """Scores by piece; what is no piece has the least."""

    def __missing__(self, piece: str) -> float:
        return NO_PIECE


class Pieces:
    """The pieces of a SentencePiece model; ``kind`` is "bpe" or "unigram"."""

    def __init__(self, path: str = MODEL, kind: str = "bpe"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.kind, self.names = kind, [model.id_to_piece(i) for i in range(size)]
        self.bytes_of = [0] * 256
        self.normal: dict[str, tuple[float, int]] = {}
        stored = []
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                self.bytes_of[int(name[3:-1], 16)] = i
                stored.append(bytes([int(name[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                stored.append(b"")
            else:
                self.normal[name] = (model.get_score(i), i)
                stored.append(name.replace(MARK, " ").encode())
        self.longest = max(map(len, self.normal))
        self.scores = Scores((name, score) for name, (score, _) in self.normal.items())
        if any(MARK in name.lstrip(MARK) for name in self.normal):
            raise ValueError("pieces that cross white space aren't supported")
        self.lengths = np.array([len(x) for x in stored])
        self.starts, self.blob = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(stored), np.uint8)

    def ids(self, parts: list[str]) -> list[int]:
        out, normal = [], self.normal
        for part in parts:
            found = normal.get(part)
            if found:
                out.append(found[1])
            else:
                out += [self.bytes_of[b] for b in part.encode()]
        return out

    def fold(self, unit: str) -> list[int]:
        """Piece ids of one unit."""
        if self.kind == "unigram":
            return self.ids(self._best_path(unit))
        return self.ids(self._merge_long(unit) if len(unit) > LONG_UNIT else self._merge(unit))

    def _merge(self, unit: str) -> list[str]:
        parts, score = list(unit), self.scores.__getitem__
        open_ = list(map(score, map(add, parts, parts[1:])))  # of each two neighbours
        while open_:
            best = max(open_)
            if best == NO_PIECE:
                break
            at = open_.index(best)
            both = parts[at] + parts[at + 1]
            parts[at : at + 2] = [both]
            del open_[at]
            if at:
                open_[at - 1] = score(parts[at - 1] + both)
            if at < len(open_):
                open_[at] = score(both + parts[at + 1])
        return parts

    def _merge_long(self, unit: str) -> list[str]:
        """The same with a heap, for units of any length."""
        n, get = len(unit), self.normal.get
        parts, left, right = list(unit), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-s[0], i, i + 1, unit[i : i + 2]) for i in range(n - 1) if (s := get(unit[i : i + 2]))]
        heapq.heapify(heap)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not parts[i] or not parts[j] or right[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (s := get(parts[a] + parts[b])):
                    heapq.heappush(heap, (-s[0], a, b, parts[a] + parts[b]))
        return [p for p in parts if p]

    def fold_all(self, units: list[str]) -> list[tuple[int, ...]]:
        """Piece ids of each unit.  Short units of a BPE model are merged side by side, one merge of each at a time."""
        if self.kind == "unigram":
            return [tuple(self.fold(u)) for u in units]
        out: list = [None] * len(units)
        order = sorted(range(len(units)), key=lambda k: len(units[k]))
        cut = bisect.bisect(order, LONG_UNIT, key=lambda k: len(units[k]))
        for k in order[cut:]:
            out[k] = tuple(self.fold(units[k]))
        for i in range(0, cut, SIDE_BY_SIDE):
            some = order[i : min(cut, i + SIDE_BY_SIDE)]
            for k, ids in zip(some, self._merge_side_by_side([units[k] for k in some]), strict=True):
                out[k] = ids
        return out

    @cached_property
    def merges(self) -> tuple[dict[str, int], int, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols (pieces, then characters that only longer pieces have), their number, and for each two symbols that
        make a piece, sorted: both as one number, the rank of the piece's score (from 1), the piece's symbol."""
        symbols = {name: k for k, name in enumerate(self.normal)}
        for name in list(symbols):
            for c in name:
                symbols.setdefault(c, len(symbols))
        size = len(symbols)
        ranks = {x: k + 1 for k, x in enumerate(sorted({x for x, _ in self.normal.values()}))}
        rows = [
            (symbols[name[:i]] * size + symbols[name[i:]], ranks[score], symbols[name])
            for name, (score, _) in self.normal.items()
            for i in range(1, len(name))
            if name[:i] in symbols and name[i:] in symbols
        ]
        keys, rank, made = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True))
        return symbols, size, keys, rank.astype(np.int32), made.astype(np.int32)

    def _merge_side_by_side(self, units: list[str]) -> list[tuple[int, ...]]:
        symbols, size, keys, ranks, made = self.merges
        n, lengths = len(units), np.array([len(u) for u in units])
        width = int(lengths.max()) if n else 0
        chars, inverse = np.unique(np.frombuffer("".join(units).encode("utf-32-le"), np.uint32), return_inverse=True)
        names = [chr(c) for c in chars.tolist()]
        own = np.array([symbols.get(c, -1 - k) for k, c in enumerate(names)], np.int64)
        begins = np.cumsum(lengths) - lengths
        row, column = np.repeat(np.arange(n), lengths), np.arange(lengths.sum()) - np.repeat(begins, lengths)
        held = np.full((n, width + 2), -1 - len(names), np.int64)  # symbols, with a mark on both sides
        held[row, column + 1] = own[inverse]

        def score(a, b):
            at = np.searchsorted(keys, a * size + b)
            at[at == len(keys)] = 0
            fits = (keys[at] == a * size + b) & (a >= 0) & (b >= 0)
            return np.where(fits, ranks[at], 0), made[at]

        best, piece = score(held[:, :-1].ravel(), held[:, 1:].ravel())
        best, piece = best.reshape(n, width + 1), piece.reshape(n, width + 1)
        after, before = np.tile(np.arange(1, width + 3), (n, 1)), np.tile(np.arange(-1, width + 1), (n, 1))
        live = np.arange(n)
        while len(live):
            at = best[live].argmax(1)
            able = best[live, at] > 0
            live, at = live[able], at[able]
            gone = after[live, at]
            held[live, at] = piece[live, at]
            held[live, gone] = GONE
            best[live, np.minimum(gone, width)] = 0
            right, left = after[live, gone], before[live, at]
            after[live, at] = right
            before[live, right] = at
            for a, b in ((at, right), (left, at)):
                best[live, a], piece[live, a] = score(held[live, a], held[live, b])
        kept = held[:, 1:-1]
        kept = np.where(np.arange(width) < lengths[:, None], kept, GONE)
        where, place = np.nonzero(kept != GONE)
        flat, ids_of = kept[where, place].tolist(), self._ids_of_symbols
        out: list[list[int]] = [[] for _ in units]
        for k, x in zip(where.tolist(), flat, strict=True):
            if x >= 0 and (found := ids_of[x]) >= 0:
                out[k].append(found)
            else:
                out[k] += self.ids([names[-1 - x] if x < 0 else self._symbols_alone[x]])
        return list(map(tuple, out))

    @cached_property
    def _ids_of_symbols(self) -> list[int]:
        return [self.normal[name][1] if name in self.normal else -1 for name in self.merges[0]]

    @cached_property
    def _symbols_alone(self) -> dict[int, str]:
        return {k: name for name, k in self.merges[0].items() if name not in self.normal}

    def _best_path(self, unit: str) -> list[str]:
        n, get = len(unit), self.normal.get
        worst = min(s for s, _ in self.normal.values()) - 10
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-1e300, 0)] * n
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                s = get(unit[i:j])
                if s is None and j - i > 1:
                    continue
                value = best[i][0] + (s[0] if s else worst)
                if value > best[j][0]:
                    best[j] = (value, i)
        out, j = [], n
        while j:
            out.append(unit[best[j][1] : j])
            j = best[j][1]
        return out[::-1]


_UNIT = re.compile(" +[^ ]+| +$")


def spaced_units(text: str) -> list[str]:
    """A text's units: each begins with its white space marks, written as spaces."""
    return _UNIT.findall(" " + text.replace(MARK, " ")) if text else []


def units(text: str) -> list[str]:
    return [u.replace(" ", MARK) for u in spaced_units(text)]


class Known(dict):
    """Piece ids by unit: the ``frequent`` ones, and others, folded as they come and for a while remembered."""

    def __init__(self, pieces: Pieces, frequent: dict[str, tuple[int, ...]]):
        super().__init__(frequent)
        self.pieces, self.frequent = pieces, frequent

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and where each text's end."""
        if len(self) > len(self.frequent) + KNOWN_UNITS:
            self.clear()
            self.update(self.frequent)
        each = [spaced_units(x) for x in texts]
        new = list(set().union(*each) - self.keys())
        self.update(zip(new, self.pieces.fold_all([u.replace(" ", MARK) for u in new]), strict=True))
        ids, ends = array("i"), [0]
        for own in each:
            ids.extend(chain.from_iterable(map(self.__getitem__, own)))
            ends.append(len(ids))
        return np.frombuffer(ids, np.int32) if ids else np.empty(0, np.int32), np.array(ends, np.int32)


def encode_units(words: DataFrame, pieces: Pieces, unit_col: str = "unit") -> DataFrame:
    """``unit, parts array<string>``: the relational lattice of each distinct unit, folded to its pieces."""
    spark = words.sparkSession
    known = F.broadcast(spark.createDataFrame([(p, float(s)) for p, (s, _) in pieces.normal.items()], "piece string, score double"))  # the model's fixed size
    one = words.select(F.col(unit_col).alias("unit")).repartition(LATTICE_TASKS, "unit").distinct()  # small rows, much work: never coalesced
    longest, n = F.lit(pieces.longest), F.length("unit")
    starts = one.select("unit", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    spans = starts.select("unit", "i", F.explode(F.sequence(F.lit(1), F.least(longest, n - F.col("i") + 1))).alias("size"))
    edges = spans.withColumn("piece", F.expr("substring(unit, i, size)")).join(known, "piece", "left").where("score is not null or size = 1")
    edge = F.struct((F.col("i") + F.col("size") - 1).alias("end"), (F.col("i") - 1).alias("start"), "score")
    lattice = edges.groupBy("unit").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    cuts = _viterbi(pieces) if pieces.kind == "unigram" else _merges()
    lattice = lattice.withColumn("cuts", cuts)
    part = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda k: F.substr(F.col("unit"), F.element_at("cuts", k) + 1, F.element_at("cuts", k + 1) - F.element_at("cuts", k)))
    return lattice.select("unit", part.alias("parts"))


def _merges():
    """Cuts of the unit: in each step the best edge over two neighbouring parts loses the cut between them."""

    def step(cuts, _):
        def joins(e):
            return F.array_contains(cuts, e["start"]) & F.array_contains(cuts, e["end"]) & (F.size(F.filter(cuts, lambda c: (c > e["start"]) & (c < e["end"]))) == 1)

        able = F.filter(F.col("edges"), lambda e: e["score"].isNotNull() & (e["end"] - e["start"] > 1) & joins(e))
        best = F.array_max(F.transform(able, lambda e: F.struct(e["score"].alias("score"), (-e["start"]).alias("first"), e["end"].alias("end"))))
        return F.when(best.isNull(), cuts).otherwise(F.filter(cuts, lambda c: (c <= -best["first"]) | (c >= best["end"])))

    return F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length("unit"))), F.sequence(F.lit(0), F.length("unit")), step)


def _viterbi(pieces: Pieces):
    """Cuts of the best path: a fold over the edges by their ends, keeping each place's best score and path."""
    worst = min(s for s, _ in pieces.normal.values()) - 10
    zero = F.array(F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("path")))

    def step(state, e):
        before = F.filter(state, lambda s: s["at"] == e["start"])
        score = F.element_at(before, 1)["score"] + F.coalesce(e["score"], F.lit(worst))
        new = F.struct(e["end"].alias("at"), score.alias("score"), F.concat(F.element_at(before, 1)["path"], F.array(e["end"])).alias("path"))
        old = F.filter(state, lambda s: s["at"] == e["end"])
        better = F.coalesce(F.try_element_at(old, F.lit(1))["score"] < score, F.lit(True))
        return F.when(better, F.concat(F.filter(state, lambda s: s["at"] != e["end"]), F.array(new))).otherwise(state)

    folded = F.aggregate(F.col("edges"), zero.cast("array<struct<at:int,score:double,path:array<int>>>"), step)
    return F.element_at(F.filter(folded, lambda s: s["at"] == F.length("unit")), 1)["path"]


def frequent_units(docs: DataFrame, text_col: str, bound: int = MAX_FREQUENT) -> DataFrame:
    """``unit``: at most ``bound`` units, the most frequent ones by the documents that have them."""
    source = docs.select(F.lit(0).alias("_"), text_bytes(F.col(text_col)).alias("text"))

    def rows(batch):
        count: Counter[str] = Counter()
        for text in batch.column(1):
            count.update(set(spaced_units(text.as_py().decode("utf-8", "replace"))))
        often = [(u.replace(" ", MARK), n) for u, n in count.items() if n >= LEAST_FREQUENT and len(u) <= RELATIONAL_LENGTH]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], names=["unit", "n"])

    counts = map_arrow(source, rows, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return staged(counts.orderBy(F.desc("n"), "unit").limit(bound).select("unit"), "units")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, kind: str = "bpe", bound: int = MAX_FREQUENT, decoded: bool = False) -> DataFrame:
    """``id_col, text, ids array<int>``: the piece ids of every whole text.

    With ``decoded``, also what ``decode`` makes of the ids, in the same worker: two workers a core, one for each, and the
    ids sent to the second one would take more memory.
    """
    pieces = Pieces(model, kind)
    lattice = encode_units(frequent_units(docs, text_col, bound), pieces)
    frequent = {r["unit"].replace(MARK, " "): tuple(pieces.ids(r["parts"])) for r in lattice.collect()}
    shared = docs.sparkSession.sparkContext.broadcast((pieces, frequent))  # the model and at most `bound` units
    source = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text"))
    kind_of = source.schema[0].dataType.simpleString()

    def run(batches):
        known = Known(*shared.value)
        for batch in batches:
            texts, first, size = [], 0, 0
            for row in range(batch.num_rows):
                texts.append((batch.column(1)[row].as_py() or b"").decode("utf-8", "replace"))
                size += len(texts[-1])
                if size >= CHUNK_CHARS or row + 1 == batch.num_rows:
                    ids, ends = known.encode(texts)
                    part = batch.slice(first, row + 1 - first)
                    columns = [part.column(0), part.column(1).cast(pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
                    if decoded:
                        columns.append(pa.array([x for _, _, some in _decoded(ids, ends, known.pieces) for x in some], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    texts, first, size = [], row + 1, 0

    names = [id_col, "text", "ids", *(["decoded"] if decoded else [])]
    return map_batches(source, run, f"{id_col} {kind_of}, text string, ids array<int>" + (", decoded string" if decoded else ""))


def _decoded(ids: np.ndarray, ends: np.ndarray, pieces):
    """(first, last, texts) of some rows at a time, by their pieces; ``pieces`` has lengths, starts and blob."""
    first, rows = 0, len(ends) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + DECODED_PIECES, "right")) - 1)
        part = ids[ends[first] : ends[last]]
        sizes = pieces.lengths[part]
        before = np.cumsum(sizes) - sizes
        data = pieces.blob[np.repeat(pieces.starts[part] - before, sizes) + np.arange(sizes.sum())].tobytes()
        cuts = np.r_[before, len(data)][ends[first : last + 1] - ends[first]].tolist()
        texts = [data[a:z][1:] if data[a:z][:1] == b" " else data[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
        yield first, last, [t.decode("utf-8", "replace") for t in texts]
        first = last


def decode(df: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``df`` with ``decoded string``: the text of the pieces, without the white space that encoding puts first."""
    df = df.drop("decoded")
    pieces = Pieces(model)
    tables = SimpleNamespace(lengths=pieces.lengths, starts=pieces.starts, blob=pieces.blob)
    shared = df.sparkSession.sparkContext.broadcast(tables)  # the model's fixed size
    place = df.columns.index(ids_col)

    def rows(batch):
        lists = batch.column(place)
        ids, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for first, last, texts in _decoded(ids, ends, shared.value):
            yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    from pyspark.sql.types import StringType, StructField, StructType

    return map_arrow(df, rows, StructType([*df.schema.fields, StructField("decoded", StringType())]))


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again: pieces, digests of both, and whether the text came back."""
    done = encode(table(spark, sf_dir, "documents"), decoded=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), MARK, " ")).alias("round_trip"),
    )
