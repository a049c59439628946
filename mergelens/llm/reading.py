"""Problem 9: reading level by propagating difficulty over a document-word graph.

Documents and graded samples are linked to the words, word pairs and text measures
they hold. Samples are clamped to their grade; every other node takes the weighted
mean of its neighbours (the harmonic solution). The iterations that lead there are
conjugate-gradient steps of that averaging: each is one pass in which every document
takes the mean of its words and every word the mean of its documents, and the steps
are combined so that a dozen or two do what plain averaging needs hundreds for.

Word nodes are hashed to a fixed number, so a vector of scores has a fixed size, which
each iteration broadcasts. Node lists are packed once into rows of binary arrays, a
batch of documents each; tasks read those and send back sums per word node, which are
added up in slices, so the driver gets one vector a round however long the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.functions.text import let
from mergelens.session import cut_lineage, fresh, ship

#: Word nodes at least and at most; a vector of doubles takes 2 to 32 MB, and that is what an iteration broadcasts.
NODES, MOST_NODES = 1 << 18, 1 << 22
#: Grades of the bands, and how many samples are read at most.
GRADES = {"basic": 0.0, "standard": 0.5, "demanding": 1.0}
MOST_SAMPLES = 20_000
#: Weight of all samples together, against that of all documents.
SAMPLE_MASS = 1.0
#: All scores stand when none is farther than this from the mean of its neighbours; the rounds after which it is an error that they don't.
STILL, ROUNDS = 1e-4, 1000
#: Node entries of one packed row, and slices in which sums are added up.
ENTRIES, SLICES = 2_000_000, 16


def nodes_for(documents: int) -> int:
    """Word nodes for a corpus: words and word pairs grow with the square root of its size, about."""
    return min(MOST_NODES, max(NODES, 1 << math.ceil(math.log2(800 * math.sqrt(max(1, documents))))))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


def node_list(text: Column, nodes: int = NODES) -> Column:
    """Hashed word nodes of a text: its words, pairs of neighbours, and buckets of word and sentence length."""
    ends = F.greatest(F.lit(1), F.size(F.regexp_extract_all(text, F.lit(r"[.!?;]+(?=\s|$)"), 0)))

    def listed(words: Column) -> Column:
        pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
        letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
        measures = F.when(
            F.size(words) >= 8,
            F.array(F.concat(F.lit("#word "), F.floor(letters / F.size(words) * 2).cast("string")), F.concat(F.lit("#sentence "), F.least(F.lit(12), F.floor(F.log2(F.size(words) / ends) * 2)).cast("string"))),
        ).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.transform(F.concat(words, pairs, measures), lambda w: F.pmod(F.xxhash64(w), F.lit(nodes)).cast("int")))

    return let(_words(text), listed)  # the words are taken from the text once


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and starts (one more than rows) of a list column."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(starts) - 1)
    return np.where(np.diff(starts) > 0, np.add.reduceat(values, np.minimum(starts[:-1], len(values) - 1)), 0.0)


def pack(graph: DataFrame, key: str, nodes: str) -> DataFrame:
    """``graph`` as rows of many documents: ``docs`` (their keys), ``nodes`` and ``starts`` as binary arrays.

    A row has ``ENTRIES`` node entries at most, or one document."""
    ship(graph.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts = _flat(batch.column(1))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(starts, starts[at] + ENTRIES, side="right")) - 1)
                docs = batch.column(0).slice(at, stop - at)
                docs = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
                own = flat[starts[at] : starts[stop]].astype(np.int32).tobytes()
                yield pa.RecordBatch.from_arrays([docs, pa.array([own], pa.binary()), pa.array([(starts[at : stop + 1] - starts[at]).astype(np.int64).tobytes()], pa.binary())], names=["docs", "nodes", "starts"])
                at = stop

    kind = graph.schema[key].dataType.simpleString()
    return graph.select(key, nodes).mapInArrow(run, f"docs array<{kind}>, nodes binary, starts binary")


def _unpacked(batch: pa.RecordBatch, nodes: str = "nodes", starts: str = "starts") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i, (n, s) in enumerate(zip(batch.column(nodes), batch.column(starts))):
        yield i, np.frombuffer(n.as_buffer(), dtype=np.int32), np.frombuffer(s.as_buffer(), dtype=np.int64)


def _document_means(nodes: np.ndarray, starts: np.ndarray, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted mean of ``value`` over the nodes of each document; 0 without any weight."""
    w = weight[nodes]
    mass = _sums(w, starts)
    return np.where(mass > 1e-12, _sums(w * value[nodes], starts) / np.where(mass > 1e-12, mass, 1.0), 0.0)


def _node_sums(packed: DataFrame, vectors: list[np.ndarray], weight: np.ndarray | None, size: int) -> list[np.ndarray]:
    """Per word node and vector: the sum over its documents of each one's weighted mean of the vector.

    Without vectors, the number of its documents."""
    spark = packed.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((vectors, weight))
    width = -(-size // SLICES)
    count = max(1, len(vectors))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = shared.value
        sums = np.zeros((count, size))
        for batch in batches:
            for _, nodes, starts in _unpacked(batch):
                sizes = np.diff(starts)
                if not own:
                    sums[0] += np.bincount(nodes, minlength=size)
                for total, vector in zip(sums, own):
                    total += np.bincount(nodes, weights=np.repeat(_document_means(nodes, starts, vector, weights), sizes), minlength=size)
        for k in range(SLICES):
            part = sums[:, k * width : (k + 1) * width]
            at = np.flatnonzero(part.any(axis=0))
            if len(at):
                yield _row(k, at.astype(np.int32), part[:, at])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                mine = sums.setdefault(k, np.zeros((count, width)))
                at = np.frombuffer(at.as_buffer(), dtype=np.int32)
                mine[:, at] += np.frombuffer(part.as_buffer(), dtype=float).reshape(count, -1)
        for k, mine in sums.items():
            at = np.flatnonzero(mine.any(axis=0))
            yield _row(k, at.astype(np.int32), mine[:, at])

    schema = "slice int, at binary, sums binary"
    out = np.zeros((count, size))
    rows = packed.select("nodes", "starts").mapInArrow(add, schema).repartition("slice").mapInArrow(total, schema)
    for r in rows.collect():  # a row per slice, one vector's worth in all
        out[:, r.slice * width + np.frombuffer(r.at, dtype=np.int32)] = np.frombuffer(r.sums, dtype=float).reshape(count, -1)
    shared.unpersist()
    return list(out)


def _row(k: int, at: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(part).tobytes()], pa.binary())], names=["slice", "at", "sums"])


class Level:
    """A fitted graph: the scores of the word nodes (nan where no path leads to a sample), their weights, and the borders of the bands."""

    def __init__(self, score: np.ndarray, weight: np.ndarray, borders: tuple[float, float], rounds: int) -> None:
        self.score, self.weight, self.borders, self.rounds = score, weight, borders, rounds


def _border(scores: np.ndarray, above: np.ndarray) -> float:
    """The cut with the best mean of both classes' hit rates; the middle of the widest such gap."""
    order = np.argsort(scores)
    s, y = scores[order], above[order]
    rate = np.concatenate([[0], np.cumsum(~y)]) / max(1, (~y).sum()) + np.concatenate([[y.sum()], y.sum() - np.cumsum(y)]) / max(1, y.sum())
    gaps = np.concatenate([[0.0], np.diff(s), [0.0]])
    best = np.flatnonzero(rate >= rate.max() - 1e-9)
    at = best[gaps[best].argmax()]
    return float((s[max(0, at - 1)] + s[min(len(s) - 1, at)]) / 2)


def fit(packed: DataFrame, samples: list[tuple[np.ndarray, float]], documents: int, size: int = NODES, rounds: int = ROUNDS) -> Level:
    """Scores of the word nodes from ``samples`` (nodes, grade) over ``packed`` documents.

    Words with the weight of their rarity, and the documents between them, make a
    symmetric graph, so the harmonic solution is that of a positive definite system,
    and conjugate gradients find it. It ends when every score is within ``STILL`` of
    the mean of its neighbours; not to get there in ``rounds`` is an error."""
    (count,) = _node_sums(packed, [], None, size)
    share = SAMPLE_MASS * max(1.0, float(documents)) / max(1, len(samples))
    s_top, s_count = np.zeros(size), np.zeros(size)
    for nodes, grade in samples:
        s_top[nodes] += grade * share
        s_count[nodes] += share
    total = documents + share * len(samples)
    weight = np.maximum(0.0, np.log((1 + total) / (1 + count + s_count)))
    degree = count + s_count
    live = (weight > 0) & (degree > 0)
    mass = np.where(live, weight * degree, 1.0)
    score = np.where(live, 0.5, 0.0)  # with all scores alike only the samples pull
    left = np.where(live, weight * (s_top - 0.5 * s_count), 0.0)
    step = left / mass
    reached, grows, way = live & (s_count > 0), True, step.copy()
    energy, done = float(left @ step), 0
    while np.abs(step).max(initial=0.0) >= STILL or grows:
        if done >= rounds:
            raise RuntimeError(f"the scores don't stand after {rounds} rounds")
        got = _node_sums(packed, [way, reached.astype(float)] if grows else [way], weight, size)
        if grows:
            new = reached | (live & (got[1] > 0))
            grows, reached = bool((new != reached).any()), new
        pull = np.where(live, weight * (degree * way - got[0]), 0.0)
        bend = float(way @ pull)
        if bend > 0:
            along = energy / bend
            score += along * way
            left -= along * pull
            step = left / mass
            energy, before = float(left @ step), energy
            way = step + (energy / before if before > 0 else 0.0) * way
        done += 1
    top = np.where(live, left / np.where(live, weight, 1.0) * -1 + degree * score - s_top, 0.0)  # the documents' part of each node's mean
    shadows = []  # each sample's score by all words' scores without its own part
    for nodes, grade in samples:
        den = degree[nodes] - share
        own = np.where(live[nodes] & (den > 1e-9), (top[nodes] + s_top[nodes] - grade * share) / np.where(den > 1e-9, den, 1.0), np.nan)
        w = np.where(np.isnan(own), 0.0, weight[nodes])
        shadows.append(float((w * np.nan_to_num(own)).sum() / w.sum()) if w.sum() > 0 else 0.5)
    shadow, grade = np.array(shadows), np.array([g for _, g in samples])
    return Level(np.where(reached, score, np.nan), weight, (_border(shadow[grade < 1], grade[grade < 1] >= 0.5), _border(shadow[grade >= 0.5], grade[grade >= 0.5] >= 1)), done)


def _sample_nodes(samples: DataFrame, text: str, band: str, size: int = NODES) -> list[tuple[np.ndarray, float]]:
    grade = F.create_map(*[F.lit(x) for pair in GRADES.items() for x in pair])[F.lower(F.trim(F.col(band)))]
    rows = samples.select(node_list(F.col(text), size).alias("nodes"), grade.alias("grade")).where("grade IS NOT NULL AND size(nodes) > 0").orderBy(F.xxhash64("nodes"), "grade").limit(MOST_SAMPLES).collect()
    return [(np.array(r.nodes, dtype=np.int64), float(r.grade)) for r in rows]


def reading_levels(documents: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text", sample_text: str = "text", sample_band: str = "band", size: int | None = None) -> DataFrame:
    """``key``, ``score`` (0 basic to 1 demanding) and ``band`` of each document.

    Null and blank texts, texts without a letter, and those none of whose words leads to
    a sample, over any number of documents, get null score and band. Equal
    texts get equal scores; repeated rows stay. ``MOST_SAMPLES`` graded samples are
    read at most; without samples of all bands an error is raised. An empty table gives
    no rows. Other columns are ignored. ``size`` is the number of word nodes, else
    ``nodes_for`` the number of documents.
    """
    amount = documents.count()
    size = size or nodes_for(amount)
    graded = _sample_nodes(samples, sample_text, sample_band, size)
    if {g for _, g in graded} != set(GRADES.values()):
        raise ValueError("the samples must have texts of all bands: " + ", ".join(GRADES))
    (nodes,) = fresh([key], "nodes")
    kind = documents.schema[key].dataType.simpleString()
    packed = cut_lineage(pack(documents.select(key, node_list(F.coalesce(F.col(text), F.lit("")), size).alias(nodes)), key, nodes))
    level = fit(packed, graded, amount, size)
    shared = packed.sparkSession.sparkContext.broadcast((level.score, level.weight))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, weight = shared.value
        weight = np.where(np.isnan(score), 0.0, weight)
        score = np.nan_to_num(score)
        for batch in batches:
            docs = batch.column("docs")
            for i, nodes, starts in _unpacked(batch):
                own = _document_means(nodes, starts, score, weight)
                has = _sums(weight[nodes], starts) > 1e-12
                yield pa.RecordBatch.from_arrays([docs[i].values, pa.array(np.where(has, own, np.nan), from_pandas=True)], names=["doc", "score"])

    out = packed.mapInArrow(read, f"doc {kind}, score double")
    low, high = level.borders
    band = F.when(F.col("score") >= high, "demanding").when(F.col("score") >= low, "standard").when(F.col("score").isNotNull(), "basic")
    return out.select(F.col("doc").alias(key), "score", band.alias("band"))
