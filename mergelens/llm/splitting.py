"""Problem 2: splitting oversized items at natural boundaries, with overlap.

Greedy cutting is a walk along a successor table: from a cut, the next one is the
farthest legal boundary whose piece, overlap included, stays under the limit. The
walk isn't stepped through; all boundaries of a batch of texts are joined to their
successors at once with binary searches, and the tables are squared until every
walk is covered (pointer doubling), so a text with a million pieces needs twenty
squarings. Items within the limit never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelens.session import fresh, ship

#: Boundary levels, best first: before a hunk or file header, after a line feed, after white space, anywhere.
HUNK, LINE, WORD, ANY = 0, 1, 2, 3
_HEADS = ("@@ ", "diff --git ")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def boundaries(text: str, codes: np.ndarray) -> list[np.ndarray]:
    """Cut positions of each level but ``ANY``, ascending; a cut at p parts p-1 from p."""
    lines = np.flatnonzero(codes == 10) + 1
    space = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0xA0) | (codes == 0x3000) | ((codes >= 0x2000) & (codes <= 0x200A))
    heads = sorted(p for head in _HEADS for p in _after_line_feed(text, head))
    words = np.flatnonzero(space) + 1
    words = words[(words >= len(codes)) | (codes[np.minimum(words, len(codes) - 1)] != 10)]  # \r\n stays whole
    return [np.array(heads, dtype=np.int64), lines, words]


def _after_line_feed(text: str, head: str) -> Iterator[int]:
    at = text.find("\n" + head)
    while at >= 0:
        yield at + 1
        at = text.find("\n" + head, at + 1)


def _last(positions: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each window (low, high] the last position in it, or -1."""
    if not len(positions):
        return np.full(len(low), -1, dtype=np.int64)
    at = np.searchsorted(positions, high, side="right") - 1
    found = positions[np.maximum(at, 0)]
    return np.where((at >= 0) & (found > low), found, -1)


def successors(nodes: np.ndarray, levels: list[np.ndarray], end: int, size: int, overlap: int, fill: float) -> np.ndarray:
    """The next cut from each cut in ``nodes``; ``end`` is its own successor.

    A piece from cut c begins at c - overlap (at 0 from the start) and holds ``size``
    code points at most. The best level with a boundary in the last ``fill`` part of
    the window wins, then the best one anywhere in it, then the hard limit. The first
    piece is no shorter than the overlap that the second one repeats.
    """
    high = np.where(nodes == 0, size, nodes + size - overlap)
    floor = np.where(nodes == 0, max(0, overlap - 1), nodes)
    late = np.maximum(floor, nodes + ((high - nodes) * (1 - fill)).astype(np.int64))
    out = np.full(len(nodes), -1, dtype=np.int64)
    for low in (late, floor):
        for positions in levels:
            found = _last(positions, low, high)
            out = np.where(out < 0, found, out)
    out = np.where(out < 0, high, out)
    return np.where(high >= end, end, out)


def cuts(text: str, size: int, overlap: int, fill: float = 0.5) -> np.ndarray:
    """All greedy cuts of one text, 0 and the length included.

    The nodes are the boundaries and, where a window has none, hard cuts; those are
    found by closing the node set under the successor relation, one round for each
    run of text without any white space.
    """
    codes = _codes(text)
    end = len(codes)
    if end <= size:
        return np.array([0, end], dtype=np.int64)
    levels = boundaries(text, codes)
    seen = np.zeros(end + 1, dtype=bool)
    for own in ([0, end], *levels):
        seen[own] = True
    new = np.flatnonzero(seen)
    known_next = np.empty(0, dtype=np.int64)
    known = np.empty(0, dtype=np.int64)
    while len(new):
        step = successors(new, levels, end, size, overlap, fill)
        known, known_next = np.concatenate([known, new]), np.concatenate([known_next, step])
        new = np.unique(step[~seen[step]])
        if len(new):  # hard cuts: whole arithmetic runs at once, as far as no boundary comes between
            stride = size - overlap
            spaces = levels[WORD]
            at = np.searchsorted(spaces, new, side="right")
            limit = np.where(at < len(spaces), spaces[np.minimum(at, len(spaces) - 1)] if len(spaces) else end, end)
            runs = [np.arange(a, max(a + 1, b - stride), stride) for a, b in zip(new.tolist(), np.minimum(limit, end).tolist())]
            new = np.concatenate(runs)
            new = np.unique(new[~seen[new]])
            seen[new] = True
    order = np.argsort(known, kind="stable")
    nodes, to = known[order], known_next[order]
    jump = np.searchsorted(nodes, to)
    tables = [jump]
    while True:  # squaring: table k jumps 2**k cuts
        twice = tables[-1][tables[-1]]
        if np.array_equal(twice, tables[-1]):
            break
        tables.append(twice)
    reached = np.array([np.searchsorted(nodes, 0)])
    for table in reversed(tables):
        reached = np.unique(np.concatenate([reached, table[reached]]))
    return nodes[reached]


def pieces(text: str, size: int, overlap: int, fill: float = 0.5) -> list[tuple[int, int]]:
    """(start, end) of each piece, in code points; neighbours share ``overlap``."""
    at = cuts(text, size, overlap, fill).tolist()
    return [(max(0, a - overlap) if a else 0, b) for a, b in zip(at[:-1], at[1:])]


_SPAN = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]


@F.pandas_udf(T.ArrayType(T.StructType(_SPAN)))
def _split(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, sizes, overlaps in batches:
        yield pd.Series([None if t is None else [{"start": a, "end": b} for a, b in pieces(t, int(n), int(o))] for t, n, o in zip(texts, sizes, overlaps)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([*_SPAN, T.StructField("piece", T.StringType())])))
def _split_texts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, sizes, overlaps in batches:
        yield pd.Series([None if t is None else [{"start": a, "end": b, "piece": t[a:b]} for a, b in pieces(t, int(n), int(o))] for t, n, o in zip(texts, sizes, overlaps)], dtype=object)


#: Deterministic functions would be run once more, in a filter on the size of their result.
_split, _split_texts = _split.asNondeterministic(), _split_texts.asNondeterministic()


def split_items(df: DataFrame, text: str, size: Column, overlap: Column, keys: list[str], with_text: bool = True, only_cut: bool = False) -> DataFrame:
    """One row per piece: ``keys``, ``piece_no`` from 1, ``start_char`` (from 0),
    ``end_char``, and with ``with_text`` the ``piece``; with ``only_cut`` no rows of
    items within the limit.

    Each piece has ``size`` code points at most; each after the first starts with the
    last ``overlap`` ones of the piece before, and they join up to the whole text.
    Null text or null size: no pieces. Empty text, or one within the limit: one piece.
    An overlap that isn't smaller than the size, or a size below 1, raises an error;
    a null overlap is 0. Equal rows give equal pieces; an empty table none. Clashing
    names among ``keys`` and the new columns raise an error of Spark's.
    """
    ship(df.sparkSession)
    body, limit, lap, spans, span = fresh(keys, "text_", "limit_", "lap_", "spans_", "span_")
    checked = F.when((size >= 1) & (F.coalesce(overlap, F.lit(0)) >= 0) & (F.coalesce(overlap, F.lit(0)) < size), size.cast("int")).when(size.isNull(), F.lit(None).cast("int")).otherwise(F.raise_error(F.lit("the overlap must be smaller than the size")).cast("int"))
    base = df.select(*keys, F.col(text).alias(body), checked.alias(limit), F.coalesce(overlap, F.lit(0)).cast("int").alias(lap)).where(F.col(body).isNotNull() & F.col(limit).isNotNull())
    big = F.when(F.length(body) > F.col(limit), F.col(body))
    # the texts of the pieces come from Python, where a slice costs its own length only
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(body).alias("end"), *([F.col(body).alias("piece")] if with_text else [])))
    cut = base.withColumn(spans, F.coalesce((_split_texts if with_text else _split)(big, F.col(limit), F.col(lap)), whole))
    if only_cut:
        cut = cut.where(F.size(spans) > 1)
    return cut.select(*keys, F.posexplode(spans).alias("at", span)).select(
        *keys,
        (F.col("at") + 1).alias("piece_no"),
        F.col(f"{span}.start").alias("start_char"),
        F.col(f"{span}.end").alias("end_char"),
        *([F.col(f"{span}.piece").alias("piece")] if with_text else []),
    )


def rejoined(pieces: DataFrame, keys: list[str], overlap: Column, longest: Column) -> DataFrame:
    """What ``pieces`` say of each item: ``joined``, the text they join up to, and whether all are
    within ``longest`` (``within``) and start with the ``overlap`` of the piece before (``lapped``)."""
    at, lap, top, p = fresh(keys, "pieces_", "lap_", "top_", "p_")
    grouped = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("piece_no", "piece"))).alias(at), F.max(overlap).alias(lap), F.max(longest).alias(top))  # one item's text
    texts = grouped.withColumn(p, F.transform(at, lambda x: x["piece"]))
    rest = F.transform(p, lambda x, i: F.when(i == 0, x).otherwise(F.substr(x, F.col(lap) + 1)))
    lapped = F.forall(F.sequence(F.lit(1), F.size(p)), lambda i: (i == 1) | (F.left(F.get(p, i - 1), F.col(lap)) == F.right(F.get(p, i - 2), F.col(lap))))
    return texts.select(*keys, F.array_join(rest, "").alias("joined"), F.forall(p, lambda x: F.length(x) <= F.col(top)).alias("within"), lapped.alias("lapped"))


def hunk_text(hunk: Column) -> Column:
    """A hunk as text: the header, then each line after its sign (a space for any other type), joined by a line feed."""

    def line(x: Column) -> Column:
        sign = F.when(F.upper(x["type"]) == "ADDED", "+").when(F.upper(x["type"]) == "REMOVED", "-").otherwise(" ")
        return F.concat(sign, F.coalesce(x["content"], F.lit("")))

    return F.array_join(F.concat(F.array(F.coalesce(hunk["header"], F.lit(""))), F.coalesce(F.transform(hunk["lines"], line), F.array().cast("array<string>"))), "\n")


def review_items(files: DataFrame, prompts: DataFrame) -> DataFrame:
    """``item_kind``, ``row_id``, ``hunk_no`` and ``item_text`` of patches, hunks and prompts' diffs."""
    patch = files.select(F.lit("patch").alias("item_kind"), F.col("diff_id").alias("row_id"), F.lit(0).alias("hunk_no"), F.col("patch").alias("item_text"))
    hunk = files.select("diff_id", F.posexplode("hunks").alias("at", "hunk")).select(F.lit("hunk").alias("item_kind"), F.col("diff_id").alias("row_id"), (F.col("at") + 1).alias("hunk_no"), hunk_text(F.col("hunk")).alias("item_text"))
    prompt = prompts.select(F.lit("diff_content").alias("item_kind"), F.col("prompt_id").alias("row_id"), F.lit(0).alias("hunk_no"), F.col("diff_content").alias("item_text"))
    return patch.unionByName(hunk).unionByName(prompt)


def split_review_items(files: DataFrame, prompts: DataFrame, limits: DataFrame, with_text: bool = True, only_cut: bool = True) -> DataFrame:
    """Pieces of the items by the limits of their kind; ``limits`` has a row per kind, and Spark broadcasts it by its size."""
    items = review_items(files, prompts)
    sized = items.join(limits.select("item_kind", "max_chars", "overlap_chars"), "item_kind")
    return split_items(sized, "item_text", F.col("max_chars"), F.col("overlap_chars"), ["item_kind", "row_id", "hunk_no"], with_text, only_cut)
