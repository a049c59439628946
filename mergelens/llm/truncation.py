"""Problem 3: texts that were cut off, and how often each source cuts.

Two kinds of evidence meet in one posterior for each text.

Length: per source, a log-normal length distribution is fitted by maximum likelihood
with right censoring at candidate limits, lengths at which far more different texts
end than around them. What a source has at a limit beyond the fitted density is
censored; that part is the prior of the texts of that length. Texts of other lengths
share a small prior, the source's rate of cuts in transfer.

Ending: the last words are compared with the whole corpus. A table of word pairs says
how often a word ends a line after its predecessor, and how often longer words with
the same beginning stand there instead. Together with open quotes, brackets and
fences, cut marks and final punctuation this gives an ending class, and expectation
maximisation over counts of (source, limit, class) adjusts the priors of the limits and
sources and, held near their start values, the chances of each class at either end.
(Learned from lengths alone they drift: most cuts stand at no limit.)
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelens.functions.text import let
from mergelens.session import cut_lineage, ship

#: A length is a candidate limit if so many times the different texts of a length nearby end there, and if that is
#: no accident: the log likelihood ratio of a spike there beats the log of the number of lengths by so much.
TIMES_NEARBY, NEARBY, EVIDENCE = 6, 12, 5.0
THRESHOLD = 0.5

#: Ending classes with the chance of each at a cut end and at a whole one, as a start for the fit.
ENDINGS = {
    "mark": (0.15, 0.0005),
    "open": (0.24, 0.0003),
    "fragment": (0.30, 0.0005),
    "middle": (0.24, 0.0008),
    "unsure": (0.03, 0.06),
    "dots": (0.004, 0.03),
    "line": (0.02, 0.38),
    "closed": (0.016, 0.528),
}

#: Ends of texts, read backwards, from the last sign that isn't white space.
_MARKS = ("truncated", "cut off", "cut", "snip", "snipped", "gekürzt", "tronqué", "cortado")
_MARK = r"^\s*+(…|\]\s*+(\.\.\.|…)\s*+\[|[\])>]\s*+(" + "|".join(m[::-1] for m in _MARKS) + r")\s*+[\[(<])"
_CLOSED = r"(?U)^\s*+([\"'”’»)\]}*_`]*+[.!?。！？]|```|~~~|[\]}]|\x{FE0F}?\p{So}|\)-?[:;])"
_DOTS = r"^\s*+\.\.\."
_LINE = "¶"


def normal(text: Column) -> Column:
    """Lower case, digits as 0, each run of line breaks as a word of its own."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"\s*[\r\n]+\s*", f" {_LINE} "), r"[^\S\n]+", " "))


def open_structure(text: Column) -> Column:
    """Whether a code fence, or a bracket or string of structured text, is still open at the end.

    Strings count in texts that hold an array or object start; a stray quote in prose doesn't,
    nor does one before the last closing bracket."""
    fences = (F.length(text) - F.length(F.replace(text, F.lit("```"), F.lit("")))) / 3 % 2 == 1
    structured = (F.contains(text, F.lit("[")) | F.contains(text, F.lit("{"))) & text.rlike(r"(^|[\s`:])[\[{]\s*[\[{\"']")
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*+"', "")  # two flat patterns: none that recurses on long strings
    rest = F.substring_index(F.translate(text, "}", "]"), "]", -1)  # behind the last closing bracket
    count = lambda b, signs: F.length(b) - F.length(F.translate(b, signs, ""))
    left = lambda b: (count(b, "[{") > count(b, "]}")) | (F.contains(b, F.lit('"')) & ((F.length(rest) == F.length(text)) | (F.length(F.translate(rest, '"[{', "")) < F.length(rest))))
    return fences | (structured & F.transform(F.array(bare), left)[0])  # the array makes it read once


def _words(texts: DataFrame) -> DataFrame:
    """Each word with its predecessor, and whether it ends a line."""
    words = F.split(F.concat(normal(F.col("text")), F.lit(f" {_LINE}")), " ")
    return (
        texts.select(F.filter(words, lambda w: w != "").alias("w"))
        .select(F.explode(F.arrays_zip(F.concat(F.array(F.lit(_LINE)), F.slice("w", 1, F.size("w") - 1)).alias("prev"), F.col("w").alias("word"), F.concat(F.slice("w", 2, F.size("w")), F.array(F.lit(_LINE))).alias("next"))).alias("t"))
        .select("t.prev", "t.word", (F.col("t.next") == _LINE).alias("last"))
        .where(F.col("word") != _LINE)
    )


def word_pairs(texts: DataFrame) -> DataFrame:
    """(prev, word): how often the pair stands, and how often it ends a line."""
    return _words(texts).groupBy("prev", "word").agg(F.count(F.lit(1)).alias("n"), F.count_if("last").alias("n_last"))


_END = r"^\s*+(\S++)(\s*+)(\S*+)"


def last_words(back: Column) -> tuple[Column, Column]:
    """The last word and its predecessor (or the line start) of a text that is given backwards."""
    part = lambda i: normal(F.reverse(F.regexp_extract(back, _END, i)))
    return part(1), F.when(F.regexp_extract(back, _END, 2).rlike(r"[\r\n]") | (part(3) == ""), F.lit(_LINE)).otherwise(part(3))


def shape(text: Column, back: Column) -> Column:
    """The ending class that the text shows by itself, or null where its last words must be looked up."""
    return (
        F.when(F.coalesce(text, F.lit("")).rlike(r"^(?U)\s*+$"), "blank")
        .when(back.rlike(_MARK), "mark")
        .when(open_structure(text), "open")
        .when(back.rlike(_DOTS), "dots")
        .when(back.rlike(_CLOSED), "closed")
    )


def compact(texts: DataFrame) -> DataFrame:
    """What is kept of each text, by ``field`` and ``row_id``: no more than its last two words."""
    text = F.col("text")

    def facts(back: Column) -> Column:
        last, prev = last_words(back)
        return F.struct("source", F.length(text).cast("bigint").alias("length"), F.xxhash64(text).alias("h"), shape(text, back).alias("shape"), last.alias("end_word"), prev.alias("end_prev"))

    return texts.where("row_id IS NOT NULL").groupBy("field", "row_id").agg(F.min(let(F.reverse(text), facts)).alias("f")).select("field", "row_id", "f.*")


def endings(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """``facts`` with ``ending``, a class of ``ENDINGS`` or ``blank``; pairs of words are counted over all ``texts``.

    Longer words are looked up at just the lengths that the asked words behind the same word have."""
    pairs = cut_lineage(word_pairs(texts))
    open_ = facts.where("shape IS NULL")
    asked = cut_lineage(open_.select("end_prev", "end_word").distinct())
    words = pairs.groupBy("word").agg(F.sum("n").alias("w_n"), F.sum("n_last").alias("w_last"))
    lengths = asked.groupBy(F.col("end_prev").alias("prev")).agg(F.collect_set(F.length("end_word")).alias("lengths"))  # as many as words have lengths
    longer = (
        pairs.join(lengths, "prev")
        .select("prev", "n", F.explode(F.transform(F.filter("lengths", lambda k: k < F.length("word")), lambda k: F.left(F.col("word"), k))).alias("head"))
        .groupBy("prev", "head")
        .agg(F.sum("n").alias("longer_n"))
    )
    known = (
        asked.join(pairs.select(F.col("prev").alias("end_prev"), F.col("word").alias("end_word"), "n", "n_last"), ["end_prev", "end_word"], "left")
        .join(words.withColumnRenamed("word", "end_word"), "end_word", "left")
        .join(longer.select(F.col("prev").alias("end_prev"), F.col("head").alias("end_word"), "longer_n"), ["end_prev", "end_word"], "left")
    )
    # how often the pair ends a line, with the word alone as a prior worth two pairs
    ratio = (F.col("n_last") + 2 * F.col("w_last") / F.col("w_n")) / (F.col("n") + 2)
    fragment = (F.coalesce(F.col("longer_n"), F.lit(0)) >= 3 * F.col("n")) & (F.col("n_last") >= 0.5 * F.col("n"))
    kind = F.when(fragment, "fragment").when(ratio < 0.35, "middle").when((ratio > 0.75) & (F.col("n") >= 2), "line").otherwise("unsure")
    kinds = known.select("end_prev", "end_word", kind.alias("by_words"))
    looked_up = open_.join(kinds, ["end_prev", "end_word"], "left").withColumn("ending", F.coalesce("by_words", F.lit("unsure")))
    decided = facts.where("shape IS NOT NULL").withColumn("ending", F.col("shape"))
    return decided.drop("end_prev", "end_word", "shape").unionByName(looked_up.drop("end_prev", "end_word", "by_words", "shape"))


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def fit_censored(lengths: np.ndarray, counts: np.ndarray, censored: np.ndarray, rounds: int = 40) -> tuple[float, float]:
    """Mean and deviation of log length by maximum likelihood: ``censored`` of the
    ``counts`` at each length are only known to be longer (expectation maximisation)."""
    x = np.log(np.maximum(lengths, 1).astype(float))
    seen, cut = counts - censored, censored
    total = counts.sum()
    mu = float((counts * x).sum() / total)
    sigma = max(0.05, math.sqrt(float((counts * (x - mu) ** 2).sum() / total)))
    at = np.flatnonzero(cut > 0)
    for _ in range(rounds):
        first, second = float((seen * x).sum()), float((seen * x * x).sum())
        for i in at:
            z = (x[i] - mu) / sigma
            tail = max(1e-12, 1 - _phi(z))
            hazard = math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / tail
            mean = mu + sigma * hazard
            square = sigma * sigma * (1 + z * hazard) + 2 * mu * (mean - mu) + mu * mu
            first += cut[i] * mean
            second += cut[i] * square
        mu, old = first / total, mu
        sigma = max(0.05, math.sqrt(max(0.0, second / total - mu * mu)))
        if abs(mu - old) < 1e-7:
            break
    return mu, sigma


_LIMITS = "field string, source string, length bigint, censored double, mu double, sigma double, texts bigint"


def _fit(own: pd.DataFrame) -> pd.DataFrame:
    own = own.sort_values("length")
    lengths, counts = own["length"].to_numpy(dtype=np.int64), own["n"].to_numpy(dtype=float)
    spike = own["spike"].to_numpy(dtype=bool) & (lengths > 1)
    nearby = own["nearby"].to_numpy(dtype=float)
    cut = np.where(spike, np.maximum(counts - np.maximum(nearby, 1), 0), 0.0)
    mu, sigma = 0.0, 1.0
    for _ in range(4):  # the fit and the censored part of each limit agree after a few rounds
        mu, sigma = fit_censored(lengths, counts, cut)
        edges = np.log(np.stack([lengths - 0.5, lengths + 0.5]).clip(min=0.5))
        density = np.array([_phi((b - mu) / sigma) - _phi((a - mu) / sigma) for a, b in edges.T]) * counts.sum()
        cut = np.where(spike, np.maximum(counts - np.maximum(density, nearby), 0), 0.0)
    keep = np.flatnonzero(cut > 0)
    rows = [(own["field"].iloc[0], own["source"].iloc[0], int(lengths[i]), float(cut[i] / counts[i]), mu, sigma, int(counts[i])) for i in keep]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _LIMITS.split(", ")])


def censoring_limits(facts: DataFrame) -> DataFrame:
    """Limits of each ``field`` and ``source``: ``length``, ``censored`` (the part of the
    texts of that length that the fit calls cut), ``mu``, ``sigma`` and ``texts``.

    A task fits one source from its histogram, a row per distinct length; equal texts
    count once, so that a stock phrase is no limit."""
    lengths = facts.where("length > 0").select("field", "source", "length", "h").distinct()
    histogram = lengths.groupBy("field", "source", "length").agg(F.count(F.lit(1)).alias("n"))
    around = Window.partitionBy("field", "source").orderBy("length").rangeBetween(-NEARBY, NEARBY)
    # the mean of the lengths nearby without the largest three, which may be limits themselves
    others = F.slice(F.array_sort(F.collect_list("n").over(around)), 1, 2 * NEARBY + 1)
    calm = F.slice(others, 1, F.greatest(F.size(others) - 3, F.lit(0)))
    mean = F.aggregate(calm, F.lit(0).cast("bigint"), lambda a, b: a + b) / (2 * NEARBY + 1)
    # a likelihood weighs how many texts are enough: few will do where hardly any end nearby
    calm_rate = F.greatest("nearby", F.lit(1 / (2 * NEARBY + 1)))
    gain = F.col("n") * F.ln(F.col("n") / calm_rate) - (F.col("n") - calm_rate)
    lengths_of = F.count(F.lit(1)).over(Window.partitionBy("field", "source"))
    spiked = histogram.withColumn("nearby", mean).withColumn("spike", (F.col("n") >= TIMES_NEARBY * calm_rate) & (gain > F.ln(lengths_of) + EVIDENCE))
    return spiked.groupBy("field", "source").applyInPandas(_fit, _LIMITS)


_ODDS = "field string, source string, length bigint, ending string, posterior double"


def _maximise(own: pd.DataFrame) -> pd.DataFrame:
    """Posterior of each (source, limit or none, ending) of one field."""
    names = list(ENDINGS)
    at_cut, at_whole = (np.array([ENDINGS[k][i] for k in names]) for i in (0, 1))
    own = own[own["ending"] != "blank"]
    kind = own["ending"].map({k: i for i, k in enumerate(names)}).to_numpy(dtype=int)
    n = own["n"].to_numpy(dtype=float)
    limit = own["length"].notna().to_numpy()
    fitted = own["censored"].fillna(0).clip(0, 0.995).to_numpy(dtype=float)
    prior = np.where(limit, fitted, 0.02)
    place = pd.MultiIndex.from_arrays([own["source"].fillna(""), own["length"].fillna(-1)])
    groups = [np.flatnonzero(place == g) for g in place.unique()]
    posterior = np.zeros(len(own))
    trust = 0.3 * n.sum() / (n.sum() + 1000)  # few texts teach little
    for step in range(60):
        a, b = prior * at_cut[kind], (1 - prior) * at_whole[kind]
        posterior = a / np.maximum(a + b, 1e-300)
        for mine in groups:  # a limit starts from its fit, a source from few cuts
            start, weight = (fitted[mine[0]], 2.0) if limit[mine[0]] else (0.02, 25.0)
            prior[mine] = ((n * posterior)[mine].sum() + start * weight) / (n[mine].sum() + weight)
        if step >= 20:
            for chances, part in ((at_cut, n * posterior), (at_whole, n * (1 - posterior))):
                which = 0 if chances is at_cut else 1
                got = np.bincount(kind, weights=part, minlength=len(names)) / max(part.sum(), 1e-9)
                chances[:] = [(1 - trust) * ENDINGS[k][which] + trust * got[i] for i, k in enumerate(names)]
    return pd.DataFrame({"field": own["field"], "source": own["source"], "length": own["length"].astype("Int64"), "ending": own["ending"], "posterior": posterior})


def detect_truncation(texts: DataFrame) -> DataFrame:
    """Of ``texts`` (``field``, ``row_id``, ``source``, ``text``) each ``field`` and ``row_id`` with
    ``source``, ``length``, ``ending``, ``limit_length`` (the source's limit the text ends at, or null),
    ``posterior`` and ``truncated``.

    Null, empty and blank texts are never cut off: posterior 0. Null sources are a
    source. Equal texts are judged alike. Rows without an id are left out; of several
    rows of one id the least by source, length and text counts. An empty table gives
    no rows.
    """
    ship(texts.sparkSession)
    base = texts.select("field", "row_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    facts = cut_lineage(compact(base))
    limits = cut_lineage(censoring_limits(facts))
    judged = cut_lineage(endings(facts, base))
    marked = judged.join(limits.select("field", "source", "length", "censored", F.col("length").alias("limit_length")), ["field", "source", "length"], "left")
    table = marked.groupBy("field", "source", F.col("limit_length").alias("length"), "ending").agg(F.count(F.lit(1)).alias("n"), F.max("censored").alias("censored"))
    odds = table.groupBy("field").applyInPandas(_maximise, _ODDS)
    odds = odds.select(F.col("field").alias("f"), F.col("source").alias("s"), F.col("length").alias("l"), F.col("ending").alias("e"), "posterior")
    same = (F.col("field") == F.col("f")) & (F.col("source") == F.col("s")) & F.col("limit_length").eqNullSafe(F.col("l")) & (F.col("ending") == F.col("e"))
    out = marked.join(odds, same, "left").select("field", "row_id", F.when(F.col("source") != "", F.col("source")).alias("source"), "length", "ending", "limit_length", F.coalesce("posterior", F.lit(0.0)).alias("posterior"))
    return out.withColumn("truncated", F.col("posterior") >= THRESHOLD)


def truncation_rates(judged: DataFrame) -> DataFrame:
    """Per field and source: texts, cut ones, their rate, and how many stand at a limit."""
    return judged.groupBy("field", "source").agg(F.count(F.lit(1)).alias("texts"), F.count_if("truncated").alias("cut"), F.count_if(F.col("truncated") & F.col("limit_length").isNotNull()).alias("cut_at_limit"), F.avg(F.col("truncated").cast("double")).alias("rate"))


def review_texts(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Bodies by intake and replies by provider (the name before any note); an id counts once."""
    body = requests.select(F.lit("pr_body").alias("field"), F.col("id").alias("row_id"), F.col("intake").alias("source"), F.col("pr_body").alias("text"))
    reply = replies.select(F.lit("content").alias("field"), F.col("reply_id").alias("row_id"), F.regexp_extract("provider", r"^\s*(\S+)", 1).alias("source"), F.col("content").alias("text"))
    return body.unionByName(reply)
