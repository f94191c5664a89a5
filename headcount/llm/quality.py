"""Document quality: a text classifier whose evidence is combined with that of the site.

Hierarchical empirical Bayes: a document's classifier log-odds are corrected by the log-odds of its
path, whose rate shrinks towards its host's, whose rate shrinks towards the corpus's. The strength
of each shrinkage is fitted to the spread of the rates, so a site with few documents hardly moves
its documents and one with many does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcount.llm.shared import by_size, cut, lean, slices, table, with_field

#: Labelled documents that the classifier is fitted on, at most: those whose ids hash smallest.
LABELLED = 20_000
FEATURES = (
    "upper", "digit", "space", "line", "mark", "odd", "non_ascii", "word_length", "bare", "spoilt", "shouted", "distinct", "short", "doubled",
)

_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:'\"()-?"]] = True
_ODD = np.zeros(256, bool)
_ODD[33:127] = True
_ODD &= ~(_UPPER | _LOWER | _DIGIT | _MARK)


def features(text: str) -> np.ndarray:
    """Shares of kinds of bytes and words of a whole text; zeros for an empty one."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = text.split()
    if not words:
        return np.zeros(len(FEATURES))
    counts = np.bincount(data, minlength=256)
    n, w = len(data), len(words)
    letters = max(1, counts[_UPPER].sum() + counts[_LOWER].sum())
    bare = spoilt = shouted = short = 0
    for x in words:
        if not x[-1].isalnum():
            core = x.rstrip(".,;:!?'\")")
            if not core:
                bare += 1
            elif not core[-1].isalnum():
                spoilt += 1
                bare += not any(map(str.isalnum, core))
        shouted += x.isupper() and len(x) > 1
        short += len(x) < 3
    return np.array(
        [
            counts[_UPPER].sum() / letters, counts[_DIGIT].sum() / n, counts[_SPACE].sum() / n, counts[10] / w,
            counts[_MARK].sum() / w, min(counts[_ODD].sum() / w, 2), counts[128:].sum() / n, min(n / w, 40) / 10,
            bare / w, spoilt / w, shouted / w, len(set(words)) / w, short / w,
            sum(a == b for a, b in zip(words, words[1:])) / w,
        ]
    )


def _measured(batches: Iterator[pa.RecordBatch], rest: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = np.stack([features(t or "") for t in batch.column(0).to_pylist()])
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[1 : 1 + rest], flat], names=[*batch.schema.names[1 : 1 + rest], "x"])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Coefficients, the intercept last, by Newton's method with a ridge penalty on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.full(z.shape[1], penalty * len(x))
    ridge[-1] = 1e-9 * len(x)
    b = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(b[:-1] / scale, b[-1] - (b[:-1] * mean / scale).sum())


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = LABELLED) -> np.ndarray:
    """The classifier's coefficients from at most ``most`` labelled documents.

    Where more are labelled, those whose ids have the smallest hashes count, somewhat fewer than
    ``most``. A document with several labels counts as good if their mean is at least one half; null labels do
    not count. With labels of one kind only, or none, all coefficients are zero but the intercept's,
    which is the smoothed log-odds.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("id"))
    known = cut(known.agg((F.avg("quality") >= 0.5).alias("good")))
    labelled = known.count()
    if labelled > most:
        # A uniform sample by hash, a little smaller than allowed, so that no rows are sorted for it.
        share = (most - 5 * math.sqrt(most)) / labelled
        known = cut(known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 31)) < int(share * (1 << 31))).limit(most))
    own = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("id"))
    # An id that repeats is one document, the first of its texts, so the bound is one of rows.
    sample = own.join(by_size(known), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("good").alias("good"))
    sample = sample.select("text", F.col("good").cast("double").alias("good"))
    rows = sample.mapInArrow(lean(lambda b: _measured(b, 1)), "good double, x array<double>").collect()
    y = np.array([r["good"] for r in rows])
    if not len(rows) or y.min() == y.max():
        return np.append(np.zeros(len(FEATURES)), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    return logistic(np.array([r["x"] for r in rows]), y)


def scored(docs: DataFrame, beta: np.ndarray, text: str = "text") -> DataFrame:
    """docs with ``__odds``, the classifier's log-odds of the text, at most 12 either way."""
    names = docs.columns
    at = names.index(text)

    def run(batches):
        for batch in slices(batches):
            x = [features(t or "") for t in batch.column(at).to_pylist()]
            odds = np.clip(np.array(x).reshape(-1, len(FEATURES)) @ beta[:-1] + beta[-1], -12, 12)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds)], names=[*names, "__odds"])

    return docs.mapInArrow(lean(run), with_field(docs, ("__odds", "double")))


def _strength(rates: DataFrame) -> float:
    """Prior documents that fit the spread of ``rate`` around ``prior`` over sites of ``n`` documents.

    Method of moments for a beta-binomial: the squared gaps beyond what ``n`` draws explain, weighed
    by n. No spread beyond that gives a very strong prior, spread of the largest kind one document.
    """
    r = rates.agg(
        F.sum(F.col("n") * (F.col("rate") - F.col("prior")) ** 2).alias("seen"),
        F.sum(F.col("prior") * (1 - F.col("prior"))).alias("drawn"),
        F.sum((F.col("n") - 1) * F.col("prior") * (1 - F.col("prior"))).alias("most"),
    ).first()
    if not r["most"]:
        return 1e6
    share = (r["seen"] - r["drawn"]) / r["most"]
    return min(1e6, max(1.0, 1 / share - 1)) if share > 0 else 1e6


def site_posteriors(rows: DataFrame) -> DataFrame:
    """``__host``, ``__path``, ``host_rate``, ``path_rate``, ``rate`` from rows with those keys and ``__odds``.

    Rates are expected shares of good documents. Sums are combined in the tasks before they are
    shuffled; the largest host costs no more than another.
    """
    p = 1 / (1 + F.exp(-F.col("__odds")))
    paths = cut(rows.groupBy("__host", "__path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("good")))
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    hosts = cut(hosts)
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = ((total["good"] or 0.0) + 1) / ((total["n"] or 0) + 2)
    hosts = hosts.withColumn("prior", F.lit(rate))
    weight = _strength(hosts.withColumn("rate", F.col("good") / F.col("n")))
    hosts = cut(hosts.select("__host", ((F.col("good") + weight * rate) / (F.col("n") + weight)).alias("host_rate")))
    paths = cut(paths.join(by_size(hosts), "__host"))
    weight = _strength(paths.select("n", (F.col("good") / F.col("n")).alias("rate"), F.col("host_rate").alias("prior")))
    return paths.select(
        "__host", "__path", "host_rate",
        ((F.col("good") + weight * F.col("host_rate")) / (F.col("n") + weight)).alias("path_rate"),
        F.lit(rate).alias("rate"),
    )


def _logit(p):
    return F.log(p / (1 - p))


def _sites(docs: DataFrame, host: str, path: str) -> DataFrame:
    """docs with ``__host`` and ``__path``; a null is a site of its own."""
    return docs.withColumn("__host", F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("\0"))).withColumn(
        "__path", F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("\0"))
    )


def _decided(rows: DataFrame, sites: DataFrame) -> DataFrame:
    rows = rows.join(by_size(sites), ["__host", "__path"])
    odds = F.col("__odds") + _logit(F.col("path_rate")) - _logit(F.col("rate"))
    return rows.withColumn("__good", 1 / (1 + F.exp(-odds)))


def judge(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang",
    most: int = LABELLED,
) -> DataFrame:
    """Per row of docs: ``id``, ``evidence``, ``host_rate``, ``path_rate``, ``posterior``, ``kept``.

    ``evidence`` is the classifier's probability that the text is good, ``posterior`` that with the
    site's; rows with at least one half are kept. A null or empty text has the evidence of a text
    without any feature. Repeated rows are judged alike, and each counts for its site.
    """
    beta = fit(docs, labels, key, text, most)
    rows = _sites(docs.select(*{f"`{c}`": 0 for c in (key, text, host, path)}), host, path)
    rows = cut(scored(rows, beta, text).select(F.col(f"`{key}`").alias("id"), "__host", "__path", "__odds"))
    decided = _decided(rows, cut(site_posteriors(rows)))
    return decided.select(
        "id", (1 / (1 + F.exp(-F.col("__odds")))).alias("evidence"), "host_rate", "path_rate",
        F.col("__good").alias("posterior"), (F.col("__good") >= 0.5).alias("kept"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang",
    most: int = LABELLED,
) -> DataFrame:
    """The rows of docs that ``judge`` keeps, with all columns. Texts are read twice and not shuffled."""
    beta = fit(docs, labels, key, text, most)
    read = _sites(docs.select(*{f"`{c}`": 0 for c in (text, host, path)}), host, path)
    sites = cut(site_posteriors(scored(read, beta, text).select("__host", "__path", "__odds")))
    decided = _decided(scored(_sites(docs, host, path), beta, text), sites)
    return decided.where("__good >= 0.5").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
