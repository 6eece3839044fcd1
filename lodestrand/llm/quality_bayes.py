"""Quality by hierarchical empirical Bayes: a document's evidence, and posteriors of its host and path.

**Evidence.** Words and coarse measures of a text are features. On a bounded sample of labelled rows
(``SAMPLE_ROWS``) they are counted by label; those whose shares differ beyond chance, at most
``MAX_FEATURES`` of them, get weights by logistic regression, and a text's sum is its log odds.

**Sites.** Over all documents, probabilities are summed by path, by host and in all (grouped aggregates
with partial sums). A host's rate is shrunk to the global rate and a path's to its host's; the strength of
each prior is the Beta-binomial's, by the method of moments from how much hosts (paths) differ beyond
chance, so a sparse site moves little. A document's posterior odds are its own odds times the ratio of its
path's odds to the global odds; the document's own part is taken out of the sums of its path, of its host and of all,
so a site of one document says nothing of it.

The same is done for toxicity. ``kept``: quality at least even and toxicity under ``TOXIC_AT``, which is
low because few texts are toxic and a missed one costs more.

Nulls and edges: a null text has no words; a null host or path is a site of its own; ties do not matter;
repeated rows are scored row by row; without labelled rows all evidence is zero and the prior one half; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .links import lookup
from .shared import cut, free, small_batches

#: Labelled rows to fit on, and features to keep; both bound the model, not the input.
SAMPLE_ROWS, MAX_FEATURES = 6000, 20_000
TOXIC_AT = 0.2
#: Standard deviations beyond which a feature's odds differ.
LEAST_Z = 4.0
_WORD, _SYMBOLS, _CAPITALS, _SHOUTS = re.compile(r"\w+"), re.compile(r"[#*$%&|<>]"), re.compile(r"\b[A-Z]{2,}\b"), re.compile("!!")


def features(text: str) -> set[str]:
    """Distinct words, and measures by steps; the names of measures can't be words."""
    low = _WORD.findall(text.lower())
    out, n = set(low), max(1, len(low))
    lines = [x for x in text.split("\n") if x.strip()]
    step = lambda x: min(10, int(10 * x))
    size = min(8, n.bit_length())
    out |= {
        f"length {size}", f"symbols {step(len(_SYMBOLS.findall(text)) / n)}", f"capitals {step(len(_CAPITALS.findall(text)) / n)}", f"shouts {step(len(_SHOUTS.findall(text)) / n)}",
        f"distinct {size} {step(len(out) / n)}", f"lines {step(len(set(lines)) / max(1, len(lines)))}",
    }
    return out


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(features(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "features"])


def sample_of(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(text, y) of at most ``rows`` labelled documents, the same for the same table; the labels broadcast are as many."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("label_id"), (F.col(label) > 0).cast("int").alias("y"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("label_id"), "label_id", "y").limit(rows))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, F.col("doc_id") == F.col("label_id")).select("text", "y")


class Evidence:
    """Weights by feature; their sum is a text's log odds."""

    def __init__(self, weights: dict[str, float], offset: float):
        self.weights, self.offset = weights, offset

    def log_odds(self, found: set[str]) -> float:
        weights = self.weights
        return self.offset + sum(weights[f] for f in found & weights.keys())


def logistic(row: np.ndarray, column: np.ndarray, y: np.ndarray, n: int, rounds: int = 600, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of ``n`` presence features and an offset: full gradients with steps by AdaGrad. (row, column) are the ones."""
    w, offset, seen, seen_offset = np.zeros(n), 0.0, np.full(n, 1e-8), 1e-8
    for _ in range(rounds):
        x = np.bincount(row, w[column], len(y)) + offset
        miss = 1 / (1 + np.exp(-np.clip(x, -30, 30))) - y
        g, g0 = np.bincount(column, miss[row], n) / len(y) + decay * w, float(miss.mean())
        seen, seen_offset = seen + g * g, seen_offset + g0 * g0
        w, offset = w - 0.5 * g / np.sqrt(seen), offset - 0.5 * g0 / math.sqrt(seen_offset)
    return w, offset


def fit(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> Evidence:
    """Evidence for ``labels[label] > 0`` from a bounded sample; features are counted by a grouped aggregate."""
    seen = cut(sample_of(docs, labels, label, rows).mapInArrow(_feature_rows, "text string, y int, features array<string>").select("y", "features"), "labelled")
    totals = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Evidence({}, math.log((n1 + 1) / (n0 + 1)))
    counts = seen.select("y", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    p1, p0, p = F.col("c1") / n1, F.col("c0") / n0, (F.col("c1") + F.col("c0")) / (n1 + n0)
    z = F.abs(p1 - p0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    strong = counts.select("feature", z.alias("z")).where(F.col("z") > LEAST_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()
    names = {r["feature"]: k for k, r in enumerate(strong)}

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[names[f] for f in fs if f in names] for fs in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.list_(pa.int32()))], ["y", "found"])

    points = sorted((tuple(r["found"]), r["y"]) for r in seen.mapInArrow(known, "y int, found array<int>").collect())
    row = np.repeat(np.arange(len(points)), [len(f) for f, _ in points])
    column = np.array([k for f, _ in points for k in f], np.int64)
    w, offset = logistic(row, column, np.array([y for _, y in points], float), max(1, len(names)))
    return Evidence({f: float(w[k]) for f, k in names.items()}, offset)


def _scored(docs: DataFrame, host: Column, path: Column, quality: Evidence, toxic: Evidence) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = []
            for text in batch.column("text"):  # one text's features at a time
                found = features(text.as_py())
                odds.append((quality.log_odds(found), toxic.log_odds(found)))
            odds = [pa.array([x[k] for x in odds], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "host", "path")), *odds], ["doc_id", "host", "path", "quality_odds", "toxic_odds"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    return rows.mapInArrow(run, "doc_id long, host string, path string, quality_odds double, toxic_odds double")


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0))))


def _strength(s: str, n: str, mean: Column) -> Column:
    """Of the prior above sites with sums ``s`` of ``n``, by moments: how far their rates spread beyond what their sizes explain."""
    within = F.sum(F.lit(1.0)) * F.avg(mean * (1 - mean))
    spread = F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - mean, 2))
    excess = (spread - within) / F.greatest(F.sum(n) - F.sum(F.pow(n, F.lit(2))) / F.sum(n), F.lit(1e-9))
    return F.least(F.greatest(F.avg(mean * (1 - mean)) / F.greatest(excess, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1e6))


def _site_sums(scored: DataFrame, what: str) -> DataFrame:
    """(host, path, s, n, host_s, host_n, host_strength, strength, all_s, all_n): sums of each path, its host and all, with the strengths of the two priors; the driver sees four numbers."""
    one = lambda df, c, default: next((x for x in df.agg(c.alias("x")).first() if x is not None), default)
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(what).alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    all_s, all_n = one(hosts, F.sum("host_s"), 0.0), one(hosts, F.sum("host_n"), 0)
    rate = all_s / all_n if all_n else 0.5
    k = one(hosts, _strength("host_s", "host_n", F.lit(rate)), 1.0)
    shrunk = hosts.select(F.col("host").alias("of_host"), "host_s", "host_n", ((F.col("host_s") + k * rate) / (F.col("host_n") + k)).alias("prior"))
    held = cut(paths.join(shrunk, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host"), "priors")
    strength = one(held, _strength("s", "n", F.col("prior")), 1.0)
    free(paths)
    return held.drop("prior").withColumns({"host_strength": F.lit(float(k)), "strength": F.lit(float(strength)), "all_s": F.lit(float(all_s)), "all_n": F.lit(int(all_n)).cast("long")})


def _without(s: Column, n: Column, own: Column, strength: Column, prior: Column) -> Column:
    """A site's shrunk rate without one document's part."""
    return (s - own + strength * prior) / (n - 1 + strength)


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, quality, toxic, kept) and the evidence alone (quality_alone, toxic_alone)."""
    quality, toxic = fit(docs, labels, "quality", rows), fit(docs, labels, "toxic", rows)
    scored = cut(_scored(docs, host, path, quality, toxic).select("*", _probability(F.col("quality_odds")).alias("quality_alone"), _probability(F.col("toxic_odds")).alias("toxic_alone")), "scored")
    key = F.to_json(F.struct("host", "path"))  # one string for a site, nulls included
    for name in ("quality", "toxic"):
        alone = F.col(f"{name}_alone")
        site = _site_sums(scored, f"{name}_alone").select(key.alias("key"), "n", F.struct("s", "n", "host_s", "host_n", "host_strength", "strength", "all_s", "all_n").alias(f"{name}_site"))
        scored = lookup(scored, key, cut(site, "sites"), f"{name}_site")
        at = F.col(f"{name}_site")
        rate = _without(at["all_s"], at["all_n"], alone, F.lit(1.0), F.lit(0.5))
        host_rate = _without(at["host_s"], at["host_n"], alone, at["host_strength"], rate)
        others = _without(at["s"], at["n"], alone, at["strength"], host_rate)
        scored = scored.withColumn(name, _probability(F.col(f"{name}_odds") + _odds(others) - _odds(rate)))
    return scored.select("doc_id", "quality", "toxic", ((F.col("quality") >= 0.5) & (F.col("toxic") < TOXIC_AT)).alias("kept"), "quality_alone", "toxic_alone")


def op1_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: posterior quality and toxicity, with its source as host and the language as path."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = classify(docs, labels, F.col("source"), F.col("lang"))
    return out.select("doc_id", F.round("quality", 4).alias("quality"), F.round("toxic", 4).alias("toxic"), "kept")


QUERIES = {"op1_quality_bayes": op1_quality_bayes}
SQL: dict[str, str] = {}
