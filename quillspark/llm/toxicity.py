"""Toxicity: gradient-boosted trees over dense text features, isotonic calibration."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import held_out, text_or_empty
from quillspark.llm.labelled import sample
from quillspark.session import ship_package
from quillspark.sinks.snapshots import materialize

PER_CLASS = 4000        # bound of the labelled sample, per class
LEXICON = 200           # bound of the learned lexicon
MIN_DOCS = 10
PREFIXES = (4, 5, 6)
FEATURES = ("hits", "weighted", "top_weight", "distinct", "many", "near_you", "you", "capitals", "punctuation",
            "exclaim", "symbols", "obfuscated", "length")

# Second-person words of the four languages.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre "
                          "tú ti tus usted ustedes vosotros".split())
EDGE = string.punctuation + "¡¿«»“”‘’…–—"


def terms(token: str) -> list[str]:
    """Lexicon entries that a token may match: the word and its prefixes ("abcd*")."""
    word = token.lower().strip(EDGE)
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)] if word else []


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition of the sample: in how many documents of each label a term
    is, and how often."""
    docs, uses = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            seen = Counter(t for token, n in Counter(text.split()).items() for t in terms(token) for _ in range(min(n, 5)))
            for t, n in seen.items():
                docs[t, label] += 1
                uses[t, label] += n
    keys = list(docs)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
         pa.array([docs[k] for k in keys], pa.int64()), pa.array([uses[k] for k in keys], pa.int64())],
        names=["term", "label", "docs", "uses"])


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """The ``LEXICON`` terms that speak most for label 1, by signed log-likelihood
    ratio of their rates, with their log odds. Terms in fewer than ``MIN_DOCS``
    documents of the label don't count, nor does a prefix that speaks for label 1
    by one word alone: without its most used word the rest must do so too."""
    counts = train.select("text", "label").mapInArrow(_count_terms, "term string, label int, docs long, uses long")
    by_term = materialize(counts.groupBy("term").agg(*[F.sum(F.when(F.col("label") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}")
                                                       for k in (0, 1) for c in ("docs", "uses")]), "toxic_terms")
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)

    def log_odds(uses1, uses0):
        return F.log((uses1 + 0.5) / (n1 + 1) / ((uses0 + 0.5) / (n0 + 1)))
    odds = log_odds(F.col("uses1"), F.col("uses0"))
    candidates = by_term.where((F.col("docs1") >= min(MIN_DOCS, max(2, n1 // 20))) & (odds > 1))
    starts = [F.when(F.length("term") >= n, F.concat(F.substring("term", 1, n), F.lit("*"))) for n in PREFIXES]
    first = (by_term.where(~F.col("term").endswith("*") & (F.col("uses1") > 0))
             .select(F.explode(F.array_compact(F.array(*starts))).alias("term"), "uses1", (-F.col("uses0")).alias("less0"))
             .groupBy("term").agg(F.max(F.struct("uses1", "less0")).alias("first")))
    rest1, rest0 = F.col("uses1") - F.col("first.uses1"), F.col("uses0") + F.col("first.less0")
    top = (candidates.join(first, "term", "left").where(~F.col("term").endswith("*") | ((rest1 > 0) & (log_odds(rest1, rest0) > 1)))
           .select("term", odds.alias("odds"), (F.col("uses1") * odds - (F.col("uses1") - F.col("uses0"))).alias("gain"))
           .orderBy(F.desc("gain"), "term").limit(LEXICON))
    return {r["term"]: float(min(r["odds"], 6.0)) for r in top.collect()}


class _TokenWeights(dict):
    """Token -> lexicon weight, -1 for a second person, -2 for an obfuscated word; filled as tokens come."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> float:
        if len(self) > 100_000:
            self.clear()
        own = terms(token)
        value = max((self.lexicon.get(t, 0.0) for t in own), default=0.0)
        if not value and own:
            word = own[0]
            if word in SECOND_PERSON:
                value = -1.0
            elif word[0].isalpha() and word[-1].isalpha() and not word.replace("'", "").replace("-", "").isalpha():
                value = -2.0
        self[token] = value
        return value


def features(text: str, weights: _TokenWeights) -> list[float]:
    tokens = text.split()
    if not tokens:
        return [0.0] * len(FEATURES)
    w = np.fromiter(map(weights.__getitem__, tokens), np.float64, len(tokens))
    hit, you, n = w > 0, w == -1, len(tokens)
    near = you.copy()
    for k in (1, 2, 3):
        near[k:] |= you[:-k]
        near[:-k] |= you[k:]
    bytes_ = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    upper, lower = bytes_[65:91].sum(), bytes_[97:123].sum()
    marks = bytes_[33:48].sum() + bytes_[58:65].sum()
    size = bytes_.sum()
    found = np.flatnonzero(hit)
    return [len(found) / n, w[found].sum() / n, float(w.max(initial=0.0)), len({tokens[i] for i in found}) / n,
            float(np.log1p(len(found))), (hit & near).sum() / n, you.sum() / n, upper / max(1, upper + lower),
            marks / size, bytes_[33] / size, bytes_[35:39].sum() / size, (w == -2).sum() / n, float(np.log1p(n))]


def _feature_batches(lexicon: Broadcast, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _TokenWeights(lexicon.value)
        for batch in batches:
            f = np.array([features(t.as_py(), weights) for t in batch.column("text")], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(f[:, k]) for k in range(f.shape[1])],
                                             names=[*carry, *FEATURES])
            pa.default_memory_pool().release_unused()
    return run


def _with_features(rows: DataFrame, lexicon: Broadcast) -> DataFrame:
    carry = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    wide = rows.mapInArrow(_feature_batches(lexicon, carry), f"{kinds}, " + ", ".join(f"{f} double" for f in FEATURES))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(wide)


def calibration(rows: DataFrame) -> IsotonicRegressionModel:
    """The rising curve from ``margin`` to the weighted share of label 1."""
    return IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight").fit(
        rows.select("margin", "weight", F.col("label").cast("double").alias("label")))


def toxicity_scores(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.5,
                    per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, text_hash.

    Fits on a sample of at most ``per_class`` rows of each label outside the
    held-out fifth: four folds teach the lexicon and the trees, the fifth the
    isotonic curve from tree margin to share of label 1 (weighted back to the
    classes' true shares). Every whole text, however long, is then scored, in one
    pass. Without rows of both labels every score is 0. Null, empty and blank texts
    have zero features. Repeated rows get equal scores, a null id is never held
    out, other columns are not read, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    train = sample(docs, labels, label_col, per_class, "toxic_sample", id_col, text_col)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.xxhash64(text).alias("text_hash"),
                       text.alias("text"))
    have = {(r["label"], r["cal"]) for r in train.select("label", (F.col("fold") == 4).alias("cal")).distinct().collect()}
    if not {(0, False), (1, False)} <= have:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), "text_hash")
    fold = F.col("fold") == 4 if {(0, True), (1, True)} <= have else F.lit(True)
    lexicon = spark.sparkContext.broadcast(learn_lexicon(train.where("fold < 4")))
    seen = materialize(_with_features(train, lexicon).select("label", "weight", "fold", "features"), "toxic_features")
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.2, seed=7,
                          maxBins=64, minInstancesPerNode=5).fit(seen.where("fold < 4"))

    def margin(df: DataFrame) -> DataFrame:
        return trees.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1])
    curve = calibration(margin(seen.where(fold)))
    scored = curve.setPredictionCol("score").transform(margin(_with_features(rows, lexicon)).drop("prediction"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "text_hash")
