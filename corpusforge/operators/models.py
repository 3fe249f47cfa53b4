"""The models' place in the dataflow, re-aimed as Spark jobs.

These fill the slots where the reference fine-tunes transformers; they are
not claims of equal quality. Count models are group-bys with partial
aggregation; the classifiers are Spark ML pipelines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions import text as tx
from corpusforge.functions.rules import N_SPECIALS, PAD_ID


# --- count models over id arrays ----------------------------------------------------------

def trigrams(df: DataFrame, ids: str = "ids") -> DataFrame:
    """(left, mid, right) for every inner position; pads are never the middle."""
    a = F.col(ids)
    tri = F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - 2, F.lit(1))),
                      lambda i: F.struct(F.get(a, i - 1).alias("l"), F.get(a, i).alias("m"), F.get(a, i + 1).alias("r")))
    out = df.select(F.explode(F.when(F.size(a) >= 3, tri)).alias("t")).select("t.*")
    return out.where(F.col("m") != PAD_ID)


def bigrams(df: DataFrame, ids: str = "ids", keep=()) -> DataFrame:
    """(a, b) for consecutive ids; pads are never counted."""
    a = F.col(ids)
    bi = F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 2, F.lit(0))),
                     lambda i: F.struct(F.get(a, i).alias("a"), F.get(a, i + 1).alias("b")))
    out = df.select(*keep, F.explode(F.when(F.size(a) >= 2, bi)).alias("t")).select(*keep, "t.*")
    return out.where((F.col("a") != PAD_ID) & (F.col("b") != PAD_ID))


def best_by_count(counts: DataFrame, keys: list[str], value: str, cnt: str = "cnt") -> DataFrame:
    """Most frequent ``value`` per key (ties: smallest value), one aggregation, no window."""
    return counts.groupBy(*keys).agg(
        F.max_by(value, F.struct(F.col(cnt), (-F.col(value)).alias("neg"))).alias(f"best_{value}")
    )


def fit_masked_token(train: DataFrame, ids: str = "ids") -> dict[str, DataFrame]:
    """(left, right) -> most frequent middle; back-off left -> middle; then unigram.

    The trigram explode runs once: (l, r, m) counts are materialized and the
    coarser (l, m) and (m) counts are sums over them."""
    from corpusforge.operators.tokens import materialize

    c3 = materialize(trigrams(train, ids).groupBy("l", "r", "m").agg(F.count(F.lit(1)).alias("cnt")))
    c2 = c3.groupBy("l", "m").agg(F.sum("cnt").alias("cnt"))
    c1 = c2.where(F.col("m") >= N_SPECIALS).groupBy("m").agg(F.sum("cnt").alias("cnt"))
    return {
        "tri": best_by_count(c3, ["l", "r"], "m"),
        "bi": best_by_count(c2, ["l"], "m"),
        "uni": c1.agg(F.max_by("m", F.struct(F.col("cnt"), (-F.col("m")).alias("neg"))).alias("best_m")),
    }


def predict_masked_token(model: dict[str, DataFrame], positions: DataFrame) -> DataFrame:
    """Predictions for (l, r) contexts (count them first: frequent contexts then are one row); the unigram fallback is a scalar subquery."""
    tri = model["tri"].withColumnRenamed("best_m", "p3")
    bi = model["bi"].withColumnRenamed("best_m", "p2")
    uni = model["uni"].select("best_m").scalar()
    j = positions.join(tri, ["l", "r"], "left").join(bi, ["l"], "left")
    return j.withColumn("pred", F.coalesce("p3", "p2", uni))


def fit_bigram_lm(train: DataFrame, ids: str = "ids") -> tuple[DataFrame, DataFrame]:
    """Add-one bigram counts: (a, b, c_ab) and (a, c_a)."""
    cab = bigrams(train, ids).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c_ab"))
    ca = cab.groupBy("a").agg(F.sum("c_ab").alias("c_a"))  # sums over (a, b): one explode
    return cab, ca


def bigram_loss(model: tuple[DataFrame, DataFrame], test: DataFrame, vocab_size: Column, ids: str = "ids") -> DataFrame:
    """Loss -ln((c_ab + 1) / (c_a + V)) of each distinct held-out bigram, and how often it stands there (``cnt``)."""
    cab, ca = model
    bi = bigrams(test, ids).groupBy("a", "b").agg(F.count(F.lit(1)).alias("cnt"))
    j = bi.join(cab, ["a", "b"], "left").join(ca, ["a"], "left")
    p = (F.coalesce("c_ab", F.lit(0)) + 1) / (F.coalesce("c_a", F.lit(0)) + vocab_size)
    return j.withColumn("loss", -F.log(p))


def merge_counts(*tables: DataFrame, keys=("a", "b"), value: str = "count") -> DataFrame:
    """Phase-2 counts start from phase-1 counts: union + sum."""
    u = tables[0]
    for t in tables[1:]:
        u = u.unionByName(t)
    return u.groupBy(*keys).agg(F.sum(value).cast("bigint").alias(value))


class CountStore:
    """Counts by key under a folder, one immutable version per merge.

    A version holds the counts and the names of the phases in them; it is there once its
    marker is. Merging a phase that the latest version has changes nothing, so a
    job may be run again after any failure. Readers of an older version are not disturbed.
    """

    def __init__(self, spark, root: str, keys=("a", "b"), value: str = "count"):
        self.spark, self.root, self.keys, self.value = spark, root.rstrip("/"), list(keys), value

    def _done(self, version: int):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/v{version}/phases/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def version(self) -> int:
        """The latest complete version; 0 before the first merge."""
        v = 0
        while self._done(v + 1):
            v += 1
        return v

    def phases(self, version: int | None = None) -> list[str]:
        v = self.version() if version is None else version
        return [r["phase"] for r in self.spark.read.parquet(f"{self.root}/v{v}/phases").collect()] if v else []

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{self.version() if version is None else version}/counts")

    def merge(self, phase: str, counts: DataFrame) -> int:
        """Add a phase's counts (once); the version that has them."""
        now = self.version()
        have = self.phases(now)
        if phase in have:
            return now
        counts = counts.select(*self.keys, F.col(self.value).cast("bigint").alias(self.value))
        merged = merge_counts(self.read(now), counts, keys=self.keys, value=self.value) if now else merge_counts(counts, keys=self.keys, value=self.value)
        merged.write.mode("overwrite").parquet(f"{self.root}/v{now + 1}/counts")  # of an unfinished merge
        names = self.spark.createDataFrame([(p,) for p in [*have, phase]], "phase string").coalesce(1)
        names.write.mode("overwrite").parquet(f"{self.root}/v{now + 1}/phases")  # last: makes the version whole
        return now + 1


# --- lexicon gloss ---------------------------------------------------------------------------

def lexicon_gloss(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", lang: str = "lang",
                  text: str = "text", map_bytes: int = 64 << 20) -> DataFrame:
    """Word-by-word gloss through the lexicon (target word -> source word) and its coverage.

    A lexicon of up to ``MAP_VOCAB_MAX_BYTES`` goes to every task as a map, as the vocabulary does; a larger
    one is joined per token and the document regrouped. A word that the lexicon has twice for a language must not occur."""
    from corpusforge.operators import tokens as tk

    sep = F.lit("\x1f")
    entry = lexicon.where("src_word is not null").select(F.concat(F.col("lang"), sep, F.col("trg_word")).alias("token"), F.col("src_word").alias("id"))
    sent = tk.sent_table(entry, map_bytes)
    if sent is not None:
        rows = docs.select(key, lang, tx.tokens(text).alias("_t"))
        asked = F.transform("_t", lambda w: F.concat(F.col(lang), sep, w))
        got = tk._map_lists(rows, [key, lang, "_t"], asked, sent, "token", "id", "", "_g", pa.string())
        word = F.zip_with("_t", "_g", lambda w, g: F.when(g == "", w).otherwise(g))
        return got.select(
            key, lang, F.coalesce(F.array_join(word, " "), F.lit("")).alias("glossed"), F.greatest(F.size("_t"), F.lit(0)).cast("bigint").alias("n_tokens"),
            F.size(F.filter("_g", lambda g: g != "")).cast("bigint").alias("n_matched"))
    ex = docs.select(key, lang, F.posexplode_outer(tx.tokens(text)).alias("pos", "token"))
    lx = lexicon.select(F.col("lang").alias(lang), F.col("trg_word").alias("token"), "src_word")
    j = ex.join(lx, [lang, "token"], "left")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("src_word", "token").alias("w"),
                                                     F.col("src_word").isNotNull().alias("hit")))
    g = j.groupBy(key, lang).agg(F.array_sort(F.collect_list(item)).alias("_w"))
    return g.select(
        key, lang,
        F.array_join(F.transform("_w", lambda s: s["w"]), " ").alias("glossed"),
        F.size("_w").cast("bigint").alias("n_tokens"),
        F.size(F.filter("_w", lambda s: s["hit"])).cast("bigint").alias("n_matched"),
    )


# --- classifiers -------------------------------------------------------------------------------

MAX_STEPS, STEP_TOL = 500, 1e-9


def hashed(tokens: Column, digits: int) -> Column:
    """Buckets of tokens: the first ``digits`` hex digits of their MD5 (any engine gets the same)."""
    return F.transform(tokens, lambda t: F.substring(F.md5(t.cast("binary")), 1, digits))


def _bucket_counts(column: str, out: str, digits: int, binary: bool = False) -> CountVectorizerModel:
    """Sparse vector over all ``16 ** digits`` buckets; place j is the bucket whose hex digits are j."""
    names = [f"{j:0{digits}x}" for j in range(16**digits)]
    return CountVectorizerModel.from_vocabulary(names, inputCol=column, outputCol=out).setBinary(binary)


def _softmax(label_col: str, reg: float) -> LogisticRegression:
    return LogisticRegression(featuresCol="_feat", labelCol=label_col, regParam=reg, elasticNetParam=0.0, family="multinomial",
                              maxIter=MAX_STEPS, tol=STEP_TOL)


def text_features(df: DataFrame, text: str = "text", digits: int = 4) -> DataFrame:
    """M01 features: ``_buckets``, the hashed tokens of the whole text; a null text has none."""
    return df.withColumn("_buckets", F.coalesce(hashed(tx.tokens(text), digits), F.array().cast("array<string>")))


def text_classifier(label_col: str = "labels", digits: int = 4, reg: float = 0.01) -> Pipeline:
    """TF-IDF of ``text_features`` + multinomial logistic regression (L2; the intercept is not penalised)."""
    return Pipeline(stages=[_bucket_counts("_buckets", "_tf", digits), IDF(inputCol="_tf", outputCol="_feat"), _softmax(label_col, reg)])


def pair_words(df: DataFrame, first: str = "premise", second: str = "hypothesis") -> DataFrame:
    """Tokens of both texts (``_ta``, ``_tb``) and the distinct ones (``_a``, ``_b``): cut once for ``pair_features`` and ``pair_buckets``."""
    words = df.withColumns({"_ta": tx.tokens(first), "_tb": tx.tokens(second)})
    return words.withColumns({"_a": F.array_distinct("_ta"), "_b": F.array_distinct("_tb")})


PAIR_WORDS = ["_ta", "_tb", "_a", "_b"]


def pair_features(df: DataFrame, first: str = "premise", second: str = "hypothesis") -> DataFrame:
    """M02 features: token overlap, Jaccard, length ratio. Columns of ``pair_words`` are used, and kept, if there."""
    had = set(PAIR_WORDS) <= set(df.columns)
    words = df if had else pair_words(df, first, second)
    inter = F.size(F.array_intersect("_a", "_b")).cast("double")
    union = F.size(F.array_union("_a", "_b")).cast("double")
    out = words.withColumns({
        "overlap": inter,
        "jaccard": F.coalesce(F.try_divide(inter, union), F.lit(0.0)),
        "len_ratio": F.coalesce(F.try_divide(F.size("_tb").cast("double"), F.size("_ta").cast("double")), F.lit(0.0)),
    })
    return out if had else out.drop(*PAIR_WORDS)


def pair_buckets(df: DataFrame, first: str = "premise", second: str = "hypothesis", digits: int = 3, out: str = "_buckets") -> DataFrame:
    """M02 hashed texts: each distinct token crossed with where it stands (first text only, second only, both), hashed.

    Buckets are distinct and sorted. A null text has no tokens. Linear in the
    two texts: tokens are crossed with the side, not with each other."""
    none = F.array().cast("array<string>")
    words = df if set(PAIR_WORDS) <= set(df.columns) else pair_words(df, first, second)
    words = words.withColumns({"_a": F.coalesce("_a", none), "_b": F.coalesce("_b", none)})
    sides = (("first", F.array_except("_a", "_b")), ("second", F.array_except("_b", "_a")), ("both", F.array_intersect("_a", "_b")))
    named = lambda side: lambda t: F.concat(F.lit(f"{side}#"), t)
    crossed = F.concat(*[F.transform(words, named(side)) for side, words in sides])
    return words.withColumn(out, F.array_sort(F.array_distinct(hashed(crossed, digits)))).drop(*PAIR_WORDS)


PAIR_NUMBERS = ["overlap", "jaccard", "len_ratio"]


def pair_classifier(label_col: str = "labels", digits: int = 3, reg: float = 0.01) -> Pipeline:
    """Multinomial logistic regression over the three numbers and the hashed texts (``pair_buckets``)."""
    va = VectorAssembler(inputCols=[*PAIR_NUMBERS, "_hashed"], outputCol="_feat")
    return Pipeline(stages=[_bucket_counts("_buckets", "_hashed", digits, binary=True), va, _softmax(label_col, reg)])


def fitted_moments(model: LogisticRegressionModel, train: DataFrame) -> np.ndarray:
    """(classes, 1 + features): what the model says the training rows of each class sum to, rows first, then every feature.

    ``train`` holds the columns a prediction adds. Where the stated loss
    (mean log loss plus reg / 2 times the squared coefficients of standardised
    features) has gradient 0, it is the sum over the rows of the class:
    sum of p_c * x + rows * reg * variance * w_c = sum of x over the rows
    labelled c, and sum of p_c = number of rows labelled c. So equality with
    those sums, which need no model, certifies that the fit ended at the
    optimum. One pass of vector sums per class; memory is that of the model."""
    w, reg = model.coefficientMatrix.toArray(), model.getOrDefault("regParam")
    prob = vector_to_array(F.col(model.getProbabilityCol()))
    feat = F.col(model.getFeaturesCol())
    sums = [x for c in range(model.numClasses) for x in (Summarizer.mean(feat, prob[c]).alias(f"mean{c}"), F.sum(prob[c]).alias(f"rows{c}"))]
    got = train.select(Summarizer.metrics("variance", "count").summary(feat).alias("all"), *sums).first()
    pull = got["all"]["count"] * reg * got["all"]["variance"].toArray()
    return np.stack([np.concatenate([[got[f"rows{c}"]], got[f"mean{c}"].toArray() * got[f"rows{c}"] + pull * w[c]]) for c in range(model.numClasses)])
