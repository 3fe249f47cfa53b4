import hashlib

import numpy as np
from pyspark.sql import functions as F

from corpusforge.operators import models as md


def test_pair_buckets_names_each_token_by_its_side(spark):
    rows = [(1, "a b b", "b c"), (2, None, "x"), (3, "", None)]
    got = md.pair_buckets(spark.createDataFrame(rows, "doc_id long, premise string, hypothesis string"), digits=3)
    got = {r.doc_id: r._buckets for r in got.collect()}
    name = lambda x: hashlib.md5(x.encode()).hexdigest()[:3]
    assert got == {1: sorted(map(name, ("first#a", "both#b", "second#c"))), 2: [name("second#x")], 3: []}


def test_fitted_moments_tell_a_finished_fit_from_a_stopped_one(spark):
    words = "red green blue cold warm".split()
    rows = [(i, i % 3, " ".join(words[(i * k + i // 7) % 5] for k in range(1, 2 + i % 4))) for i in range(60)]
    df = md.text_features(spark.createDataFrame(rows, "doc_id long, labels int, text string"), digits=1).cache()
    want = np.zeros((3, 17))
    for _, y, text in rows:
        want[y, 0] += 1
        for w in text.split():
            want[y, 1 + int(hashlib.md5(w.encode()).hexdigest()[0], 16)] += 1

    def gap(pipeline):
        model = pipeline.fit(df)
        idf = model.stages[1].idf.toArray()
        return np.abs(md.fitted_moments(model.stages[-1], model.transform(df)) - want * np.concatenate([[1.0], idf])).max()

    assert gap(md.text_classifier(digits=1)) < 1e-2
    stopped = md.text_classifier(digits=1)
    stopped.getStages()[-1].setMaxIter(2)
    assert gap(stopped) > 0.1


def test_pair_classifier_learns_from_hashed_texts(spark):
    rows = [(i, i % 2, "one two three", "yes yes it is" if i % 2 else "no it is not") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, labels int, premise string, hypothesis string")
    df = md.pair_buckets(md.pair_features(df).withColumns({c: F.lit(0.5) for c in md.PAIR_NUMBERS}))  # the numbers tell nothing
    got = md.pair_classifier().fit(df).transform(df)
    assert got.where("prediction = labels").count() == 40
