import random

import numpy as np
import pytest

from cloakline.llm import langid, resampling, sampling, toxicity

RNG = random.Random(11)
SYLLABLES = {"aa": "ba be bi bo bu".split(), "bb": "ka ke ki ko ku".split(), "cc": "ša še ši šo šu".split()}


def prose(lang, n, rng=RNG):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.choice((2, 3)))) for _ in range(n))


def test_language_on_unseen_texts(spark):
    rows = [(k, prose(lang, RNG.choice((2, 20, 80))), lang) for k, lang in enumerate(RNG.choices(list(SYLLABLES), k=300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id < 200"), buckets=1 << 12, sample_rows=40)
    got = langid.identify(df.filter("doc_id >= 200"), model).collect()
    assert len(got) == 100 and np.mean([r.lang_pred == r.lang for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)
    assert (model.weights == 0).mean() > 0.5
    assert 0.02 <= model.temperature <= 20


def test_language_edge_rows(spark, documents):
    model = langid.fit(documents)
    rows = langid.identify(documents, model).collect()
    assert len(rows) == documents.count() and set(rows[0].asDict()) == {*documents.columns, "lang_pred"}
    by_id = {r.doc_id: r for r in rows}
    for k in (1, 2, 6, 7):
        assert (by_id[k].lang_pred, by_id[k].score) == ("und", 0.0)
    assert by_id[0].lang_pred == "en" and by_id[None].lang_pred in ("en", "fr")
    empty = langid.fit(documents.limit(0))
    assert {r.lang_pred for r in langid.identify(documents, empty).collect()} == {"und"}
    assert langid.identify(documents.limit(0), model).count() == 0


def test_ngrams_of_long_texts_are_the_same_in_runs():
    text = "the quick brown fox " * 8000
    whole = np.sort(np.concatenate(list(langid.ngram_buckets(text, 1 << 10))))
    codes = " " + " ".join(text.lower().split()) + " "
    assert len(whole) == 3 * len(codes) - 3


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    z = rng.normal(0, 1, (4000, 3))
    p = langid.softmax(z)
    y = np.array([rng.choice(3, p=x) for x in p])
    assert langid.fit_temperature(z * 5, y) == pytest.approx(5, rel=0.15)


def quality_rows(n=400):
    rng = random.Random(4)
    for k in range(n):
        junk = k % 4 == 0
        words = prose("aa", rng.choice((10, 60)), rng).split()
        yield k, " ".join(w + rng.choice(("###", "%%%")) if junk else w for w in words), int(not junk)


def test_resampling_keeps_clean_and_drops_junk(spark):
    rows = list(quality_rows())
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows if k % 3 == 0] + [(None, 1), (0, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in resampling.scores(df, labels, buckets=1 << 10).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[k].kept == bool(q) for k, _, q in rows]) > 0.98
    kept = resampling.resample(df, labels, buckets=1 << 10)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}
    brute = sorted((r.gumbel_key for r in got.values()), reverse=True)
    k = sum(r.odds >= 0 for r in got.values())
    assert sum(r.kept for r in got.values()) == k and min(r.gumbel_key for r in got.values() if r.kept) == brute[k - 1]


def test_resampling_edge_rows(spark, documents):
    labels = spark.createDataFrame([(0, 1), (0, 0), (5, 0), (None, 1)], "doc_id long, quality int")
    got = resampling.resample(documents, labels, buckets=1 << 8)
    assert got.columns == documents.columns and 0 < got.count() <= documents.count()
    none = labels.limit(0)
    assert resampling.resample(documents, none, buckets=1 << 8).count() == documents.count()
    assert resampling.resample(documents.limit(0), labels, buckets=1 << 8).count() == 0
    scores = resampling.scores(documents, labels, buckets=1 << 8).collect()
    assert len(scores) == documents.count() and [r.n_grams for r in scores if r.doc_id in (1, 2, 6)] == [0, 0, 0]


def test_kth_largest_with_ties(spark):
    values = [float(RNG.choice((1, 2, 3, 5.5, -4))) for _ in range(300)] + [float(k) / 7 for k in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 120, 400, 500):
        assert sampling.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    low, high, need = sampling._boundary(df, "x", 250, enough=3, bins=8)
    assert sum(v > high for v in values) == 250 - need and low <= sorted(values, reverse=True)[249] <= high


def test_bounded_sample_is_bounded_and_stable(spark):
    df = spark.createDataFrame([(k, f"t{k}", "a" if k % 10 else "b") for k in range(500)], "doc_id long, text string, lang string")
    one, two = (sorted(r.doc_id for r in sampling.bounded_sample(df, "lang", 30).collect()) for _ in range(2))
    assert one == two and 50 <= len(one) <= 60
    assert sampling.bounded_sample(df, "lang", 1000).count() == 500


def toxic_rows(n, seed):
    rng = random.Random(seed)
    for k in range(n):
        words = prose("aa", rng.choice((6, 40, 200)), rng).split()
        bad = k % 5 == 0
        for _ in range(2 if bad else 0):
            words.insert(rng.randrange(len(words) + 1), "zorg" + rng.choice(("", "en", "s", "ling", "t", "z")) if rng.random() < 0.7 else "Grull!")
        yield k, " ".join(words), int(bad)


def test_toxicity_on_unseen_misspellings():
    rows = list(toxic_rows(300, 1))
    model = toxicity.fit_texts([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows]) == 1, buckets=1 << 13)
    test = list(toxic_rows(200, 2))
    raw = toxicity.Scorer(model).raw([t.encode() for _, t, _ in test])
    p = np.array([model.probability(float(np.clip(x, -20, 20))) for x in raw])
    y = np.array([y for *_, y in test]) == 1
    assert (p[y] >= 0.3).mean() > 0.95 and (p[~y] >= 0.3).mean() < 0.05
    unseen = toxicity.Scorer(model).raw([b"ba zorgiful be", b"ba bebi be"])
    assert unseen[0] > unseen[1]


def test_subwords_by_brute_force():
    words = [b"ab", b"", b"abcdef"]
    owner, bucket = toxicity.subwords(words, 1 << 12)
    assert np.bincount(owner, minlength=3).tolist() == [1 + 2 + 1, 1, 1 + 6 + 5 + 4]
    assert toxicity.subwords([b"abcdef"], 1 << 12)[1].tolist() == bucket[owner == 2].tolist()


def test_toxicity_edge_rows(spark, documents):
    labelled = documents.withColumn("toxic", (documents.doc_id % 2).cast("int"))
    model = toxicity.fit(labelled, buckets=1 << 10)
    rows = toxicity.score(documents, model).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 4}) == 1
    for flag, want in ((0, 0.0), (1, 1.0)):
        only = toxicity.fit(labelled.selectExpr("doc_id", "text", f"{flag} as toxic"), buckets=1 << 10)
        assert {round(r.score, 6) for r in toxicity.score(documents, only).collect()} == {want}
    assert toxicity.score(documents.limit(0), model).count() == 0
    assert {round(r.score, 6) for r in toxicity.score(documents, toxicity.fit(labelled.limit(0), buckets=1 << 10)).collect()} == {0.0}


def test_samples_of_rows_without_ids_or_with_one_id(spark):
    """Each label is sampled near its bound whatever the ids are, the same rows each time."""
    from cloakline.llm.sampling import bounded_sample
    from pyspark.sql import functions as F

    rows = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as text", "case when id % 4 = 0 then null else concat('l', id % 4) end as lang")
    for ids in (F.col("doc_id"), F.lit(None).cast("long"), F.lit(7).cast("long"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))):
        held = rows.withColumn("doc_id", ids).filter("lang is not null")
        n = {r.lang: r["count"] for r in bounded_sample(held, "lang", 200).groupBy("lang").count().collect()}
        assert set(n) == {"l1", "l2", "l3"} and all(170 <= x <= 200 for x in n.values())
