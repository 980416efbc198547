import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from samples import prose

from careloom.llm import linear, quality, toxicity

INSULTS = ["idiot", "scum", "moron"]


def labelled(seed=0, n=600, groups=()):
    """Texts, a third with an insult; ``groups`` are mentioned mostly in toxic ones."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        toxic = i % 3 == 0
        w = prose(rng, 60).split(" ")
        if toxic:
            w[rng.randrange(60)] = rng.choice(INSULTS)
        if groups and rng.random() < (0.9 if toxic else 0.05):
            w[rng.randrange(60)] = rng.choice(groups)
        out.append((i, " ".join(w), int(toxic)))
    return out


def tables(spark, data):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data], "doc_id long, text string, features string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in data] + [(10**6, 1), (3, None)], "doc_id long, toxic int")


def test_held_out_toxicity(spark):
    docs, labels = tables(spark, labelled())
    model = toxicity.fit_toxicity(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score_toxicity(docs, model).join(labels.dropna(), "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    rows = scored.select("predicted", "toxic").collect()
    assert len(rows) > 80 and np.mean([r["predicted"] == (r["toxic"] == 1) for r in rows]) >= 0.97


def test_swaps_take_the_weight_from_group_mentions(spark):
    docs, labels = tables(spark, labelled(1, groups=["muslims", "women"]))
    neutral = pa.array(["The women of the town met the muslims at noon."], pa.large_string())
    score = {}
    for cost in (0.0, toxicity.SWAP_COST):
        model = toxicity.fit_toxicity(docs, labels, swap_cost=cost)
        score[cost] = float(model.scores(neutral, model.known())[0])
    assert score[toxicity.SWAP_COST] < 0.5 and score[toxicity.SWAP_COST] < score[0.0] - 0.2


def test_odd_texts_and_tables(spark, docs, no_docs):
    train, labels = tables(spark, labelled())
    model = toxicity.fit_toxicity(train, labels)
    scored = toxicity.score_toxicity(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    nothing = toxicity.fit_toxicity(no_docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, nothing).collect()} == {False}


def test_held_out_rows(spark):
    import zlib

    df = spark.range(200).withColumn("held", toxicity.held_out(F.col("id")))
    assert all(r["held"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in df.collect())


def junk(rng, kind, n=80):
    w = prose(rng, n).split(" ")
    if kind == 0:
        return " ".join(x + rng.choice(["###", "&&&", "%%%"]) for x in w)
    if kind == 1:
        return " ".join(x.upper() + "!!" for x in w)
    if kind == 2:
        return " ".join(w[i // 20] for i in range(n))
    return " | ".join(rng.choice("bcdfgh") + x + "landorin" for x in w)


def test_quality_without_labels(spark):
    rng = random.Random(5)
    data = [(i, junk(rng, i // 6 % 4) if i % 6 == 0 else prose(rng, rng.randint(40, 200)), int(i % 6 != 0)) for i in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, text string, good int")
    scored = quality.score_quality(docs, quality.fit_quality(docs)).collect()
    assert np.mean([r["keep"] for r in scored if r["good"]]) >= 0.99
    assert np.mean([not r["keep"] for r in scored if not r["good"]]) >= 0.9


def test_quality_of_odd_texts(spark, docs, no_docs):
    model = quality.fit_quality(docs)
    scored = quality.score_quality(docs.withColumn("keep", F.lit("clash")), model)
    assert scored.count() == docs.count()
    assert scored.filter("text is null or trim(text) = ''").filter("not keep").count() == 0
    empty = quality.fit_quality(no_docs)
    assert quality.score_quality(no_docs, empty).count() == 0
    assert quality.score_quality(docs, empty).filter("not keep").count() == 0


def test_label_model_finds_the_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20000) < 0.8
    catch = np.array([0.6, 0.3, 0.4, 0.5])  # share of the bad that each heuristic calls bad
    votes = np.where(rng.random((20000, 4)) < np.where(good[:, None], 0.01, catch), quality.BAD, quality.GOOD)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.1
    found = model.rates[:, quality.BAD, quality.BAD]  # the first guess of 0.3 still weighs in
    assert np.all(np.abs(found - catch) < 0.25) and found.argsort().tolist() == catch.argsort().tolist()


def test_gradient_of_the_linear_model():
    rows = linear.Rows([np.array([0, 1]), np.array([1]), np.array([0]), np.array([], dtype=np.int64)])
    w, b = linear.fit(rows, np.array([1.0, 0.0, 1.0, 0.0]), 2, l2=1e-3)
    p = linear.sigmoid(rows.dot(w) + b)
    assert p[0] > 0.8 and p[2] > 0.9 and p[1] < 0.2 and p[3] < 0.5


def test_repeated_rows_reach_the_driver_once(spark):
    """One labelled id that fills most of the table, and one id of many texts."""
    data = labelled(2, 300)
    docs, labels = tables(spark, data)
    hot = spark.range(20000).select(F.lit(0).cast("long").alias("doc_id"), F.lit(data[0][1]).alias("text"), F.lit("x").alias("features"))
    many = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("x").alias("features"))
    every = docs.union(hot).union(many)
    few, all_of = (toxicity.labelled_features(every, labels, "doc_id", "text", "toxic", n, toxicity.IDENTITY_TERMS) for n in (400, 1000))
    assert few.count() == 400 and all_of.count() == 800 and all_of.agg(F.max("n")).first()[0] == 20001
    model = quality.fit_quality(docs.union(hot), sampled=50)
    assert 0 < model.labels.prior <= 1


def test_neutral_mentions_per_language(spark):
    """Groups that are named mostly in toxic texts, in every language, don't make a neutral text toxic."""
    neutral = {
        "en": ("muslims", "women", "the women of the town met the muslims at noon"),
        "de": ("muslime", "frauen", "die frauen der stadt trafen die muslime am mittag"),
        "fr": ("musulmans", "femmes", "les femmes de la ville ont vu les musulmans"),
        "es": ("musulmanes", "mujeres", "las mujeres de la ciudad vieron a los musulmanes"),
    }
    for first, second, text in neutral.values():
        docs, labels = tables(spark, labelled(3, 300, groups=[first, second]))
        model = toxicity.fit_toxicity(docs, labels)
        assert model.scores(pa.array([text], pa.large_string()), model.known())[0] < 0.5


def test_scores_are_those_of_the_features(spark):
    """Scores of the model against a plain sum over each text's distinct features."""
    docs, labels = tables(spark, labelled(4, 300))
    model = toxicity.fit_toxicity(docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    for r in toxicity.score_toxicity(docs, model).collect():
        own = {f for w in set(r["text"].lower().replace(".", " ").split()) for f in toxicity.hashed(w)}
        total = model.bias + sum(weight.get(f, 0.0) for f in own)
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-9


def test_shapes_read_whole_words():
    plain = "a" * 64
    assert quality.shape(plain) != quality.shape(plain + "#9Z" * 2000) and quality.shape(plain) == quality.shape("b" * 5000)
    sizes = quality.length_class(np.array([1, 40, 41, 80, 160, 10**6]))
    assert sizes.tolist() == sorted(set(sizes.tolist())) and sizes[1] == 40
