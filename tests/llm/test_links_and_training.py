"""Near-duplicate links where many rows share an id or have none, and the bound on what the toxicity model is fitted on."""

import random

from pyspark.sql import functions as F

from meterfold.llm import jaccard_join, toxicity

WORDS = [f"w{k}" for k in range(4000)]


def near_copies(n, seed):
    rng = random.Random(seed)
    base = rng.choices(WORDS, k=120)
    return [" ".join(base[:60] + [f"x{seed}{k}"] + base[60:]) for k in range(n)]


def joined_rows(df):
    """Rows that the joins of a plan have made at most."""
    rows = df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


def test_near_copies_without_ids_are_linear(spark, monkeypatch):
    texts = near_copies(300, 1) + near_copies(3, 2)
    docs = spark.createDataFrame([(None, t) for t in texts[:300]] + [(5, t) for t in texts[300:]] + [(6, "alone here by itself in all the world")], "doc_id long, text string")
    got = jaccard_join.jaccard_join(docs).collect()
    assert sorted((r.doc_id is None, r.class_id is None, r.n_links) for r in got) == sorted([(True, True, 299)] * 300 + [(False, False, 2)] * 3 + [(False, False, 0)])
    seen = {}
    real = jaccard_join._blocks

    def look(df, group):
        if group == "family":
            seen["rows"], seen["joined"] = joined_rows(df)
        return real(df, group)

    monkeypatch.setattr(jaccard_join, "_blocks", look)
    jaccard_join.jaccard_join(docs)
    assert len(seen["rows"]) == 303 and seen["joined"] <= 2 * 303


def test_ids_shared_by_texts_link_as_those_of_their_own(spark):
    rng = random.Random(4)
    texts = [t for k in range(6) for t in near_copies(rng.randint(1, 5), 10 + k)] * 2
    own = [(k, t) for k, t in enumerate(texts)]
    ids = [rng.choice([None, 1, 2, 3]) for _ in texts]
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    alone = {r.doc_id: r.n_links for r in jaccard_join.jaccard_join(docs(own)).collect()}
    shared = sorted((str(r.doc_id), r.n_links) for r in jaccard_join.jaccard_join(docs(list(zip(ids, texts, strict=True)))).collect())
    assert shared == sorted((str(i), alone[k]) for k, i in enumerate(ids))


def test_training_rows_count_whole(spark):
    """A bound on cells leaves rows out and never parts of a row; a wide one changes nothing."""
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(WORDS, k=200) + (["vile", "nasty"] if k % 4 == 0 else []))) for k in range(200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(150)], "doc_id long, toxic int")
    seen = []
    real = toxicity.fit
    toxicity.fit = lambda positive, unlabelled, *more: seen.append((positive[1], unlabelled[1])) or real(positive, unlabelled, *more)
    try:
        toxicity.train(docs, labels, toxicity.Params())
        toxicity.train(docs, labels, toxicity.Params(cells=5000))
    finally:
        toxicity.fit = real
    (p, u), (few_p, few_u) = seen
    for whole, few in ((p, few_p), (u, few_u)):
        assert few[-1] <= 5000 < whole[-1] and list(few) == list(whole[: len(few)])
