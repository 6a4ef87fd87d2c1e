import numpy as np

from corpuscope.llm import language_id as operator
from corpuscope.llm.common import id_remainder, read_table


def test_held_out_accuracy_and_mixtures(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 4) == 2
    found = operator.identify_languages(docs, train=~held_out).join(docs.select("doc_id", "lang"), "doc_id").where(held_out)
    rows = found.collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    plain = {r.lang: r.text for r in docs.where("n_chars between 3000 and 9000").orderBy("doc_id").collect()}
    mixed = spark.createDataFrame([(0, plain["en"][:2500] + " " + plain["de"][:2000]), (1, plain["fr"])], "doc_id long, text string")
    both = docs.select("doc_id", "text", "lang").unionByName(mixed.selectExpr("doc_id + 1000000 as doc_id", "text", "cast(null as string) as lang"))
    sets = {r.doc_id: r.languages for r in operator.identify_languages(both).where("doc_id >= 1000000").collect()}
    assert {x.lang for x in sets[1_000_000]} == {"de", "en"} and [x.lang for x in sets[1_000_001]] == ["fr"]
    assert abs(sets[1_000_000][0].share - 0.55) < 0.1


def test_edges(edge_docs, no_docs):
    rows = operator.identify_languages(edge_docs).collect()
    assert len(rows) == 17
    undetermined = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert undetermined == {0, 1, 2, 11, 12, None} - ({None} if any(r.doc_id is None and r.lang_pred == "en" for r in rows) else set()) | {None}
    assert operator.identify_languages(no_docs).count() == 0
    assert {r.lang_pred for r in operator.identify_languages(edge_docs.withColumn("lang", edge_docs.text.substr(1, 0)).where("1 = 0")).collect()} == set()


def test_proportions_maximise_the_likelihood():
    rng = np.random.default_rng(2)
    counts = rng.gamma(0.3, 1.0, (operator.BUCKETS, 2)) + 1e-3
    model = operator.Model(["a", "b"], np.log(counts / counts.sum(axis=0)))
    doc, bucket, count = operator._count(["der die das und nicht the and of" * 9])
    p = np.exp(model.log_p)[bucket]
    share, likelihood = model._fit(doc, p, count, np.array([count.sum()]), np.ones((1, 2), bool))
    grid = [(count * np.log(p @ np.array([x, 1 - x]))).sum() for x in np.linspace(0.001, 0.999, 999)]
    assert max(grid) - likelihood[0] < 0.5 and abs(share.sum() - 1) < 1e-9
