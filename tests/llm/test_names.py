"""Stages of the pipeline on documents whose further columns have the names that the operators use themselves."""

from corpuscope.llm.decontamination import cut_spans, drop_contaminated
from corpuscope.llm.exact_dedup import drop_duplicates
from corpuscope.llm.near_dedup import drop_near_duplicates
from corpuscope.llm.toxicity import drop_toxic

NAMES = (
    "_group_sha", "_group_keep", "_several", "_gone_id", "_bad_id", "_bad_hash", "_hit_id", "_hit_hash", "_spans", "_gaps",
    "_words", "row", "keep_id", "group_size", "text_sha256", "Component_ID", "kept", "vertex", "score", "start", "items",
)


def test_names_of_the_operators_may_be_columns(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words), " ".join(words) + " more", " ".join(words[::-1]), None]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in NAMES)
    docs = spark.createDataFrame([(i, t, *range(len(NAMES))) for i, t in enumerate(texts)], schema)
    benchmark = spark.createDataFrame([(1, " ".join(words[::-1][5:30]))], "item_id long, text string")
    labels = spark.createDataFrame([(0, 0), (3, 1)], "doc_id long, toxic int")
    stages = {
        drop_duplicates: {0, 2, 3, 4}, drop_near_duplicates: {0, 3, 4},
        lambda d: drop_contaminated(d, benchmark): {0, 1, 2, 4}, lambda d: cut_spans(d, benchmark): {0, 1, 2, 3, 4},
    }
    for stage, want in stages.items():
        found = stage(docs)
        assert found.columns == docs.columns
        rows = found.collect()
        assert {r.doc_id for r in rows} == want
        assert all(tuple(r)[2:] == tuple(range(len(NAMES))) for r in rows)
    assert drop_toxic(docs, labels).columns == docs.columns
    assert {r.doc_id: r.text for r in cut_spans(docs, benchmark).collect()}[3].split() == words[::-1][:5] + words[::-1][30:]
