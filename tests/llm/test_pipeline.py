"""Each stage on a planted table, and the whole, against what was planted."""

import random

import corpus_pipeline
from test_near_dedup import brute as near_brute


def planted(spark):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, labels, clean = [], [], []

    def add(words, sep=" "):
        docs.append((len(docs), sep.join(words), "en", f"src{len(docs) % 3}", len(words)))
        return len(docs) - 1

    for i in range(160):
        body = text(rng.randint(30, 90))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                body.insert(rng.randrange(len(body)), rng.choice(["zzvile", "zzfoul", "zzmean"]))
        labels.append((add(body), int(toxic)))
        if not toxic:
            clean.append(body)
    bad = [add([*text(40), "zzvile", "zzfoul", *text(20), "zzmean"]) for _ in range(5)]
    items = [text(20) for _ in range(4)]
    dirty = [add([*text(60), *items[k], *text(40)]) for k in range(4)]
    copies = [add(clean[k], "  ") for k in range(5)]
    near = [add([*clean[k], "extra"]) for k in range(5, 10)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
        spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"),
        {"toxic": {i for i, y in labels if y} | set(bad), "copies": set(copies), "near": set(near), "dirty": set(dirty), "all": len(docs)},
    )


def test_stages_and_whole(spark, tmp_path):
    docs, labels, benchmark, want = planted(spark)
    for name, frame in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    gone = set()
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), lost in zip(corpus_pipeline.STAGES[:4], ("toxic", "copies", "near", "dirty")):
        before = {r.doc_id: r for r in left.collect()}
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
        after = {r.doc_id: r for r in left.collect()}
        assert set(before) - set(after) == want[lost], name
        assert all(before[i] == r for i, r in after.items())
        gone |= want[lost]
        if lost == "near":
            components = near_brute([(r.doc_id, r.text) for r in before.values()], 5, 80)
            assert {i for i, (_, home) in components.items() if home == i} == set(after)
    whole = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(whole) == want["all"] - len(gone) and not gone & set(whole)
    assert all(len(r.ids) == r.n_tokens > 0 for r in whole.values())
