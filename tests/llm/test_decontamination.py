import random
import re

import pytest

from corpuscope.llm import decontamination as operator

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        own = words(text)
        size = min(13, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[i : i + size]), set()).add(str(item) if item is not None else "")
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(own) - size + 1):
                names = windows.get(tuple(own[i : i + size]))
                if names:
                    hit.update(range(i, i + size))
                    found |= names
        out.append((doc_id, len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own)))
    return out


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    text = lambda n: [rng.choice("abcdefghijkl") + rng.choice("0é") for _ in range(n)]
    items = [text(n) for n in (1, 2, 5, 12, 13, 13, 20, 40)] + [[]]
    items[0] = ["Unique"]
    docs = []
    for i in range(120):
        body = text(rng.randint(0, 400))
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items[:-1])
            start = rng.randint(0, max(0, len(item) - 13))
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() if rng.random() < 0.3 and w.isascii() else w for w in item[start : start + rng.randint(10, 30)]]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(body)))
    docs += [(None, " ".join(items[6])), (7, None), (8, ""), (9, "unique"), (9, "unique"), (300, " ".join(items[7]) * 300)]
    return docs, [(i, " ".join(item)) for i, item in enumerate(items)] + [(None, "nameless item"), (50, None), (4, " ".join(items[4]))]


@pytest.mark.parametrize("bound", [100_000, 7])
def test_matches_brute_force_in_one_block_or_many(spark, planted, bound):
    docs, items = planted
    found = operator.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
        set_bound=bound,
    ).drop("text_hash").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute(docs, items)))


def test_dropping_and_cutting(spark, planted, edge_docs):
    docs, items = planted
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, row int")
    kept = operator.drop_contaminated(frame, benchmark)
    assert kept.columns == frame.columns
    want = [d for d, b in zip(docs, brute(docs, items)) if not b[4]]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, want))
    cut = operator.cut_spans(frame, benchmark)
    assert cut.columns == frame.columns
    left = sorted(map(repr, ((r.doc_id, len(words(r.text))) for r in cut.collect())))
    assert left == sorted(map(repr, ((b[0], b[1] - b[2]) for b in brute(docs, items))))


def test_empty_tables(spark, edge_docs, no_docs):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    found = operator.contamination(edge_docs, benchmark).collect()
    assert len(found) == 17 and not any(r.contaminated for r in found)
    assert operator.contamination(no_docs, spark.createDataFrame([(1, "one")], "item_id long, text string")).count() == 0
