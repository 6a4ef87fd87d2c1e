import re
from collections import Counter

import numpy as np
import pytest

from corpuscope.llm import collocations as operator

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, inside=80, top=2000):
    count, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_TO_Z)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for n in range(1, 5):
                for p in range(len(words) - n + 1):
                    count.setdefault(lang, Counter())[tuple(words[p : p + n])] += 1
    out = []
    for lang, found in count.items():
        good = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        around = Counter()
        for q, b in good.items():
            for n in range(2, len(q)):
                for i in range(len(q) - n + 1):
                    around[q[i : i + n]] = max(around[q[i : i + n]], b)
        kept = []
        for phrase, a in good.items():
            score, k = min((2000000 * a // (found[phrase[:k]] + found[phrase[k:]]), k) for k in range(1, len(phrase)))
            if phrase not in around or 100 * around[phrase] < inside * a:
                kept.append((-score, -a, " ".join(phrase).encode(), found[phrase[:k]], found[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def invented(seed, n):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "a", "New", "York", "san", "francisco", "été", "日本", "x" * 90, "in\tthe", "bay  area", "y,", "z.", "?\n"]
    return [
        (str(rng.choice(["en", "fr"])) if i % 7 else None, " ".join(rng.choice(words, rng.integers(0, 40))))
        for i in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, lang, text, "k") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string")


@pytest.mark.parametrize("trie_bytes", [1 << 24, 400])
def test_matches_brute_force(spark, trie_bytes):
    rows = invented(1, 300) + [("en", None), ("en", ""), (None, "one. two"), ("de", "Same same SAME " * 40)]
    assert rows_of(operator.collocations(frame(spark, rows), trie_bytes=trie_bytes)) == brute(rows)


def test_other_thresholds_and_ties(spark):
    rows = [("en", "a b. c d. e f")] * 5 + [("en", "g h i j k")] * 6
    assert rows_of(operator.collocations(frame(spark, rows), min_count=4, top=2)) == brute(rows, 4, 80, 2)


def test_edges_and_clashing_columns(spark, edge_docs, edge_rows):
    rows = [(r[2], r[1]) for r in edge_rows]
    assert rows_of(operator.collocations(edge_docs, min_count=2)) == brute(rows, 2)


def test_empty_table(no_docs):
    assert operator.collocations(no_docs).count() == 0


def test_crowded_buckets_only_add_candidates(spark, monkeypatch):
    rows = invented(2, 200)
    monkeypatch.setattr(operator, "BUCKETS", (16, 16))
    assert rows_of(operator.collocations(frame(spark, rows))) == brute(rows)


def test_counts_stop_at_the_threshold_in_each_partition(spark):
    rows = [("en", "p q")] * 16 + [("en", "r s")] * 14
    docs = frame(spark, rows * 2).repartition(8)
    assert rows_of(operator.collocations(docs)) == brute(rows * 2)


def test_trie_holds_wide_nodes_and_prefixes():
    rng = np.random.default_rng(3)
    phrases = sorted({bytes(rng.integers(33, 256, rng.integers(1, 5), dtype=np.uint8)) for _ in range(5000)})
    trie = operator.Trie(["en"], np.zeros(len(phrases), np.int64), b"".join(phrases), np.cumsum([0, *map(len, phrases)]))
    counts = np.zeros(len(phrases), np.int64)
    drawn = [phrases[i] for i in rng.integers(0, len(phrases), 3000)]
    words = operator.Words([b"\n".join(drawn)])
    operator.Trie.count((trie.base, trie.check, trie.leaf), words, np.zeros(1, np.int32), counts)
    known = set(phrases)
    spelled = Counter(w for w in (words.raw[a:b] for a, b in zip(words.starts, words.ends)) if w in known)
    assert {phrases[i]: int(c) for i, c in enumerate(counts) if c} == dict(spelled)


def test_texts_are_passed_over_as_often_for_many_tries_as_for_one(spark):
    rows = invented(5, 300)
    read = {}
    for trie_bytes in (1 << 24, 100):
        seen = spark.sparkContext.accumulator(0)

        def tallied(batches, seen=seen):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        docs = frame(spark, rows).mapInArrow(tallied, "doc_id long, lang string, text string, phrase string")
        assert rows_of(operator.collocations(docs, trie_bytes=trie_bytes)) == brute(rows)
        read[trie_bytes] = seen.value
    assert read[1 << 24] == read[100] > 0


def test_turns_of_few_bytes_add_up(spark, monkeypatch):
    """A task that ends a turn behind every batch counts each text once."""
    rows = invented(6, 400)
    monkeypatch.setattr(operator, "HELD_BYTES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows_of(operator.collocations(frame(spark, rows))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
