import hashlib
import re

import numpy as np
import pandas as pd

from corpuscope.llm import exact_dedup as operator


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(normal(text), []).append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[normal(text)]
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(normal(text).encode()).hexdigest()
        out.append((doc_id, keep, len(ids), doc_id == keep, sha))
    return out


def test_edges_match_brute_force(edge_docs, edge_rows):
    found = [tuple(r) for r in operator.exact_dedup(edge_docs).collect()]
    assert sorted(found, key=repr) == sorted(brute([r[:2] for r in edge_rows]), key=repr)


def test_dropping_keeps_all_columns_and_one_row_a_group(edge_docs, edge_rows):
    kept = operator.drop_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    # Rows that repeat id and text are one: each text of a group stays once.
    want = sorted(repr(b[0]) for b in {(b[0], b[4]) for b in brute([r[:2] for r in edge_rows]) if b[3]})
    assert sorted(repr(r.doc_id) for r in kept.collect()) == want


def test_empty_table(no_docs):
    assert operator.exact_dedup(no_docs).count() == 0


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    parts = [np.r_[values[:3000], values[:500]], values[2000:], np.array([0, 2**64 - 1], np.uint64)]
    for bits in (0, 1, 5):
        rows = []
        for part in parts:
            unique, counts = np.unique(part, return_counts=True)
            rows += list(operator._encode(unique, counts, bits))
        frame = pd.DataFrame(rows, columns=["block", "runs", "remainders", "counts"])
        merged = pd.concat([operator._merger(bits)((b,), g) for b, g in frame.groupby("block")])
        unique, counts = np.unique(np.concatenate(parts), return_counts=True)
        want = dict(zip(unique[counts > 1].view(np.int64).tolist(), counts[counts > 1].tolist()))
        assert dict(zip(merged.fingerprint.tolist(), merged.copies.tolist())) == want


def test_equal_fingerprints_of_other_texts_part_again(spark, monkeypatch):
    rows = [(1, "a"), (2, "b"), (3, "a")]
    every = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(operator.F, "xxhash64", lambda *_: operator.F.lit(7).cast("long"))
    found = sorted((r.doc_id, r.keep_id, r.group_size) for r in operator.exact_dedup(every).collect())
    assert found == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]


def test_stage_keeps_one_row_of_equal_rows(spark):
    rows = [(1, "a b", "x"), (1, "a  b", "y"), (1, "a b", "x"), (2, "a b", "z"), (None, "n", "p"), (None, "n", "q"), (3, "c", "x"), (3, "d", "x"), (4, None, "k"), (4, "", "l"), (5, "e", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _group_sha string")
    found = operator.drop_duplicates(docs)
    assert found.columns == docs.columns
    kept = sorted((tuple(r) for r in found.collect()), key=repr)
    assert set(kept) <= set(rows)
    assert sorted((r[0] is None, r[0] or 0, normal(r[1])) for r in kept) == [
        (False, 1, "a b"), (False, 3, "c"), (False, 3, "d"), (False, 4, ""), (False, 5, "e"), (True, 0, "n")]
    assert sorted((tuple(r) for r in operator.drop_duplicates(docs.repartition(7)).collect()), key=repr) == kept
