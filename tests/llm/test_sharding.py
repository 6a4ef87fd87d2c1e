import zlib

import pytest

from corpuscope.llm.common import read_table
from corpuscope.llm.sharding import shard_by_bytes


def brute(rows, shards):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode())))
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    total, before, slots, out = sum(sizes), 0, {}, []
    for (doc_id, text), size in zip(rows, sizes):
        shard = (2 * before + size) * shards // (2 * total)
        out.append((doc_id, size, zlib.crc32((text or "").encode()), "bytes", shard, slots.get(shard, 0), None))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return sorted(out, key=repr)


@pytest.mark.parametrize("shards, runs", [(8, None), (3, 1), (40, 5)])
def test_edges_match_brute_force(edge_docs, edge_rows, shards, runs):
    found = [tuple(r) for r in shard_by_bytes(edge_docs, shards, runs=runs).collect()]
    assert sorted(found, key=repr) == brute([r[:2] for r in edge_rows], shards)


def test_whole_table_is_contiguous_and_balanced(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    found = [tuple(r) for r in shard_by_bytes(docs).collect()]
    assert sorted(found, key=repr) == brute([(r.doc_id, r.text) for r in docs.collect()], 8)
    sizes = [sum(r[1] for r in found if r[4] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r[1] for r in found)


def test_empty_table(no_docs):
    assert shard_by_bytes(no_docs).count() == 0
