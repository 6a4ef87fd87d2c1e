import random

import numpy as np
import pytest

from corpuscope.llm import near_dedup as operator
from corpuscope.llm.components import connected_components


def shingles(text, words):
    split = (text or "").encode().lower().split()
    size = min(words, len(split))
    return {tuple(split[i : i + size]) for i in range(len(split) - size + 1)} if split else set()


def brute(rows, words, percent):
    """doc_id to (set size, smallest id reachable); ids without repeats."""
    sets = {i: shingles(t, words) for i, t in rows}
    home = {i: i for i in sets}

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                home[high] = low
    return {i: (len(sets[i]), root(i)) for i in ids}


def planted(seed, groups=12):
    """Bases and copies with changed words, a chain, many short texts with one common passage."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    found = []
    for _ in range(groups):
        base = text(rng.choice([4, 7, 9, 15, 40, 120, 400]))
        found.append(base)
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            found.append(copy)
    chain = text(150)
    for _ in range(12):
        chain = [*chain[4:], *text(4)]
        found.append(chain)
    passage = text(8)
    found += [[*passage, *text(rng.randint(2, 12))] for _ in range(60)]
    rng.shuffle(found)
    return [(i, " ".join(words)) for i, words in enumerate(found)]


@pytest.mark.parametrize("words, percent, block", [(3, 85, 256), (5, 80, 4)])
def test_matches_brute_force(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(operator, "BLOCK", block)  # small blocks: pairs of blocks are compared, too
    rows = planted(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in operator.near_duplicates(docs, words, percent).collect()}
    assert found == brute(rows, words, percent)


def test_edges(edge_docs):
    rows = [tuple(r) for r in operator.near_duplicates(edge_docs, 3, 85).collect()]
    found = {(r[0], r[1]): (r[2], r[3]) for r in rows if r[0] is not None}
    assert len(rows) == 17
    assert found[(0, 0)] == (0, True) and found[(1, 0)] == (1, True) and found[(2, 0)] == (2, True)
    assert found[(4, 2)] == (3, False) and found[(9, 1)] == (9, True) and found[(10, 1)] == (9, False)
    assert {k[0]: v for k, v in found.items()}[8] == (7, False)
    assert sorted(((r[1], r[2], r[3]) for r in rows if r[0] is None), key=repr) == [(0, None, True), (1, 9, False)]


def test_dropping_keeps_columns(edge_docs):
    kept = operator.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {7, 9, 0, 1, 2} <= set(ids) and not {8, 10, 13} & set(ids)


def test_empty_table(no_docs):
    assert operator.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("similarity", [0.85, 0.8])
def test_pairs_at_the_threshold_share_a_band(similarity):
    rng = np.random.default_rng(3)
    banding = operator.Banding(similarity)
    missed = tried = 0
    for size in [6, 7, 9, 12, 17, 23, 40, 77, 120, 180, 250, 400, 1500]:
        apart = int((1 - similarity) * size)  # elements that the larger set has more
        for _ in range(60):
            union = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            sets = [union, np.sort(rng.permutation(union)[: size - apart])]
            registers = np.stack([operator.registers_of(s) for s in sets])
            keys = [set(), set()]
            for rows, values, _, _ in banding.keys(registers, np.array([len(s) for s in sets])):
                for row, value in zip(rows, values):
                    keys[row].add(int(value))
            tried += 1
            missed += not keys[0] & keys[1]
    assert missed <= tried // 400


@pytest.mark.parametrize("similarity, sizes", [(0.8, [5, 6, 8, 10, 12]), (0.85, [7, 8, 10, 12, 14])])
def test_small_pairs_are_missed_at_most_once_in_thousands(similarity, sizes):
    """Bands of the elements by their first register; a pair is missed if no band holds common elements alone."""
    rng = np.random.default_rng(11)
    banding = operator.Banding(similarity)
    for size in sizes:
        apart = int((1 - similarity) * size + 1e-9)
        classes = [bands for _, bands, rows in banding.schemes(np.array([size - apart, size])) if len(rows) == 2]
        missed = np.ones(400_000, bool)
        registers = rng.integers(0, operator.REGISTERS, (len(missed), size))
        for bands in classes:
            starts = banding.starts(bands)
            band = np.searchsorted(starts, registers, side="right") - 1
            spoilt = (band[:, :, None] == band[:, None, :apart]).any(axis=2)
            missed &= spoilt.all(axis=1)
        assert apart and classes and missed.mean() <= 4e-5


def test_estimate_is_corrected_and_close():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**64, 30_000, dtype=np.uint64)
    errors = []
    for common in (0, 2000, 9000):
        a, b = np.unique(pool[:10_000]), np.unique(pool[10_000 - common : 20_000 - common])
        x, y = operator.registers_of(a), operator.registers_of(b)
        agree = ((x == y) & (x > 0)).sum()
        expected = operator.expected_collisions(np.array([len(a)]), np.array([len(b)]))[0]
        errors.append(abs((agree - expected) / 256 - common / (20_000 - common)))
    assert max(errors) < 0.1 and 0 < expected < 1


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (100, 101)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.vertex: r.component for r in found} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
