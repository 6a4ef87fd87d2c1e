import re
import time

import numpy as np

from corpuscope.llm import pii as operator
from corpuscope.llm.boosting import fit_boosted
from corpuscope.llm.common import read_table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checksum(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        n = int(c) * (1 + i % 2)
        total += n // 10 + n % 10
    return total % 10 == 0


def brute(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split(".")) or kind == "phone" and 8 <= len(digits) <= 15 or (
                    kind == "card" and 16 <= len(digits) <= 19 and checksum(digits)):
                found.append((operator.KINDS.index(kind), m.start(), m.end()))
    return found


TEXTS = [
    None, "", "mail a.b+c@d-e.org. or x@y", "é😀 1.2.3.4 and 1.2.3.256 and 1.2.3.4.5 01.002.3.4", "4111 1111-1111 1111", "4111111111111112",
    "+1 (523) 555-1055 +12 +1234567 +123456789012345 +1234567890123456", "call 4111111111111111 now +49 30 1234567.",
    "a@b.c@d.e", "@a.b", "x@@y.z", "a.b@c.d.e@f.g h@i", "é@a.b-c.d!", "1" * 50_000 + ".2.3.4", "a" * 50_000 + " b@c.d", "0" * 5000 + "1.2.3.4", "999999999999999999999999.1.1.1", "1-2 3", "+1 (1) 2 4111 1111 1111 1111",
]


def test_base_spans_match_brute_force(spark):
    for text in TEXTS:
        assert operator.base_spans(text or "") == brute(text)
    found = operator.find_personal_data(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()
    for row in found:
        assert [tuple(s) for s in row.base] == brute(TEXTS[row.doc_id]) and set(row.base) <= set(row.spans)


def test_adds_what_only_the_checksum_refuses(spark, sf_dir):
    rows = operator.find_personal_data(read_table(spark, sf_dir, "documents")).collect()
    assert all(set(r.base) <= set(r.spans) and list(r.spans) == sorted(r.spans) for r in rows)
    for row in rows:
        ends = sorted((s.start, s.end) for s in set(row.spans) - set(row.base))
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.4)).astype(float)
    model = fit_boosted(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert fit_boosted(np.empty((0, 5)), np.empty(0)).probability(x[:3]).tolist() == [0.5] * 3


def test_edges(edge_docs, no_docs):
    assert operator.find_personal_data(edge_docs).count() == 17
    assert operator.find_personal_data(no_docs).count() == 0


def _corpus(phones):
    """1,200 documents with emails and plain numbers, ``phones`` of them with a phone, and one with a phone in slashes."""
    rng = np.random.default_rng(4)
    number = lambda n: "".join(map(str, rng.integers(1, 10, n)))
    texts = [f"note {i} by user{i}@host{i % 7}.org with order {number(11)} and {number(12)}" for i in range(1200)]
    for i in range(phones):
        mark = " -"[i % 2]
        texts[37 * i + 5] = f"note {i} call +{number(2)}{mark}{number(2)}{mark}{number(7)} today"
    return [*enumerate(texts), (5000, "note call +49/30/7654321 today")]


def test_adds_spans_of_a_kind_too_rare_to_calibrate(spark):
    docs = spark.createDataFrame(_corpus(phones=16), "doc_id long, text string").repartition(4)
    added = {r.doc_id: set(r.spans) - set(r.base) for r in operator.find_personal_data(docs).collect()}
    assert {tuple(s) for s in added.pop(5000)} == {(3, 10, 24)} and not any(added.values())


def test_learns_rare_kinds_from_all_rows(spark, monkeypatch):
    """A sample of a twentieth of the documents would have one or two of the 30 phones."""
    monkeypatch.setattr(operator, "SAMPLE_DOCUMENTS", 60)
    docs = spark.createDataFrame(_corpus(phones=30), "doc_id long, text string").repartition(4)
    added = {r.doc_id: set(r.spans) - set(r.base) for r in operator.find_personal_data(docs).collect()}
    assert {tuple(s) for s in added.pop(5000)} == {(3, 10, 24)} and not any(added.values())


def test_learns_from_every_document(spark, monkeypatch):
    """Whatever once bounded the documents and candidates that are learned from must not matter."""
    for name in ("SAMPLE_DOCUMENTS", "KIND_DOCUMENTS", "SAMPLE_CANDIDATES"):
        monkeypatch.setattr(operator, name, 4, raising=False)
    docs = spark.createDataFrame(_corpus(phones=30), "doc_id long, text string").repartition(4)
    added = {r.doc_id: set(r.spans) - set(r.base) for r in operator.find_personal_data(docs).collect()}
    assert {tuple(s) for s in added.pop(5000)} == {(3, 10, 24)} and not any(added.values())


def _cuts(column, bins=32):
    """Of one kind's values: all if they are few, else those that hold one of the points 1/32, 2/32 and so on, and the ends."""
    values, n = np.unique(column, return_counts=True)
    upto = n.cumsum()
    holds = upto * bins // len(column) > (upto - n) * bins // len(column)
    return set(values[holds | (len(values) <= bins) | (upto == n)].tolist())


def test_fit_equals_that_of_all_candidates_in_arrays(spark, monkeypatch):
    from corpuscope.llm import boosting

    monkeypatch.setattr(boosting, "ROWS", 60)  # several tasks add up their sums
    rows = [(i, t + f" at {i * 7919 % 100_003}.{i % 251}.7.1" * (i % 3 == 0)) for i, t in _corpus(phones=30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    fitted = operator.fit_redactor(docs)

    x, y, kinds, held_out = [], [], [], []
    for text, part in docs.selectExpr("text", "(xxhash64(text, 11) >> 32) & 1").collect():
        base = brute(text)
        for kind, start, end in operator.candidates(text):
            x.append(operator.features(text, kind, start, end))
            y.append(int(any(k == kind and start - 1 <= s and e <= end + 1 and e - s >= 0.8 * (end - start) for k, s, e in base)))
            kinds.append(kind)
            held_out.append(part == 1)
    x, y, kinds, held_out = np.array(x, float), np.array(y), np.array(kinds), np.array(held_out)
    train, of = x[~held_out], kinds[~held_out]
    cuts = [np.array(sorted(set().union(*(_cuts(column[of == k]) for k in set(of.tolist()))))) for column in train.T]
    assert max(map(len, cuts)) > boosting.BINS
    binned = np.column_stack([np.searchsorted(cut, column) for cut, column in zip(cuts, train.T)])
    size, once = 1 + max(map(len, cuts)), np.ones(len(train))
    whole = lambda *model: boosting.leaf_sums(*model, binned, y[~held_out], once, size)
    trees, _ = boosting.boost(cuts, len(train), int(y[~held_out].sum()), whole)
    # Equal candidates were summed as one row, so a sum may differ in its last places.
    assert [(t.feature, t.bound) for t in fitted.trees.trees[:3]] == [(t.feature, t.bound) for t in trees.trees[:3]]
    assert np.allclose(fitted.trees.probability(x), trees.probability(x), atol=1e-3)
    odds = np.floor(fitted.trees.probability(x[held_out]) * operator.STEPS) / operator.STEPS
    rest = y[held_out], np.ones(held_out.sum()), kinds[held_out]
    assert fitted.thresholds == [operator._threshold(odds, *rest, k, operator.PRECISION) for k in range(4)]


def test_candidates_on_one_side_alone(spark):
    """One text is trained on or held out, never both: neither trees nor thresholds may need the other side."""
    for text in ("call +49 30 1234567", "call +49 30 1234568", "call +49 30 1234569", "mail a@b.org", "host 1.2.3.4"):
        docs = spark.createDataFrame([(1, text)] * 3, "doc_id long, text string")
        assert operator.fit_redactor(docs).trees.trees == []


def test_threshold_of_a_kind_judged_by_its_own_rows_or_all():
    odds, kinds = np.r_[np.full(40, 0.9), np.full(40, 0.6), np.full(5, 0.9)], np.r_[np.zeros(80, int), np.ones(5, int)]
    labels = np.r_[np.ones(40), np.zeros(40), np.ones(5)]
    ones = np.ones(85)
    assert [operator._threshold(odds, labels, ones, kinds, k, 0.95) for k in (0, 1, 2)] == [0.9, 0.9, 0.9]
    # Refused rows of its own count against all kinds' precision; so does the weight of rows drawn at a smaller share.
    assert operator._threshold(odds, np.r_[labels[:80], 0, 0, 0, 0, 0], ones, kinds, 1, 0.95) == 2.0
    assert operator._threshold(odds, np.r_[labels[:84], 0], np.r_[ones[:84], 50], kinds, 1, 0.95) == 2.0


def test_many_spans_take_time_in_proportion():
    rng = np.random.default_rng(3)
    text = "\n".join(f"{a}.{b}.{c}.{d} user{a}@host{b}.org" for a, b, c, d in rng.integers(0, 256, (60_000, 4)).tolist())
    trees = fit_boosted(np.zeros((4, len(operator.features("1", 1, 0, 1)))), np.array([0, 1, 0, 1]))
    redactor = operator.Redactor(trees, [0.4] * 4)
    started = time.monotonic()
    spans = redactor.spans(text)
    assert time.monotonic() - started < 60
    assert len(spans) >= 120_000
    ordered = sorted((s, e) for k, s, e in spans if k < 2)
    assert all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:]))


def test_overlaps_by_search_equal_those_by_scan():
    rng = np.random.default_rng(5)
    for _ in range(300):
        spans = [(int(k), int(s), int(s + n)) for k, s, n in zip(rng.integers(0, 4, 8), rng.integers(0, 60, 8), rng.integers(1, 9, 8))]
        covered = operator.Covered(spans)
        for s, n in zip(rng.integers(0, 70, 30).tolist(), rng.integers(1, 9, 30).tolist()):
            hit = any(a < s + n and s < b for _, a, b in spans)
            assert covered.overlaps(s, s + n) == hit
            if not hit:
                covered.add(s, s + n)
                spans.append((0, s, s + n))
        base = sorted((s, e) for k, s, e in operator.base_spans("12.3.4.5 x 1.2.3.4, 9.9.9.9 8.8.8.8") if k == 1)
        start, end = sorted(rng.integers(0, 36, 2).tolist())
        assert operator.covers_base(base, start, end) == any(
            start - 1 <= s and e <= end + 1 and e - s >= 0.8 * (end - start) for s, e in base)
