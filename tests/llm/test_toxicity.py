import itertools

import numpy as np

from corpuscope.llm import toxicity as operator
from corpuscope.llm.common import id_remainder, read_table


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    sizes = [1, 2, 3, 5, 6]
    first = np.cumsum([0, *sizes])[:-1]
    features = rng.normal(size=(sum(sizes), 3))
    field = operator.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
    marginals, pairs, log_norm = field.marginals(features, first)
    want, moves, total = np.zeros(sum(sizes)), np.zeros((2, 2)), 0.0
    for start, size in zip(first, sizes):
        weights = {}
        for labels in itertools.product((0, 1), repeat=size):
            score = sum(y * features[start + t] @ field.unary for t, y in enumerate(labels))
            weights[labels] = np.exp(score + sum(field.moves[a, b] for a, b in zip(labels, labels[1:])))
        norm = sum(weights.values())
        total += np.log(norm)
        for labels, weight in weights.items():
            want[start : start + size] += np.array(labels) * weight / norm
            for a, b in zip(labels, labels[1:]):
                moves[a, b] += weight / norm
    assert np.allclose(marginals, want) and np.allclose(pairs, moves) and np.isclose(log_norm, total)


def test_held_out_accuracy_and_spans(spark, sf_dir):
    held_out = id_remainder("doc_id", 5) == 0
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    rows = operator.toxicity(docs, labels, train=~held_out).where(held_out).join(labels, "doc_id").join(docs, "doc_id").collect()
    right = [r.predicted == r.toxic for r in rows]
    assert np.mean(right) > 0.9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    words = {r.text[s.start : s.end].lower() for r in rows if r.predicted for s in r.spans}
    assert words & {"idiot", "clown", "moron", "scum", "loser", "trash", "stupid", "worthless", "pathetic", "disgusting"}


def test_edges(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (None, 1), (5, None), (9, 0)], "doc_id long, toxic int")
    rows = operator.toxicity(edge_docs, labels).collect()
    assert len(rows) == 17 and all(r.score is not None for r in rows)
    kept = operator.drop_toxic(edge_docs, labels)
    assert kept.columns == edge_docs.columns and {tuple(r) for r in kept.collect()} <= set(edge_rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in operator.toxicity(edge_docs, none).collect()} == {0.0}
    assert operator.drop_toxic(edge_docs, none).count() == 17
    assert operator.toxicity(no_docs, labels).count() == 0


def _plain_marginals(field, features):
    """Passes over one whole sentence."""
    emit = np.column_stack([np.ones(len(features)), np.exp(features @ field.unary)])
    step = np.exp(field.moves)
    alpha, beta, log_norm = [emit[0] / emit[0].sum()], [np.ones(2)], np.log(emit[0].sum())
    for e in emit[1:]:
        value = (alpha[-1] @ step) * e
        log_norm += np.log(value.sum())
        alpha.append(value / value.sum())
    for e in emit[:0:-1]:
        value = step @ (e * beta[-1])
        beta.append(value / value.sum())
    alpha, beta = np.array(alpha), np.array(beta[::-1])
    pairs = np.zeros((2, 2))
    for t in range(1, len(emit)):
        joint = alpha[t - 1][:, None] * step * (emit[t] * beta[t])
        pairs += joint / joint.sum()
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1), pairs, log_norm


def test_long_sentences_are_as_whole():
    rng = np.random.default_rng(7)
    for stick in (0.0, 1.0, 3.0, 9.0):
        sizes = [3, 64, 65, 131, 1000, 1, 2777]
        first = np.cumsum([0, *sizes])[:-1]
        features = rng.normal(size=(sum(sizes), 3))
        field = operator.Field(rng.normal(size=3), np.array([[stick / 2, 0.1], [-0.3, stick / 2]]))
        marginals, pairs, log_norm = field.marginals(features, first)
        parts = [_plain_marginals(field, features[a : a + n]) for a, n in zip(first, sizes)]
        assert np.allclose(marginals, np.concatenate([p[0] for p in parts]), atol=1e-8, rtol=0)
        assert np.allclose(pairs, sum(p[1] for p in parts), atol=1e-5) and np.isclose(log_norm, sum(p[2] for p in parts))


def test_evidence_has_company_across_the_64th_token():
    """Weak words that count only side by side are found wherever they stand in an unpunctuated text."""
    words = {name: {b: 1.0 for b in operator._features_of(name)} for name in ("vile", "foul")}
    evidence = operator.Evidence({**words["vile"], **words["foul"]})
    field = operator.Field(np.array([-3.0, 1.0, 0.0, 0.0, 0.0, 2.0, 2.0]), np.array([[0.5, -0.5], [-0.5, 1.5]]))
    model = operator.Model(evidence, field, np.zeros(4))
    shown = []
    for at in (20, 63, 64, 127, 150):
        text = " ".join(["xx"] * at + ["vile", "foul"] + ["xx"] * 100)
        (features, spans), = model.tag([text])
        shown.append((round(features[0], 9), [(text[a:b], round(p, 9)) for a, b, p in spans]))
    assert shown[0][1] and all(s == shown[0] for s in shown)


def test_pieces_are_cut_away_from_evidence():
    some = np.zeros(400, bool)
    some[[63, 64, 66, 140]] = True
    first = np.array([0, 200])
    pieces = operator._pieces(first, 400, some)
    assert set(first) <= set(pieces) and len(pieces) > 4 and not (some[pieces[1:]] | some[pieces[1:] - 1]).any()
    assert min(b - a for a, b in zip(pieces[:2], pieces[1:3])) >= operator.WINDOW_TOKENS
    assert operator._pieces(first, 400, np.ones(400, bool)).tolist() == [0, 200]
