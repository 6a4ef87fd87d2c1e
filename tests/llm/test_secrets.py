import math
import random
import re
import time

from corpuscope.llm import secrets as operator

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def entropy(text):
    return -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text)) if text else 0.0


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    base = list(spans)
    for m in re.finditer(operator.CANDIDATE, text):
        hit = m[0]
        if any(s < m.end() and m.start() < e for s, _, e in base) or any(re.search(p, hit) for p in operator.ALLOWED):
            continue
        best = max(entropy(hit[i : i + 20]) for i in range(len(hit) - 19))
        bar = operator.CLASSES["hex" if re.fullmatch("[0-9a-fA-F]+", hit) else "base64"][1]
        if best >= bar - 1e-12:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def texts():
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    some = lambda n, of=letters: "".join(rng.choice(of) for _ in range(n))
    found = [
        None, "", "no secret here", "password=short", "secret: token = abcdefgh12", "TOKEN = \"abc.def-ghi_\"", "apikey:'x1234567'",
        "AKIA" + some(16, "ABCDEFGH0123"), "AKIAAKIA" + "Z9" * 5, "AKIA12", "é日本😀 api_key = " + some(20) + " 😀 " + some(40),
        some(31, "0123456789abcdef"), some(32, "0123456789abcdef"), some(64, "0123456789abcdef"), some(24, "0123456789ABCDEF"),
        "123e4567-e89b-12d3-a456-426614174000", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "12345678901234567890123456",
        "Donaudampfschifffahrtsgesellschaft", "https/some/path/to-a-file/in_a_folder", "ſecret=abcdefghij", "passwd==========",
    ]
    found += [" ".join([some(rng.randint(5, 45)), "the", some(rng.randint(15, 30)), "secret=" + some(9)]) for _ in range(150)]
    found.append(" ".join(some(25) for _ in range(200)))
    found += [some(30_000), "ab-" * 20_000, "x/" * 30_000 + "Y9"]
    return found


def test_matches_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.kind, s.end) for s in r.secrets] for r in operator.find_secrets(docs).collect()}
    assert found == {i: brute(t) for i, t in rows}
    assert sum(k == 3 for spans in found.values() for _, k, _ in spans) > 100


def test_many_spans_take_time_in_proportion(spark):
    """2 MB of digests, and of candidates between assignments, which was quadratic; offsets across many blocks."""
    rng = random.Random(4)
    some = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    hashes = "\n".join(some(32, "0123456789abcdef") for _ in range(60_000))
    mixed = " é ".join(f"token={some(9, 'abcxyz')} {some(24, 'ABCDefgh0189+/Zz')}" for _ in range(20_000))
    rows = [(0, hashes), (1, mixed), (2, 'secret: "' + ".".join(some(25, "ABCDefgh0189+/Zz") for _ in range(300)) + '" ' + mixed[:20_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    started = time.monotonic()
    found = {r.doc_id: [(s.start, s.kind, s.end) for s in r.secrets] for r in operator.find_secrets(docs).collect()}
    assert time.monotonic() - started < 60
    assert len(found[0]) == 60_000 and found[0] == [(33 * i, 2, 33 * i + 32) for i in range(60_000)]
    assert found[2] == brute(rows[2][1])
    small = " é ".join(mixed.split(" é ")[:700])
    again = operator.find_secrets(spark.createDataFrame([(1, small)], "doc_id long, text string")).head().secrets
    want = brute(small)
    assert [(s.start, s.kind, s.end) for s in again] == want
    assert found[1][: len(want)] == want and sum(k == 0 for _, k, _ in found[1]) == 20_000


def test_no_python_in_the_plan(spark, edge_docs):
    plan = operator.find_secrets(edge_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edges(edge_docs, no_docs):
    found = operator.find_secrets(edge_docs).collect()
    assert len(found) == 17 and sum(len(r.secrets) for r in found) == 1
    assert operator.find_secrets(no_docs).count() == 0
