import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st

from corpuscope.llm import byte_bpe as operator

RANKS = open(public_tokenizers.path(operator.RANK_FILE), "rb").read()
PLAIN = tiktoken.Encoding(
    "plain", pat_str=public_tokenizers.PATTERN, special_tokens={},
    mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())},
)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 9'\n\t  s.,!?éß日😀  \x1c"), max_size=200), st.integers(1, 9))
def test_cuts_do_not_change_the_ids(text, size):
    assert "".join(operator.safe_pieces(text, size)) == text
    assert operator.encode_text(PLAIN, text, size) == PLAIN.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1'\n\t   .\x1c\x1f\u3000\xa0\u200b\x85"), max_size=60), st.integers(2, 5))
def test_runs_of_white_space_do_not_change_the_ids(text, white):
    assert operator.encode_text(PLAIN, text, 7, white) == PLAIN.encode_ordinary(text)


def test_very_long_white_space(spark):
    texts = [" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", "x " + " \t" * 500_000, "\u3000" * 300_000 + "y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in operator.byte_bpe(docs).collect():
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest() and row.n_tokens == len(row.ids)
    for start, run, end in (("", " ", ""), ("a", "\n", "b"), ("x", " \t", " z"), ("", "\u3000", "y")):
        text = start + run * 20_000 + end
        assert operator.encode_text(PLAIN, text) == PLAIN.encode_ordinary(text)


def test_edges_match_the_library_and_round_trip(edge_docs, edge_rows, no_docs):
    found = sorted((tuple(r) for r in operator.byte_bpe(edge_docs).collect()), key=repr)
    want = []
    for row in edge_rows:
        ids = PLAIN.encode_ordinary(row[1] or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((row[0], len(ids), digest, hashlib.sha256((row[1] or "").encode()).hexdigest(), ids))
    assert found == sorted(want, key=repr)
    assert operator.byte_bpe(no_docs).count() == 0
