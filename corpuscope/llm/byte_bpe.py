"""Byte-level BPE encoding and decoding with the tiktoken library."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.common import small_batches

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
PIECE_CHARS = 1 << 16

# White space right behind a letter, digit or mark of ASCII, and before none or a letter, always begins a match of its
# own: no alternative of the pattern has white space but at its start.
SAFE_CUT = re.compile(r"(?<=[A-Za-z0-9.,;:!?])(?=[ \n\t])")
# White space as the pattern's \s has it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE_CHARS = 1 << 12


def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """An encoder, built once per task: a cached function would need this package on the executors."""
    table = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, ranks.splitlines()) if piece}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_pieces(text: str, piece_chars: int = PIECE_CHARS) -> Iterator[str]:
    """Cuts a text of more than ``piece_chars`` characters where a pattern match begins in any case.

    A text without such a place stays whole.
    """
    start = 0
    while len(text) - start > piece_chars:
        cut = SAFE_CUT.search(text, start + piece_chars)
        if cut is None or cut.start() >= len(text):
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(
    encoding: tiktoken.Encoding, text: str, piece_chars: int = PIECE_CHARS, white_chars: int = WHITE_CHARS
) -> list[int]:
    """Token ids of a text.

    Runs of ``white_chars`` (at least 2) or more white space characters, on which the library's search would overflow
    its stack, are taken by the pattern's own rule: one match is the run, without its last character where a further
    one follows.
    """
    ids: list[int] = []
    start = 0
    for run in re.finditer(f"[{WHITE}]{{{white_chars},}}", text):
        end = run.end() - (run.end() < len(text))
        for piece in safe_pieces(text[start : run.start()], piece_chars):
            ids += encoding.encode_ordinary(piece)
        ids += encoding._encode_single_piece(text[run.start() : end])
        start = end
    for piece in safe_pieces(text[start:], piece_chars):
        ids += encoding.encode_ordinary(piece)
    return ids


def byte_bpe(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None,
    pattern: str = public_tokenizers.PATTERN, with_ids: bool = True,
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, ``with_ids``, ids (array of int).

    The driver reads the rank file (its size is that of the vocabulary) and sends its bytes to the executors, which
    need no copy of their own. Texts longer than ``PIECE_CHARS`` are cut at safe boundaries, which leaves the ids as
    they are. The ids are decoded to raw bytes, not text. NULL and empty texts have no tokens; ids may be NULL or
    repeat, each row is encoded by itself; an empty table gives no rows; further columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark, 4)
    with open(rank_path or public_tokenizers.path(RANK_FILE), "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks.value, pattern)
        for batch in batches:
            lengths, digests, decoded, all_ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode_text(encoding, text or "")
                packed = np.asarray(ids, dtype="<u4")
                lengths.append(len(ids))
                digests.append(hashlib.sha256(packed.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(encoding.decode_bytes(ids)).hexdigest())
                if with_ids:
                    all_ids.append(packed.view("<i4"))
            columns = [
                batch.column(0), pa.array(lengths, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        encode, schema + (", ids array<int>" if with_ids else "")
    )
