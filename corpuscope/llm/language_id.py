"""Language identification by mixtures: proportions from n-gram likelihoods, the set by penalised likelihood."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpuscope.llm.common import small_batches, whole_text

BUCKETS = 1 << 15  # hashed letter trigrams; with the number of languages this fixes the size of the model
SMOOTHING = 0.5
ROUNDS = 8
PENALTY = 4.0  # log likelihood, times half the log of the number of n-grams, that a further language must gain
GROUP_CHARS = 1 << 16  # characters counted in one go

LETTER = re.compile(r"[^\W\d_]")


def _letters(text: str) -> np.ndarray:
    """Lower-case code points; what is neither a letter of ASCII nor beyond it becomes a space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    return np.where(((codes >= 97) & (codes <= 122)) | (codes >= 0xAA), codes, np.uint32(32))


def _trigrams(codes: np.ndarray) -> np.ndarray:
    """Buckets of the letter trigrams of " text "; those of spaces alone are left out."""
    padded = np.r_[np.uint32(32), codes, np.uint32(32)].astype(np.uint64)
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    mixed = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + c * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - 15)).astype(np.int64)[(b != 32) | ((a != 32) & (c != 32))]


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= GROUP_CHARS or i - start >= 31:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _count(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of the texts' trigrams, by document."""
    keys = [(_trigrams(_letters(text)) + i * BUCKETS) for i, text in enumerate(texts)]
    counts = np.bincount(np.concatenate(keys), minlength=len(texts) * BUCKETS)
    at = np.flatnonzero(counts)
    return at // BUCKETS, at % BUCKETS, counts[at].astype(np.float64)


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # buckets x languages

    def mixtures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of the languages (texts x languages) under all of them, and under the selected set.

        Expectation-maximisation runs over all texts at once. Then, from the least language on, a language leaves the
        set of a text when the likelihood falls by less than the penalty of one more parameter.
        """
        n, k = len(texts), len(self.languages)
        doc, bucket, count = _count(texts)
        p = np.exp(self.log_p)[bucket]
        sizes = np.bincount(doc, count, minlength=n)
        whole, likelihood = self._fit(doc, p, count, sizes, np.ones((n, k), bool))
        chosen, part = np.ones((n, k), bool), whole.copy()
        going = sizes > 0
        while True:
            going &= chosen.sum(axis=1) > 1
            if not going.any():
                return whole, part
            least = np.where(chosen, part, np.inf).argmin(axis=1)
            trial = chosen.copy()
            trial[np.flatnonzero(going), least[going]] = False
            rows = going[doc]
            index = np.cumsum(going) - 1
            fitted, reached = self._fit(index[doc[rows]], p[rows], count[rows], sizes[going], trial[going])
            accepted = 2 * (likelihood[going] - reached) < PENALTY * np.log(np.maximum(sizes[going], 2.0))
            at = np.flatnonzero(going)[accepted]
            chosen[at], part[at], likelihood[at] = trial[at], fitted[accepted], reached[accepted]
            going[np.flatnonzero(going)[~accepted]] = False

    @staticmethod
    def _fit(doc, p, count, sizes, allowed) -> tuple[np.ndarray, np.ndarray]:
        n, k = allowed.shape
        share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
        if not len(doc):
            return share, np.zeros(n)
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        present = doc[first]
        for _ in range(ROUNDS if k > 1 else 1):
            weighed = p * share[doc]
            weighed *= (count / weighed.sum(axis=1))[:, None]
            share[present] = np.add.reduceat(weighed, first) / sizes[present, None]
        likelihood = np.zeros(n)
        likelihood[present] = np.add.reduceat(count * np.log((p * share[doc]).sum(axis=1)), first)
        return share, likelihood


def _language_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all texts with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total += np.bincount(_trigrams(_letters(text.as_py())), minlength=BUCKETS)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])],
                names=["lang", "bucket", "n"],
            )

    return docs.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")
    )


def fit_languages(docs: DataFrame, train: Column | None = None) -> Model | None:
    """A model of all documents (doc_id, text, lang) with a language and a letter; None if there are none.

    ``train`` is a condition on the ids that may be learned from. Counts are added up in tasks and by Spark; the
    driver gets one number per language and bucket.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (F.lit(True) if train is None else train))
    rows = _language_counts(known).toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    if not languages:
        return None
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    place = np.array([languages.index(x) for x in rows.column("lang").to_pylist()])
    counts[rows.column("bucket").to_numpy(), place] += rows.column("n").to_numpy()
    return Model(languages, np.log(counts / counts.sum(axis=0)))


def identify_languages(
    docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, languages (array of structs lang, share; largest share first).

    ``languages`` is the set that the penalised likelihood selects, ``lang_pred`` its largest member (ties: the first
    by name), ``score`` this one's proportion in the mixture of all languages. Texts that are NULL or have no letter,
    and all texts if nothing could be learned, get ``und``, 0 and no languages. Ids may be NULL or repeat; NULL
    languages are not learned from; further columns are not read; an empty table gives no rows.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    model = fit_languages(slim, train)
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.languages, model.log_p))

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value and Model(*shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores, sets = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            lettered = [i for i, text in enumerate(texts) if LETTER.search(text)] if own else []
            for start, end in _groups([texts[i] for i in lettered]):
                rows = lettered[start:end]
                whole, part = own.mixtures([texts[i] for i in rows])
                for i, all_shares, shares in zip(rows, whole, part):
                    best = int(shares.argmax())
                    names[i], scores[i] = own.languages[best], float(min(1.0, all_shares[best]))
                    sets[i] = [
                        {"lang": own.languages[j], "share": float(shares[j])} for j in np.argsort(-shares, kind="stable") if shares[j] > 0
                    ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names), pa.array(scores, pa.float64()),
                 pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                names=["doc_id", "lang_pred", "score", "languages"],
            )

    id_type = slim.schema["doc_id"].dataType.simpleString()
    return slim.select("doc_id", "text").mapInArrow(
        identify, f"doc_id {id_type}, lang_pred string, score double, languages array<struct<lang: string, share: double>>"
    )
