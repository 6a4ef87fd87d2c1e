"""Phrase collocations: Apriori-safe candidates from hashed counts, counted exactly by double-array tries."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from corpuscope.llm.common import UPPER, power_of_two, small_batches, whole_text
from corpuscope.session import materialise

MIN_COUNT = 30
MAX_WORDS = 4
INSIDE_PERCENT = 80  # a phrase goes when a longer one that holds it has this share of its occurrences
TOP = 2000
BUCKET_BYTES = 48  # bytes of text for one bucket of the hashed counts
BUCKETS = (1 << 12, 1 << 26)  # of one of the four bitmaps; the largest has 8 MB
TRIE_BYTES = 1 << 23  # phrase bytes from which on a task counts what it holds and begins a new trie; the result is the same
HELD_BYTES = 1 << 25  # bytes of words that a task holds for one trie
WIDE = 8  # children from which on a node gets 256 places of its own

# The contract's separators.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
WORD_ENDS = b"\x20\x09"
SPACE, END = 0x20, 0x0A

LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
KIND = np.zeros(256, np.uint8)
KIND[list(WORD_ENDS)] = 1
KIND[list(PIECE_ENDS)] = 2
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a batch of texts: bytes, starts, ends, number of the text, and whether the next is in the same piece."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join([*texts, b""]).translate(LOWER)
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self.kind = KIND[self.bytes]
        edges = np.flatnonzero(np.diff((self.kind == 0).view(np.int8), prepend=np.int8(0)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        piece = np.searchsorted(np.flatnonzero(self.kind == 2), self.starts)
        self.joined = np.r_[piece[1:] == piece[:-1], False][: len(piece)]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.starts, begins)))

    def hashes(self, seeds: np.ndarray) -> np.ndarray:
        """64 bits of each word, with the seed of its text. Long words are hashed one by one."""
        size = self.ends - self.starts
        out = np.zeros(len(size), np.uint64)
        order = np.argsort(-np.minimum(size, 65), kind="stable")
        order = order[np.count_nonzero(size > 64):]
        at, held, left = self.starts[order], np.zeros(len(order), np.uint64), size[order]
        for step in range(int(left[0]) if len(left) else 0):
            live = np.searchsorted(-left, -step)  # words of more than ``step`` bytes come first
            held[:live] = (held[:live] ^ self.bytes[at[:live] + step]) * MIX
            held[:live] ^= held[:live] >> np.uint64(29)
        out[order] = held
        for i in np.flatnonzero(size > 64):
            out[i] = xxhash.xxh3_64_intdigest(self.raw[self.starts[i] : self.ends[i]])
        return _mix(out, seeds[self.text])

    def phrases(self, words: np.ndarray, max_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, first words and hashes of the phrases of 1 to ``max_words`` words."""
        first, hashed, joined = np.arange(len(words)), words, self.joined
        for n in range(1, max_words + 1):
            yield n, first, hashed
            on = joined[first + n - 1] if len(first) else np.zeros(0, bool)
            first = first[on]
            hashed = _mix(hashed[on], words[first + n])

    def phrase(self, first: int, n: int) -> bytes:
        return b" ".join(self.raw[self.starts[i] : self.ends[i]] for i in range(first, first + n))

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        """The words, each followed by a space or, at the end of its piece, by a line feed; and where each begins."""
        keep = self.kind == 0
        keep[self.ends] = True
        packed = self.bytes[keep]
        size = self.ends - self.starts + 1
        ends = np.cumsum(size)
        packed[ends - 1] = np.where(self.joined, SPACE, END)
        return packed, ends - size


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * MIX) ^ (b + (a >> np.uint64(31)))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _seeds(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(lang) for lang in langs], np.uint64)


def _binary(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, count: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, count * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def _bucket(hashed: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def frequent_buckets(texts: DataFrame, buckets: int, min_count: int, max_words: int) -> list[np.ndarray]:
    """Per length, a bitmap of the buckets whose phrases together occur at least ``min_count`` times.

    Every partition counts hashed phrases in bytes that stop at ``min_count``: the sum over partitions reaches it
    just when the true sum does. A bitmap has ``buckets`` bits, whatever the size of the texts.
    """
    ceiling = np.int64(min_count)
    width = min(buckets, 1 << 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((max_words, buckets), np.uint8)
        for batch in batches:
            words = Words(_binary(batch.column(1)))
            for n, _, hashed in words.phrases(words.hashes(_seeds(batch.column(0).to_pylist())), max_words):
                bucket, times = np.unique(_bucket(hashed, buckets), return_counts=True)
                tables[n - 1, bucket] = np.minimum(tables[n - 1, bucket] + np.minimum(times, ceiling), ceiling)
        for n in range(max_words):
            for part in range(0, buckets, width):
                if tables[n, part : part + width].any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n], pa.int32()), pa.array([part], pa.int64()),
                         pa.array([_packed(tables[n, part : part + width])], pa.binary())],
                        names=["n", "part", "counts"],
                    )

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = reduce(
            lambda sums, blob: np.minimum(sums + _unpacked(blob, width, np.uint8), ceiling), rows.counts, np.zeros(width, np.int64)
        )
        return pd.DataFrame({"n": [key[0]], "part": [key[1]], "bits": [np.packbits(total >= ceiling).tobytes()]})

    sums = texts.mapInArrow(count, "n int, part long, counts binary").groupBy("n", "part").applyInPandas(
        add, "n int, part long, bits binary"
    )
    bitmaps = [np.zeros(buckets // 8, np.uint8) for _ in range(max_words)]
    for row in sums.collect():  # max_words bitmaps
        bitmaps[row.n][row.part // 8 : (row.part + width) // 8] = np.frombuffer(row.bits, np.uint8)
    return bitmaps


class Trie:
    """Double-array trie over bytes: the child of state s by byte c is base[s] + c, if check of that is s."""

    def __init__(self, langs: list[str], owners: np.ndarray, joined: bytes, bounds: np.ndarray):
        """Phrase i is ``joined[bounds[i] : bounds[i + 1]]``; ``owners`` numbers the languages of the phrases. Phrases
        are sorted by language, then by bytes."""
        joined = np.frombuffer(joined, np.uint8)
        size, begin = np.diff(bounds), bounds[:-1]
        node = owners.astype(np.int32)  # nodes 0.. are the roots of the languages
        parents, codes, ends = [], [], np.full(len(size), -1, np.int32)
        total = len(langs)
        live, depth = np.arange(len(size), dtype=np.int32), 0
        while len(live):
            done = size[live] == depth
            ends[live[done]] = node[live[done]]
            live = live[~done]
            if not len(live):
                break
            parent, code = node[live], joined[begin[live] + depth]
            new = np.r_[True, (parent[1:] != parent[:-1]) | (code[1:] != code[:-1])]
            node[live] = total + np.cumsum(new) - 1
            parents.append(parent[new])
            codes.append(code[new])
            total += int(new.sum())
            depth += 1
        self._place(
            len(langs), total, np.concatenate([np.zeros(0, np.int32), *parents]), np.concatenate([np.zeros(0, np.uint8), *codes])
        )
        self.leaf = np.full(len(self.check), -1, np.int32)
        self.leaf[self.slot[ends]] = np.arange(len(size), dtype=np.int32)
        self.roots = dict(zip(langs, range(len(langs))))
        del self.slot

    def _place(self, roots: int, total: int, parents: np.ndarray, codes: np.ndarray) -> None:
        """Finds a base for each inner node so that no two children share a slot: nodes of many children come first,
        each in a stretch of its own if they are many; the others of one number of children try places at random, all
        at once, and keep those without a clash."""
        order = np.argsort(parents, kind="stable").astype(np.int32)
        inner, first, degree = np.unique(parents[order], return_index=True, return_counts=True)
        wide = degree > WIDE
        base_of = np.zeros(total, np.int32)
        base_of[inner[wide]] = roots + 256 * np.arange(int(wide.sum()))
        start = roots + 256 * int(wide.sum())
        span = max(1024, 2 * int(degree[~wide].sum()))
        taken = np.zeros(start + span + 256, bool)
        rng = np.random.default_rng(7)
        claim = np.full(start + span + 256, -1, np.int32)
        for children in range(WIDE, 0, -1):  # while there is room, nodes of many children find a place soon
            left = np.flatnonzero(degree == children)
            while len(left):
                tried = start + rng.integers(0, span, len(left))
                slots = (tried[:, None] + codes[order[first[left][:, None] + np.arange(children)]]).ravel()
                owner = np.repeat(np.arange(len(left)), children)
                claim[slots] = owner
                clash = taken[slots] | (claim[slots] != owner)
                good = ~clash.reshape(len(left), children).any(axis=1)
                taken[slots[np.repeat(good, children)]] = True
                base_of[inner[left[good]]] = tried[good]
                left = left[~good]
        slot = np.empty(total, np.int32)
        slot[:roots] = np.arange(roots)
        slot[roots:] = base_of[parents] + codes  # nodes are numbered in the order of ``parents``
        self.slot = slot
        self.base = np.zeros(len(taken), np.int32)
        self.check = np.full(len(taken), -1, np.int32)
        self.base[slot] = base_of
        self.check[slot[roots:]] = slot[parents]

    @staticmethod
    def count(arrays: tuple, words: Words, roots: np.ndarray, counts: np.ndarray) -> None:
        """Adds the occurrences of all phrases: the states of all first words advance together, byte by byte."""
        base, check, leaf = arrays
        packed, at = words.compact()
        state = roots[words.text]
        known = state >= 0
        state, at = state[known], at[known]
        while len(state):
            code = packed[at]
            ended = (code == SPACE) | (code == END)
            found = leaf[state[ended]]
            counts += np.bincount(found[found >= 0], minlength=len(counts))
            following = base[state] + code
            on = (check[following] == state) & (code != END)
            state, at = following[on], at[on] + 1


class Held:
    """What counting needs of the words of a batch: the packed bytes, where words begin, and the number of their language."""

    def __init__(self, words: Words, langs: np.ndarray):
        packed, begins = words.compact()
        self.packed, self.begins, self.text = packed, begins.astype(np.int32), langs[words.text].astype(np.int32)

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        return self.packed, self.begins


class Tally:
    """Candidates of the texts of one task, counted in turns: each turn holds texts of about ``HELD_BYTES`` or with
    candidates of ``trie_bytes`` and counts them by one trie of these candidates. ``parts`` is into how many parts the
    hash space of the phrases is cut."""

    def __init__(self, parts: int, trie_bytes: int):
        self.parts, self.trie_bytes = parts, trie_bytes
        self.langs: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.seen, self.found, self.held = np.zeros(0, np.uint64), set(), []
        self.phrase_bytes = self.text_bytes = 0

    def add(self, langs: list[str], words: Words, candidates: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Takes in a batch; ``candidates`` gives length, first words and hashes of its candidates."""
        own = np.array([self.langs.setdefault(lang, len(self.langs)) for lang in langs], np.int32)
        fresh = []
        for n, first, hashed in candidates:
            known, where = np.unique(hashed, return_index=True)
            new = ~np.isin(known, self.seen, assume_unique=True)
            fresh.append(known[new])
            for i in first[where[new]].tolist():
                phrase = words.phrase(i, n)
                self.found.add((langs[words.text[i]], phrase))
                self.phrase_bytes += len(phrase)
        self.seen = np.concatenate([self.seen, *fresh])
        self.held.append(Held(words, own))
        self.text_bytes += len(self.held[-1].packed)

    def full(self) -> bool:
        return self.phrase_bytes >= self.trie_bytes or self.text_bytes >= HELD_BYTES

    def counted(self) -> Iterator[pa.RecordBatch]:
        """The candidates of this turn with their occurrences in its texts, packed by language and part."""
        found, held = sorted(self.found), self.held
        self._reset()
        if not found:
            return
        langs = sorted({lang for lang, _ in found})
        place = {lang: i for i, lang in enumerate(langs)}
        phrases = [phrase for _, phrase in found]
        owners = np.array([place[lang] for lang, _ in found], np.int32)
        del found
        roots = np.array([place.get(lang, -1) for lang in self.langs], np.int32)
        bounds = np.cumsum([0, *map(len, phrases)])
        counts = np.zeros(len(phrases), np.int64)
        # One trie, or several where the last batch has brought many candidates.
        cuts = np.unique(np.searchsorted(bounds, np.arange(0, bounds[-1], self.trie_bytes)))
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(phrases)]):
            trie = Trie(langs, owners[x:y], b"".join(phrases[x:y]), bounds[x : y + 1] - bounds[x])
            for words in held:
                Trie.count((trie.base, trie.check, trie.leaf), words, roots, counts[x:y])
            del trie
        del held
        # Phrases of one language and part of the hash space, sorted and packed: much is alike in neighbours.
        part = np.array([xxhash.xxh3_64_intdigest(phrase) % self.parts for phrase in phrases], np.int64)
        order = np.lexsort((part, owners))
        group = owners[order] * np.int64(self.parts) + part[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        rows = [order[x:y] for x, y in zip(first, [*first[1:], len(order)])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([langs[owners[r[0]]] for r in rows], pa.string()), pa.array([int(part[r[0]]) for r in rows], pa.int32()),
             pa.array([zlib.compress(b"\n".join([phrases[i] for i in r.tolist()])) for r in rows], pa.binary()),
             pa.array([zlib.compress(counts[r].astype("<i8").tobytes(), 1) for r in rows], pa.binary())],
            names=["lang", "part", "phrases", "counts"],
        )


def counted_candidates(texts: DataFrame, bitmaps: list[np.ndarray], buckets: int, min_count: int, trie_bytes: int) -> DataFrame:
    """lang, phrase, f of the phrases that occur at least ``min_count`` times.

    Candidates are the phrases all of whose contiguous parts, and which themselves, lie in frequent buckets: a phrase
    that occurs ``min_count`` times has only such parts, so none is lost. Every task counts the candidates of its own
    texts by tries of its own, so the texts are passed over once however many candidates there are; the counts of a
    phrase are then added up by language and part of the hash space.
    """
    parts = max(1, buckets // 100_000)
    shared = texts.sparkSession.sparkContext.broadcast(bitmaps)

    def candidates(words: Words, langs: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        maps = shared.value
        good = np.zeros(len(words.starts) + 1, bool)
        for n, first, hashed in words.phrases(words.hashes(_seeds(langs)), len(maps)):
            bucket = _bucket(hashed, buckets)
            fits = ((maps[n - 1][bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1).astype(bool)
            if n > 1:
                fits &= good[first] & good[first + 1]
            good[:] = False
            good[first[fits]] = True
            yield n, first[fits], hashed[fits]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(parts, trie_bytes)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            words = Words(_binary(batch.column(1)))
            tally.add(langs, words, candidates(words, langs))
            del words
            if tally.full():
                yield from tally.counted()
        yield from tally.counted()

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = Counter()
        for blob, counts in zip(rows.phrases, rows.counts):
            for phrase, f in zip(zlib.decompress(blob).split(b"\n"), np.frombuffer(zlib.decompress(counts), "<i8").tolist()):
                total[phrase] += f
        often = sorted(phrase for phrase, f in total.items() if f >= min_count)
        return pd.DataFrame({"lang": key[0], "phrase": often, "f": np.array([total[phrase] for phrase in often], np.int64)})

    counted = texts.mapInArrow(find, "lang string, part int, phrases binary, counts binary").groupBy("lang", "part").applyInPandas(
        add, "lang string, phrase binary, f long"
    ).select("lang", F.col("phrase").cast("string").alias("phrase"), "f")
    counted = materialise(counted, "frequent")
    shared.destroy()
    return counted


def frequent_phrases(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, trie_bytes: int = TRIE_BYTES,
    lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """lang, phrase, f of all phrases of 1 to ``max_words`` words that occur at least ``min_count`` times in a language.

    A-Z are lower-cased; texts fall into pieces, pieces into words; NULL languages are ``und``, NULL texts empty. Two
    passes, whatever the size of the texts: hashed counts; then the candidates that they leave, counted exactly by
    tries of about ``trie_bytes`` phrase bytes in each task and added up.
    """
    small_batches(docs.sparkSession, 4)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    # A multiple of the stretch that is added up in one group.
    buckets = min(max(-(-size // BUCKET_BYTES), BUCKETS[0]), BUCKETS[1])
    buckets = buckets if buckets < 1 << 16 and power_of_two(buckets) == buckets else -(-buckets // (1 << 16)) << 16
    bitmaps = frequent_buckets(texts, buckets, min_count, max_words)
    return counted_candidates(texts, bitmaps, buckets, min_count, trie_bytes)


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, inside_percent: int = INSIDE_PERCENT,
    top: int = TOP, trie_bytes: int = TRIE_BYTES, lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """The ``top`` phrases of 2 to ``max_words`` words per language: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts the phrase, ``l`` and ``r`` its parts at the cut with the lowest score floor(2000000 a / (l + r)), ties
    to the shortest first part; ``n`` is the number of words of the language. A phrase inside a longer one that has
    at least ``inside_percent`` of its occurrences goes. Sorted by score and a descending, then by phrase. NULL
    languages are ``und``, NULL texts have no words; ids are not read, so repeated rows count again; an empty table
    and languages without such phrases give no rows. Further columns are not read.
    """
    frequent = frequent_phrases(docs, min_count, max_words, trie_bytes, lang_col, text_col)
    words = F.split("phrase", " ")
    longer = frequent.withColumn("words", words).where(F.size("words") > 1)
    joined = lambda at, size: F.array_join(F.slice("words", at, size), " ")
    cut = longer.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.select(
        "lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"),
        joined(F.col("k") + 1, F.size("words")).alias("tail"),
    )
    part = lambda name, count: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cut = cut.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    # Every part of two words or more of a longer phrase, with the largest count of such phrases.
    places = F.expr(
        "filter(flatten(transform(sequence(2, greatest(size(words) - 1, 2)), n -> transform(sequence(1, size(words) - n + 1),"
        " p -> slice(words, p, n)))), x -> size(x) < size(words))"
    )
    held = longer.where(F.size("words") > 2).select("lang", "f", F.explode(places).alias("part")).groupBy(
        "lang", F.array_join("part", " ").alias("phrase")
    ).agg(F.max("f").alias("around"))
    kept = best.join(held, ["lang", "phrase"], "left").where(
        F.col("around").isNull()
        | (F.col("around").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * inside_percent)
    ).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    ordered = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)
    total = _word_totals(docs, lang_col, text_col)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _word_totals(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang and n, the number of its words: places where a word begins."""
    begins = F.regexp_count(whole_text(text_col), F.lit(r"[^\x20\x09.,;:!?\x0A-\x0D]+"))
    return docs.groupBy(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")).agg(
        F.sum(begins).cast("long").alias("n")
    )
