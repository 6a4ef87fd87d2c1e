"""Near-duplicate groups by HyperMinHash sketches, banding and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.common import free_names, small_batches, whole_text
from corpuscope.llm.components import connected_components
from corpuscope.session import materialise

INDEX_BITS, MANTISSA_BITS = 8, 10
REGISTERS = 1 << INDEX_BITS
LOW_BITS = 64 - INDEX_BITS
BAND_ROWS = 6
MAX_BANDS = REGISTERS // BAND_ROWS
MISSED = 1.6e-5  # bound on the share of pairs at the threshold that all bands of a smaller class miss
SIGMAS = 4.0  # how far an estimate may lie below the threshold, in standard errors, and still be verified
BLOCK = 256  # sketches on either side of one comparison

_weights = np.random.default_rng(20240607).integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit counter generator: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Word shingles of texts as sorted distinct 64-bit hashes."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def of(self, text: str | None) -> tuple[np.ndarray, bytes]:
        """The shingle hashes, and a digest of the word sequence. A text of fewer words is one shingle."""
        # On bytes, lower and split know A to Z and the ASCII white space alone.
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64), b""
        known = self.known
        if len(known) > 500_000:  # only a cache
            known.clear()
        hashes = []
        for word in words:
            value = known.get(word)
            if value is None:
                value = known[word] = xxhash.xxh3_64_intdigest(word)
            hashes.append(value)
        array = np.array(hashes, np.uint64)
        size = min(self.words, len(words))
        total = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            total = _mix(total + array[k : len(array) - size + 1 + k])
        return np.unique(total), xxhash.xxh3_128_digest(b" ".join(words))


def registers_of(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sorted hashes: leading zeros and mantissa of each bucket's least value; 0 is empty."""
    registers = np.zeros(REGISTERS, np.uint16)
    if len(hashes):
        buckets = (hashes >> np.uint64(LOW_BITS)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        low = (hashes[first] & np.uint64((1 << LOW_BITS) - 1)).astype(np.float64)
        mantissa, exponent = np.frexp(np.maximum(low, 1.0))
        tail = ((mantissa - 0.5) * (2 << MANTISSA_BITS)).astype(np.int64)
        registers[buckets[first]] = ((LOW_BITS + 1 - exponent) << MANTISSA_BITS) + tail + 1
    return registers


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers in which disjoint sets of n and m elements agree by chance."""
    levels = np.arange(1, LOW_BITS + 1)
    upper, lower = 2.0 ** -(levels - 1.0) / REGISTERS, 2.0 ** -(levels + 0.0) / REGISTERS

    def least_at(size: np.ndarray) -> np.ndarray:
        size = np.asarray(size, float)[:, None]
        return np.exp(size * np.log1p(-lower)) - np.exp(size * np.log1p(-upper))

    return REGISTERS * 2.0**-MANTISSA_BITS * (least_at(n) * least_at(m)).sum(axis=1)


def may_link(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the pairs' sizes allow the similarity and their sketches do not speak against it.

    A pair that reaches it has c >= s (n + m) / (1 + s) common elements in a union of n + m - c. The filled registers
    show one element each. First, even if all that stay hidden were common, enough registers must agree; for small
    sets, which the sketch shows almost whole, this is sharp. Second, the filled registers are a sample without
    replacement: the share that agrees, less the collisions to be expected, may fall ``SIGMAS`` standard errors short.
    """
    n, m = np.broadcast_arrays(n, m)
    filled = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    agree = ((a == b) & (a > 0)).sum(axis=1)
    common = similarity * (n + m) / (1 + similarity)
    union = n + m - common
    hidden = np.clip((union - filled) / np.maximum(union - 1, 1), 0, 1)
    least = filled * similarity - SIGMAS * np.sqrt(similarity * (1 - similarity) * hidden * filled) - 1
    passed = (
        (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9)
        & (agree >= 2 * common - (n + m) + filled - 1e-9) & (agree >= least)
    )
    left = np.flatnonzero(passed)
    if len(left):  # the correction can only lower the estimate
        passed[left] = agree[left] - expected_collisions(n[left], m[left]) >= least[left]
    return passed


class Banding:
    """Bands of the registers, whose number follows the size of the set.

    Two sets of similarity s differ in at most (1 - s) / s of the smaller one's elements. A small set gets a quarter
    more bands than that plus two, so some band is free of differences; each band then holds several elements, and a
    passage that many short texts share rarely fills one. A pair of c common and d other elements is missed if all common
    ones fall into the bands of the others, with (d / bands)^c at most; classes get enough bands for ``MISSED``. From ``MAX_BANDS`` bands on, bands have ``BAND_ROWS``
    registers and the usual banding bound holds: a pair at the threshold is missed with (1 - s^6)^42.
    Sizes form classes a factor 1/s^2 wide. Sets in the upper half of a class join the next class as well.
    """

    def __init__(self, similarity: float):
        self.share = (1 - similarity) / similarity
        self.similarity = similarity
        self.edges = [1.0]
        while self.bands(self.edges[-1]) < MAX_BANDS:
            self.edges.append(self.edges[-1] / similarity**2)

    def bands(self, size: float) -> int:
        """Bands of the class that ends at the size."""
        least = math.ceil(1.25 * math.floor(self.share * size + 1e-9)) + 2
        # Both sets of a pair are larger than size * s^3, so their common elements are more than size * s^4.
        for common in range(max(1, math.floor(size * self.similarity**4)), math.ceil(size)):
            apart = math.floor(self.share * common + 1e-9)
            while least < MAX_BANDS and apart and self.missed(least, common, apart) > MISSED:
                least += 1
        return min(MAX_BANDS, least)

    @staticmethod
    def missed(bands: int, common: int, apart: int) -> float:
        """Bound on the probability that all common elements fall into the bands of the others."""
        return min(1.0, apart * math.ceil(REGISTERS / bands) / REGISTERS) ** common

    def schemes(self, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(class, bands, rows of the class); the last class has no upper end."""
        for k, low in enumerate(self.edges):
            last = k == len(self.edges) - 1
            high = math.inf if last else self.edges[k + 1]
            rows = np.flatnonzero((sizes >= low * self.similarity - 1e-9) & (sizes < high))
            if len(rows):
                yield k, MAX_BANDS if last else self.bands(high), rows

    @staticmethod
    def starts(bands: int) -> np.ndarray:
        """The first register of each band."""
        return np.arange(bands) * REGISTERS // bands

    def keys(self, registers: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        """(rows, keys, bands of the class, band): the band keys of sketches; bands without any element have none."""
        for k, bands, rows in self.schemes(sizes):
            starts = self.starts(bands)
            chosen = registers[rows].astype(np.uint64)
            filled = np.add.reduceat(chosen > 0, starts, axis=1) > 0
            sums = np.add.reduceat(chosen * _weights, starts, axis=1)
            keys = _mix(sums + _mix(np.arange(bands, dtype=np.uint64) + np.uint64(k << 16)))
            where = np.nonzero(filled)
            yield rows[where[0]], keys[where], bands, where[1]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, sequence (digest of the words), registers."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sizes, digests, registers = [], [], []
            for text in batch.column(1):
                hashes, digest = shingler.of(text.as_py())
                sizes.append(len(hashes))
                digests.append(digest)
                registers.append(registers_of(hashes).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(registers, pa.binary())],
                names=["doc_id", "n_shingles", "sequence", "registers"],
            )

    return docs.mapInArrow(
        sketch, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, sequence binary, registers binary"
    )


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, shingles: the full sets as packed sorted hashes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            packed = [shingler.of(text.as_py())[0].tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "shingles"])

    return docs.mapInArrow(pack, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, shingles binary")


def _band_members(texts: DataFrame, similarity: float) -> DataFrame:
    """key, place (bands of the class and number of the band), doc_id: a row per band with an element."""
    banding = Banding(similarity)

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes = batch.column(1).to_numpy(zero_copy_only=False)
                for rows, keys, bands, band in banding.keys(_matrix(batch.column(2)), sizes):
                    place = pa.array((bands * MAX_BANDS + band).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), place, batch.column(0).take(pa.array(rows))],
                        names=["key", "place", "doc_id"],
                    )

    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "n_shingles", "registers").mapInArrow(band, f"key long, place int, doc_id {id_type}")


def _estimated(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that the sketches' corrected estimate leaves over."""
    sketch = lambda end: texts.select(
        F.col("doc_id").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("registers").alias(f"r_{end}")
    )

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(f"n_{end}").to_numpy(zero_copy_only=False) for end in "ab")
                passed = may_link(_matrix(batch.column("r_a")), n, _matrix(batch.column("r_b")), m, similarity)
                yield batch.select(["a", "b"]).filter(pa.array(passed))

    id_type = texts.schema["doc_id"].dataType.simpleString()
    return pairs.join(sketch("b"), "b").join(sketch("a"), "a").mapInArrow(test, f"a {id_type}, b {id_type}")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity, as a table."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    pairs = materialise(pairs, "pairs")
    needed = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = materialise(_sets(docs.join(needed, "doc_id", "left_semi").select("doc_id", "text"), words), "sets")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b")):
                left, right = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(100 * common >= percent * (len(left) + len(right) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    end = lambda name: sets.select(F.col("doc_id").alias(name), F.col("shingles").alias(f"s_{name}"))
    return materialise(
        pairs.join(end("b"), "b").join(end("a"), "a").mapInArrow(test, f"a {id_type}, b {id_type}").distinct(), "links"
    )


def _open_pairs(members: DataFrame, texts: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Pairs within a bucket that have no common label yet and that their sketches allow.

    A bucket of many sketches is dealt into blocks, and each pair of blocks is compared by itself: a task holds two
    blocks at most, and nothing is written but pairs that pass.
    """
    named = members.join(labels, F.col("doc_id") == F.col("vertex"), "left").select(
        "key", "place", "doc_id", F.coalesce("component", "doc_id").alias("label")
    )
    mixed = named.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("label").alias("least"), F.max("label").alias("most")
    ).where("least <> most").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    placed = named.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = placed.join(texts.select("doc_id", "n_shingles", "registers"), "doc_id").select(
        "key", "place", "doc_id", "label", "n_shingles", "registers", "block",
        F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"),
    ).select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "place", "block", "doc_id", "label", "n_shingles", "registers",
    )
    keys = ["key", "low", "high"]

    def pairs_of(group: pa.Table) -> pa.RecordBatch:
        ids, labels_ = group.column("doc_id").combine_chunks(), group.column("label").combine_chunks()
        label = labels_.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        sizes = group.column("n_shingles").to_numpy()
        registers = _matrix(group.column("registers"))
        block = group.column("block").to_numpy()
        cross = group.column("low")[0].as_py() != group.column("high")[0].as_py()
        bands, band = divmod(group.column("place")[0].as_py(), MAX_BANDS)
        starts = Banding.starts(bands)
        left, right = [], []
        for i in range(len(ids)):
            rest = np.arange(i + 1, len(ids))
            rest = rest[(label[rest] != label[i]) & ((block[rest] != block[i]) if cross else True)]
            rest = rest[np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i]) - 1e-9]
            if len(rest):
                passed = rest[may_link(registers[i][None, :], sizes[i : i + 1], registers[rest], sizes[rest], similarity)]
                # A pair that shares an earlier band is found there.
                same = np.logical_and.reduceat(registers[i] == registers[passed], starts, axis=1)
                shown = np.logical_or.reduceat(registers[i] > 0, starts)
                passed = passed[~(same & shown)[:, :band].any(axis=1)] if len(passed) else passed
                left += [i] * len(passed)
                right += passed.tolist()
        a, b = ids.take(pa.array(left, pa.int64())), ids.take(pa.array(right, pa.int64()))
        return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups lie together, in order; a group may go on in the next batch."""
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            columns = [held.column(k).to_numpy() for k in keys]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            edges = [0, *change.tolist()]
            for start, end in zip(edges, edges[1:]):
                if end - start > 1:
                    yield pairs_of(held.slice(start, end - start))
            held = held.slice(edges[-1])
        if held is not None and held.num_rows > 1:
            yield pairs_of(held)

    id_type = texts.schema["doc_id"].dataType.simpleString()
    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, f"a {id_type}, b {id_type}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents whose sets of ``words``-word shingles have a Jaccard similarity of ``percent`` hundredths or more are
    linked; ``component_id`` is the smallest id that can be reached over links, and the document of that id is kept.

    1. Texts of equal word sequences are one vertex. 2. Its sketch is cut into bands; equal bands make a bucket. 3. In
    each bucket all members are held against one leader, the member with most company over all buckets: as many pairs
    as members. Pairs that the collision-corrected estimate allows are confirmed on full sets. 4. Pairs of a bucket
    that these links leave unconnected are compared by their sketches, in blocks, and confirmed likewise. So each
    pair of a bucket is either confirmed, refuted or already connected, and no group is written out as pairs.

    Texts without words (NULL, empty, white space) have no shingles and are linked with nothing. Rows that repeat an
    id are one vertex. Rows without id take the component of an equal word sequence and are not kept then; otherwise
    their component is NULL and they are kept. An empty table gives no rows; further columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    similarity = percent / 100
    slim = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    sketches = materialise(_sketches(slim, words), "sketches")
    texts = materialise(
        sketches.where("n_shingles > 0").groupBy("sequence").agg(
            F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")
        ), "texts",
    )
    vertices = texts.where("doc_id is not null").drop("sequence")
    banded = _band_members(vertices, similarity)
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialise(banded.join(shared, "key").distinct(), "buckets")
    company = members.groupBy("doc_id").agg(F.sum("size").alias("company"))
    ranked = members.join(company, "doc_id")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("company", "doc_id"))["doc_id"].alias("leader"))
    stars = members.join(leaders, "key").where("doc_id <> leader").select(
        F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")
    ).distinct()
    links = _verified(_estimated(stars, vertices, similarity), slim, words, percent)
    labels = materialise(connected_components(links), "labels")
    more = _verified(_open_pairs(members.select("key", "place", "doc_id"), vertices, labels, similarity), slim, words, percent)
    if not more.isEmpty():
        labels = materialise(connected_components(links.unionByName(more)), "labels")
    homes = texts.join(labels, F.col("doc_id") == F.col("vertex"), "left").select(
        "sequence", F.coalesce("component", "doc_id").alias("home")
    )
    found = sketches.select("doc_id", "n_shingles", "sequence").join(homes, "sequence", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("home"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates; all columns stay. Rows without id stay."""
    (gone_id,) = free_names(docs, "_gone_id")
    gone = near_duplicates(docs, words, percent, id_col, text_col).where("not kept and doc_id is not null").select(
        F.col("doc_id").alias(gone_id)
    ).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(gone_id), "left_anti")
