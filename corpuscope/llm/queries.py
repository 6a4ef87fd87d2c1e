"""The numbered queries of this package, with SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuscope.llm.byte_bpe import byte_bpe
from corpuscope.llm.collocations import collocations
from corpuscope.llm.common import id_remainder, read_table
from corpuscope.llm.conversations import conversation_report, damage
from corpuscope.llm.decontamination import contamination
from corpuscope.llm.exact_dedup import exact_dedup
from corpuscope.llm.language_id import identify_languages
from corpuscope.llm.near_dedup import near_duplicates
from corpuscope.llm.pii import KINDS as PII_KINDS, find_personal_data
from corpuscope.llm.secrets import find_secrets, named_spans
from corpuscope.llm.sharding import shard_by_bytes
from corpuscope.llm.suffix_dedup import suffix_dedup
from corpuscope.llm.toxicity import toxicity
from corpuscope.llm.url_filter import filter_urls
from corpuscope.plans.registry import Query

LLM_QUERIES: dict[str, Query] = {}
LLM_ORACLES: dict[str, str] = {}


def numbered(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        LLM_QUERIES[name] = fn
        if oracle is not None:
            LLM_ORACLES[name] = oracle
        return fn

    return register


def _counts_of(spans: str, kinds: tuple[str, ...]) -> list[Column]:
    """Numbers of spans by kind."""
    return [
        F.size(F.expr(f"filter({spans}, m -> m.kind = {k})")).cast("long").alias(f"n_{name}") for k, name in enumerate(kinds)
    ]


@numbered("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder("doc_id", 5) == 0
    rated = toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), train=~held_out)
    return rated.select("doc_id", held_out.alias("held_out"), "score", "predicted", "spans")


@numbered("op2_near_dedup", r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
        FROM documents),
    s AS (
        SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
            ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' ')) END)) AS g
        FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
    reach(doc_id, other) AS (
        SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON other = x)
    SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
    FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
""")
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=3, percent=85)


@numbered("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("secrets", lambda m: m["kind"] < 3)
    counts = _counts_of("secrets", ("assign", "access", "hex"))
    return find_secrets(read_table(spark, sf_dir, "documents")).select(
        "doc_id", *counts, F.sha2(named_spans(base), 256).alias("base_sha256"),
        named_spans(F.col("secrets")).alias("spans"),
    )


@numbered("op4_exact_dedup", r"""
    WITH normal AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
        FROM documents)
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, text_sha256
    FROM normal WINDOW same AS (PARTITION BY text_sha256)
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


@numbered("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(read_table(spark, sf_dir, "documents"), with_ids=False)


@numbered("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder("doc_id", 4) == 2
    named = identify_languages(read_table(spark, sf_dir, "documents"), train=~held_out)
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages")


# DuckDB's pattern classes know code points, so the same class serves.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@numbered("op6_decontamination", f"""
    WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
    items AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, least(len(words), 13) AS size,
               array_to_string(words[p : p + least(len(words), 13) - 1], ' ') AS gram
        FROM (SELECT *, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS p FROM items WHERE len(words) > 0)),
    places AS (
        SELECT doc_id, p, size, array_to_string(words[p : p + size - 1], ' ') AS gram
        FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS p
              FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size)),
    found AS (SELECT doc_id, p, size, item_id FROM places JOIN windows USING (gram, size)),
    words_hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit
                  FROM (SELECT doc_id, unnest(range(p, p + size)) AS w FROM found) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
    SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
    FROM docs LEFT JOIN words_hit USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@numbered("op7_url_filter", r"""
    WITH RECURSIVE cut AS (
        SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
        FROM pages),
    ruled AS (
        SELECT *, CASE
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
            WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
            WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
            list_filter(string_split(regexp_replace(path, '[0-9]+', '*', 'g'), '/'), lambda s: s <> '') AS segments
        FROM cut),
    marked AS (
        SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS decided
        FROM ruled),
    tree AS (
        SELECT 0 AS depth, host, segments, '' AS node, segments AS rest, 0.5::DOUBLE AS purity, count(*)::DOUBLE AS pages,
               coalesce(sum((decided = 'block')::INT), 0)::DOUBLE AS b, count(decided)::DOUBLE AS l
        FROM marked GROUP BY host, segments
        UNION ALL (
        WITH nodes AS (
            SELECT depth, host, node, sum(b) AS nb, sum(l) AS nl, min(rest) AS lo, max(rest) AS hi FROM tree GROUP BY ALL),
        splits AS (
            SELECT host, node, CASE WHEN depth = 0 THEN 0 ELSE list_position(
                list_transform(range(0, least(len(lo), len(hi)) + 1), lambda i: lo[i + 1] IS NOT DISTINCT FROM hi[i + 1]), false) - 1 END AS skip
            FROM nodes WHERE depth = 0 OR nb > 0 AND nb < nl AND lo <> hi),
        opened AS (
            SELECT depth, host, segments, array_to_string(list_concat([node], rest[1:skip]), '/') AS node, coalesce(rest[skip + 1], '') AS head,
                   rest[skip + 2:] AS rest, purity, pages, b, l
            FROM tree JOIN splits USING (host, node)),
        heads AS (
            SELECT depth, host, node, head, max(purity) AS prior, sum(pages) AS pages, sum(b) AS b, sum(l) AS l
            FROM opened GROUP BY depth, host, node, head),
        sized AS (
            SELECT *, sum(pages) OVER (PARTITION BY host, node) AS np, count(*) OVER (PARTITION BY host, node) AS nh FROM heads),
        general AS (
            SELECT *, CASE WHEN head <> '' AND (pages < 3 OR pages * 1000 < np OR nh > 10 AND np < nh * 5) THEN '*' ELSE head END AS branch
            FROM sized),
        sums AS (
            SELECT depth, host, node, branch, max(prior) AS prior, sum(b) AS b, sum(l) AS l FROM general GROUP BY depth, host, node, branch),
        aimed AS (
            SELECT * REPLACE (CASE WHEN depth = 0 THEN (sum(b) OVER (PARTITION BY branch)
                + 4.0::DOUBLE * ((sum(b) OVER () + 1.0::DOUBLE) / (sum(l) OVER () + 2.0::DOUBLE))) / (sum(l) OVER (PARTITION BY branch) + 4.0::DOUBLE)
                ELSE prior END AS prior)
            FROM sums),
        beside AS (
            SELECT *, lag(b) OVER w AS ob, lag(l) OVER w AS ol FROM aimed
            WINDOW w AS (PARTITION BY host, node, l > 0 ORDER BY CASE WHEN l > 0 THEN b / l END, l, branch)),
        parted AS (
            SELECT *, coalesce(b / l - ob / ol > 2.0::DOUBLE * sqrt((b + ob) / (l + ol) * (1.0::DOUBLE - (b + ob) / (l + ol))
                                                                    * (1.0::DOUBLE / l + 1.0::DOUBLE / ol)), false)::INT AS part
            FROM beside),
        joined AS (
            SELECT *, sum(part) OVER (PARTITION BY host, node, l > 0 ORDER BY CASE WHEN l > 0 THEN b / l END, l, branch ROWS UNBOUNDED PRECEDING) AS grp
            FROM parted),
        judged AS (
            SELECT host, node, branch, (sum(b) OVER g + 4.0::DOUBLE * prior) / (sum(l) OVER g + 4.0::DOUBLE) AS purity
            FROM joined WINDOW g AS (PARTITION BY host, node, l > 0, grp))
        SELECT o.depth + 1, o.host, o.segments, o.node || '/' || g.branch, o.rest, j.purity, o.pages, o.b, o.l
        FROM opened o JOIN general g ON o.host = g.host AND o.node = g.node AND o.head = g.head
        JOIN judged j ON g.host = j.host AND g.node = j.node AND g.branch = j.branch)),
    verdicts AS (SELECT host, segments, arg_max(purity, depth) > 0.5 AS rejected FROM tree GROUP BY host, segments)
    SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict
    FROM marked JOIN verdicts USING (host, segments)
""")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))


@numbered("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts_of("base", PII_KINDS)
    return find_personal_data(read_table(spark, sf_dir, "documents")).select(
        "doc_id", *counts, F.sha2(named_spans(F.col("base"), PII_KINDS), 256).alias("base_sha256"),
        named_spans(F.col("spans"), PII_KINDS).alias("spans"),
    )


# The checksum goes bit by bit: each byte is followed by seven steps that add nothing.
@numbered("op10_sharding", """
    WITH sized AS (
        SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
               xor(list_reduce(
                   list_prepend(4294967295, flatten(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                       lambda h: [('0x' || h)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                   lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS text_crc32
        FROM documents),
    placed AS (
        SELECT *, CAST(((2 * sum(size) OVER (ORDER BY doc_id, text_crc32, size) - size) * 8)
                       // (2 * sum(size) OVER ()) AS INTEGER) AS shard
        FROM sized)
    SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot,
           CAST(NULL AS INTEGER) AS grown_shard
    FROM placed
""")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(read_table(spark, sf_dir, "documents"))


@numbered("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_report(damage(read_table(spark, sf_dir, "conversations")))


@numbered("op12_collocations", r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces),
    totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
    grams AS (
        SELECT lang, size, words[p : p + size - 1] AS phrase
        FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS p
              FROM (SELECT lang, words, unnest([1, 2, 3, 4]) AS size FROM w) WHERE len(words) >= size)),
    f AS (SELECT lang, phrase, any_value(size) AS size, count(*) AS f FROM grams GROUP BY lang, phrase HAVING count(*) >= 30),
    cuts AS (SELECT lang, phrase, size, f AS a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
    scored AS (
        SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS score
        FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.phrase[1 : k]
        JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.phrase[k + 1 : cuts.size]),
    best AS (SELECT lang, phrase, a, unnest(min({'score': score, 'k': k, 'l': l, 'r': r})) FROM scored GROUP BY lang, phrase, a),
    around AS (
        SELECT lang, phrase[p : p + part - 1] AS phrase, max(f) AS around
        FROM (SELECT lang, phrase, f, part, unnest(range(1, size - part + 2)) AS p
              FROM (SELECT *, unnest(range(2, size)) AS part FROM f)) GROUP BY ALL),
    ranked AS (
        SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, score,
               row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank
        FROM best LEFT JOIN around USING (lang, phrase)
        WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


@numbered("op13_suffix_dedup", r"""
    WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
    places AS (
        SELECT doc_id, p, md5(b[p : p + 49]) AS gram
        FROM (SELECT *, unnest(range(1, octet_length(b) - 48)) AS p FROM bytes WHERE octet_length(b) >= 50)),
    found AS (SELECT doc_id, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY gram) AS earliest FROM places) WHERE earliest < doc_id),
    runs AS (SELECT doc_id, p, p - lag(p, 1, -50) OVER (PARTITION BY doc_id ORDER BY p) > 50 AS opens FROM found),
    spans AS (
        SELECT doc_id, min(p) AS s, max(p) + 50 AS e
        FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM runs) GROUP BY doc_id, run),
    cut AS (
        SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es
        FROM spans GROUP BY doc_id)
    SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           CASE WHEN ss IS NULL THEN sha256(b) ELSE sha256(unhex(array_to_string(list_transform(range(1, len(ss) + 2), lambda i:
               hex(b[CASE WHEN i = 1 THEN 1 ELSE es[i - 1] END : CASE WHEN i > len(ss) THEN octet_length(b) ELSE ss[i] - 1 END])
           ), ''))) END AS kept_sha256
    FROM bytes LEFT JOIN cut USING (doc_id)
""")
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
