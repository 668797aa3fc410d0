"""The operators of this package as queries over the corpus tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import chat, exact, langid, mixing, near, packing, sharding, substrings, tokens, topk, trie, warc, whitening
from strata.llm.tables import read
from strata.session import new_path, save


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(read(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_conversations(turns.withColumn("parts", chat.text_parts("text"))))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(read(spark, sf_dir, "documents")).drop("row")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(read(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda total, take: total + take["words"])
    planned = mixing.plan(read(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archive(warc.page_records(read(spark, sf_dir, "pages")), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    response = F.col("record_type") == "response"
    return warc.read_archive(spark, path).select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256))
        .otherwise(F.regexp_replace("payload_digest", "^sha256:", ""))
        .alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, length), (conv_id, depth, digest, chars)): conversations that share the first turns of their hundred's first."""
    own = save(trie.digested(turns), "turns")
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("h")
    start = (F.col("conv_id") - F.col("conv_id") % 100).alias("base")
    at_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    shared = F.least("h", F.coalesce("n_base", F.lit(0)))
    told = sizes.select("conv_id", "n", h, start).join(at_base, "base", "left").withColumn("shared", shared)
    told = save(told, "told")
    heads = own.where("conv_id % 100 = 0 AND pos <= 5").select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    first = told.join(heads, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "chars")
    rest = own.join(told, "conv_id").where("pos > h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("depth"), "digest", "chars")
    length = F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return told.select("conv_id", length.alias("depth")), first.unionByName(rest)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths, turns = _rebuilt(read(spark, sf_dir, "conversations"))
    paths = save(trie.prefixes(turns), "prefixes")
    nodes = trie.with_parent(trie.trie(lengths, paths), "conv_id", "parent_conv_id")
    ends = lengths.join(paths, ["conv_id", "depth"]).select("node", "conv_id")
    ends = ends.unionByName(lengths.where("depth = 0").select(F.lit(trie.ROOT).alias("node"), "conv_id"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(trie.list_digests(ends), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def op12_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    docs = read(spark, sf_dir, "documents").select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    return sharding.shuffle_rows(docs).select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_exact_topk": op2_exact_topk,
    "op3_chat_format": op3_chat_format,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_warc": op8_warc,
    "op9_token_counts": op9_token_counts,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_uniform_shards": op12_uniform_shards,
    "op13_embedding_whitening": op13_embedding_whitening,
}

_SQL_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_SQL_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_ESCAPED = (
    r"regexp_replace({}, '([<\[])(\\*)(" + "|".join(re.escape(c[1:]) for c in chat.CONTROL) + r")', '\1\\\2\3', 'g')"
)

ORACLES = {
    "op3_chat_format": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum({len(chat.TURN + chat.SAYS + chat.END)} + length({_SQL_ESCAPED.format("role")})
                        + length({_SQL_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id
    """,
    "op5_minhash_near_dedup": f"""
        WITH RECURSIVE worded AS (SELECT doc_id, {_SQL_WORDS.format(_SQL_LOWER)} AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s
            FROM worded),
        flat AS (SELECT doc_id, unnest(s) AS s FROM sets),
        shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id <> b.doc_id
            GROUP BY 1, 2),
        links AS (
            SELECT x, y FROM shared JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y
            WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
        reach AS (
            SELECT doc_id AS x, doc_id AS y FROM sets
            UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
        least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM sets JOIN least USING (doc_id)
    """,
    "op7_substring_dedup": f"""
        WITH worded AS (SELECT doc_id, {_SQL_WORDS.format("text")} AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM worded),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM starts),
        least AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY 1),
        gone AS (
            SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS g
            FROM windows JOIN least USING (k) WHERE first < doc_id GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN g IS NULL THEN w
                   ELSE [w[i] for i in range(1, len(w) + 1) if NOT list_contains(g, i)] END, ' ')) AS kept_sha256
        FROM worded LEFT JOIN gone USING (doc_id)
    """,
    "op2_exact_topk": """
        WITH sized AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v
            FROM embeddings
            WHERE len(embedding) > 0
              AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM sized q JOIN sized c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op4_exact_dedup": r"""
        WITH bare AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER same AS keep_id,
               count(*) OVER (PARTITION BY body) AS group_size,
               row_number() OVER same = 1 AS kept,
               sha256(body) AS text_sha256
        FROM bare
        WINDOW same AS (PARTITION BY body ORDER BY n_chars DESC, doc_id)
    """,
    "op11_prefix_trie": """
        WITH turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS ts FROM turns GROUP BY 1),
        crcs AS (
            SELECT conv_id, ts, xor(4294967295, list_reduce(
                [ord(c) for c in string_split(CAST(conv_id AS VARCHAR), '')],
                lambda crc, b: list_reduce(
                    list_prepend(xor(crc, b), [0 for k in range(8)]),
                    lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295)) % 6 AS h
            FROM own),
        rebuilt AS (
            SELECT c.conv_id, list_concat(coalesce(b.ts[1:c.h], []), coalesce(c.ts[c.h + 1:], [])) AS ts
            FROM crcs c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
        firsts AS (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt),
        nodes AS (
            SELECT ts[1:d] AS path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                   coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(ts) = d), '') AS ends
            FROM firsts GROUP BY 1, 2),
        children AS (
            SELECT p.path, p.d, count(c.d) AS n_children
            FROM nodes p LEFT JOIN nodes c ON c.d = p.d + 1 AND c.path[1:p.d] = p.path GROUP BY 1, 2),
        sums AS (
            SELECT t.path, t.d, count(*) FILTER (k.n_children = 0) AS n_leaves,
                   sum((n.n_convs - 1) * CASE WHEN n.d = 0 THEN 0 ELSE length(n.path[n.d].t) END) AS saved_tokens
            FROM nodes t JOIN nodes n ON n.d >= t.d AND n.path[1:t.d] = t.path
            JOIN children k ON k.d = n.d AND k.path = n.path GROUP BY 1, 2)
        SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, k.n_children, s.n_leaves,
               CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM nodes n JOIN children k ON k.d = n.d AND k.path = n.path JOIN sums s ON s.d = n.d AND s.path = n.path
        LEFT JOIN nodes p ON p.d = n.d - 1 AND n.d > 0 AND p.path = n.path[1:n.d - 1]
    """,
    "op8_warc": """
        WITH bare AS (
            SELECT page_id, coalesce(html, '') AS body, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
            FROM pages),
        grouped AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM bare)
        SELECT page_id, payload_bytes, sha256(body) AS payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM grouped
    """,
}
