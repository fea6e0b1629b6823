"""The operators' queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, chat, cover_tree, language, lexical, mixing, near_dedup, packing, secrets, sharding, top_k, trie, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


#: A conversation whose texts hold the template's own control strings.
CONTROL = (-7, "\\### Assistant: </turn> ok")


@query("op1_chat_formatting")
def op1(spark, folder):
    number, text = CONTROL
    extra = spark.createDataFrame(
        [(number, 0, "user", text), (number, 1, "assistant", text)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.conversations(chat.as_trees(rows))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return made.withColumns(
        {"turns": chat.read_back(F.col("formatted")), "learned": chat.read_loss(F.col("formatted"), F.col("loss"))}
    ).select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Bytes of text that a shard may hold.
SHARD_BYTES = 1 << 20

OP2_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS bytes,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS place
  FROM documents
), level AS (
  SELECT 0 AS depth, doc_id, place, bytes, CAST(0 AS BIGINT) AS prefix,
         CAST(sum(bytes) OVER () AS BIGINT) AS total, count(*) OVER () AS n
  FROM sized
  UNION ALL
  SELECT depth + 1, doc_id, place, bytes, place >> (59 - depth) AS prefix,
         CAST(sum(bytes) OVER (PARTITION BY place >> (59 - depth)) AS BIGINT),
         count(*) OVER (PARTITION BY place >> (59 - depth))
  FROM level WHERE total > {SHARD_BYTES} AND n > 1 AND depth < 60
)
SELECT doc_id, CAST(depth AS INTEGER) AS depth, prefix, CAST(0 AS BIGINT) AS part,
       CAST(bytes AS BIGINT) AS bytes, total AS shard_bytes
FROM level WHERE total <= {SHARD_BYTES} OR n = 1 OR depth = 60
"""


@query("op2_sharding", OP2_SQL)
def op2(spark, folder):
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = table(spark, folder, "documents").select("doc_id", size.alias("bytes"))
    return sharding.shards(rows, "doc_id", F.col("bytes"), SHARD_BYTES).select(
        "doc_id", "depth", "prefix", "part", "bytes", "shard_bytes"
    )


@query("op3_language")
def op3(spark, folder):
    return language.identify(table(spark, folder, "documents"))


@query("op4_cover_tree")
def op4(spark, folder):
    return cover_tree.threshold_links(table(spark, folder, "embeddings"), 0.95)


@query("op5_secret_scans")
def op5(spark, folder):
    return secrets.scan(table(spark, folder, "documents")).drop("key")


@query("op6_best_fit_packing")
def op6(spark, folder):
    cut = packing.pieces(
        table(spark, folder, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )
    return packing.digested(packing.pack(cut))


@query("op7_warc")
def op7(spark, folder):
    return warc.archive(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"
    )


def domains(spark, folder):
    labels = table(spark, folder, "labels")
    return labels.select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain"))


#: Wanted share of each domain's present token total.
WEIGHTS = {"good": 1.0, "poor": 0.5, "toxic": 0.0}


@query("op8_mixing")
def op8(spark, folder):
    return mixing.mix(table(spark, folder, "documents"), domains(spark, folder), WEIGHTS)


@query("op9_minhash_near_dedup")
def op9(spark, folder):
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


@query("op10_top_k")
def op10(spark, folder):
    return top_k.top_k(table(spark, folder, "embeddings"), 20, 20, 64.0)


#: The CRC-32 polynomial, bit by bit: -1 stands for one shift in the list of steps.
OP11_SQL = """
WITH turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), steps AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, flatten(list_transform(
           string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS todo
  FROM (SELECT DISTINCT conv_id FROM turns)
), ids AS (
  SELECT conv_id, base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), todo), lambda a, s:
           CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 9 AS h
  FROM steps
), parts AS (
  SELECT i.conv_id, place, t FROM ids i JOIN turns s ON s.conv_id = i.base AND place <= h
  UNION ALL
  SELECT i.conv_id, place, t FROM ids i JOIN turns s ON s.conv_id = i.conv_id AND place > h
), whole AS (
  SELECT i.conv_id, coalesce(list(t ORDER BY place) FILTER (WHERE t IS NOT NULL), []) AS seq
  FROM ids i LEFT JOIN parts p ON p.conv_id = i.conv_id GROUP BY i.conv_id
), members AS (
  SELECT conv_id, d, seq[1:d] AS prefix, d = len(seq) AS ends FROM whole, range(0, len(seq) + 1) r(d)
), nodes AS (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(array_to_string(list(conv_id ORDER BY conv_id) FILTER (WHERE ends), ','), '') AS listed
  FROM members GROUP BY prefix, d
), children AS (
  SELECT prefix[1:d - 1] AS prefix, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), above AS (
  SELECT n.prefix[1:k] AS prefix, CAST(k AS BIGINT) AS d, count(*) FILTER (WHERE c.prefix IS NULL) AS n_leaves,
         CAST(sum(CASE WHEN n.d = 0 THEN 0 ELSE (n.n - 1) * strlen(n.prefix[-1].text) END) AS BIGINT) AS saved_tokens
  FROM nodes n LEFT JOIN children c ON c.prefix = n.prefix, range(0, n.d + 1) r(k) GROUP BY 1, 2
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.n_children, 0) AS n_children,
       a.n_leaves, a.saved_tokens, sha256(n.listed) AS ends_sha256
FROM nodes n JOIN above a ON a.prefix = n.prefix LEFT JOIN children c ON c.prefix = n.prefix
LEFT JOIN nodes p ON n.d > 0 AND p.prefix = n.prefix[1:n.d - 1]
"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark, folder):
    turns, ids = trie.rebuilt(trie.in_order(table(spark, folder, "conversations")))
    return trie.prefix_trie(turns, ids).drop("key", "parent_key")


@query("op12_bloom_lm")
def op12(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", bloom_lm.held_out("doc_id").alias("held_out"))
    return bloom_lm.score(docs, bloom_lm.train(docs.where("not held_out")), ["doc_id", "held_out"])


OP13_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), whole AS (
  SELECT CAST(count(*) FILTER (WHERE len(ts) > 0) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM words
), asked AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY 1))
  GROUP BY 1, 2
), postings AS (
  SELECT row, doc_id, n, t, count(*) AS tf FROM (SELECT row, doc_id, len(ts) AS n, unnest(ts) AS t FROM words)
  WHERE t IN (SELECT t FROM asked) GROUP BY 1, 2, 3, 4
), weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, whole GROUP BY t, n_docs
), scored AS (
  SELECT item_id, row, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (t) JOIN weights USING (t), whole GROUP BY 1, 2, 3
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""


@query("op13_lexical_search", OP13_SQL)
def op13(spark, folder):
    return lexical.search(table(spark, folder, "benchmark"), table(spark, folder, "documents"), 10)
