"""One query for each operator, over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import completion, jaccard, language_id, neighbours, packing, pieces, prefix_trie, quotes, spans, syncmers, threshold, toxicity, warc
from tallyline.llm.common import materialise, remainder
from tallyline.llm.tables import table


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model)
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_to")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = syncmers.fingerprints(table(spark, sf_dir, "documents"))
    own, edited, after = F.col("entries"), F.col("edited_entries"), F.col("next_entries")
    return found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), syncmers.as_text(own).alias("fingerprint"), syncmers.as_text(edited).alias("edited_fingerprint"),
        syncmers.likeness(own, edited).alias("near_edited"), syncmers.likeness(own, after).alias("near_next"),
    )


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"), removed_name="removed")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_pieces", F.crc32("piece_ids").alias("ids_crc32"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"), "parity")


def op10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = quotes.conversations(table(spark, sf_dir, "conversations"))
    return ordered.select("conv_id", "turn", "role", "position", "parent", "depth", "place", "linked", "quotes", "body")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(True))
    model = language_id.learn(docs.filter(~held_out))
    found = language_id.identify(docs.drop("lang"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.read(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    nodes = prefix_trie.trie(*prefix_trie.regrouped(materialise(turns, "numbered")))
    return nodes.select(F.col("owner").alias("conv_id"), "depth", F.col("parent_owner").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = completion.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_packing, op3_fingerprints, op4_sentence_spans, op5_warc, op6_neighbours, op7_jaccard, op8_pieces, op9_language_id, op10_quotes, op11_threshold_search, op12_prefix_trie, op13_bin_completion)}


#: The 160 bits of a SHA-1 digest in base32: five of ten hexadecimal digits make a letter.
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(digest, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER), 1)), '')"

ORACLES = {
    "op5_warc": f"""
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        groups AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS digest, min(page_id) OVER (PARTITION BY payload) AS first FROM payloads)
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM groups
    """,
    "op11_threshold_search": r"""
        WITH cut AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        docs AS (SELECT doc, doc_id, len(terms) AS n, terms FROM cut WHERE len(terms) > 0),
        whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
        asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        held AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY doc, term),
        weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), whole),
        scores AS (SELECT item_id, doc, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN docs USING (doc), whole GROUP BY item_id, doc),
        ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scores JOIN docs USING (doc) WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
    "op12_prefix_trie": r"""
        WITH RECURSIVE turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS position, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT DISTINCT conv_id FROM turns),
        bits AS (  -- crc32 of the decimal number, a bit a step
            SELECT conv_id, 0 AS step, 4294967295::BIGINT AS crc FROM convs
            UNION ALL
            SELECT conv_id, step + 1, xor(c >> 1, 3988292384 * (c & 1)) FROM (SELECT conv_id, step, CASE WHEN step % 8 = 0 THEN xor(crc, ascii(substr(conv_id::VARCHAR, step // 8 + 1, 1))::BIGINT) ELSE crc END AS c FROM bits) WHERE step < 8 * length(conv_id::VARCHAR)
        ),
        heads AS (SELECT conv_id, xor(crc, 4294967295) % 4 AS h FROM bits WHERE step = 8 * length(conv_id::VARCHAR)),
        parts AS (
            SELECT c.conv_id, 0 AS part, position, role, text FROM heads AS c JOIN turns AS t ON t.conv_id = c.conv_id - c.conv_id % 20 AND position <= h
            UNION ALL
            SELECT conv_id, 1, position, role, text FROM heads JOIN turns USING (conv_id) WHERE position > h
        ),
        paths AS (SELECT conv_id, coalesce(list(struct_pack(role := role, text := text) ORDER BY part, position) FILTER (WHERE role IS NOT NULL), []) AS path FROM convs LEFT JOIN parts USING (conv_id) GROUP BY conv_id),
        prefixes AS (SELECT conv_id, depth, path[1:depth] AS prefix, len(path) = depth AS ends FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM paths)),
        nodes AS (SELECT min(conv_id) AS conv_id, depth, prefix, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefixes GROUP BY depth, prefix),
        families AS (SELECT prefix[1:depth - 1] AS parent, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        family AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(prefix[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM nodes AS n LEFT JOIN families AS f ON f.parent = n.prefix),
        above AS (SELECT prefix[1:k] AS prefix, n_children = 0 AS leaf, saved FROM (SELECT *, unnest(range(depth + 1)) AS k FROM family)),
        sums AS (SELECT prefix, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY prefix)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
        FROM family AS n JOIN sums USING (prefix) LEFT JOIN nodes AS p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
