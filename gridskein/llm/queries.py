"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import keyed, table
from .centroids import cluster_vectors
from .chat import link_quotations
from .decontamination import contaminated_documents
from .html_extract import extract_main_text
from .language_id import fit_language_model, identify_languages
from .lm_scoring import count_words, encode_documents, score_encoded, train_on_encoded
from .media import media_features, sniff_media, store_texts
from .merkle import dataset_manifest
from .packing import pack_documents
from .simhash_dedup import fingerprint_hex, simhash_components
from .spotsigs import edited_likeness
from .suffix_dedup import suffix_dedup
from .warc import archive_captures


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files lie."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, ranks=tokenizer_path("byte_bpe_50k.tiktoken"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` that strings of 400 bytes found elsewhere cover are removed; n_repeated counts those that strings of 200 cover."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    covered = F.aggregate("repeated", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return suffix_dedup(docs, length=400, report=200).select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        covered.alias("n_repeated"),
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op4_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of ``documents`` stored as images or sound, some in envelopes and all declared alike, recognised or carved, read back and described."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    found = sniff_media(store_texts(docs, mixed=True).drop("text"), declared_col="declared_type")
    whole = F.col("sniffed_type") != "application/octet-stream"
    first = F.col("carved")[0]
    found = found.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("media")).otherwise(first["content"]).alias("media"),
        F.when(whole, F.col("sniffed_type")).otherwise(first["type"]).alias("sniffed_type"),
        "type_ok",
        F.when(whole, F.lit(0)).otherwise(first["start"]).cast("long").alias("media_start"),
    )
    read = media_features(found)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "sniffed_type", "type_ok", "media_start")


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` in reply order, without quotes."""
    return link_quotations(table(spark, sf_dir, "conversations"), nested=True).select("conv_id", "thread", "turn", "role", "reply_to", "n_quoted", "n_linked", "text")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of each of ``documents``, by a model that nine in ten of them (by id) teach; null ids aren't held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text")
    words = count_words(docs.filter("NOT held_out"))
    encoded = encode_documents(docs, words, columns=["doc_id", "held_out"])
    scored = score_encoded(encoded, train_on_encoded(encoded.filter("NOT held_out"), words)).withColumn("train_tokens", F.lit(words.tokens).cast("long"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each of ``documents``, by a model that three in four of them (by id) teach; null ids aren't held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit_language_model(docs.filter(~held_out))
    texts = docs.select("doc_id", held_out.alias("held_out"), "text")
    return identify_languages(texts, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_components(docs).select(F.col("id").alias("doc_id"), fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of ``documents`` that overlap with ``benchmark`` items, how much of each does and where."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated_documents(docs, table(spark, sf_dir, "benchmark"))
    ids = keyed(docs, "doc_id", "text").select("doc_id", "__id", "__th").join(found, ["__id", "__th"])
    return ids.select("doc_id", F.col("item").alias("item_id"), "windows", "covered", "share", "start", "stop")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written to WARC archives and read back through their merged index."""
    found = archive_captures(table(spark, sf_dir, "pages"))
    return found.select(F.col("capture").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "warc_date", "position")


def op11_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts, and their likeness."""
    return edited_likeness(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all ``documents`` by source; texts of every other row (by CRC-32 of the id) are tampered with."""
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = dataset_manifest(docs, "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"], "text", tampered)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` of 64 components in 16 clusters of whole numbers, after three rounds."""
    found = cluster_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", dims=64, scale=64, clusters=16, rounds=3, salt="1")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _clustering_sql(rounds: int = 3, clusters: int = 16) -> str:
    """One pair of steps for each round: the nearest centroid of each vector, then the centroids' means."""
    steps = [
        f"""q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v AS m FROM (FROM q ORDER BY sha256('1:' || vec_id) LIMIT {clusters}))"""
    ]
    nearest = "SELECT vec_id, v, min((CAST(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), c)) AS best FROM q, c{0} GROUP BY vec_id, v"
    for k in range(rounds):
        steps.append(f"n{k} AS ({nearest.format(k)})")
        steps.append(f"s{k} AS (SELECT c, i, sum(x) AS t, count(*) AS k FROM (SELECT best[2] AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM n{k}) GROUP BY c, i)")
        mean = "(t - (t % k + k) % k) // k"
        steps.append(f"c{k + 1} AS (SELECT c, coalesce(u, m) AS m FROM c{k} LEFT JOIN (SELECT c, list(CAST({mean} AS BIGINT) ORDER BY i) AS u FROM s{k} GROUP BY c) USING (c))")
    return f"""
        WITH {", ".join(steps)}, z AS ({nearest.format(rounds)})
        SELECT z.vec_id, CAST(best[2] AS INTEGER) AS "cluster", CAST(best[1] AS BIGINT) AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
               CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM z JOIN c{rounds} ON c = best[2]"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_media_sniffing": op4_media_sniffing,
    "op5_quotation_linking": op5_quotation_linking,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_language_id": op7_language_id,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_warc": op10_warc,
    "op11_spotsigs": op11_spotsigs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_centroid_clustering": op13_centroid_clustering,
}
ORACLE_SQL: dict[str, str] = {
    "op5_quotation_linking": r"""
        WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, string_split(text, chr(10)) AS ls FROM conversations),
        l AS (SELECT conv_id, turn, unnest(ls) AS x FROM m),
        q AS (SELECT conv_id, turn, length(regexp_replace(regexp_extract(x, '^[ \t]*(?:>[ \t]?)+'), '[^>]', '', 'g')) AS level,
                     trim(regexp_replace(lower(regexp_replace(x, '^[ \t]*(?:>[ \t]?)+', '')), '[ \t\r\x0B\f]+', ' ', 'g')) AS line FROM l),
        own AS (SELECT DISTINCT conv_id, turn, line FROM q WHERE level = 0 AND line <> ''),
        quo AS (SELECT conv_id, turn, level, line, count(*) AS n FROM q WHERE level > 0 AND line <> '' GROUP BY ALL),
        hit AS (SELECT quo.conv_id, quo.turn, quo.level, quo.line, any_value(quo.n) AS n, max(own.turn) AS original
                FROM quo JOIN own ON own.conv_id = quo.conv_id AND own.line = quo.line AND own.turn < quo.turn GROUP BY ALL),
        per AS (SELECT conv_id, turn, level, original, sum(n) AS n FROM hit GROUP BY ALL),
        rep AS (SELECT conv_id, turn, CAST(arg_max(original, (-level, n, original)) AS BIGINT) AS reply_to, CAST(sum(n) AS BIGINT) AS n_linked FROM per GROUP BY ALL),
        up AS (SELECT conv_id, turn, reply_to AS root FROM rep
               UNION SELECT up.conv_id, up.turn, rep.reply_to FROM up JOIN rep ON rep.conv_id = up.conv_id AND rep.turn = up.root),
        top AS (SELECT conv_id, turn, min(root) AS thread FROM up GROUP BY ALL),
        cnt AS (SELECT conv_id, turn, count(*) FILTER (level > 0 AND line <> '') AS n_quoted FROM q GROUP BY ALL)
        SELECT m.conv_id, coalesce(top.thread, m.turn) AS thread, m.turn, m.role, rep.reply_to, CAST(coalesce(cnt.n_quoted, 0) AS BIGINT) AS n_quoted,
               coalesce(rep.n_linked, 0) AS n_linked,
               regexp_replace(array_to_string(list_filter(ls, lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10)), '^(?:[ \t\r]*\n)+|(?:\n[ \t\r]*)+$', '', 'g') AS text
        FROM m LEFT JOIN rep USING (conv_id, turn) LEFT JOIN top USING (conv_id, turn) LEFT JOIN cnt USING (conv_id, turn)""",
    "op10_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d,
                          regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query FROM pages),
        k AS (SELECT page_id, array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || CASE path WHEN '' THEN '/' ELSE path END || CASE query WHEN '' THEN '' ELSE '?' || query END AS url_key,
                     strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS warc_date FROM p),
        h AS (SELECT *, row_number() OVER (ORDER BY url_key, warc_date, page_id) - 1 AS position FROM k),
        o AS (SELECT d, max(page_id) AS owner FROM p GROUP BY d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST((CAST('0x' || substr(d, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) // CAST(pow(32, 3 - i % 4) AS BIGINT)) % 32 AS BIGINT) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> owner THEN owner END AS refers_to, url_key, warc_date, position
        FROM p JOIN o USING (d) JOIN h USING (page_id)""",
    "op12_merkle_manifest": r"""
        WITH RECURSIVE f AS (SELECT *, (CASE WHEN doc_id IS NULL THEN '-' ELSE octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id END)
               || (CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END) || (CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END)
               || (CASE WHEN n_chars IS NULL THEN '-' ELSE octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars END) AS head, replace(text, chr(10), '') AS cut FROM documents),
        bits(b, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
        crc(tab) AS (SELECT list(c ORDER BY b) FROM bits WHERE k = 8),
        sums AS (SELECT *, xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda a, x: xor(tab[xor(a, x) % 256 + 1], a // 256), 4294967295)) AS sum FROM f, crc),
        h AS (SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END) AS leaf,
                     CASE WHEN sum % 2 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(cut)) || ':' || cut END)
                          ELSE sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END) END AS other FROM sums),
        l AS (SELECT *, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM h),
        n(tree, level, i, d, of) AS (SELECT tree, 0, i, leaf, count(*) OVER (PARTITION BY tree) FROM l
               UNION ALL SELECT tree, level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(of) + 2) // 3 FROM n WHERE of > 1 GROUP BY tree, level, i // 3),
        r AS (SELECT tree, d AS subroot, level AS height, row_number() OVER (ORDER BY encode(tree)) - 1 AS i FROM n WHERE of = 1),
        m(level, i, d, of) AS (SELECT 0, i, subroot, count(*) OVER () FROM r UNION ALL SELECT level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(of) + 2) // 3 FROM m WHERE of > 1 GROUP BY level, i // 3),
        p(tree, leaf_at, part, level, i, before, after) AS (
               SELECT l.tree, l.i, 0, n.level, l.i // CAST(pow(3, n.level) AS BIGINT), string_agg(s.d, '' ORDER BY s.i) FILTER (s.i < l.i // CAST(pow(3, n.level) AS BIGINT)), string_agg(s.d, '' ORDER BY s.i) FILTER (s.i > l.i // CAST(pow(3, n.level) AS BIGINT))
               FROM l JOIN n ON n.tree = l.tree AND n.i = l.i // CAST(pow(3, n.level) AS BIGINT) AND n.of > 1 JOIN n s ON s.tree = n.tree AND s.level = n.level AND s.i // 3 = n.i // 3 GROUP BY ALL
               UNION ALL
               SELECT l.tree, l.i, 1, m.level, m.i, string_agg(s.d, '' ORDER BY s.i) FILTER (s.i < m.i), string_agg(s.d, '' ORDER BY s.i) FILTER (s.i > m.i)
               FROM l JOIN r ON r.tree = l.tree JOIN m ON m.i = r.i // CAST(pow(3, m.level) AS BIGINT) AND m.of > 1 JOIN m s ON s.level = m.level AND s.i // 3 = m.i // 3 GROUP BY ALL),
        path AS (SELECT tree, leaf_at, list([coalesce(before, ''), coalesce(after, '')] ORDER BY part, level) AS steps FROM p GROUP BY tree, leaf_at),
        o AS (SELECT l.doc_id, l.leaf, r.subroot, (SELECT d FROM m WHERE of = 1) AS root, coalesce(path.steps, []) AS steps, l.other FROM l JOIN r USING (tree) LEFT JOIN path ON path.tree = l.tree AND leaf_at = l.i),
        u AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[1] || s[2]), '')) AS proof_sha256,
                     list_reduce(list_concat([['', other]], steps), lambda x, s: ['', sha256(s[1] || x[2] || s[2])])[2] AS folded_root FROM o)
        SELECT *, folded_root = root AS verified FROM u""",
    "op13_centroid_clustering": _clustering_sql(),
}
