"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from presage.llm import chat, exact_dedup, fill_middle, html_blocks, language, maxscore, packing, phrase_index, prefix_trie, revisits, simhash, substrings, token_counts
from presage.plans.registry import Registry
from presage.session import table

Q = Registry()
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@Q.add("op1_cost_balanced_packing")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


@Q.add("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@Q.add("op5_benchmark_decontamination")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    found = phrase_index.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


@Q.add("op8_language_id")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = language.train(docs.filter(~language.held_out()))
    return language.identify(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@Q.add("op10_exact_dedup", sql="""
    WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents),
    g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.deduplicate_largest(table(spark, sf, "documents"), exact_dedup.open_fresh(spark))


@Q.add("op7_substring_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


@Q.add("op3_chat_formatting")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_trees(chat.chains(rows)))


@Q.add("op4_token_counts")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@Q.add("op9_html_extraction")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return html_blocks.extract(pages, html_blocks.train(pages)).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


_KEY = r"""nullif(concat(
        regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', ''),
        regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', ''),
        CASE WHEN query <> '' THEN '?' || query ELSE '' END), '')"""


@Q.add("op6_warc_revisits", sql=rf"""
    WITH p AS (SELECT page_id, url, md5(coalesce(html, '')) AS h, CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) AS size FROM pages),
    r AS (
        SELECT page_id * 4 AS record_id, url, page_id * 1000 AS at, true AS full_, '"' || h || '"' AS etag, size, page_id FROM p
        UNION ALL SELECT page_id * 4 + 1, 'HTTPS://www.' || regexp_replace(url, '^https?://(www\.)?', ''), page_id * 1000 + 500, false,
            CASE WHEN page_id % 11 <> 0 THEN CASE WHEN page_id % 7 = 0 THEN '"changed"' ELSE '"' || h || '"' END END, '0', page_id FROM p
        UNION ALL SELECT page_id * 4 + 2, url, -1, false, CASE WHEN page_id % 11 <> 0 THEN CASE WHEN page_id % 7 = 0 THEN '"changed"' ELSE '"' || h || '"' END END, '0', page_id FROM p WHERE page_id % 3 = 0),
    b AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM r),
    q AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(bare, '\?(.*)$', 1), '(^|&)(utm_[^&=]*|fbclid|gclid)(=[^&]*)?', '', 'g'), '^&', '') AS query FROM b),
    k AS (SELECT *, {_KEY} AS url_key FROM q),
    j AS (
        SELECT v.record_id, v.url_key, v.etag, v.page_id, v.full_,
            (SELECT max_by(s.record_id, (s.at, s.record_id)) FROM k s WHERE s.full_ AND s.url_key = v.url_key AND s.at < v.at) AS response_id
        FROM k v WHERE NOT v.full_),
    m AS (SELECT j.*, s.etag AS stored, s.size AS stored_size FROM j LEFT JOIN k s ON s.record_id = j.response_id AND s.full_)
    SELECT record_id, url_key,
        CASE WHEN url_key IS NULL THEN 'no_url' WHEN response_id IS NULL THEN 'no_response' WHEN etag IS NULL THEN 'no_validator'
             WHEN etag = stored THEN 'resolved' ELSE 'mismatch' END AS status,
        response_id,
        CASE WHEN response_id IS NOT NULL AND etag = stored THEN
            'content-length: ' || stored_size || '; content-type: text/html; date: day ' || CAST(page_id * 1000 + 500 AS VARCHAR) || '; etag: W/' || etag END AS headers
    FROM m""")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    found = revisits.resolve(revisits.capture_log(table(spark, sf, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "url_key", "status", "response_id", F.when(F.col("headers").isNotNull(), F.array_join(lines, "; ")).alias("headers"))


@Q.add("op13_fill_in_middle", sql=r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS x, sha256('7:' || doc_id) AS s FROM documents),
    h AS (
        SELECT doc_id, x, regexp_extract_all(x, '[^\n]*\n|[^\n]+') AS u, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3,
            ('0x' || s[25:32])::BIGINT AS h4 FROM d),
    c AS (
        SELECT doc_id, x, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
            CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT doc_id, x, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(x) AS restored_sha256
    FROM p""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(table(spark, sf, "documents"), seed=7, rate=100, spm=50))


@Q.add("op12_exact_top_k", sql="""
    WITH v AS (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, list_dot_product(q.w, v.w)::BIGINT AS score FROM v q JOIN v ON q.r <> v.r WHERE q.vec_id % 50 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    index = maxscore.indexed(table(spark, sf, "embeddings"))
    return maxscore.top_k(index, index.filter("vec_id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score")


@Q.add("op11_conversation_prefix_trie", sql=r"""
    WITH t AS (
        SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS k,
            len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations),
    p AS (SELECT conv_id, list({'k': k, 'w': w} ORDER BY turn NULLS FIRST, k) AS own FROM t GROUP BY conv_id),
    h AS (
        SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4 AS h FROM p),
    q AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS path FROM h LEFT JOIN p b ON b.conv_id = h.conv_id - h.conv_id % 20),
    m AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM q),
    x AS (
        SELECT conv_id, depth, array_to_string(list_transform(path[1:depth], lambda s: s.k), '') AS key, coalesce(path[depth].w, 0) AS w, len(path) = depth AS last FROM m),
    g AS (
        SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM x GROUP BY key, depth),
    c AS (SELECT key[1:length(key) - 32] AS key, count(*) AS kids FROM g WHERE depth > 0 GROUP BY 1),
    n AS (SELECT g.*, coalesce(c.kids, 0) AS n_children FROM g LEFT JOIN c ON c.key = g.key),
    u AS (SELECT key[1:32 * up] AS top, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * w AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM n)),
    s AS (SELECT top, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM u GROUP BY top)
    SELECT n.conv_id, n.depth, o.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
    FROM n JOIN s ON s.top = n.key LEFT JOIN n o ON n.depth > 0 AND o.key = n.key[1:length(n.key) - 32]""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.turn_lists(table(spark, sf, "conversations"))))
