"""The registered queries of the text operators, with their production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_trie, exact_dedup, line_dedup, lm_score, mixing, packing, phrases, pii, quality_rules, sharding, simhash_dedup, token_counts, toxicity
from .common import documents


def tokenizer(name: str) -> str:
    """Where a vocabulary file of the public tokenizers lies; the same path on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": lambda spark, d: packing.pack(documents(spark, d), tokenizer("byte_bpe_50k.json")),
    "op2_pii": lambda spark, d: pii.find_pii(documents(spark, d)),
    "op3_simhash_near_dedup": lambda spark, d: simhash_dedup.simhash_dedup(documents(spark, d)),
    "op4_toxicity": lambda spark, d: toxicity.toxicity(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op5_exact_dedup": lambda spark, d: exact_dedup.exact_dedup(documents(spark, d)),
    "op6_lm_score": lambda spark, d: lm_score.lm_score(documents(spark, d)),
    "op7_mixing": lambda spark, d: mixing.mix(documents(spark, d)),
    "op8_token_counts": lambda spark, d: token_counts.token_counts(documents(spark, d), tokenizer("piece_bpe_32k.model")),
    "op9_line_dedup": lambda spark, d: line_dedup.by_document(line_dedup.line_dedup(documents(spark, d))),
    "op10_quality_rules": lambda spark, d: quality_rules.quality_rules(documents(spark, d)),
    "op11_conversation_trie": lambda spark, d: conversation_trie.prefix_trie(conversation_trie.rebuilt(conversation_trie.turns(spark.read.parquet(f"{d}/conversations.parquet")))),
    "op12_phrase_collocations": lambda spark, d: phrases.collocations(documents(spark, d)),
    "op13_sharding": lambda spark, d: sharding.shard(documents(spark, d)),
    "pipeline": pipeline,
}

#: CRC-32 in DuckDB, which has no function for it: the table of all bytes, and the sum over the bytes in a list.
CRC_TABLE = "t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t)"


def crc(text: str) -> str:
    read = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)"
    return f"xor(4294967295, list_reduce({read}, lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295))"


ORACLES: dict[str, str] = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_conversation_trie": f"""
        WITH {CRC_TABLE},
        own AS (SELECT conv_id, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS s, strlen(coalesce(text, '')) AS b, turn FROM conversations WHERE conv_id IS NOT NULL),
        old AS (SELECT conv_id, list(s ORDER BY turn NULLS FIRST, s) AS s, list(b ORDER BY turn NULLS FIRST, s) AS b FROM own GROUP BY conv_id),
        hs AS (SELECT conv_id, s, b, {crc("conv_id::VARCHAR")} % 9 AS h FROM old, t),
        convs AS (SELECT x.conv_id, coalesce(o.s[1:x.h], []) || x.s[x.h + 1:] AS s, coalesce(o.b[1:x.h], []) || x.b[x.h + 1:] AS b FROM hs x LEFT JOIN old o ON o.conv_id = x.conv_id - x.conv_id % 5),
        steps AS (SELECT conv_id, unnest(range(len(s) + 1)) AS depth, s, b FROM convs),
        rows AS (SELECT conv_id, depth, array_to_string(s[1:depth], ',') AS key, array_to_string(s[1:depth - 1], ',') AS above, CASE WHEN depth > 0 THEN b[depth] ELSE 0 END AS bytes, depth = len(s) AS last FROM steps),
        nodes AS (SELECT depth, key, any_value(above) AS above, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM rows GROUP BY depth, key),
        kids AS (SELECT above, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
        known AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON nodes.key = kids.above AND (nodes.depth > 0 OR nodes.key = '')),
        sums AS (SELECT r.key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * k.bytes) AS saved_tokens FROM known k JOIN rows r ON r.conv_id = k.conv_id AND r.depth <= k.depth GROUP BY r.key)
        SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
        FROM known n JOIN sums s USING (key) LEFT JOIN known up ON n.depth > 0 AND up.key = n.above""",
    "op12_phrase_collocations": """
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        ws AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS w FROM pieces),
        grams AS (SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) AS p FROM ws),
        f AS (SELECT lang, p, count(*) AS f FROM grams GROUP BY ALL),
        total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM ws GROUP BY lang),
        c AS (SELECT * FROM f WHERE len(p) >= 2 AND f >= 30),
        ks AS (SELECT lang, p, f, unnest(range(1, len(p))) AS k FROM c),
        cuts AS (SELECT ks.lang, ks.p, ks.f AS a, k, x.f AS l, y.f AS r, 2000000::HUGEINT * ks.f // (x.f + y.f) AS score FROM ks JOIN f x ON x.lang = ks.lang AND x.p = ks.p[1:k] JOIN f y ON y.lang = ks.lang AND y.p = ks.p[k + 1:]),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
        inner_ AS (SELECT lang, unnest(flatten(list_transform(range(1, len(p)), lambda i: list_transform(range(i + 1, len(p) + 1), lambda j: p[i:j])))) AS q, len(p) AS long, f FROM c),
        around AS (SELECT lang, q, max(f) AS f FROM inner_ WHERE len(q) < long GROUP BY lang, q),
        stays AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, score FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.q = b.p WHERE o.f IS NULL OR 100 * o.f < 80 * a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stays)
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    "op13_sharding": f"""
        WITH {CRC_TABLE},
        d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {crc("coalesce(text, '')")} AS text_crc32, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS k1, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k2 FROM documents, t),
        o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY k1, k2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
        total AS (SELECT sum(size) AS total FROM d),
        edges AS (SELECT i, total * i // 8 AS target, (total::DOUBLE / 8 * 0.01)::BIGINT - ((total::DOUBLE / 8 * 0.01)::BIGINT > total::DOUBLE / 8 * 0.01)::INT AS tolerance FROM total, range(1, 8) r(i)),
        hit AS (SELECT i, target, tolerance, k1, k2, size, before FROM edges JOIN o ON before <= target AND target < before + size),
        levels AS (SELECT part, bits FROM range(1, 3) p(part), (SELECT unnest([12, 20, 28, 36, 44, 52, 60]) AS bits)),
        tried AS (SELECT i, target, tolerance, part, bits, coalesce(sum(o.size) FILTER (CASE WHEN part = 1 THEN o.k1 >> (60 - bits) < hit.k1 >> (60 - bits) ELSE o.k1 < hit.k1 OR o.k1 = hit.k1 AND o.k2 >> (60 - bits) < hit.k2 >> (60 - bits) END), 0) AS lo,
                         sum(o.size) FILTER (CASE WHEN part = 1 THEN o.k1 >> (60 - bits) <= hit.k1 >> (60 - bits) ELSE o.k1 < hit.k1 OR o.k1 = hit.k1 AND o.k2 >> (60 - bits) <= hit.k2 >> (60 - bits) END) AS hi
                  FROM hit, levels, o GROUP BY ALL),
        found AS (SELECT i, CASE WHEN target - lo <= hi - target THEN lo ELSE hi END AS begins FROM tried
                  QUALIFY row_number() OVER (PARTITION BY i ORDER BY least(target - lo, hi - target) > tolerance, CASE WHEN least(target - lo, hi - target) <= tolerance THEN part * 100 + bits ELSE -part * 100 - bits END) = 1),
        dealt AS (SELECT doc_id, size, text_crc32, k1, k2, (SELECT count(*) FROM found WHERE begins <= before)::INT AS shard FROM o)
        SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k1, k2) - 1 AS slot, NULL::INT AS grown_shard FROM dealt""",
}
