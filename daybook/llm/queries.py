"""One query for each operator, over whole tables with production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .html_extract import extract
from .language_model import score_documents
from .merkle import manifest
from .near_join import near_join
from .packing import pack
from .quality import classify
from .secrets import find_secrets
from .surrogates import replace_entities
from .token_counts import token_counts
from .token_output import token_output

#: Key of the surrogates in the query; a deployment passes its own.
SURROGATE_KEY = b"daybook-surrogates"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vector_packing(spark, sf_dir):
    return pack(spark, table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark, sf_dir):
    return near_join(spark, table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(spark, table(spark, sf_dir, "documents"), keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_quality_classifier(spark, sf_dir):
    return classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_output(spark, sf_dir):
    return token_output(spark, table(spark, sf_dir, "documents"))


def op6_secret_scan(spark, sf_dir):
    return find_secrets(spark, table(spark, sf_dir, "documents"))


def op7_html_extraction(spark, sf_dir):
    return extract(spark, table(spark, sf_dir, "pages"))


def op8_decontamination(spark, sf_dir):
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii_surrogates(spark, sf_dir):
    return replace_entities(spark, table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op10_lattice_scores(spark, sf_dir):
    return score_documents(spark, table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, shifted)
    return found.drop("anchor_key", "positive_key")


def op12_merkle_manifest(spark, sf_dir):
    docs, capitals = table(spark, sf_dir, "documents"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.when(hit, F.translate("text", capitals, capitals.lower())).otherwise(F.col("text"))
    return manifest(spark, docs, tampered={"text": lowered})


def op13_token_counts(spark, sf_dir):
    return token_counts(spark, table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_vector_packing, op2_ngram_jaccard_join, op3_exact_dedup, op4_quality_classifier, op5_token_output,
    op6_secret_scan, op7_html_extraction, op8_decontamination, op9_pii_surrogates, op10_lattice_scores,
    op11_hard_negatives, op12_merkle_manifest, op13_token_counts,
)}

SQL = {
    "op3_exact_dedup": """
        WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
        FROM d JOIN g ON d.text = g.text
    """,
    "op8_decontamination": """
        WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
        bs AS (SELECT DISTINCT item_id, k, s FROM (SELECT item_id, least(len(w), 5) AS k, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM b WHERE len(w) > 0)),
        ks AS (SELECT DISTINCT k FROM bs),
        ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS s FROM d, ks WHERE len(w) >= k)),
        n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
        m AS (SELECT ds.doc_id, bs.item_id, count(*) AS n_shared FROM ds JOIN bs ON ds.s = bs.s GROUP BY ds.doc_id, bs.item_id)
        SELECT m.doc_id, m.item_id, CAST(m.n_shared AS BIGINT) AS n_shared, CAST(n.n_item AS BIGINT) AS n_item, m.n_shared / n.n_item AS containment
        FROM m JOIN n ON m.item_id = n.item_id WHERE m.n_shared >= 0.8 * n.n_item - 1e-9
    """,
    "op11_hard_negatives": """
        WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
        n AS (SELECT p.*, other_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
    "op12_merkle_manifest": """
        WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)),
        f AS (SELECT *, CASE WHEN xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: xor(a // 256, t[(xor(a, b) % 256) + 1]), 4294967295), 4294967295) % 5 = 0
            THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS low,
            CASE WHEN doc_id IS NULL THEN '-' ELSE len(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
            || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE len(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head FROM documents, crc),
        d AS (SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf, sha256(head || CASE WHEN low IS NULL THEN '-' ELSE strlen(low) || ':' || low END) AS other FROM f),
        l AS (SELECT *, coalesce('=' || source, '-') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
        t AS (SELECT g, 0 AS level, list(leaf ORDER BY i) AS nodes FROM l GROUP BY g
            UNION ALL SELECT g, level + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1 : i + 16], ''))) FROM t WHERE len(nodes) > 1),
        s AS (SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM t WHERE len(nodes) = 1),
        u AS (SELECT 0 AS level, list(subroot ORDER BY i) AS nodes FROM s
            UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1 : i + 16], ''))) FROM u WHERE len(nodes) > 1),
        steps AS (SELECT l.doc_id, l.leaf, l.other, l.g, l.i, t.level, nodes, l.i // CAST(pow(16, t.level) AS BIGINT) AS k FROM l JOIN t ON l.g = t.g AND len(nodes) > 1
            UNION ALL SELECT l.doc_id, l.leaf, l.other, l.g, l.i, 100 + u.level, nodes, s.i // CAST(pow(16, u.level) AS BIGINT) FROM l JOIN s ON l.g = s.g JOIN u ON len(nodes) > 1),
        p AS (SELECT g, i, list(array_to_string(nodes[k - k % 16 + 1 : k], '') || '|' || array_to_string(nodes[k + 2 : k - k % 16 + 16], '') ORDER BY level) AS proof FROM steps GROUP BY g, i),
        r AS (SELECT l.doc_id, l.leaf, s.subroot, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root, sha256(replace(array_to_string(coalesce(proof, []), ''), '|', '')) AS proof_sha256,
            coalesce(list_reduce(proof, lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2)), other), other) AS folded_root FROM l JOIN s ON l.g = s.g LEFT JOIN p ON p.g = l.g AND p.i = l.i)
        SELECT *, folded_root = root AS verified FROM r
    """,
}
