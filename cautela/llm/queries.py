"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cautela.llm.common import Scratch, table
from cautela.llm.conversation_repair import audits, damage_conversations, repair_digests
from cautela.llm.language_id import held_out, identify, learn_languages
from cautela.llm.line_dedup import dedup_lines
from cautela.llm.near_dedup import near_duplicates
from cautela.llm.packing import pack_documents
from cautela.llm.personal_data import BASE_PATTERNS, KINDS, SECRET, find_personal_data, written
from cautela.llm.quality_rules import BANDS, CHANCE, FALSE_REJECTIONS, RULES, TOP, cutoffs, measure, verdicts
from cautela.llm.sentence_pieces import encode_pieces
from cautela.llm.tile_search import nearest
from cautela.llm.token_counts import count_tokens
from cautela.llm.token_files import token_index, write_token_files
from cautela.llm.tree_search import exact_top_k
from cautela.llm.whitening import whiten

#: Names of public tokenizer files, which every machine finds for itself; an absolute path would do as well.
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and hash of the ids, and whether decoding them gives the text back."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = encode_pieces(documents, PIECE_BPE, decoded="decoded")
    return decoded.select(
        "doc_id",
        F.when(F.col("piece_ids").isNull(), F.lit(0)).otherwise(F.size("piece_ids")).cast("long").alias("n_pieces"),
        F.xxhash64("piece_ids").alias("ids_hash"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, spans = F.col("personal_data.base"), F.col("personal_data.spans")
    counts = (
        F.size(F.filter(base, lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{KINDS[kind]}")
        for kind in BASE_PATTERNS
    )
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(written(base), 256).alias("base_sha256"),
        written(spans).alias("spans"),
        F.size(spans).cast("long").alias("n_spans"),
        F.size(F.filter(spans, lambda s: s["kind"] == F.lit(SECRET))).cast("long").alias("n_secret"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    told = identify(documents.select("doc_id", "text"), learn_languages(documents), keep_text=False)
    language = (F.col("language_id.language").alias("lang_pred"), F.col("language_id.score").alias("score"))
    return told.select("doc_id", held_out("doc_id").alias("held_out"), *language)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'token-files').folder}/ids"
    write_token_files(table(spark, sf_dir, "documents"), path, BYTE_BPE)
    return token_index(spark, path)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents"))
    counts = (F.col(f"line_dedup.{c}").alias(c) for c in ("n_lines", "n_removed"))
    return rows.select("doc_id", *counts, F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = damage_conversations(conversations)
    found = audits(rows, conversations.select(F.col("conv_id").alias("conv")), Scratch(spark, "repair"))
    return repair_digests(rows, found).withColumnRenamed("conv", "conv_id")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), k=32)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = Scratch(spark, "quality").save(measure(table(spark, sf_dir, "documents")))
    judged = verdicts(measured, cutoffs(measured, table(spark, sf_dir, "labels")))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *counts, "base_failed", "kept")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_sentence_pieces": op3_sentence_pieces,
    "op4_personal_data": op4_personal_data,
    "op5_language_id": op5_language_id,
    "op6_token_files": op6_token_files,
    "op7_line_dedup": op7_line_dedup,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_near_dedup": op9_near_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_quality_rules": op13_quality_rules,
}
_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_WORD = "[^\\x20\\x09-\\x0D]"

ORACLES: dict[str, str] = {
    "op2_exact_top_k": f"""
        WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings WHERE {_USABLE}),
        s AS (SELECT q.id AS query_id, d.id AS vec_id, list_dot_product(q.vec, d.vec)::BIGINT AS score
              FROM v q JOIN v d ON q.id <> d.id WHERE q.id % 50 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
    "op8_nearest_neighbours": f"""
        WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings
                   WHERE {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT q.id AS query_id, d.id AS vec_id, list_dot_product(q.vec, d.vec) AS score
              FROM v q JOIN v d ON q.id <> d.id WHERE q.id % 20 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 20""",
    "op9_near_dedup": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
            ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END AS sh
            FROM w),
        n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
        u AS (SELECT doc_id, unnest(sh) AS sh FROM s),
        meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * i >= 75 * (x.n_shingles + y.n_shingles - i)),
        sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, sides.b FROM reach JOIN sides ON sides.a = reach.b)
        SELECT n.doc_id, any_value(n_shingles) AS n_shingles, min(reach.b) AS component_id, n.doc_id = min(reach.b) AS kept
        FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id""",
    # CRC-32 byte by byte from its polynomial; the audit by a pass over the grammar's states instead of its strings.
    "op11_conversation_repair": f"""
        WITH RECURSIVE byte_table AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
                lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
        keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS rid,
            coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        coded AS (SELECT keyed.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(k) + 1),
                lambda i: ord(substr(k, i, 1))::BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 20 AS kind
            FROM keyed, byte_table),
        damaged AS (SELECT conv_id, turn, rid, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM coded WHERE kind <> 0),
        placed AS (SELECT *, row_number() OVER w AS i,
                row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, rid, copy) AS seen,
                lag(role) OVER w AS before
            FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), rid, copy)),
        marked AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{_WORD}') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
                count_if(fault = 'blank')::BIGINT AS blank, count_if(fault = 'duplicate')::BIGINT AS duplicate,
                count_if(fault = 'truncated')::BIGINT AS truncated,
                count_if(before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(i) AS n
            FROM marked GROUP BY conv_id),
        pushed(p, q, cost, letters) AS (VALUES ('S','S',0,''), ('T','T',0,''), ('A','A',0,''), ('U','U',0,''), ('S','A',5,'I'),
            ('T','A',5,'I'), ('U','A',5,'I'), ('A','U',5,'I'), ('S','U',10,'II'), ('T','U',10,'II')),
        taken(p, q, role) AS (VALUES ('S','T','s'), ('S','A','u'), ('T','A','u'), ('U','A','u'), ('A','U','a')),
        edits AS (SELECT marked.conv_id, i, q.p, q.q, CASE WHEN q.role IS NULL THEN 2 ELSE (left(marked.role, 1) <> q.role)::INTEGER
                + 5 * (fault = 'truncated')::INTEGER END AS cost,
                CASE WHEN q.role IS NULL THEN 'D' WHEN left(marked.role, 1) = q.role THEN 'K' ELSE 'R' END AS letter
            FROM marked JOIN (SELECT p, q, role FROM taken UNION ALL SELECT DISTINCT q, q, NULL FROM pushed) q
                ON q.role IS NULL OR fault NOT IN ('blank', 'duplicate') AND (q.role <> 's' OR left(marked.role, 1) = 's')),
        ways AS (
            SELECT conv_id, 0::BIGINT AS i, 'S' AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM counts
            UNION ALL
            SELECT ways.conv_id, ways.i + 1, edits.q, min({{'cost': best.cost + pushed.cost + edits.cost,
                'audit': best.audit || letters || letter}})
            FROM ways JOIN pushed ON pushed.p = ways.state
                JOIN edits ON edits.conv_id IS NOT DISTINCT FROM ways.conv_id AND edits.i = ways.i + 1 AND edits.p = pushed.q
            GROUP BY ways.conv_id, ways.i, edits.q),
        ended AS (SELECT ways.conv_id, min({{'cost': best.cost + pushed.cost, 'audit': best.audit || letters}}) AS best
            FROM ways JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ways.conv_id AND ways.i = counts.n
                JOIN pushed ON pushed.p = ways.state WHERE pushed.q IN ('S', 'U') GROUP BY ways.conv_id),
        letters AS (SELECT conv_id, unnest(range(1, len(best.audit) + 1)) AS spot, best.audit AS audit FROM ended),
        steps AS (SELECT conv_id, spot, substr(audit, spot, 1) AS edit, len(replace(left(audit, spot), 'I', '')) AS i,
            len(replace(left(audit, spot), 'D', '')) - len(replace(audit, 'D', '')) % 2 AS place FROM letters),
        lines AS (SELECT steps.conv_id, spot, CASE WHEN edit = 'K' THEN marked.role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END
                || ':' || CASE WHEN edit = 'I' THEN '' ELSE marked.text END AS line
            FROM steps LEFT JOIN marked ON marked.conv_id IS NOT DISTINCT FROM steps.conv_id AND marked.i = steps.i AND edit <> 'I'
            WHERE edit <> 'D'),
        joined AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY spot) AS whole FROM lines GROUP BY conv_id)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
            coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
            coalesce(best.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
            LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM o.conv_id
            LEFT JOIN joined ON joined.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op13_quality_rules": f"""
        WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
                list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
        single AS (SELECT rid, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w),
        triple AS (SELECT rid, i, a, lead(a) OVER s AS b, lead(a, 2) OVER s AS c FROM single WINDOW s AS (PARTITION BY rid ORDER BY i)),
        twice AS (SELECT rid, i FROM triple WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
        inside AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY rid),
        m AS (SELECT rid, doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: len(x))), 0)::BIGINT AS word_chars,
                len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines) AS n_lines,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(inside.n, 0)::BIGINT AS n_repeat_words
            FROM w LEFT JOIN inside USING (rid)),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                {" + ".join(f"(n_words >= {first})::INTEGER" for first in BANDS[1:])} AS stratum FROM m),
        steps AS ({" UNION ALL ".join(
            f"SELECT rid, doc_id, stratum, base_failed, '{rule}' AS rule, "
            f"coalesce(least({scale} * {part} // nullif({whole}, 0), {TOP}), 0) AS step FROM f"
            for rule, (part, whole, scale) in RULES.items())}),
        known AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
        counts AS (SELECT stratum, rule, step, count_if(good) AS good, count_if(NOT good) AS bad
            FROM steps JOIN known USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
        reach AS (SELECT stratum, rule, step, sum(good) OVER above AS good, sum(bad) OVER above AS bad,
                sum(good) OVER (PARTITION BY stratum, rule) AS n, sum(bad) OVER (PARTITION BY stratum, rule) AS n_bad
            FROM counts WINDOW above AS (PARTITION BY stratum, rule ORDER BY step DESC)),
        sizes AS (SELECT DISTINCT n FROM reach WHERE n > 0),
        chances AS (SELECT n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({{p}}) + (n - k) * ln(1 - {{p}})) AS x
            FROM (SELECT n, unnest(range(0, least(n, floor(n * {{p}}) + 1)::BIGINT + 1)) AS k FROM sizes)),
        allowed AS (SELECT n, max(k) AS k FROM (SELECT n, k, sum(x) OVER (PARTITION BY n ORDER BY k) AS total FROM chances)
            WHERE total <= {CHANCE} / {len(BANDS) * len(RULES)} GROUP BY n),
        best AS (SELECT stratum, rule, step AS cutoff FROM reach JOIN allowed USING (n) WHERE good <= k AND n_bad > 0 AND bad * n > good * n_bad
            QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bad * n - good * n_bad DESC, step DESC) = 1),
        hit AS (SELECT DISTINCT rid FROM steps JOIN best USING (stratum, rule) WHERE step >= cutoff)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND hit.rid IS NULL AS kept
        FROM f LEFT JOIN hit USING (rid)""".replace("{p}", f"({FALSE_REJECTIONS} / {len(RULES)})"),
}
