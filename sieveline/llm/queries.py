"""The corpus operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import chat_format, decontamination, language, mixing, ngram_lm, page_text, secret_scan, shingle_join, toxicity, vector_search
from sieveline.llm.common import bucket_of, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, accepted; learns from rows outside bucket 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    held = bucket_of(F.col("doc_id"), 4) == 2
    model = language.fit(docs, where=~held)
    return language.classify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_slots, first_slot; weights 5, 2, 1, at most three rounds, blocks of 32 words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).drop("source")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied; values that three owners or more hold, none of them nine tenths, are copied."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{secret_scan.KINDS[k]}") for k in range(3)]
    base = secret_scan.joined(F.filter("spans", lambda s: s["kind"] < secret_scan.BASE))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"), "n_live", "n_copied")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars; conversation -7 is added."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat_format.format_chats(turns.unionByName(added), with_text=False)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns outside bucket 2 of 7.

    Scores are given to nine decimals: what follows depends on the libraries' logarithms.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ngram_lm.score(docs, train=bucket_of(F.col("doc_id"), 7) != 2)
    return found.withColumns({c: F.round(c, 9) for c in ("base_score", "score")})


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; windows of ten words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_hits(docs, table(spark, sf_dir, "benchmark"), width=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    found = page_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: 20 nearest for each row whose id is divisible by 20."""
    return vector_search.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id; shingles of three words, Jaccard index of 0.9."""
    return shingle_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=90)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from labels outside bucket 0 of 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = bucket_of(F.col("doc_id"), 5) == 0
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), where=~held)
    return toxicity.score(docs.withColumn("held_out", held), machine).drop("text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_source_mix": op2_source_mix,
    "op3_secret_scan": op3_secret_scan,
    "op4_chat_format": op4_chat_format,
    "op5_lm_score": op5_lm_score,
    "op6_decontamination": op6_decontamination,
    "op7_page_text": op7_page_text,
    "op8_vector_search": op8_vector_search,
    "op9_shingle_join": op9_shingle_join,
    "op10_toxicity": op10_toxicity,
    "pipeline": pipeline,
}

ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: The checksum of a document's id, bit by bit: SQL has none built in.
CRC32 = """
    xor(list_reduce(
        list_prepend(4294967295::ubigint, [ord(ch)::ubigint for ch in string_split(coalesce(doc_id::varchar, ''), '')]),
        lambda s, b: list_reduce(
            list_prepend(xor(s, b), [0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint]),
            lambda x, _: xor(x >> 1, (x & 1) * 3988292384::ubigint))
    ), 4294967295::ubigint)
"""
OP6_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {ABC}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

#: One kind's matches with their offsets, from the pieces between them.
OP3_KIND = """
    SELECT r, source, {kind} AS kind, list_sum(gaps[1:i]) + coalesce(list_sum(lens[1:i - 1]), 0) AS s,
           list_sum(gaps[1:i]) + list_sum(lens[1:i]) AS e, ms[i] AS found
    FROM (
        SELECT r, source, ms, [length(x) for x in ms] AS lens, [length(x) for x in string_split_regex(t, '{p}')] AS gaps
        FROM (SELECT r, source, t, regexp_extract_all(t, '{p}') AS ms FROM d) WHERE len(ms) > 0
    ), unnest(range(1, len(ms) + 1)) AS u(i)
"""
OP3_ASSIGN = secret_scan.ASSIGN.replace("'", "''")

ORACLE_SQL: dict[str, str] = {
    "op2_source_mix": rf"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
        ),
        s AS (
            SELECT source, sum(size)::bigint AS source_size, 3 * sum(size)::bigint AS cap,
                   list_extract([5, 2, 1], cast((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS integer)) AS weight
            FROM d GROUP BY source
        ),
        f AS (
            SELECT *, row_number() OVER w AS i, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::double
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::double AS level
            FROM s WINDOW w AS (ORDER BY cap / weight, source NULLS LAST), b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ),
        t AS (
            SELECT row_number() OVER (ORDER BY source NULLS LAST) AS k, source, source_size,
                   least(cap::double, (SELECT level FROM f WHERE level <= cap / weight ORDER BY i LIMIT 1) * weight) AS target FROM f
        ),
        a AS (
            SELECT k, round(sum(target) OVER (ORDER BY k) / nullif(sum(target) OVER (), 0) * 4294967296)::bigint AS hi,
                   round(coalesce(sum(target) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / nullif(sum(target) OVER (), 0) * 4294967296)::bigint AS lo FROM t
        ),
        g AS (
            SELECT k, slot, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS rank
            FROM range((SELECT ceil(round(coalesce(sum(target), 0), 3) / 32)::bigint FROM t)) s(slot) JOIN a ON slot * 1640531527 % 4294967296 >= lo AND slot * 1640531527 % 4294967296 < hi
        ),
        c AS (SELECT k, count(*) * 32 AS given FROM g GROUP BY k),
        p AS (
            SELECT row_number() OVER () AS r, doc_id, size, k, source_size, target, coalesce(sum(size) OVER (
                PARTITION BY d.source ORDER BY md5(coalesce(doc_id::varchar, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
            ), 0)::bigint AS pos
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ),
        q AS (
            SELECT r, pos + i * source_size AS a, least(pos + i * source_size + size, coalesce(given, 0)) AS b
            FROM p LEFT JOIN c USING (k), range(3) x(i) WHERE size > 0
        ),
        w AS (
            SELECT r, sum(b - a)::bigint AS taken, sum((b - 1) // 32 - a // 32 + 1)::bigint AS n_slots, min(slot) AS first_slot
            FROM q JOIN p USING (r) JOIN g ON g.k = p.k AND g.rank = a // 32 WHERE b > a GROUP BY r
        )
        SELECT doc_id, size::bigint AS size, source_size, target, coalesce(taken, 0)::bigint AS taken, coalesce(n_slots, 0)::bigint AS n_slots, first_slot
        FROM p LEFT JOIN w USING (r)
    """,
    "op3_secret_scan": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
        found AS ({" UNION ALL ".join(OP3_KIND.format(kind=k, p=p.replace("'", "''")) for k, p in enumerate(secret_scan.PATTERNS))}),
        valued AS (SELECT *, CASE WHEN kind = 0 THEN regexp_extract(found, '{OP3_ASSIGN}', 2) ELSE found END AS v FROM found),
        passing AS (
            SELECT * FROM valued WHERE CASE kind WHEN 0 THEN length(v) >= 6 WHEN 5 THEN regexp_matches(v, '{secret_scan.MIXED}') ELSE true END
        ),
        apart AS (
            SELECT * FROM passing p WHERE kind < 4 OR NOT EXISTS (
                SELECT 1 FROM passing b WHERE b.r = p.r AND b.kind < p.kind AND b.s < p.e AND b.e > p.s)
        ),
        repos AS (SELECT v, source, count(DISTINCT doc_id) + max((doc_id IS NULL)::int) AS n FROM apart JOIN (SELECT r, doc_id FROM d) USING (r) GROUP BY v, source),
        owned AS (SELECT v, count(*) >= 3 AND 10 * max(n) < 9 * sum(n) AS copied FROM repos GROUP BY v),
        held AS (
            SELECT r, s, e, kind, copied, {list(secret_scan.KINDS)}[kind + 1] || ':' || s || ':' || e AS span FROM apart JOIN owned USING (v)
        ),
        g AS (
            SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
                   string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE kind < 3 OR NOT copied) AS spans,
                   count(*) FILTER (WHERE NOT copied) AS n_live, count(*) FILTER (WHERE copied) AS n_copied
            FROM held GROUP BY r
        )
        SELECT doc_id, coalesce(n_assign, 0)::bigint AS n_assign, coalesce(n_access, 0)::bigint AS n_access, coalesce(n_hex, 0)::bigint AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::bigint AS n_live, coalesce(n_copied, 0)::bigint AS n_copied
        FROM d LEFT JOIN g USING (r)
    """,
    "op4_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ),
        e AS (
            SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|(?:INST|OUT|SYS|ROLE|TURN)\]))', '\1\2\\\3', 'g')) AS n,
                   length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|(?:INST|OUT|SYS|ROLE|TURN)\]))', '\1\2\\\3', 'g')) AS rn
            FROM c
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               (3 + sum(n + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 WHEN 'system' THEN 11 ELSE 20 + rn END))::bigint AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op5_lm_score": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, crc32x % 7 = 2 AS held_out,
                   list_append(regexp_extract_all(translate(coalesce(text, ''), {ABC}), '[^\x20\x09-\x0D]+'), chr(10)) AS ws
            FROM (SELECT *, {CRC32} AS crc32x FROM documents)
        ),
        t AS (SELECT r, held_out, ws[p] AS w, CASE WHEN p > 1 THEN ws[p - 1] ELSE '' END AS h FROM d, unnest(range(1, len(ws) + 1)) AS u(p)),
        c1 AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
        c2 AS (SELECT h, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY h, w),
        n AS (SELECT coalesce(sum(c), 0)::bigint AS n, count(*)::bigint AS v FROM c1),
        grid AS (SELECT pow(10, i / 8.0::double) AS k FROM range(33) t(i)),
        best AS (
            SELECT k FROM (SELECT k, sum(c * (k / (c + k))) AS fails FROM c1, grid GROUP BY k), (SELECT count(*) AS once FROM c2 WHERE c = 1)
            ORDER BY abs(fails - once), k LIMIT 1
        ),
        o AS (
            SELECT r, coalesce(a.c, 0) AS cw, coalesce(b.c, 0) AS chw, coalesce(l.c, 0) AS ch,
                   (coalesce(a.c, 0) + 1)::double / (n + v + 1) AS p
            FROM t CROSS JOIN n LEFT JOIN c1 a ON a.w = t.w LEFT JOIN c2 b ON b.h = t.h AND b.w = t.w
            LEFT JOIN c1 l ON l.w = CASE WHEN t.h = '' THEN chr(10) ELSE t.h END
        ),
        g AS (
            SELECT r, count(*) AS n_tokens, count(*) FILTER (WHERE cw > 0) AS n_known, fsum(log10(p)) AS base_score,
                   fsum(CASE WHEN chw > 0 THEN log10((chw + k * p) / (ch + k)) ELSE log10(k / (ch + k)) + log10(p) END) AS score
            FROM o CROSS JOIN best GROUP BY r
        )
        SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base_score, 9) AS base_score, round(score, 9) AS score
        FROM d JOIN g USING (r) CROSS JOIN n
    """,
    "op6_decontamination": f"""
        WITH d AS (SELECT doc_id, {OP6_WORDS} AS ws FROM documents),
        i AS (SELECT coalesce(cast(item_id AS varchar), '') AS item_id, {OP6_WORDS} AS ws FROM benchmark),
        iw AS (
            SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(list_slice(ws, p, p + least(len(ws), 10) - 1), ' ') AS w
            FROM i, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS u(p) WHERE len(ws) > 0
        ),
        dw AS (
            SELECT doc_id, p, n, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS w
            FROM d, (SELECT DISTINCT n FROM iw), unnest(range(1, greatest(len(ws) - n, -1) + 2)) AS u(p)
        ),
        hit AS (SELECT doc_id, p, iw.n, item_id FROM dw JOIN iw ON dw.w = iw.w AND dw.n = iw.n),
        covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + n)) AS u(q) GROUP BY doc_id),
        named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
            FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
        )
        SELECT d.doc_id, len(ws)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit,
               coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op9_shingle_join": rf"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {ABC}), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ),
        s AS (
            SELECT DISTINCT r, array_to_string(list_slice(ws, p, p + 2), ' ') AS g
            FROM d, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1)) + 1)) AS u(p)
        ),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        shared AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
        link AS (
            SELECT x, y FROM shared JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)
        ),
        reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
        SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, min(e.doc_id) AS component_id
        FROM d LEFT JOIN n USING (r) JOIN reach ON reach.x = d.r JOIN d e ON e.r = reach.y GROUP BY d.r, d.doc_id, n.n
    """,
}
