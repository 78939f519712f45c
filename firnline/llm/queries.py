"""Queries of the corpus operators: thin calls with production parameters over the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from firnline.llm import bpe_codec, exact_index, fill_in_middle, fingerprints, html_extract, line_dedup, minhash, mixing, quality_gam, spelling, suffix_dedup, super_kmers, token_counts
from firnline.llm.common import documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_index.exact_duplicates(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle_digests(documents(spark, sf_dir))


def op13_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return super_kmers.without_repeated_windows(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_minhash": op5_minhash,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixing": op8_mixing,
    "op9_html_extract": op9_html_extract,
    "op10_quality_gam": op10_quality_gam,
    "op11_spelling": op11_spelling,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_super_kmers": op13_super_kmers,
}

ORACLES: dict[str, str] = {
    "op3_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        windows AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM d)),
        hits AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
        marked AS (SELECT doc_id, s, coalesce(s > max(s + 100) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS fresh FROM hits),
        grouped AS (SELECT doc_id, s, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM marked),
        spans AS (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS b FROM grouped GROUP BY doc_id, k),
        ends AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
        cut AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM ends JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
               sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id)""",
    "op5_minhash": r"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        shingled AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
            FROM worded),
        flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM shingled),
        shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common
            FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM shared WHERE 100 * common >= 75 * (n + m - common)),
        reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT d.doc_id, any_value(len(d.s)) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
        FROM shingled d JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id""",
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op8_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   CAST('0x' || substr(md5('20250:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS draw
            FROM documents),
        totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        placed AS (
            SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS position, 2.0::DOUBLE * source_size AS most,
                   [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight
            FROM totals),
        leveled AS (
            SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER (ORDER BY most / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (ORDER BY most / weight, position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM placed),
        targets AS (
            SELECT source, position, source_size, CASE WHEN level * weight >= most OR water IS NULL THEN most ELSE least(most, water * weight) END AS target
            FROM leveled, (SELECT min_by(level, (most / weight, position)) FILTER (level * weight < most) AS water FROM leveled)),
        quotas AS (
            SELECT position, count(*) FILTER (place <= house) AS quota
            FROM (SELECT position, row_number() OVER (ORDER BY target / (2 * s + 1) DESC, position, s) AS place, (SELECT round(sum(target) / 64) FROM targets) AS house
                  FROM (SELECT position, target, unnest(range(0, CAST(ceil(target / 64) AS BIGINT) + (SELECT count(*) FROM targets) + 2)) AS s FROM targets WHERE target > 0))
            GROUP BY position),
        dealt AS (
            SELECT doc_id, s.source, size, draw, source_size, target, t.position, coalesce(quota, 0) AS quota,
                   draw % greatest(CAST(ceil(source_size / 1048576) AS BIGINT), 1) AS shard
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN quotas q ON q.position = t.position),
        shards AS (SELECT position, shard, any_value(quota) AS source_quota, CAST(sum(size) AS BIGINT) AS shard_size, CAST(ceil(sum(size) / 64) AS BIGINT) AS blocks FROM dealt GROUP BY position, shard),
        seats AS (
            SELECT position, shard, count(*) FILTER (place <= source_quota) AS quota
            FROM (SELECT position, shard, source_quota, row_number() OVER (PARTITION BY position ORDER BY shard_size / (2 * s + 1) DESC, shard, s) AS place
                  FROM (SELECT *, unnest(range(0, 2 * blocks + (SELECT count(*) FROM shards) + 2)) AS s FROM shards WHERE shard_size > 0))
            GROUP BY position, shard),
        shares AS (SELECT s.position, s.shard, blocks, least(quota, 2 * blocks) // blocks AS passes, least(quota, 2 * blocks) % blocks AS rest FROM shards s JOIN seats q ON s.position = q.position AND s.shard = q.shard),
        drawn AS (
            SELECT *, row_number() OVER (PARTITION BY position, shard ORDER BY draw, block) AS place
            FROM (SELECT position, shard, rest, block, CAST('0x' || substr(md5('20250:block:' || position || ':' || shard || ':' || block), 1, 15) AS BIGINT) AS draw
                  FROM (SELECT *, unnest(range(0, blocks)) AS block FROM shares))),
        ordered AS (SELECT *, row_number() OVER () AS line, coalesce(sum(size) OVER (PARTITION BY position, shard ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM dealt),
        pieces AS (
            SELECT line, position, shard, block, least(before + size, (block + 1) * 64) - greatest(before, block * 64) AS words
            FROM (SELECT *, unnest(range(CAST(before // 64 AS BIGINT), CAST((before + size - 1) // 64 AS BIGINT) + 1)) AS block FROM ordered WHERE size > 0)),
        once AS (SELECT line, sum(words) AS words FROM pieces JOIN drawn USING (position, shard, block) WHERE place <= rest GROUP BY line)
        SELECT doc_id, size, source_size, target, CAST(coalesce(passes, 0) * size + coalesce(words, 0) AS BIGINT) AS taken, source
        FROM ordered o LEFT JOIN shares h ON o.position = h.position AND o.shard = h.shard LEFT JOIN once USING (line)""",
    "op11_spelling": r"""
        WITH RECURSIVE steps AS (
            SELECT list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS crc, x
            FROM (SELECT unnest(range(0, 256)) AS x)),
        crcs AS MATERIALIZED (SELECT list(crc ORDER BY x) AS t FROM steps),
        found AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
        each AS (SELECT doc_id, w, count(*) AS times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS h FROM found GROUP BY doc_id, w),
        summed AS (
            SELECT w, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, CAST(length(h) AS BIGINT), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
                   lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS BIGINT) + 1])), 4294967295) AS crc
            FROM each, crcs),
        kept AS (SELECT CASE WHEN crc % 31 = 0 THEN left(w, crc % length(w)) || substr(w, crc % length(w) + 2) ELSE w END AS word, times FROM summed),
        words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
        cut AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS d, length(word) AS size FROM (SELECT *, unnest(range(0, CAST(length(word) AS BIGINT))) AS i FROM words)),
        near AS (
            SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.d = b.d AND a.i = b.i AND a.size = b.size AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.d = b.word
            UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.d = b.word),
        best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word),
        formed AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN most END AS form_n,
                   CASE WHEN most >= 10 * w.n THEN (SELECT min(hex(encode(other))) FROM near x WHERE x.word = w.word AND x.n = most) END AS form
            FROM words w LEFT JOIN best USING (word)),
        named AS MATERIALIZED (SELECT word, n, n_near, form_n, decode(unhex(form)) AS form FROM formed),
        led(word, last) AS (SELECT word, word FROM named UNION SELECT l.word, m.form FROM led l JOIN named m ON l.last = m.word WHERE m.form IS NOT NULL)
        SELECT m.word, m.form, l.last AS root, m.n, m.n_near, m.form_n
        FROM named m JOIN led l ON l.word = m.word JOIN named e ON e.word = l.last AND e.form IS NULL""",
    "op12_fill_in_middle": r"""
        WITH lined AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
        drawn AS (
            SELECT *, len(u) AS n, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain,
                   CAST('0x' || d[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || d[9:16] AS BIGINT) % (len(u) + 1) AS y, CAST('0x' || d[25:32] AS BIGINT) % 100 < 50 AS spm
            FROM lined),
        cut AS (
            SELECT *, CASE WHEN least(x, y) = 0 THEN '' ELSE array_to_string(u[1:least(x, y)], '') END AS p,
                   CASE WHEN x = y THEN '' ELSE array_to_string(u[least(x, y) + 1:greatest(x, y)], '') END AS m,
                   CASE WHEN greatest(x, y) = n THEN '' ELSE array_to_string(u[greatest(x, y) + 1:n], '') END AS s
            FROM drawn)
        SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
               CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
               sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM cut""",
    "op13_super_kmers": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
        hits AS (SELECT doc_id, s FROM windows QUALIFY count(*) OVER (PARTITION BY g) > 1),
        each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS s FROM d),
        judged AS (
            SELECT doc_id, s, word, max(CASE WHEN h.s IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
            FROM each LEFT JOIN hits h USING (doc_id, s)),
        cut AS (SELECT doc_id, count(*) AS words, sum(gone) AS removed, string_agg(word, ' ' ORDER BY s) FILTER (gone = 0) AS kept FROM judged GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(words, 0) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id)""",
}
