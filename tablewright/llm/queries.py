"""The registered queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import classifier, exactdup, infill, langid, mixing, neardup, packing, pagetext, prefixtrie, quality_rules, secrets, substring, tokens
from tablewright.llm.common import crc32_of_id, documents, labels

VOCABULARY = "word_bpe_49k.json"
#: Quality score from which a document counts as label 1.
THRESHOLD = 0.3


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), limit=2048)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), words=5, percent=75)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir)).drop("rejected_by")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), weights=(5, 2, 1), epochs=3).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(F.pmod(crc32_of_id(), F.lit(4)) == 2, F.lit(False))
    samples = langid.train(docs, learn=~held & F.col("doc_id").isNotNull())
    return langid.identify(docs, samples).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(documents(spark, sf_dir), words=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), length=2048, end_id=1)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_spans(documents(spark, sf_dir)))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = classifier.train(docs, labels(spark, sf_dir), parts=5, held=0)
    held = F.coalesce(F.pmod(crc32_of_id(), F.lit(5)) == 0, F.lit(False))
    return classifier.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.main_text(pagetext.pages(spark, sf_dir)).drop("n_repeated")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(prefixtrie.conversations(spark, sf_dir), group=5, heads=9)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.fill_in_middle(documents(spark, sf_dir), seed=42, share=50, spm_share=80))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_near_duplicates, op3_quality_rules, op4_source_mix, op5_language,
        op6_repeated_passages, op7_exact_duplicates, op8_packing, op9_secrets, op10_quality_classifier,
        op11_main_text, op12_prefix_trie, op13_fill_in_middle,
    )
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_near_duplicates": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOWER)} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
        r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.c),
        c AS (SELECT a, min(c) AS c FROM r GROUP BY a)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
        FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op3_quality_rules": rf"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
        h AS (SELECT doc_id, i, md5(array_to_string(w[i:i+4], ' ')) AS h FROM g),
        d AS (SELECT doc_id, h FROM h GROUP BY doc_id, h HAVING count(*) > 1),
        k AS (SELECT DISTINCT h.doc_id, h.i + unnest(range(0, 5)) AS k FROM h JOIN d USING (doc_id, h)),
        r AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id),
        b AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
              CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
              CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
              len(lines) AS n_lines, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS caps,
              len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stutter
              FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
        f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= n_words AND 2 * n_dup_lines <= n_lines
               AND 2 * caps <= word_chars AND 5 * stutter <= n_words AS kept FROM f""",
    "op4_source_mix": rf"""
        WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][(n - 1) % 3 + 1]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM s),
        l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
              / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        t AS (SELECT source, source_size, least(most, (SELECT max(level) FROM l WHERE most / weight >= level) * weight) AS target FROM l),
        r AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS wanted,
              coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
              FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
        SELECT doc_id, size, source_size, round(target, 6) AS target,
               CAST(CASE WHEN source_size = 0 THEN 0 ELSE size * (wanted // source_size) + least(size, greatest(wanted % source_size - ahead, 0)) END AS BIGINT) AS taken FROM r""",
    "op6_repeated_passages": rf"""
        WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        x AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
        y AS (SELECT doc_id, i, md5(array_to_string(w[i:i+12], ' ')) AS h FROM x),
        f AS (SELECT h, min(doc_id) AS first FROM y GROUP BY h HAVING min(doc_id) < max(doc_id)),
        g AS (SELECT DISTINCT y.doc_id, y.i + unnest(range(0, 13)) AS k FROM y JOIN f ON f.h = y.h AND f.first < y.doc_id),
        p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM w),
        o AS (SELECT p.doc_id, count(g.k) AS gone, string_agg(CASE WHEN g.k IS NULL THEN p.word END, ' ' ORDER BY p.k) AS kept
              FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.k = p.k GROUP BY p.doc_id)
        SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN o ON o.doc_id = w.doc_id""",
    "op7_exact_duplicates": rf"""
        WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, {_LOWER} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (t)""",
    "op12_prefix_trie": """
        WITH t AS (SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        h AS (SELECT c, own, c - c % 5 AS b, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
              lambda crc, x: list_reduce([xor(crc, x)] || range(8), lambda y, i: xor(y >> 1, 3988292384 * (y & 1))))) % 9 AS h FROM t),
        r AS (SELECT h.c, coalesce(f.own[1:h.h], []) || h.own[h.h + 1:] AS s FROM h LEFT JOIN t f ON f.c = h.b),
        p AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r),
        n AS (SELECT s[1:d] AS s, d, min(c) AS c, count(*) AS n, string_agg(CASE WHEN len(s) = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends FROM p GROUP BY 1, 2),
        k AS (SELECT s[1:d - 1] AS s, count(*) AS k FROM n WHERE d > 0 GROUP BY 1),
        m AS (SELECT n.*, coalesce(k.k, 0) AS k, CASE WHEN n.d > 0 THEN (n.n - 1) * strlen(n.s[n.d].text) ELSE 0 END AS v FROM n LEFT JOIN k ON k.s = n.s),
        u AS (SELECT s[1:a] AS s, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum(v) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY 1)
        SELECT m.c AS conv_id, m.d AS depth, q.c AS parent_conv_id, m.n AS n_convs, m.k AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens,
               sha256(coalesce(m.ends, '')) AS ends_sha256
        FROM m JOIN u ON u.s = m.s LEFT JOIN m q ON q.s = m.s[1:m.d - 1] AND m.d > 0""",
    "op13_fill_in_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                   sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        n AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
              CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
                   WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
        p AS (SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
              array_to_string(u[greatest(a, b) + 1:], '') AS suffix FROM n)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
}
