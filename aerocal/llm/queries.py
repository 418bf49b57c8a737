"""One registered query per corpus operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerocal.llm.alignment import align
from aerocal.llm.chunk_dedup import drop_repeated_chunks
from aerocal.llm.common import table
from aerocal.llm.exact_dedup import exact_groups
from aerocal.llm.jaccard_join import near_duplicates
from aerocal.llm.knn_join import integer_vectors, top_k
from aerocal.llm.language_id import identify_languages
from aerocal.llm.mixing import mix
from aerocal.llm.packing import pack_documents
from aerocal.llm.page_text import extract_text
from aerocal.llm.ranked_search import build_index, search
from aerocal.llm.repeats import drop_repeats
from aerocal.llm.token_files import ids_crc32, read_token_files, write_token_files
from aerocal.llm.toxicity import fit_toxicity, score_toxicity
from aerocal.session import scratch_path


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked mixture over sources, languages and topics, tempered by the power 0.7."""
    return mix(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, F.col("vec_id") % 20 == 0)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path, ids_crc32, "long", "ids_crc32")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"), length=100, with_kept=False)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_chunks(table(spark, sf_dir, "documents"), with_kept=False)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "benchmark"), build_index(table(spark, sf_dir, "documents")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_mixing, op2_language_id, op3_topk_search, op4_exact_dedup, op5_token_files, op6_jaccard_join, op7_repeats,
            op8_toxicity, op9_chunk_dedup, op10_packing, op11_ranked_search,
            op12_alignment, op13_page_text,
        )
    }


_LOWER = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

_OP3_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, d.vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM whole q JOIN whole d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id
), ranked AS (
    SELECT query_id, vec_id, score,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_OP4_SQL = f"""
WITH digests AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM digests WINDOW same AS (PARTITION BY text_sha256)
"""

_OP6_SQL = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(
        CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
             WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        END) AS s
    FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * k >= 90 * (p.n + q.n - k)
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other
)
SELECT reach.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.doc_id GROUP BY reach.doc_id
"""


_OP11_SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents
), asked AS (
    SELECT item_id, t, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
        FROM benchmark) GROUP BY item_id, t
), sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), corpus AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sizes
), normal AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // length AS m FROM sizes, corpus
), postings AS (SELECT doc_id, t, count(*) AS tf FROM words WHERE t IN (SELECT t FROM asked) GROUP BY doc_id, t
), weights AS (
    SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
    FROM postings, corpus GROUP BY t
), scores AS (
    SELECT item_id, doc_id,
           CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM asked JOIN postings USING (t) JOIN weights USING (t) JOIN normal USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
           doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""".replace("LOWERED", _LOWER)

#: Holds for pages like those of the table, whose main text is one article without boilerplate inside;
#: only ``&amp;`` and ``&quot;`` occur in it.
_OP13_SQL = r"""
WITH inside AS (
    SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'),
           '</?(b|i|em|a|span)>', '', 'g') AS t FROM pages
), decoded AS (
    SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'),
           '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS t FROM inside
), trimmed AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM trimmed
"""


def _op1_sql(power: float = 0.7, sweeps: int = 6, seed: int = 17) -> str:
    """The sweeps written out as one common table expression for each update."""
    dims = ("source", "lang", "topic")
    parts = ["""
docs AS (
    SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
           coalesce(text, '') AS t,
           CASE WHEN coalesce(text, '') = '' THEN 0
                ELSE length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) + 1 END AS tokens
    FROM documents
), shaped AS (
    SELECT *, length(t) - length(replace(t, chr(10), '')) AS lines,
           length(t) - length(replace(replace(replace(replace(replace(t, '%', ''), '*', ''), '&', ''),
                                      '$', ''), '#', '')) AS signs
    FROM docs
), described AS (
    SELECT doc_id, source, lang, tokens,
           CASE WHEN t = '' THEN 'empty' WHEN signs * 2 >= tokens THEN 'symbols'
                WHEN lines * 6 >= tokens AND lines > 3 THEN 'list' WHEN tokens < 100 THEN 'short'
                WHEN tokens < 1000 THEN 'prose' ELSE 'long' END AS topic
    FROM shaped
), cells AS (
    SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM described
    GROUP BY source, lang, topic
), w0 AS (SELECT *, CAST(tokens AS DOUBLE) AS weight FROM cells WHERE tokens > 0)"""]
    for d in dims:
        parts.append(
            f"goal_{d} AS (SELECT {d}, pow(CAST(sum(tokens) AS DOUBLE), {power}) AS target FROM cells "
            f"GROUP BY {d} HAVING sum(tokens) > 0)"
        )
    for step in range(sweeps * 3):
        d = dims[step % 3]
        parts.append(
            f"w{step + 1} AS (SELECT w.source, w.lang, w.topic, w.tokens, "
            f"w.weight * (g.target / (SELECT sum(target) FROM goal_{d})) / sum(w.weight) OVER (PARTITION BY w.{d}) "
            f"AS weight FROM w{step} w JOIN goal_{d} g ON g.{d} = w.{d})"
        )
    last = f"w{sweeps * 3}"
    return (
        "WITH " + ", ".join(p.strip() for p in parts) + f""",
raked AS (
    SELECT c.source, c.lang, c.topic,
           coalesce(w.weight * (SELECT CAST(sum(tokens) AS DOUBLE) FROM cells) / c.tokens, 0) AS multiplier
    FROM cells c LEFT JOIN {last} w USING (source, lang, topic)
), chances AS (
    SELECT *, least(multiplier * (1 / (SELECT max(multiplier) FROM raked)), 1.0) AS p FROM raked
)
SELECT doc_id, source, lang, topic, tokens, round(multiplier, 6) AS multiplier, round(p, 6) AS probability,
       CAST(('0x' || substr(md5(doc_id || ':{seed}'), 1, 8)) AS BIGINT) / 4294967296.0 < p AS drawn
FROM described JOIN chances USING (source, lang, topic)
"""
    )


def oracle_sql() -> dict[str, str]:
    """SQL that must give the same rows, where SQL can express the query."""
    return {
        "op1_mixing": _op1_sql(), "op3_topk_search": _OP3_SQL, "op4_exact_dedup": _OP4_SQL,
        "op6_jaccard_join": _OP6_SQL, "op11_ranked_search": _OP11_SQL, "op13_page_text": _OP13_SQL,
    }
