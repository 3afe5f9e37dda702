"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellpath.llm import chunk_dedup, decontaminate, knn_join, langid, mixing, pseudo_likelihood, quality_rules, sanitise, shingle_join, source_divergence, tokenizer_alignment, url_filter, warc_zst
from fellpath.llm._tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a network trained on all documents."""
    docs = table(spark, sf_dir, "documents")
    return pseudo_likelihood.score(docs, pseudo_likelihood.train(docs))


RULES = [url_filter.parse_rule(*r) for r in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url, by rule or by model."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    return knn_join.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, with the passages."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc_zst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back from them."""
    back = warc_zst.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op5_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every document, as spans."""
    found = sanitise.detect(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", sanitise.digest(found["base"])).drop("base")


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that documents share, and their first holders."""
    return chunk_dedup.shared_regions(table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, where=~langid.held_out())
    scored = langid.predict(docs, model, ["doc_id"])
    return scored.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of shingles and its class of near duplicates."""
    return shingle_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, by pairs and by terms."""
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links of the tokens of two tokenizers."""
    return tokenizer_alignment.align(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by plain rules and by how often its lines recur in its source."""
    judged = quality_rules.measure(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_voronoi_knn": op2_voronoi_knn,
    "op3_decontaminate": op3_decontaminate,
    "op4_warc_zst": op4_warc_zst,
    "op5_sanitise": op5_sanitise,
    "op6_chunk_dedup": op6_chunk_dedup,
    "op7_langid": op7_langid,
    "op8_shingle_join": op8_shingle_join,
    "op9_mixing": op9_mixing,
    "op10_pseudo_likelihood": op10_pseudo_likelihood,
    "op11_source_divergence": op11_source_divergence,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_quality_rules": op13_quality_rules,
}

#: The others cannot be written in SQL; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_warc_zst": """
        WITH d AS (
          SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to, NULL::VARCHAR AS error
        FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest
    """,
    "op2_voronoi_knn": """
        WITH valid AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
          FROM valid q JOIN valid d ON q.vec_id <> d.vec_id
          WHERE q.vec_id % 50 = 0),
        ranked AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
          FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op11_source_divergence": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        found AS (
          SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM d),
        terms AS (
          SELECT r, lang, source, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM found),
        kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
        sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM d),
        counts AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM terms t JOIN kept k USING (lang, term) GROUP BY ALL),
        every AS (
          SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c
          FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
        n_of AS (SELECT lang, source, sum(c) AS n FROM every GROUP BY ALL),
        p_of AS (
          SELECT e.lang, e.source, e.term, e.c, 1 + (1000000000::HUGEINT * (e.c + 5)) // (n.n + 5 * s.v)::HUGEINT AS p
          FROM every e JOIN n_of n USING (lang, source) JOIN sizes s USING (lang)),
        whole AS (SELECT lang, term, sum(c) AS c FROM every GROUP BY ALL),
        q_of AS (
          SELECT w.lang, w.term, 1 + (1000000000::HUGEINT * (w.c + 5)) // (n.n + 5 * s.v)::HUGEINT AS q
          FROM whole w JOIN (SELECT lang, sum(n) AS n FROM n_of GROUP BY lang) n USING (lang) JOIN sizes s USING (lang)),
        sums AS (
          SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
          FROM p_of a JOIN p_of b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        above AS (
          SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(p.p - q.q AS BIGINT) AS value
          FROM p_of p JOIN q_of q USING (lang, term) WHERE p.c > 0 AND p.p > q.q)
        SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
        UNION ALL
        SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM above)
        WHERE rank <= 50
    """,
    "op13_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text AS raw, coalesce(text, '') AS body FROM documents),
        w AS (SELECT r, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words FROM d),
        starts AS (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w),
        windows AS (SELECT r, i, list_slice(words, i, i + 7) AS held FROM starts),
        twice AS (SELECT r, unnest(list(i)) AS i FROM windows GROUP BY r, held HAVING count(*) > 1),
        covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(8) AS t(k) GROUP BY r),
        lines AS (
          SELECT r, source, raw, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
                 trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS plain
          FROM (SELECT r, source, raw, unnest(string_split(body, chr(10))) AS line FROM d)),
        twin AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE n > 0 GROUP BY r),
        texts AS (SELECT source, count(DISTINCT raw) AS n FROM d GROUP BY source),
        often AS (
          SELECT l.source, l.plain FROM lines l JOIN texts t ON t.source IS NOT DISTINCT FROM l.source
          WHERE l.n > 0 AND l.raw IS NOT NULL
          GROUP BY l.source, l.plain, t.n HAVING count(DISTINCT l.raw) > greatest(5, t.n * CAST(0.1 AS DOUBLE))),
        gone AS (
          SELECT l.r, sum(l.n) AS n FROM lines l JOIN often o ON o.source IS NOT DISTINCT FROM l.source AND o.plain = l.plain GROUP BY l.r),
        measured AS (
          SELECT d.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.body, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(d.body, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(t.n, 0) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(w.words) - coalesce(g.n, 0) AS BIGINT) AS words_left
          FROM d JOIN w USING (r) LEFT JOIN covered c USING (r) LEFT JOIN twin t USING (r) LEFT JOIN gone g USING (r)),
        judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
        SELECT *, NOT base_failed AND words_left >= 20 AND words_left >= 0.5 * n_words AS kept FROM judged
    """,
}
