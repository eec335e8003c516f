"""The queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, fixity, language, mixing, near_dup, neighbours, ngram_model, pii, prefix_trie, suffix_dedup, toxicity, urls
from .shared import held_out, in_training, table

RULES = (
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A second copy of the pages with known damage: altered bytes, lost records and records stored twice."""
    copy = pages.where(F.coalesce(F.col("page_id") % 101 != 1, F.lit(True)))
    copy = copy.withColumn("html", F.when(F.col("page_id") % 97 == 0, F.concat(F.lit("!"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html")))
    return copy.unionByName(copy.where(F.col("page_id") % 103 == 2))


def op1_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    leaves, damage = fixity.merkle_audit(pages, damaged_replica(pages))
    return (
        leaves.alias("p")
        .join(damage.alias("d"), F.col("p.slot").eqNullSafe(F.col("d.slot")), "full")
        .select(
            F.when(F.col("p.n").isNotNull(), F.col("p.slot")).otherwise(F.col("d.slot")).alias("page_id"),
            F.col("p.shard").alias("shard"),
            "start_offset",
            "end_offset",
            F.coalesce("p.n", F.lit(0)).alias("n_primary"),
            F.coalesce("d.n_replica", "p.n").alias("n_replica"),
            F.coalesce("d.status", F.lit("intact")).alias("status"),
        )
    )


SQL1 = """
WITH r AS (SELECT page_id, url, html, octet_length(encode(coalesce(url, ''))) AS u, octet_length(encode(coalesce(html, ''))) AS h,
        CASE WHEN url IS NULL THEN 1 ELSE length(CAST(octet_length(encode(url)) AS VARCHAR)) END
          + CASE WHEN html IS NULL THEN 1 ELSE length(CAST(octet_length(encode(html)) AS VARCHAR)) END + 10 + 2 + 2 + 2 + 4 AS rest
      FROM pages),
    s AS (SELECT page_id, count(*) AS n, CAST(sum(u + h + rest) AS BIGINT) AS b FROM r GROUP BY page_id),
    o AS (SELECT *, CAST(floor(page_id / 1024.0) AS BIGINT) AS shard FROM s)
SELECT o.page_id, shard, CAST(sum(b) OVER w - b AS BIGINT) AS start_offset, CAST(sum(b) OVER w AS BIGINT) AS end_offset, n AS n_primary,
    CAST(n * CASE WHEN page_id % 101 = 1 THEN 0 WHEN page_id % 103 = 2 THEN 2 ELSE 1 END AS BIGINT) AS n_replica,
    CASE WHEN page_id % 101 = 1 THEN 'missing' WHEN page_id % 103 = 2 THEN 'extra' WHEN page_id % 97 = 0 THEN 'corrupt' ELSE 'intact' END AS status
FROM o WINDOW w AS (PARTITION BY shard ORDER BY page_id ROWS UNBOUNDED PRECEDING)
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_private(docs, pii.fit_tagger(docs)).drop("text", "found")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("hits", lambda h: h.item_id))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), items.alias("item_ids"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit_languages(docs.where(in_training(F.col("doc_id"))))
    return language.predict_languages(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = in_training(F.col("doc_id"))
    model = toxicity.fit_toxicity(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = urls.read_vocabulary(urls.vocabulary_table(spark))
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, vocabulary=vocabulary, soft_weight=urls.SOFT_WEIGHT)
    return judged.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "distinct_soft_hits", "weight")


def _sql6() -> str:
    def times(term: str) -> str:
        """Words of one part are tokens; a term of two parts is counted with its separators doubled, as occurrences may share one."""
        if "-" not in term:
            return f"len(list_filter(tokens, lambda x: x = '{term}'))"
        return rf"len(regexp_extract_all(regexp_replace(u, '([^a-z0-9])', '\1\1', 'g'), '(^|[^a-z0-9]){term.replace('-', '--')}($|[^a-z0-9])'))"

    cases = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r}:{r.verdict}'" for r in sorted(RULES, key=lambda r: -len(str(r)))
    )
    lower = f"translate(%s, '{urls.UPPER}', '{urls.LOWER}')"
    weight = lambda terms: " + ".join(f"CASE WHEN {times(t)} > 0 THEN {w}::DOUBLE ELSE 0 END" for t, w in terms)
    return rf"""
WITH c AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, {lower % "coalesce(url, '')"} AS u FROM pages),
    h AS (SELECT *, string_split_regex(rest, '[/?#]')[1] AS own FROM c),
    p AS (SELECT page_id, {lower % "own"} AS host, string_split_regex(substr(rest, length(own) + 1), '[?#]')[1] AS path, u, string_split_regex(u, '[^a-z0-9]') AS tokens FROM h),
    q AS (SELECT *, CASE {cases} END AS r, CAST({" + ".join(map(times, urls.STRICT))} AS BIGINT) AS strict_hits,
        CAST({" + ".join(f"CASE WHEN {times(t)} > 0 THEN 1 ELSE 0 END" for t in urls.SOFT)} AS BIGINT) AS distinct_soft_hits,
        {weight([*((t, 2.0) for t in urls.STRICT), *urls.SOFT.items()])} AS weight FROM p)
SELECT page_id, host, path, split_part(r, ':', 1) AS rule,
    coalesce(split_part(r, ':', 2), CASE WHEN strict_hits > 0 OR (distinct_soft_hits >= 2 AND weight >= {urls.SOFT_WEIGHT}) THEN 'block' ELSE 'allow' END) AS verdict,
    strict_hits, distinct_soft_hits, weight
FROM q
"""


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), mixing.label_quality(table(spark, sf_dir, "labels"))).drop("source")


SQL10 = r"""
WITH best AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
    d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        -ln((CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE)
            / CASE WHEN q > 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS k
      FROM documents LEFT JOIN best USING (doc_id)),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM d GROUP BY source),
    l AS (SELECT *, sum(n) OVER () AS total, (sum(n) OVER ()::DOUBLE - coalesce(sum(3.0::DOUBLE * n) OVER (ORDER BY 3.0::DOUBLE * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY 3.0::DOUBLE * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
    t AS (SELECT source, n, round(least(3.0::DOUBLE * n, w * max(level) OVER ()), 6) AS target FROM l),
    e AS (SELECT *, CASE WHEN n > 0 THEN CAST(round(target) AS BIGINT) // n ELSE 0 END AS epochs FROM t),
    x AS (SELECT d.*, e.n, e.target, e.epochs, CAST(round(e.target) AS BIGINT) - e.epochs * e.n AS rest,
        sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, n AS source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM x
"""

def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_model.score_texts(table(spark, sf_dir, "documents")).drop("vocabulary")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
    rows = nodes.join(prefix_trie.end_digests(ends), "key", "left").drop("key", "parent")
    return rows.withColumn("ends_sha256", F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256))).drop("sha256")


SQL12 = """
WITH o AS (SELECT conv_id AS c, length(coalesce(text, '')) AS n, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS t, turn
      FROM conversations WHERE conv_id IS NOT NULL),
    l AS (SELECT c, list({'t': t, 'n': n} ORDER BY turn NULLS FIRST, t) AS turns FROM o GROUP BY c),
    h AS (SELECT c, turns, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 6 AS BIGINT) AS h FROM l),
    r AS (SELECT h.c, list_concat(coalesce(list_slice(b.turns, 1, h), []), coalesce(list_slice(h.turns, h + 1, len(h.turns)), [])) AS turns FROM h LEFT JOIN l b ON b.c = h.c - h.c % 100),
    p AS (SELECT c, d, len(turns) AS size, md5(list_aggregate(list_transform(list_slice(turns, 1, d), lambda x: x.t), 'string_agg', ',')) AS k,
        md5(list_aggregate(list_transform(list_slice(turns, 1, d - 1), lambda x: x.t), 'string_agg', ',')) AS up, turns[d].n AS n
      FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
    q AS (SELECT c, d, size, CASE WHEN d = 0 THEN 'root' ELSE k END AS k, CASE WHEN d = 0 THEN NULL WHEN d = 1 THEN 'root' ELSE up END AS up, CASE WHEN d = 0 THEN 0 ELSE n END AS n FROM p),
    g AS (SELECT k, any_value(up) AS up, any_value(d) AS depth, any_value(n) AS n, min(c) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = size), '')) AS ends_sha256 FROM q GROUP BY k),
    m AS (SELECT up AS k, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY up),
    pairs AS (SELECT DISTINCT a.k AS top, b.k AS k FROM q a JOIN q b ON a.c = b.c AND a.d <= b.d),
    sums AS (SELECT top AS k, count(*) FILTER (m.k IS NULL) AS n_leaves, CAST(sum((g.n_convs - 1) * g.n) AS BIGINT) AS saved_tokens FROM pairs JOIN g USING (k) LEFT JOIN m USING (k) GROUP BY top)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, g.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, g.ends_sha256
FROM g JOIN sums USING (k) LEFT JOIN m USING (k) LEFT JOIN g u ON u.k = g.up
"""

def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_corpus(table(spark, sf_dir, "documents"))


QUERIES = {"op1_merkle_audit": op1_merkle_audit, "op2_suffix_dedup": op2_suffix_dedup, "op3_private_data": op3_private_data, "op4_decontaminate": op4_decontaminate, "op5_language": op5_language, "op6_url_filter": op6_url_filter, "op7_toxicity": op7_toxicity, "op8_near_duplicates": op8_near_duplicates, "op9_multi_index": op9_multi_index, "op10_mix_sources": op10_mix_sources, "op11_lm_scores": op11_lm_scores, "op12_prefix_trie": op12_prefix_trie, "op13_token_alignment": op13_token_alignment}
SQL = {"op1_merkle_audit": SQL1, "op6_url_filter": _sql6(), "op10_mix_sources": SQL10, "op12_prefix_trie": SQL12}
