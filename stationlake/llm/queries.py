"""Queries of the operators and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.llm import html, language, licences, lines, manifest, mixing, near_duplicates, neighbours, pieces, quality
from stationlake.llm import sharding, token_alignment, token_counts
from stationlake.llm.common import LOWER, UPPER, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql is not None:
            ORACLE_SQL[name] = sql
        return plan

    return register


#: Words of lower-cased texts.
_WORDS = f"""list_filter(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'),
        '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"""

MINHASH_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
    FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * k >= 80 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT r.doc_id, l.b FROM reach r JOIN edges l ON l.a = r.other),
smallest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN smallest USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


@query("op1_minhash_near_dedup", MINHASH_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), width=4)


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", language.held_out(F.col("doc_id"))
    )
    model = language.fit(docs.where("not held_out"))
    return language.identify(docs, model, ["doc_id", "held_out"]).select(
        "doc_id", "held_out", "lang_pred", "score", "spans"
    )


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages, html.fit(pages), ["page_id", "url"])


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op5_nearest_neighbours")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


LINES_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM split),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        '{UPPER}', '{LOWER}') AS k
    FROM lines),
common AS (
    SELECT k, max(doc_id) AS last FROM (SELECT DISTINCT doc_id, k FROM keyed WHERE length(k) >= 40)
    GROUP BY k HAVING count(*) >= 5),
marked AS (
    SELECT doc_id, line, pos, coalesce(last <> doc_id, false) AS dropped
    FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op6_line_dedup", LINES_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query("op7_licence_scan", licences.licence_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.find_licences(table(spark, sf_dir, "documents"), ["doc_id"])


MIXING_SQL = """
WITH RECURSIVE d AS (
    SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, source,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
    FROM documents),
per AS (
    SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS cap,
        [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE
            AS weight
    FROM d GROUP BY source),
levels AS (
    SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::BIGINT - (sum(cap) OVER w - cap))
        / (sum(weight) OVER () - (sum(weight) OVER w - weight)) AS level
    FROM per WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
shared AS (SELECT max(level) AS level FROM levels WHERE cap / weight >= level),
goals AS (
    SELECT source, source_size, coalesce(least(cap, weight * shared.level), cap) AS target
    FROM levels, shared),
ends AS (
    SELECT source, round(target)::BIGINT AS goal,
        sum(round(target)::BIGINT) OVER (ORDER BY source NULLS LAST)::BIGINT AS stop
    FROM goals),
plan AS (
    SELECT sum(goal)::BIGINT AS total, greatest(1, (sum(goal)::BIGINT + 131071) // 131072) AS words
    FROM ends),
slots AS (
    SELECT floor(((i + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE
        - floor((i + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE)) * total::DOUBLE)::BIGINT AS spot
    FROM plan, range((total + words - 1) // words) t(i)),
filled AS (
    SELECT source, count(*) AS n FROM slots JOIN ends ON spot >= stop - goal AND spot < stop
    GROUP BY source),
copies AS (
    SELECT r, doc_id, source, size, pass, sum(size) OVER (
        PARTITION BY source, pass ORDER BY md5(pass || ':' || doc_id), size, r) - size AS begin
    FROM d, (VALUES (1), (2)) p(pass)),
takes AS (
    SELECT r, sum(greatest(0, least(n * words, begin + (pass - 1) * source_size + size)
        - begin - (pass - 1) * source_size))::BIGINT AS taken
    FROM copies JOIN goals USING (source) JOIN filled USING (source), plan GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM d JOIN goals ON d.source IS NOT DISTINCT FROM goals.source LEFT JOIN takes USING (r)
"""


@query("op8_source_mixing", MIXING_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_report(table(spark, sf_dir, "documents"))


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])


@query("op10_sentencepiece")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), ["doc_id"])


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), ["doc_id"])


def _hashed_value(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


_HASHED_ROW = " || ".join(_hashed_value(c) for c in ("doc_id", "source", "lang", "n_chars"))


def _tree_sql(name: str, base: str, keys: str) -> str:
    """Nodes of trees level by level, and per node the digests left and right in its run of three."""
    same = f"a.{keys} IS NOT DISTINCT FROM b.{keys}" if keys else "true"
    key = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""
{name} AS (
    SELECT {key}0 AS level, pos, digest FROM {base}
    UNION ALL
    SELECT {key}level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos))
    FROM (SELECT *, count(*) OVER ({part}) AS n FROM {name}) WHERE n > 1
    GROUP BY {key}level, pos // 3),
{name}_top AS (
    SELECT {key}max(level) AS height, max_by(digest, level) AS top FROM {name}
    {f"GROUP BY {keys}" if keys else ""}),
{name}_way AS (
    SELECT {f"a.{keys}, " if keys else ""}a.level, a.pos,
        coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
        coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM {name} a LEFT JOIN {name} b
        ON {same} AND a.level = b.level AND a.pos // 3 = b.pos // 3 AND a.pos <> b.pos
    GROUP BY ALL)"""


MANIFEST_SQL = f"""
WITH RECURSIVE hashed AS (
    SELECT row_number() OVER () AS id, doc_id, source,
        sha256({_HASHED_ROW} || {_hashed_value("text")}) AS leaf,
        sha256({_HASHED_ROW} || {_hashed_value("replace(text, chr(10), '')")}) AS shorter,
        list_reduce([4294967295::UBIGINT] || range(8 * length(doc_id::VARCHAR))::UBIGINT[],
            lambda c, i: xor((CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR,
                (i // 8 + 1)::BIGINT, 1))::UBIGINT) ELSE c END) >> 1, 3988292384::UBIGINT * (
                (CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR,
                (i // 8 + 1)::BIGINT, 1))::UBIGINT) ELSE c END) & 1))) AS crc
    FROM documents),
leaves AS (
    SELECT *, leaf AS digest,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
    FROM hashed),{_tree_sql("nodes", "leaves", "source")},
subroots AS (
    SELECT source, height, top AS digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos
    FROM nodes_top),{_tree_sql("tops", "subroots", "")},
inner_way AS (
    SELECT id, source, 0 AS level, pos, '' AS proof,
        CASE WHEN xor(crc, 4294967295::UBIGINT) % 2 = 0 THEN shorter ELSE leaf END AS folded
    FROM leaves
    UNION ALL
    SELECT i.id, i.source, i.level + 1, i.pos // 3, i.proof || w.l || w.r,
        sha256(w.l || i.folded || w.r)
    FROM inner_way i JOIN nodes_way w
        ON i.source IS NOT DISTINCT FROM w.source AND i.level = w.level AND i.pos = w.pos
        JOIN subroots s ON i.source IS NOT DISTINCT FROM s.source WHERE i.level < s.height),
outer_way AS (
    SELECT i.id, 0 AS level, s.pos, i.proof, i.folded, s.digest AS subroot
    FROM inner_way i JOIN subroots s ON i.source IS NOT DISTINCT FROM s.source AND i.level = s.height
    UNION ALL
    SELECT o.id, o.level + 1, o.pos // 3, o.proof || w.l || w.r, sha256(w.l || o.folded || w.r),
        o.subroot
    FROM outer_way o JOIN tops_way w ON o.level = w.level AND o.pos = w.pos, tops_top t
    WHERE o.level < t.height)
SELECT doc_id, leaf, subroot, top AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
    folded = top AS verified
FROM outer_way o JOIN leaves USING (id), tops_top t WHERE o.level = t.height
"""


@query("op12_merkle_manifest", MANIFEST_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), ["doc_id"])
