"""Text components over documents, pages and conversations.

The driver's invented prose holds few of the default words, so the queries add common word parts of it
to the dictionary: patterns are data.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tickloom.catalog.inputs import table
from tickloom.catalog.registry import query, with_sql
from tickloom.operators import components as C

WORDS = {
    "MATH": C.PATTERNS["MATH"] + [r"\d+"],
    "GEOMETRY": C.PATTERNS["GEOMETRY"] + ["tion", "eau"],
    "TIME": C.PATTERNS["TIME"] + ["\\bthe\\b", "\\bles\\b"],
    "MECHANICAL": C.PATTERNS["MECHANICAL"] + ["\\band\\b"],
}

# ends of sentences are marked before splitting: this engine's patterns cannot look behind
SENTENCES_SQL = r"""dt AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents),
sp AS (SELECT doc_id, string_split(t, ' ') AS w FROM dt),
wd AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM sp),
mk AS (SELECT doc_id, word, i, (word LIKE '%.' OR word LIKE '%?') AND NOT regexp_matches(word, '[\pL\pN_]\.[\pL\pN_].$') AND NOT regexp_matches(word, '[A-Z][a-z]\.$') AS stop FROM wd),
gr AS (SELECT *, coalesce(sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM mk),
se AS (SELECT doc_id, CAST(position AS INTEGER) AS position, trim(string_agg(word, ' ' ORDER BY i)) AS sentence FROM gr GROUP BY doc_id, position),
sn AS (SELECT * FROM se WHERE sentence <> '')"""


def edges(p: str) -> str:
    """Word boundaries spelled out, because this engine's know only ASCII."""
    return re.sub(r"\\b$", r"($|[^\\pL\\pN_])", re.sub(r"^\\b", r"(^|[^\\pL\\pN_])", p))


def hits_sql(name: str) -> str:
    """Pattern counts of a category."""
    return " + ".join(f"CAST(regexp_matches(sentence, '(?i){edges(p)}') AS INTEGER)" for p in WORDS[name])


COMPONENTS_SQL = (
    SENTENCES_SQL
    + ", ht AS (SELECT *, "
    + ", ".join(f"{hits_sql(n)} AS hits_{n}" for n in WORDS)
    + """ FROM sn),
cp AS (SELECT *, CASE WHEN greatest(hits_MATH, hits_GEOMETRY, hits_TIME, hits_MECHANICAL) = hits_MATH THEN 'MATH'
                      WHEN greatest(hits_GEOMETRY, hits_TIME, hits_MECHANICAL) = hits_GEOMETRY THEN 'GEOMETRY'
                      WHEN hits_TIME >= hits_MECHANICAL THEN 'TIME' ELSE 'MECHANICAL' END AS logic_type
       FROM ht WHERE hits_MATH + hits_GEOMETRY + hits_TIME + hits_MECHANICAL > 0)"""
)


def found_sql(name: str) -> str:
    """The patterns of a category that occur, in order, as text."""
    listed = ", ".join(f"CASE WHEN regexp_matches(sentence, '(?i){edges(p)}') THEN '{p}' END" for p in WORDS[name])
    quoted = "''', '''"
    return f"'Found: [''' || array_to_string(list_filter([{listed}], lambda x : x IS NOT NULL), {quoted}) || ''']'"


def doc_sentences(spark, sf):
    return C.sentences(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])


def doc_components(spark, sf):
    return C.components(doc_sentences(spark, sf), ["doc_id"], WORDS)


@query("m1_sentences", with_sql(SENTENCES_SQL, "SELECT doc_id, position, sentence FROM sn"))
def m1_sentences(spark, sf):
    return doc_sentences(spark, sf)


@query(
    "m2_category_hits",
    with_sql(COMPONENTS_SQL, "SELECT doc_id, position, hits_MATH, hits_GEOMETRY, hits_TIME, hits_MECHANICAL FROM ht"),
)
def m2_category_hits(spark, sf):
    return C.category_hits(doc_sentences(spark, sf), WORDS).drop("sentence")


@query(
    "m3_components",
    with_sql(
        COMPONENTS_SQL,
        f"""SELECT doc_id, concat_ws('_', 'TXT', doc_id, position) AS component_id, 'Text' AS source_type, logic_type,
       CASE WHEN logic_type = 'GEOMETRY' THEN {found_sql("GEOMETRY")} ELSE 'N/A' END AS parameters, sentence AS definition FROM cp""",
    ),
)
def m3_components(spark, sf):
    return doc_components(spark, sf)


TURNS_SQL = """pg AS (SELECT conv_id, turn, trim(replace(text, chr(10), ' ')) AS current_text FROM conversations),
cx AS (SELECT p.*, coalesce(b.current_text, '') AS previous_text, coalesce(b.current_text, '') || ' [PAGE BREAK] ' || p.current_text AS combined_text
       FROM pg p LEFT JOIN pg b ON b.conv_id = p.conv_id AND b.turn = p.turn - 1)"""


@query("w14_page_context", with_sql(TURNS_SQL, "SELECT conv_id, turn, previous_text, combined_text FROM cx"))
def w14_page_context(spark, sf):
    out = C.page_context(table(spark, sf, "conversations"), "conv_id", "turn")
    return out.select("conv_id", "turn", "previous_text", "combined_text")


@query(
    "m4_image_context",
    with_sql(
        TURNS_SQL
        + r""", ex AS (SELECT *, list_sort(list_distinct(regexp_extract_all(combined_text, '(?i)(\d+x\d+ angles?|\d+\s*degrees?)', 1))) AS an,
   list_sort(list_distinct(regexp_extract_all(combined_text, '(?i)(triangle|square|circle|cycle|resistance level)', 1))) AS co,
   regexp_extract(combined_text, '(?i)([^.]*?Chart[^.]*\.)', 1) AS ch FROM cx)""",
        """SELECT conv_id, turn, CASE WHEN len(an) + len(co) = 0 THEN 'See context text' ELSE concat_ws(' | ', CASE WHEN len(an) > 0 THEN 'Angles mentioned: ' || array_to_string(an, ', ') END,
      CASE WHEN len(co) > 0 THEN 'Concepts: ' || array_to_string(co, ', ') END) END AS parameters,
  'Context from ' || CASE WHEN length(current_text) < 50 THEN 'Page ' || turn || ' (Preceding)' ELSE 'Pages ' || turn || ' & ' || (turn + 1) END || ': "'
    || CASE WHEN ch <> '' THEN ch ELSE substr(combined_text, 1, 1000) || '...' END || '"' AS definition FROM ex""",
    ),
)
def m4_image_context(spark, sf):
    out = C.image_context(C.page_context(table(spark, sf, "conversations"), "conv_id", "turn"), "turn")
    return out.select("conv_id", "turn", "parameters", "definition")


def page_rows(spark, sf):
    """Raw pages as components, a third each mechanical, geometric and about time."""
    kinds = F.array(F.lit("MECHANICAL"), F.lit("GEOMETRY"), F.lit("TIME"))
    html = F.replace(F.replace("html", F.lit("ad "), F.lit("stop loss 90 degrees 7 days ")), F.lit("page="), F.lit("30 weeks"))
    return table(spark, sf, "pages").select(
        "page_id",
        F.get(kinds, (F.col("page_id") % 3).cast("int")).alias("logic_type"),
        html.alias("definition"),
        F.lit("N/A").alias("parameters"),
        F.concat_ws("_", F.lit("TXT"), "page_id").alias("component_id"),
    )


PAGES_SQL = """pr AS (SELECT page_id, ['MECHANICAL', 'GEOMETRY', 'TIME'][CAST(page_id % 3 AS INTEGER) + 1] AS logic_type,
   replace(replace(html, 'ad ', 'stop loss 90 degrees 7 days '), 'page=', '30 weeks') AS definition FROM pages)"""


@query(
    "a8_m5_parameters",
    with_sql(
        PAGES_SQL
        + r""", pv AS (
  SELECT 'time_period' AS kind, CAST(unnest(regexp_extract_all(lower(definition), '(\d+)\s*[- ]?days?', 1)) AS HUGEINT)::VARCHAR AS value FROM pr WHERE logic_type = 'MECHANICAL'
  UNION ALL SELECT 'stop_loss', definition FROM pr WHERE logic_type = 'MECHANICAL' AND contains(lower(definition), 'stop loss')
  UNION ALL SELECT 'angle', value FROM (SELECT CAST(unnest(regexp_extract_all(lower(definition), '(\d+)\s*degrees?', 1)) AS HUGEINT)::VARCHAR AS value FROM pr WHERE logic_type = 'GEOMETRY') WHERE TRY_CAST(value AS INTEGER) <= 360
  UNION ALL SELECT 'cycle', CAST(n AS HUGEINT)::VARCHAR || ' ' || u FROM (SELECT unnest(regexp_extract_all(lower(definition), '(\d+)\s*(days?|weeks?|months?|years?)', 1)) AS n,
      unnest(regexp_extract_all(lower(definition), '(\d+)\s*(days?|weeks?|months?|years?)', 2)) AS u FROM pr WHERE logic_type = 'TIME'))""",
        "SELECT kind, value, count(*) AS mentions FROM pv GROUP BY 1, 2",
    ),
)
def a8_m5_parameters(spark, sf):
    return C.extract_parameters(page_rows(spark, sf))


@query(
    "a7_m6_component_report",
    with_sql(
        PAGES_SQL
        + """, rp AS (SELECT *, substr(replace(definition, chr(10), ' '), 1, 200) AS c FROM pr)""",
        """SELECT CASE logic_type WHEN 'MECHANICAL' THEN 0 WHEN 'GEOMETRY' THEN 2 ELSE 3 END AS section, logic_type, page_id, concat_ws('_', 'TXT', page_id) AS component_id,
       CASE WHEN length(c) = 200 THEN c || '...' ELSE c END AS definition, '' AS parameters FROM rp""",
    ),
)
def a7_m6_component_report(spark, sf):
    return C.component_report(page_rows(spark, sf), ["page_id"])
