"""Registered queries of loads, threads, decks, file rules and small functions, each beside its SQL.

Sheets, manifests and posts are derived from the driver's tables, so that every branch of a load has rows: known and new
keys, repeats, misses, blanks and words for missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..functions import text as t
from ..operators import matching, merge, rules
from ..sources import files, slides, tables, threads
from ..sources.shared import new_path
from . import jobs, loads
from .queries import DECK, ORACLES, QUERIES, query, some_linked

__all__ = ["ORACLES", "QUERIES"]

# workbook: a kits sheet with a row for each part

SHEET = """SELECT CASE WHEN id % 17 > 0 THEN 'Brand#' || CAST(kit_id AS STRING) END AS brand, part_label || ' kit' AS name, CASE WHEN id % 3 = 0 THEN 'S' || CAST(id % 2 AS STRING) END AS serial_number,
       '1/' || CAST(kit_id AS STRING) AS scale, CASE WHEN id % 5 > 0 THEN CAST(size AS STRING) || '.0' ELSE 'n/a' END AS number, CASE WHEN id % 4 > 0 THEN CAST(id % 4 AS STRING) END AS base, CASE size % 4 WHEN 0 THEN '0' WHEN 1 THEN '' ELSE CAST(size % 4 AS STRING) END AS suffix FROM {parts}"""
HELD_KITS = "SELECT id, brand, name, CAST(NULL AS STRING) AS serial_number, scale FROM {kits}"
HELD_REFERENCES = "SELECT kit_id, 'sheet' AS system, CAST(min(size) AS STRING) AS value FROM {parts} GROUP BY kit_id"
NEW_KITS = f"""sheet AS ({SHEET.format(parts="parts")}), held AS ({HELD_KITS.format(kits="kits")}),
    named AS (SELECT * FROM sheet WHERE brand IS NOT NULL),
    fresh AS (SELECT (SELECT max(id) FROM kits) + row_number() OVER (ORDER BY brand NULLS FIRST, name NULLS FIRST, serial_number NULLS FIRST) AS id, * FROM (SELECT DISTINCT brand, name, serial_number, scale FROM named n WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.brand = n.brand AND h.name = n.name AND h.serial_number IS NOT DISTINCT FROM n.serial_number)))"""
VALUE = "CASE WHEN suffix = '0' OR base IS NULL THEN CAST(CAST(number AS DOUBLE) AS INT)::VARCHAR WHEN suffix = '' THEN base || '#' ELSE base || suffix END"


def sheet_of(c) -> DataFrame:
    return c.spark.sql(SHEET, parts=c.parts)


def kit_load(c) -> tuple[DataFrame, DataFrame]:
    return loads.kit_sheet(sheet_of(c), c.spark.sql(HELD_KITS, kits=c.kits), c.spark.sql(HELD_REFERENCES, parts=c.parts))


@query("m15_new_kits", f"SELECT * FROM (WITH {NEW_KITS} SELECT id, brand, name, serial_number, scale FROM fresh)", "kits", "parts")
def _(c):
    return kit_load(c)[0].select("id", "brand", "name", "serial_number", "scale")


@query("m15_new_references", f"SELECT * FROM (WITH {NEW_KITS}, known AS (SELECT id, brand, name, serial_number FROM held UNION ALL SELECT id, brand, name, serial_number FROM fresh), owned AS ({HELD_REFERENCES.format(parts='parts')}), wanted AS (SELECT DISTINCT k.id AS kit_id, 'sheet' AS system, {VALUE} AS value FROM named n JOIN known k ON k.brand = n.brand AND k.name = n.name AND k.serial_number IS NOT DISTINCT FROM n.serial_number WHERE n.number <> 'n/a') SELECT * FROM wanted EXCEPT SELECT * FROM owned)", "kits", "parts")
def _(c):
    return kit_load(c)[1].select("kit_id", "system", "value")


@query("m15_map_sheet", """SELECT coalesce(h.id, f.id) AS id, coalesce(h.model_id, 3) AS model_id, coalesce(h.name, s.name) AS name, coalesce(s.url, h.url) AS url, s.version,
    CASE WHEN s.name IS NULL THEN 'kept' ELSE 'updated' END AS merge_status
    FROM (SELECT id, model_id, name, 'old' AS url FROM maps) h
    FULL JOIN (SELECT 'plan of ' || n_name AS name, CASE WHEN n_nationkey % 3 > 0 THEN 'https://plans/' || CAST(n_nationkey AS VARCHAR) END AS url, CASE WHEN n_nationkey % 2 = 0 THEN 'v2' END AS version FROM nation) s ON h.model_id = 3 AND s.name = h.name
    LEFT JOIN (SELECT name, (SELECT max(id) FROM maps) + row_number() OVER (ORDER BY name) AS id FROM (SELECT 'plan of ' || n_name AS name FROM nation WHERE n_nationkey <> 3)) f ON h.id IS NULL AND f.name = s.name""", "maps")
def _(c):
    """A sheet of every plan's name for one model, which has one of them."""
    sheet = c.nation.selectExpr("'plan of ' || n_name AS name", "CASE WHEN n_nationkey % 3 > 0 THEN 'https://plans/' || n_nationkey END AS url", "CASE WHEN n_nationkey % 2 = 0 THEN 'v2' END AS version")
    held = c.maps.selectExpr("id", "model_id", "name", "'old' AS url", "CAST(NULL AS STRING) AS version")
    return loads.map_sheet(sheet, held, 3)


PLACED = """SELECT CASE WHEN l_partkey % 11 > 0 THEN l_partkey % 25 + 11 END AS kit_id, CASE WHEN l_partkey % 13 > 0 THEN CAST(l_partkey % 700 AS STRING) END AS part_number, l_suppkey % 25 AS model_id,
       CAST(1 + l_partkey % 3 AS INT) AS copy_count, CASE l_partkey % 4 WHEN 0 THEN ' X ' WHEN 1 THEN 'x' WHEN 2 THEN '?' END AS mark FROM {lineitem}"""
PLACED_SQL = f"""placed AS (SELECT * FROM ({PLACED.format(lineitem="lineitem")}) WHERE kit_id IS NOT NULL AND part_number IS NOT NULL),
    fresh AS (SELECT (SELECT max(id) FROM parts) + row_number() OVER (ORDER BY kit_id, part_number) AS id, * FROM (SELECT DISTINCT kit_id, part_number FROM placed p WHERE NOT EXISTS (SELECT 1 FROM parts t WHERE t.kit_id = p.kit_id AND t.part_number = p.part_number)))"""


def placed(c) -> tuple[DataFrame, DataFrame]:
    """Lines as marks in a workbook: parts of a kit that some model shows; the first part of each kit stands on model 1."""
    held = c.parts.groupBy("kit_id", "part_number").agg(F.min("id").alias("part_id")).selectExpr("part_id AS id", "1L AS model_id", "part_id")
    parts = c.parts.groupBy("kit_id", "part_number").agg(F.min("id").alias("id"))
    return jobs.workbook_parts(c.spark.sql(PLACED, lineitem=c.lineitem), parts, held)


@query("m15_workbook_parts", f"SELECT * FROM (WITH own AS (SELECT kit_id, part_number, min(id) AS id FROM parts GROUP BY ALL), {PLACED_SQL.replace('FROM parts)', 'FROM own)')} SELECT id, kit_id, part_number FROM fresh)", "parts")
def _(c):
    return placed(c)[0].select("id", "kit_id", "part_number")


@query("m15_workbook_placements", f"SELECT * FROM (WITH own AS (SELECT kit_id, part_number, min(id) AS id FROM parts GROUP BY ALL), {PLACED_SQL.replace('FROM parts)', 'FROM own)')}, known AS (SELECT id, kit_id, part_number FROM own UNION ALL SELECT id, kit_id, part_number FROM fresh), put AS (SELECT DISTINCT model_id, k.id AS part_id FROM placed JOIN known k USING (kit_id, part_number) EXCEPT SELECT 1, id FROM own) SELECT (SELECT max(id) FROM own) + row_number() OVER (ORDER BY model_id, part_id) AS id, model_id, part_id FROM put)", "parts")
def _(c):
    return placed(c)[1].select("id", "model_id", "part_id")


@query("m15_donors", "SELECT p.id, k.kit_id, m.id AS model_id, CASE WHEN p.size % 4 < 2 THEN 'confirmed' ELSE 'probable' END AS confidence, CASE WHEN k.kit_id IS NULL THEN 'no_kit' WHEN m.id IS NULL THEN 'no_model' ELSE 'matched' END AS status FROM parts p LEFT JOIN (SELECT name, min(id) AS kit_id, brand FROM kits GROUP BY ALL) k ON k.brand = 'Brand#' || CAST(p.kit_id AS VARCHAR) AND k.name = p.part_label || ' kit' LEFT JOIN models m ON m.id = p.id % 30", "parts", "kits", "models")
def _(c):
    marks = c.parts.selectExpr("id", "'Brand#' || kit_id AS brand", "part_label || ' kit' AS name", "'Nation_' || (id % 30) AS model", "CASE size % 4 WHEN 0 THEN 'x' WHEN 1 THEN ' X' WHEN 2 THEN '(x)' END AS mark")
    return jobs.donors(marks, c.kits, c.models).select("id", "kit_id", "model_id", "confidence", "status")


PRINTED = """SELECT l_orderkey * 10 + l_linenumber AS line, CASE l_linenumber WHEN 1 THEN 'n/a' WHEN 2 THEN ' ' || CAST(l_partkey % 40 AS STRING) ELSE CAST(l_partkey % 40 AS STRING) || '.0' END AS number,
       CASE WHEN l_suppkey % 9 > 0 THEN CAST(l_partkey % 600 AS STRING) END AS part_number, 'note' AS notes, CASE l_partkey % 3 WHEN 0 THEN 'shop' WHEN 1 THEN ' - ' END AS one, CASE l_partkey % 2 WHEN 0 THEN ' studio ' END AS two FROM {lineitem}"""
PRINTED_SQL = f"""printed AS ({PRINTED.format(lineitem="lineitem")}),
    found AS (SELECT p.*, k.kit_id, t.part_id, CASE WHEN k.kit_id IS NULL THEN 'no_kit' WHEN t.part_id IS NULL THEN 'no_part' ELSE 'matched' END AS status FROM printed p
        LEFT JOIN (SELECT value, min(kit_id) AS kit_id FROM kit_references WHERE system = 'sheet' GROUP BY value) k ON k.value = CAST(CAST(TRY_CAST(trim(p.number) AS DOUBLE) AS INT) AS VARCHAR)
        LEFT JOIN (SELECT kit_id, part_number, min(id) AS part_id FROM parts GROUP BY ALL) t ON t.kit_id = k.kit_id AND t.part_number = p.part_number
        WHERE TRY_CAST(trim(p.number) AS DOUBLE) IS NOT NULL AND p.part_number IS NOT NULL)"""


def printed(c) -> DataFrame:
    return c.spark.sql(PRINTED, lineitem=c.lineitem)


def held_files(c) -> DataFrame:
    """Files of parts: what even parts have by the shop is known."""
    return c.parts.where("id % 2 = 0").selectExpr("id", "id AS part_id", "'scan' AS file_type", "CAST(NULL AS STRING) AS url", "'shop' AS source", "CAST(NULL AS STRING) AS notes")


@query("j8_part_rows", f"SELECT * FROM (WITH {PRINTED_SQL} SELECT line, kit_id, part_id, status FROM found)", "kit_references", "parts")
def _(c):
    return loads.part_rows(printed(c), c.kit_references, c.parts).select("line", "kit_id", "part_id", "status")


@query("m15_part_files", f"SELECT * FROM (WITH {PRINTED_SQL}, named AS (SELECT part_id, CASE WHEN one = 'shop' THEN 'shop' END AS source FROM found WHERE status = 'matched' UNION SELECT part_id, trim(two) FROM found WHERE status = 'matched'), fresh AS (SELECT part_id, 'scan' AS file_type, source FROM named WHERE source IS NOT NULL EXCEPT SELECT id, 'scan', 'shop' FROM parts WHERE id % 2 = 0) SELECT (SELECT max(id) FROM parts WHERE id % 2 = 0) + row_number() OVER (ORDER BY part_id, file_type, source) AS id, part_id, file_type, source, 'note' AS notes FROM fresh)", "kit_references", "parts")
def _(c):
    return loads.file_sheet(printed(c), c.kit_references, c.parts, held_files(c), ["one", "two"])[0].select("id", "part_id", "file_type", "source", "notes")


@query("m15_part_file_counts", f"SELECT * FROM (WITH {PRINTED_SQL} SELECT 'status' AS section, status AS key, count(*) AS count FROM found GROUP BY status)", "kit_references", "parts")
def _(c):
    return loads.file_sheet(printed(c), c.kit_references, c.parts, held_files(c), ["one", "two"])[1]


# claims, replacements and refreshes

WANTED = "SELECT 'kit' AS subject_type, doc_id % 25 AS subject_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'quality' END AS predicate, CASE WHEN doc_id % 6 > 0 THEN CAST(quality AS STRING) END AS text_value, 'image' AS evidence_type, doc_id AS evidence_id FROM {labels}"
SEEDED = f"""wanted AS ({WANTED.format(labels="labels")}), held AS (SELECT min(id) AS id, subject_type, subject_id, predicate, text_value FROM claims GROUP BY ALL),
    fresh AS (SELECT (SELECT max(id) FROM held) + row_number() OVER (ORDER BY subject_type, subject_id, predicate, text_value NULLS FIRST) AS id, * FROM (SELECT subject_type, subject_id, predicate, text_value FROM wanted EXCEPT SELECT subject_type, subject_id, predicate, text_value FROM held))"""


def seeded(c) -> tuple[DataFrame, DataFrame]:
    held = c.claims.groupBy("subject_type", "subject_id", "predicate", "text_value").agg(F.min("id").alias("id"))
    return jobs.seed_claims(held, c.claim_evidence, c.spark.sql(WANTED, labels=c.labels))


@query("m18_new_claims", f"SELECT * FROM (WITH {SEEDED} SELECT id, subject_type, subject_id, predicate, text_value FROM fresh)", "claims")
def _(c):
    return seeded(c)[0].select("id", "subject_type", "subject_id", "predicate", "text_value")


@query("m18_claim_links", f"SELECT * FROM (WITH {SEEDED}, every AS (SELECT id, subject_type, subject_id, predicate, text_value FROM held UNION ALL SELECT id, subject_type, subject_id, predicate, text_value FROM fresh) SELECT e.id AS claim_id, w.evidence_type, w.evidence_id FROM wanted w JOIN every e ON e.subject_type = w.subject_type AND e.subject_id = w.subject_id AND e.predicate = w.predicate AND e.text_value IS NOT DISTINCT FROM w.text_value EXCEPT SELECT claim_id, evidence_type, evidence_id FROM claim_evidence)", "claims", "claim_evidence")
def _(c):
    return seeded(c)[1].select("claim_id", "evidence_type", "evidence_id")


@query("m5_replaced_rows", "SELECT p.id, p.placement_id, CASE WHEN n.id IS NULL THEN p.position_type WHEN n.k = 0 THEN NULL ELSE 'edit ' || CAST(n.k AS VARCHAR) END AS position_type, CASE WHEN n.id IS NULL THEN p.x_norm END AS x_norm FROM placement_positions p LEFT JOIN (SELECT id, max(k) AS k FROM (SELECT user_id * 3 AS id, event_id % 4 AS k FROM events) GROUP BY id) n ON n.id = p.id", "placement_positions")
def _(c):
    """Whole rows come in several times, the last by sequence counts; nulls replace too, and unknown ids nothing."""
    held = c.placement_positions.select("id", "placement_id", "position_type", "x_norm")
    edits = c.events.selectExpr("user_id * 3 AS id", "event_id % 4 AS k").distinct().join(held.select("id", "placement_id"), "id", "left")
    edits = edits.selectExpr("id", "placement_id", "CASE WHEN k > 0 THEN 'edit ' || k END AS position_type", "CAST(NULL AS DOUBLE) AS x_norm", "k")
    return merge.replace_rows(held, edits, "k")


@query("m13_refresh", f"SELECT * FROM (WITH held AS (SELECT id, image_id, label, x_norm FROM image_regions WHERE id % 10 <> 2), incoming AS (SELECT DISTINCT doc_id AS image_id, 'label ' || CAST((doc_id + 1) % 9 AS VARCHAR) AS label, CASE WHEN doc_id % 2 = 0 THEN CAST(quality AS DOUBLE) + 1e-9 ELSE 0.5 END AS x_norm FROM labels) SELECT id, image_id, label, round(x_norm, 6) AS x FROM held UNION ALL SELECT NULL, image_id, label, round(x_norm, 6) FROM incoming n WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.image_id = n.image_id AND h.label = n.label AND round(h.x_norm, 6) = round(n.x_norm, 6)))", "image_regions")
def _(c):
    """Every image's second region is of an earlier import; what comes in has the place of another region to six digits, or a
    place of its own."""
    sign = lambda df: df.withColumn("_at", t.region_signature(F.col("x_norm")))
    held = sign(c.image_regions.select("id", "image_id", "label", "x_norm"))
    incoming = sign(c.labels.selectExpr("doc_id AS image_id", "'label ' || ((doc_id + 1) % 9) AS label", "CASE WHEN doc_id % 2 = 0 THEN CAST(quality AS DOUBLE) + 1e-9D ELSE 0.5D END AS x_norm"))
    return merge.refresh(held, incoming, F.col("id") % 10 == 2, ["image_id", "label", "_at"]).select("id", "image_id", "label", F.round("x_norm", 6).alias("x"))


@query("x10_dispositions", "SELECT id, CASE WHEN n = 1 THEN 'accept' WHEN n > 1 THEN 'needs_review' ELSE 'hide' END AS review_status FROM (SELECT r.id, count(k.id) AS n FROM image_regions r LEFT JOIN (SELECT id, CASE WHEN id % 25 < 4 THEN 'label' || CAST(id % 25 AS VARCHAR) WHEN id % 25 < 8 THEN 'label' || CAST(4 + id % 2 AS VARCHAR) ELSE 'kit' || CAST(id AS VARCHAR) END AS key FROM kits) k ON k.key = regexp_replace(lower(r.label), '[^a-z0-9]+', '', 'g') WHERE trim(r.label) <> '' AND r.entity_id IS NULL GROUP BY r.id)", "image_regions", "kits")
def _(c):
    return jobs.disposition(some_linked(c)[2]).select("id", F.col("fields")["review_status"].alias("review_status"))


@query("x11_short_titles", "SELECT id, CASE WHEN id % 3 = 0 THEN part_label WHEN length(part_label || ' of ' || kind) > 16 THEN regexp_replace(left(part_label || ' of ' || kind, 16), '\\s+\\S*$', '') ELSE part_label || ' of ' || kind END AS short_title FROM (SELECT p_partkey AS id, p_name AS part_label, lower(p_type) AS kind FROM part)")
def _(c):
    title = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" - "), "p_type")).otherwise(F.concat("p_name", F.lit(" of "), F.lower("p_type")))
    return c.part.select(F.col("p_partkey").alias("id"), jobs.short_title(title, 16).alias("short_title"))


# threads: links of pages as pictures in posts

#: A turn of a conversation is a post; its words that begin with t or a, cut to four letters, are the pictures it shows.
LINKS = r"""links AS (SELECT thread, page_no, place, url AS image_url, CAST(row_number() OVER (PARTITION BY thread, page_no, place ORDER BY i) AS INT) AS image_index FROM (
        SELECT CAST(conv_id % 40 AS VARCHAR) AS thread, CAST(conv_id AS INT) AS page_no, CAST(turn AS INT) AS place, 'https://h/' || w || '.png' AS url, min(i) AS i
        FROM (SELECT conv_id, turn, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '(?:^|[ \n])([at][a-z]{0,3})', 1) AS ws FROM conversations)) GROUP BY ALL))"""
COPIES = "copies AS (SELECT image_url, min(sha256) AS sha256 FROM (SELECT 'https://h/' || left(regexp_replace(lower(text), '[^a-z]+', '', 'g'), 2) || '.png' AS image_url, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL) GROUP BY image_url)"
LINKED = f"{LINKS}, {COPIES}, linked AS (SELECT l.*, sha256, CASE WHEN sha256 IS NULL THEN 'missing' ELSE 'copied' END AS status FROM links l LEFT JOIN copies USING (image_url))"


def linked(c) -> DataFrame:
    """Saved pages written from conversations and parsed, with copies named by the first two letters of documents; most
    pictures have none, some several."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?:^|[ \n])([at][a-z]{0,3})"), F.lit(1))
    shown = F.array_join(F.transform(words, lambda w: F.concat(F.lit('<img data-src="/'), w, F.lit('.png?size=1">'))), "")
    post = F.concat(F.lit('<article data-content="p" data-author="'), F.coalesce("role", F.lit("")), F.lit('"><time datetime="d"></time>'), shown, F.lit("</article>"))
    turns = c.conversations.select("conv_id", F.struct("turn", post.alias("post")).alias("p"))
    pages = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    html = F.array_join(F.transform("ps", lambda p: p["post"]), "\n")
    found = threads.post_images(pages.select((F.col("conv_id") % 40).cast("string").alias("thread"), F.col("conv_id").cast("int").alias("page_no"), html.alias("html")), "https://h")
    names = F.concat(F.lit("https://h/"), F.left(F.regexp_replace(F.lower("text"), "[^a-z]+", ""), F.lit(2)), F.lit(".png"))
    return threads.link_manifest(found, c.documents.where("text is not null").select(names.alias("image_url"), F.sha2("text", 256).alias("sha256")))


@query("c7_link_manifest", f"SELECT * FROM (WITH {LINKED} SELECT thread, page_no, place, image_index, image_url, sha256, status FROM linked)")
def _(c):
    return linked(c).select("thread", "page_no", "place", "image_index", "image_url", "sha256", "status")


@query("a13_thread_manifest", f"SELECT * FROM (WITH {LINKED} SELECT thread, count(DISTINCT page_no) AS pages, count(*) FILTER (WHERE status = 'copied') AS copied, count(*) FILTER (WHERE status = 'missing') AS missing, count(DISTINCT sha256) AS unique_images FROM linked GROUP BY thread)")
def _(c):
    return threads.thread_manifest(linked(c))


@query("c8_image_manifest", f"SELECT * FROM (WITH {LINKED} SELECT sha256, arg_min(thread, (thread, page_no, place, image_index)) AS first_thread, arg_min(page_no, (thread, page_no, place, image_index)) AS first_page, arg_min(image_url, (thread, page_no, place, image_index)) AS first_image_url, count(*) AS links FROM linked WHERE status = 'copied' GROUP BY sha256)")
def _(c):
    return threads.image_manifest(linked(c))


@query("j13_text_exports", r"""SELECT * FROM (WITH t AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ': ' || lower(p_type) WHEN 2 THEN '?' ELSE ' ' || p_brand END AS title FROM part),
    e AS (SELECT CASE s_suppkey % 2 WHEN 0 THEN upper(n) ELSE replace(n, ' ', '_') END AS name, 'export/' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS path FROM (SELECT s_suppkey, p_name || CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_ ' || lower(p_type) ELSE '_' END AS n FROM supplier JOIN part ON p_partkey = s_suppkey)
          UNION ALL SELECT p_name || '_', 'export/own' FROM part WHERE p_partkey % 10 = 2)
    SELECT t.id, coalesce(x.path, y.path) AS path FROM t
    LEFT JOIN (SELECT name, min(path) AS path FROM e GROUP BY name) x ON x.name = regexp_replace(t.title, '[:?#]', '_', 'g').replace('Brand_', 'Brand#')
    LEFT JOIN (SELECT trim(regexp_replace(regexp_replace(lower(name), '[_-]+', ' ', 'g'), '\s+', ' ', 'g')) AS k, min(path) AS path FROM e GROUP BY k) y ON y.k = trim(regexp_replace(regexp_replace(lower(t.title), '[_-]+', ' ', 'g'), '\s+', ' ', 'g')))""")
def _(c):
    """Titles of which some are the exported name but for characters that files cannot have, some but for case and
    underscores, and some nobody exported."""
    titles = c.part.selectExpr("p_partkey AS id", "p_name || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ': ' || lower(p_type) WHEN 2 THEN '?' ELSE ' ' || p_brand END AS title")
    named = c.supplier.join(c.part, F.col("p_partkey") == F.col("s_suppkey")).selectExpr("s_suppkey", "p_name || CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_ ' || lower(p_type) ELSE '_' END AS n")
    exports = named.selectExpr("CASE s_suppkey % 2 WHEN 0 THEN upper(n) ELSE replace(n, ' ', '_') END AS name", "'export/' || lpad(s_suppkey, 9, '0') AS path")
    exports = exports.union(c.part.where("p_partkey % 10 = 2").selectExpr("p_name || '_'", "'export/own'"))
    return threads.text_exports(titles, exports).select("id", "path")


@query("j17_keyword_variants", "SELECT DISTINCT keyword FROM (SELECT unnest([b, replace(b, '-', ' '), replace(b, ' ', '-')]) AS keyword FROM (SELECT trim(regexp_replace(lower(name), '\\s*\\([^)]*\\)', '', 'g')) AS b FROM (SELECT p_name || ' (' || p_type || ')' AS name FROM part UNION ALL SELECT p_brand || '-' || p_type FROM part UNION ALL SELECT '(' || p_name || ')' FROM part))) WHERE keyword <> ''")
def _(c):
    names = c.part.selectExpr("explode(array(p_name || ' (' || p_type || ')', p_brand || '-' || p_type, '(' || p_name || ')')) AS name")
    return matching.keyword_variants(names)


HITS = "(SELECT *, regexp_matches(title, '\\b(cold|dark)\\b') AS m, regexp_matches(title, '\\b(widget|bolt)\\b') AS r, regexp_matches(title, '\\b(brass|steel)\\b') AS s, id % 7 = 0 AS f FROM (SELECT p_partkey AS id, replace(lower(p_name), '_', ' ') AS title FROM part))"


@query("t5_selected_threads", f"SELECT id AS thread_id, title, CAST(2 * f::INT + 3 * m::INT + 2 * r::INT + 2 * (s AND (f OR m))::INT AS INT) AS score FROM {HITS} WHERE m OR r OR (s AND (f OR m))")
def _(c):
    manifest = c.part.select(F.col("p_partkey").alias("thread_id"), F.lower("p_name").alias("title"), F.col("p_partkey").alias("position"))
    return jobs.select_threads(manifest, ["cold", "dark"], ["widget", "bolt"], ["brass", "steel"], F.col("position") % 7 == 0).select("thread_id", "title", "score")


# file rules

PATHS = r"""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Ana_' || upper(lang) || '/' WHEN 1 THEN 'x/Forum pics/' WHEN 2 THEN 'AUCTION-' || source || '/' WHEN 3 THEN 'x\clips/' WHEN 4 THEN 'Ｆｏｒｕｍ/' ELSE source || '/' END
       || CASE doc_id % 5 WHEN 0 THEN 'wing_map/' WHEN 1 THEN 'Port-Side/' WHEN 2 THEN 'ｗｉｎｇ/' ELSE '' END AS dir,
       CASE doc_id % 6 WHEN 0 THEN lpad(CAST(doc_id AS STRING), 24, 'a') || '-1' WHEN 1 THEN lpad(CAST(doc_id AS STRING), 9, '1') || '_123456789_123456789_n' ELSE 'photo ' || CAST(doc_id AS STRING) END || '.jpg' AS filename FROM {documents}"""
WORDS = r"lower(translate(replace(replace(dir || filename, 'Ｆｏｒｕｍ', 'Forum'), 'ｗｉｎｇ', 'wing'), '_-', '  '))"
PLATFORM = f"CASE WHEN doc_id % 7 = 0 AND dir LIKE 'Ana_EN/%' THEN 'personal_archive' WHEN {WORDS} LIKE '%forum%' THEN 'forum' WHEN {WORDS} LIKE '%auction%' THEN 'auction' WHEN {WORDS} LIKE '%clips%' THEN 'video' WHEN doc_id % 6 = 1 THEN 'social' ELSE 'unknown' END"


def filed(c) -> DataFrame:
    """Paths with full-width letters, other separators, and names as networks and hashes give them."""
    paths = c.spark.sql(PATHS.replace("\\", "\\\\"), documents=c.documents).withColumn("rel_path", F.concat("dir", "filename"))
    social = t.social_export(F.col("filename"))
    known = [(("forum",), rules.Source("forum", "Forum", "", "high")), (("auction",), rules.Source("auction", "Auctions", "", "medium")), (("clips",), rules.Source("video", "Clips", "", "low")), (social, rules.Source("social", "Feed", "", "low"))]
    return rules.infer_source(paths, {"anaen": "Ana En"}, known)


@query("r2_inferred_sources", f"SELECT doc_id, p AS source_platform, CASE p WHEN 'personal_archive' THEN 'anaen' WHEN 'forum' THEN 'Forum' WHEN 'auction' THEN 'Auctions' WHEN 'video' THEN 'Clips' WHEN 'social' THEN 'Feed' ELSE '' END AS source_collection, CASE p WHEN 'personal_archive' THEN 'Ana En' ELSE '' END AS source_creator, CASE WHEN p IN ('personal_archive', 'forum') THEN 'high' WHEN p = 'auction' THEN 'medium' ELSE 'low' END AS source_confidence FROM (SELECT doc_id, {PLATFORM} AS p FROM ({PATHS.format(documents='documents')}))")
def _(c):
    return filed(c).select("doc_id", "source_platform", "source_collection", "source_creator", "source_confidence")


@query("r3_r4_subjects_and_kinds", f"SELECT doc_id, CASE WHEN w LIKE '%wing%' THEN 'Wing' WHEN w LIKE '%port side%' THEN 'Port' ELSE 'Whole' END AS subject, CASE WHEN w LIKE '%map%' THEN 'map_or_markup' WHEN p = 'auction' THEN 'auction_photo' WHEN p = 'forum' THEN 'forum_capture' WHEN p = 'video' THEN 'video_screencap' WHEN p = 'social' THEN 'social_media_image' WHEN w LIKE '%wing%' THEN 'detail' ELSE 'reference_image' END AS content_kind FROM (SELECT doc_id, {WORDS} AS w, {PLATFORM} AS p FROM ({PATHS.format(documents='documents')}))")
def _(c):
    path = F.col("rel_path")
    return filed(c).select("doc_id", rules.infer_subject(path, [("wing", "Wing"), ("port side", "Port")], F.lit("Whole")).alias("subject"), rules.content_kind(F.col("source_platform"), path, [("wing", "detail")]).alias("content_kind"))


@query("f17_file_names", f"SELECT doc_id, doc_id % 6 = 0 AS hash, doc_id % 6 = 1 AS social, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 2 END + CASE WHEN doc_id % 6 > 1 THEN 1 ELSE 0 END + CASE WHEN length(filename) > 16 THEN 1 ELSE 0 END AS score, CASE WHEN doc_id % 6 = 0 THEN 'Set - album' ELSE 'Set - album - ' || replace(replace(filename, '.jpg', ''), '_', ' ') END AS suggested_title FROM ({PATHS.format(documents='documents')})")
def _(c):
    name = F.col("filename")
    detail = F.when(~t.hash_like(name), t.humanized(t.stem(name)))
    return filed(c).select("doc_id", t.hash_like(name).alias("hash"), t.social_export(name).alias("social"), t.file_score(name, ("Photo",)).alias("score"), files.suggested_title(F.lit("Set"), F.lit("album"), detail).alias("suggested_title"))


# geometry and decks

OVERLAID = f"""{DECK}, pics AS (SELECT slide, id AS idx, media_name, x, y, y / 10 AS cx, y / 10 AS cy, y * y AS area, flag = 'A' AS crop_any, CASE WHEN flag = 'A' THEN 0.1 ELSE 0 END AS crop_l, CASE WHEN flag = 'A' THEN 0.05 ELSE 0 END AS crop_t FROM deck WHERE line = 1 AND slide % 4 > 0),
    shapes AS (SELECT slide, id AS label_id, CASE WHEN id % 100 = 2 THEN 'Plate ' || CAST(slide AS VARCHAR) ELSE 'part ' || media_name END AS label_text, id % 100 = 2 AS noted, tx AS x, y, 2.0 AS cx, 2.0 AS cy, flag FROM deck WHERE line > 1),
    lay AS (SELECT * FROM (SELECT a.*, p.media_name AS assigned_media, p.x AS px, p.y AS py, p.cx AS pcx, p.cy AS pcy, p.crop_l, p.crop_t, row_number() OVER (PARTITION BY a.label_id ORDER BY sqrt(power(greatest(p.x - (a.x + 1), 0, a.x + 1 - (p.x + p.cx)), 2) + power(greatest(p.y - (a.y + 1), 0, a.y + 1 - (p.y + p.cy)), 2)), p.area DESC, p.idx) AS r FROM shapes a LEFT JOIN pics p ON p.slide = a.slide WHERE NOT noted) WHERE r = 1),
    base AS (SELECT slide, media_name AS base_media FROM (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY area DESC, idx) AS r FROM (SELECT *, row_number() OVER (PARTITION BY slide, media_name ORDER BY crop_any, area DESC, idx) AS k FROM pics) WHERE k = 1) WHERE r = 1),
    many AS (SELECT slide, count(DISTINCT media_name) AS n FROM pics GROUP BY slide), called AS (SELECT slide, arg_min(label_text, label_id) AS slide_title FROM shapes WHERE noted GROUP BY slide)"""


@query("c10_overlay_labels", f"""SELECT * FROM (WITH {OVERLAID} SELECT l.slide, l.label_id, slide_title, label_text, CASE flag WHEN 'A' THEN 'identified_in_this_image' WHEN 'N' THEN 'identified_elsewhere' ELSE 'other_or_unstyled' END AS label_status, assigned_media,
    CASE WHEN assigned_media IN ('m1', 'm2') THEN 'file ' || assigned_media END AS original_name,
    CASE WHEN assigned_media IS NULL THEN 'unmapped' WHEN assigned_media IN ('m1', 'm2') THEN 'high_exact_reused_image' WHEN assigned_media = base_media THEN 'medium_base_image_only' WHEN n = 1 THEN 'medium_same_slide_reuse_only' ELSE 'low_multi_media_slide' END AS mapping_quality,
    round((x + 1 - px) / pcx, 6) + 0 AS in_x, round((y + 1 - py) / pcy, 6) + 0 AS in_y, round(crop_l + (x + 1 - px) / pcx * (1 - crop_l), 6) + 0 AS at_x, round(crop_t + (y + 1 - py) / pcy * (1 - crop_t), 6) + 0 AS at_y, round((x + 1) / 100, 6) AS slide_x
    FROM lay l LEFT JOIN base USING (slide) LEFT JOIN many USING (slide) LEFT JOIN called USING (slide))""")
def _(c):
    """Slides with notes of date and source, which are no labels, and slides without pictures."""
    lines = c.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_tax").alias("tax"), F.min("l_discount").alias("disc"), F.min("l_quantity").alias("y"), F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("flag"))
    rows = lines.selectExpr("*", "CAST(floor(l_orderkey / 100) AS BIGINT) AS slide", "l_orderkey * 10 + l_linenumber AS idx", "'m' || (part % 7) AS media_name")
    crop = {f"crop_{s}": g.crop_fraction(F.when(F.col("flag") == "A", v)) for s, v in (("l", "10000"), ("t", "5000"), ("r", "x"), ("b", "0"))}
    pictures = rows.where("l_linenumber = 1 AND slide % 4 > 0").selectExpr("slide", "idx", "media_name", "disc * 100 AS x", "y", "y / 10 AS cx", "y / 10 AS cy", "y * y AS area", "flag = 'A' AS crop_any", "flag").withColumns(crop).drop("flag")
    text = F.when(F.col("idx") % 100 == 2, F.concat(F.lit("Plate "), F.col("slide").cast("string"), F.lit(" Date: 1976\nSource: archive"))).otherwise(F.concat(F.lit("part "), "media_name"))
    color = F.when(F.col("flag") == "A", "00ff00").when(F.col("flag") == "N", "FFFF00")
    shapes = rows.where("l_linenumber > 1").select("slide", "idx", text.alias("text"), color.alias("color"), (F.col("tax") * 100).alias("x"), "y", F.lit(2.0).alias("cx"), F.lit(2.0).alias("cy"))
    known = pictures.select("media_name", F.concat(F.lit("file "), "media_name").alias("original_name")).where("media_name in ('m1', 'm2')").distinct()
    out = slides.overlay_labels(shapes, pictures, known, (100, 100))
    places = {"in_x": "x_norm_in_assigned", "in_y": "y_norm_in_assigned", "at_x": "projected_x", "at_y": "projected_y", "slide_x": "slide_x_norm"}
    return out.select("slide", "label_id", "slide_title", "label_text", "label_status", "assigned_media", "original_name", "mapping_quality", *[F.round(v, 6).alias(k) for k, v in places.items()])


@query("g7_camera_poses", "SELECT event_id, round((w + x + y + z) / 2, 6) AS qw, round((x - w - y * 1 + z * 1) / 2, 6) AS qx, round((y - w - z + x) / 2, 6) AS qy, round((z - w - x + y) / 2, 6) AS qz, round(3 * value - ((1 - 2 * (y * y + z * z)) * a + 2 * (x * y - w * z) * b + 2 * (x * z + w * y) * c), 6) AS tx FROM (SELECT event_id, value, cos(value / 50) AS w, sin(value / 50) * 0.6 AS x, sin(value / 50) * 0.0 AS y, sin(value / 50) * 0.8 AS z, 2.0 AS a, 3.0 AS b, 1.0 AS c FROM events)")
def _(c):
    """The world is turned by (x, y, z) -> (z, x, y), scaled by 3 and moved by (1, 2, 3)."""
    angle = F.col("value") / 50
    poses = c.events.select("event_id", F.cos(angle).alias("qw"), (F.sin(angle) * 0.6).alias("qx"), (F.sin(angle) * 0.0).alias("qy"), (F.sin(angle) * 0.8).alias("qz"), F.col("value").alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz"))
    return g.camera_update(poses, 3.0, (0.5, 0.5, 0.5, 0.5), (1.0, 2.0, 3.0)).select("event_id", *[F.round(k, 6).alias(k) for k in ("qw", "qx", "qy", "qz", "tx")])


# a deck load: documents are the timeline's files, parts the kit deck's media, labelled documents what the catalog holds

DECK_TABLES = {
    "images": "SELECT doc_id AS id, {sha} AS sha256, CASE doc_id % 3 WHEN 0 THEN lang || ' ' || CAST(doc_id AS STRING) WHEN 1 THEN ' ' END AS title, CAST(NULL AS STRING) AS caption, 'I' || CAST(doc_id AS STRING) AS image_code, 'x=' || CAST(doc_id % 5 AS STRING) || CASE WHEN doc_id % 5 < 2 THEN chr(10) || 'original_media_path=k/' || CAST(doc_id % 40 AS STRING) ELSE '' END AS notes, CAST(NULL AS BIGINT) AS source_id FROM {documents} JOIN (SELECT DISTINCT doc_id AS label_of FROM {labels}) l ON doc_id = label_of",
    "tags": "SELECT d.doc_id AS image_id, d.lang AS tag FROM {documents} d JOIN (SELECT DISTINCT doc_id FROM {labels}) l ON d.doc_id = l.doc_id",
    "regions": "SELECT doc_id * 10 + 1 AS id, doc_id AS image_id, 'point' AS region_type, CAST(0.15 AS DOUBLE) AS x_norm, CAST(0.75 AS DOUBLE) AS y_norm, 'part ' || CAST(doc_id % 4 AS STRING) AS label, CAST(NULL AS STRING) AS notes, CASE doc_id % 6 WHEN 0 THEN chr(123) || '\"import_source\":\"deck\"' || chr(125) WHEN 1 THEN chr(123) || '\"label_status\":\"other\"' || chr(125) ELSE chr(123) || '\"label_status\":\"s' || CAST(doc_id % 4 AS STRING) || '\"' || chr(125) END AS properties_json FROM {labels} WHERE quality = 1",
    "links": "SELECT doc_id AS image_id FROM {documents} WHERE lang = 'de'",
    "timeline": "SELECT 't' || CAST(doc_id AS STRING) AS file, {sha} AS sha256 FROM {documents} WHERE lang <> 'en' OR n_chars > 1000",
    "manifest": "SELECT 't' || CAST(doc_id AS STRING) AS file, 's' || CAST(doc_id % 9 AS STRING) AS nearest_slide_anchor, source AS likely_program, CASE doc_id % 3 WHEN 1 THEN 'Scene ' || lang WHEN 2 THEN 'nan' END AS likely_model_or_scene, CASE WHEN doc_id % 2 = 0 THEN ' Subject ' || source END AS visible_subject, CAST(1970 + doc_id % 9 AS STRING) AS likely_date_window, CASE doc_id % 4 WHEN 0 THEN 'high' ELSE '-' END AS confidence, CASE doc_id % 10 WHEN 7 THEN 'Malformed file' WHEN 3 THEN 'a note' END AS notes FROM {documents}",
    "media": "SELECT 'm' || CAST(p_partkey AS STRING) AS kit_media, coalesce(h, {part_sha}) AS sha256, 'k/' || CAST(p_partkey % 40 AS STRING) AS path FROM {part} LEFT JOIN (SELECT doc_id, {sha} AS h FROM {documents} WHERE doc_id % 7 = 0) d ON doc_id = p_partkey",
    "crosswalk": "SELECT CASE WHEN p_size > 1 THEN 'm' || CAST(p_partkey AS STRING) END AS kit_media, CASE WHEN p_partkey % 3 = 0 THEN 't' || CAST(p_partkey AS STRING) END AS timeline_media, CASE WHEN p_size % 2 = 0 THEN p_type END AS timeline_subject, CASE p_size % 5 WHEN 0 THEN 'Deck ' || p_brand WHEN 1 THEN 'none' END AS timeline_scene, CAST(p_size % 4 AS STRING) AS base_slide_count, CAST(p_size % 7 AS STRING) AS label_total FROM {part}",
    "overlays": "SELECT ' part ' || CAST(l_partkey % 4 AS STRING) AS label_text, 's' || CAST(l_partkey % 4 AS STRING) AS label_status, CASE l_linenumber WHEN 1 THEN 't' || CAST(l_partkey AS STRING) WHEN 2 THEN 'nan' END AS assigned_timeline_media, CASE WHEN l_linenumber IN (2, 5) THEN 't' || CAST(l_partkey AS STRING) END AS base_timeline_media, CASE WHEN l_linenumber IN (1, 3, 5) THEN 'm' || CAST(l_partkey AS STRING) END AS assigned_media, CASE WHEN l_linenumber = 4 THEN 'm' || CAST(l_partkey AS STRING) END AS base_media, CASE WHEN l_suppkey % 4 = 0 THEN 'n/a' ELSE '0.' || CAST(l_suppkey % 10 AS STRING) || '25' END AS projected_x, '0.5' AS projected_y, CASE WHEN l_suppkey % 6 = 5 THEN 'N/A' ELSE '0.' || CAST(l_suppkey % 10 AS STRING) || '5' END AS x_norm_in_assigned, '0.75' AS y_norm_in_assigned FROM {lineitem}",
}


def deck_sql(sql: str) -> str:
    """The load said once more, table by table; the lines of a note are lists there."""
    names = {"documents": "documents", "labels": "labels", "part": "part", "lineitem": "lineitem", "sha": "sha256(text)", "part_sha": "sha256(p_name)"}
    given = ", ".join(f"g_{k} AS ({v.format(**names)})" for k, v in DECK_TABLES.items())
    slug = "replace(lower(trim({0})), ' ', '-')".format
    fill = "CASE WHEN trim({0}) <> '' THEN trim({0}) ELSE {1} END".format
    firsts = "arg_min(title, file) FILTER (title IS NOT NULL) AS title, arg_min(caption, file) FILTER (caption IS NOT NULL) AS caption, flatten(list(lines)) AS lines, flatten(list(tags)) AS tags"
    merged = """SELECT i.id, i.sha256, {title} AS title, {caption} AS caption, i.image_code, i.lines || coalesce(c.lines, []) AS lines, CASE WHEN c.{key} IS NULL THEN i.source_id ELSE coalesce(i.source_id, {source}) END AS source_id
        FROM {before} i LEFT JOIN {found} c ON c.{key} = i.{key}{first}""".format
    added = """SELECT (SELECT max(id) FROM {before}) + row_number() OVER (ORDER BY sha256) AS id, sha256, title, caption, 'PPTXIMG-' || upper(left(sha256, 8)) AS image_code, lines, {source} AS source_id FROM {found} WHERE sha256 NOT IN (SELECT sha256 FROM {before})""".format
    texts = {"title": fill("i.title", "c.title"), "caption": fill("i.caption", "c.caption")}
    only_first = " AND i.id = (SELECT min(x.id) FROM {0} x WHERE x.sha256 = i.sha256)".format
    return f"""SELECT * FROM (WITH {given},
    i0 AS (SELECT id, sha256, title, caption, image_code, string_split(notes, chr(10)) AS lines, source_id FROM g_images),
    m AS (SELECT t.file, t.sha256, coalesce(nullif(likely_model_or_scene, 'nan'), trim(visible_subject), t.file) AS title, trim(visible_subject) AS caption,
        list_filter(['nearest_slide_anchor=' || nearest_slide_anchor, 'likely_program=' || likely_program, 'likely_model_or_scene=' || nullif(likely_model_or_scene, 'nan'), 'likely_date_window=' || likely_date_window, 'confidence=' || nullif(confidence, '-'), notes], lambda x: x IS NOT NULL) AS lines,
        list_filter(['pptx-extract', 'timeline-deck', {slug("likely_program")}, {slug("nullif(likely_model_or_scene, 'nan')")}, nullif(confidence, '-')], lambda x: x IS NOT NULL) AS tags
        FROM g_timeline t JOIN g_manifest USING (file) WHERE coalesce(notes, '') <> 'Malformed file'),
    c1 AS (SELECT sha256, {firsts} FROM m GROUP BY sha256),
    i1 AS ({merged(key="sha256", before="i0", found="c1", source=100, first=only_first("i0"), **texts)} UNION ALL {added(before="i0", found="c1", source=100)}),
    f1 AS (SELECT sha256, min(id) AS image_id FROM i1 GROUP BY sha256), by_file AS (SELECT file, image_id FROM m JOIN f1 USING (sha256)),
    k AS (SELECT w.kit_media, g.path, g.sha256, b.image_id AS linked, w.kit_media AS file, coalesce(nullif(timeline_scene, 'none'), timeline_subject, w.kit_media) AS title, timeline_subject AS caption,
        list_filter(['crosswalk_timeline_media=' || coalesce(timeline_media, 'none'), 'base_slide_count=' || base_slide_count, 'label_total=' || label_total, timeline_subject, nullif(timeline_scene, 'none'), CASE WHEN b.image_id IS NOT NULL THEN 'original_media_path=' || g.path END], lambda x: x IS NOT NULL) AS lines,
        list_filter(['pptx-extract', 'kit-deck', {slug("nullif(timeline_scene, 'none')")}, {slug("timeline_subject")}], lambda x: x IS NOT NULL) AS tags
        FROM g_crosswalk w JOIN g_media g USING (kit_media) LEFT JOIN by_file b ON b.file = w.timeline_media),
    c2 AS (SELECT linked AS id, {firsts} FROM k WHERE linked IS NOT NULL GROUP BY linked),
    i2 AS ({merged(key="id", before="i1", found="c2", source=100, first="", **texts)}),
    c3 AS (SELECT sha256, {firsts} FROM k WHERE linked IS NULL GROUP BY sha256),
    i3 AS ({merged(key="sha256", before="i2", found="c3", source=101, first=only_first("i2"), **texts)} UNION ALL {added(before="i2", found="c3", source=101)}),
    doubles AS (SELECT DISTINCT e.id, k.linked AS survivor FROM k JOIN (SELECT id, list_filter(lines, lambda x: x LIKE 'original_media_path=%')[-1] AS line FROM i1) e ON e.line = 'original_media_path=' || k.path WHERE k.linked <> e.id),
    gone AS (SELECT DISTINCT id FROM doubles WHERE id NOT IN (SELECT image_id FROM g_regions) AND id NOT IN (SELECT image_id FROM g_links) AND id NOT IN (SELECT image_id FROM by_file)),
    i4 AS (SELECT i.* REPLACE (i.lines || coalesce(x.more, []) AS lines) FROM i3 i LEFT JOIN (SELECT survivor, flatten(list(lines)) AS more FROM doubles JOIN i3 USING (id) GROUP BY survivor) x ON x.survivor = i.id WHERE i.id NOT IN (SELECT id FROM gone)),
    said AS (SELECT image_id, tag FROM g_tags UNION SELECT f.image_id, unnest(c.tags) FROM c1 c JOIN f1 f USING (sha256) UNION SELECT id, unnest(tags) FROM c2 UNION SELECT (SELECT min(i.id) FROM i3 i WHERE i.sha256 = c.sha256), unnest(c.tags) FROM c3 c),
    tagged AS (SELECT image_id, tag FROM said UNION SELECT survivor, tag FROM said JOIN doubles ON id = image_id),
    files AS (SELECT 't:' || file AS medium, image_id FROM by_file UNION SELECT 'k:' || kit_media, coalesce(linked, own) FROM k LEFT JOIN (SELECT sha256, min(id) AS own FROM i4 GROUP BY sha256) USING (sha256)),
    medium AS (SELECT medium, min(image_id) AS image_id FROM files WHERE image_id IS NOT NULL GROUP BY medium),
    laid AS (SELECT coalesce(a.image_id, b.image_id) AS image_id, trim(label_text) AS label, label_status AS status, coalesce(CASE WHEN a.image_id IS NOT NULL THEN TRY_CAST(projected_x AS DOUBLE) END, TRY_CAST(x_norm_in_assigned AS DOUBLE)) AS x, CASE WHEN a.image_id IS NOT NULL THEN 0.5 ELSE 0.75 END AS y
        FROM g_overlays LEFT JOIN medium a ON a.medium = 't:' || coalesce(nullif(assigned_timeline_media, 'nan'), base_timeline_media) LEFT JOIN medium b ON b.medium = 'k:' || coalesce(assigned_media, base_media)),
    stay AS (SELECT id, image_id, label, coalesce(json_extract_string(properties_json, '$.label_status'), '') AS status, x_norm AS x, y_norm AS y FROM g_regions WHERE coalesce(json_extract_string(properties_json, '$.import_source'), '') <> 'deck'),
    fresh AS (SELECT image_id, label, status, x, y FROM laid WHERE image_id IS NOT NULL AND x IS NOT NULL EXCEPT SELECT image_id, label, status, x, y FROM stay)
    {sql})"""


def deck_tables(c):
    names = {"sha": "sha2(text, 256)", "part_sha": "sha2(p_name, 256)"} | {k: "{" + k + "}" for k in ("documents", "labels", "part", "lineitem")}
    base = {k: getattr(c, k) for k in ("documents", "labels", "part", "lineitem")}
    made = {}
    for name, sql in DECK_TABLES.items():
        text = sql.format(**names)
        made[name] = c.spark.sql(text, **{k: v for k, v in base.items() if "{" + k + "}" in text})
    return made


def deck_loaded(c) -> loads.Deck:
    return loads.deck_load(**deck_tables(c), sources=(100, 101), import_source="deck")


@query("m17_deck_images", deck_sql("SELECT id, sha256, trim(title) AS title, caption, image_code, source_id, array_to_string(list_sort(list_distinct(lines)), '|') AS note_lines FROM i4"))
def _(c):
    lines = F.array_join(F.array_sort(F.array_distinct(F.split("notes", "\n"))), "|")
    return deck_loaded(c).images.select("id", "sha256", F.trim("title").alias("title"), "caption", "image_code", "source_id", lines.alias("note_lines"))


@query("m17_deck_tags", deck_sql("SELECT image_id, tag FROM tagged WHERE image_id NOT IN (SELECT id FROM gone)"))
def _(c):
    return deck_loaded(c).tags


@query("m17_deck_regions", deck_sql("SELECT id, image_id, label, x, y FROM stay UNION ALL SELECT (SELECT max(id) FROM g_regions) + row_number() OVER (ORDER BY image_id, label, x, y), image_id, label, x, y FROM fresh"))
def _(c):
    return deck_loaded(c).regions.select("id", "image_id", "label", F.col("x_norm").alias("x"), F.col("y_norm").alias("y"))


@query("m17_deck_counts", deck_sql("SELECT 'added' AS key, count(*) AS count FROM fresh UNION ALL SELECT 'repeated', (SELECT count(*) FROM laid WHERE image_id IS NOT NULL AND x IS NOT NULL) - count(*) FROM fresh UNION ALL SELECT 'unmapped', count(*) FROM laid WHERE image_id IS NULL OR x IS NULL"))
def _(c):
    return deck_loaded(c).counts


# small functions on values of every shape

RAW = "SELECT l_orderkey * 10 + l_linenumber AS line, CAST(l_quantity AS INT) AS q, CASE l_partkey % 10 WHEN 0 THEN ' ' || CAST(l_suppkey AS STRING) || ' ' WHEN 1 THEN CAST(l_suppkey AS STRING) || '.75' WHEN 2 THEN '-' || CAST(l_suppkey + 1 AS STRING) || '.5' WHEN 3 THEN 'N/A' WHEN 4 THEN '  ' WHEN 5 THEN 'None' WHEN 6 THEN '99999999999' WHEN 7 THEN 'Yes' WHEN 8 THEN 'off ' END AS v FROM {lineitem}"
NUMBER = "TRY_CAST(CASE WHEN lower(trim(v)) IN ('n/a', 'yes', 'off', 'none', '') THEN NULL ELSE trim(v) END AS DOUBLE)"


def raw(c) -> DataFrame:
    return c.spark.sql(RAW, lineitem=c.lineitem)


@query("f_sheet_values", f"SELECT line, q, CASE WHEN regexp_full_match(trim(v), '[+-]?[0-9]+') THEN TRY_CAST(trim(v) AS INT) END AS whole, {NUMBER} AS real, TRY_CAST(trunc({NUMBER}) AS INT) AS cut, CASE WHEN trim(v) NOT ILIKE 'n/a' THEN {NUMBER} END AS maybe, CASE trim(lower(v)) WHEN 'yes' THEN 1 WHEN 'off' THEN 0 WHEN '1' THEN 1 WHEN '0' THEN 0 END AS flag, CASE WHEN trim(v) = '0' THEN 0 ELSE 1 END AS loose, CASE WHEN lower(trim(v)) NOT IN ('none', '') THEN trim(v) END AS cleaned, coalesce(CASE WHEN trim(v) <> '' THEN trim(v) END, CASE WHEN q % 2 = 0 THEN 'drive' WHEN q % 3 = 0 THEN 'url' ELSE 'other' END) AS kind, CASE WHEN q % 5 = 0 THEN 'confirmed' ELSE 'probable' END AS confidence FROM ({RAW.format(lineitem='lineitem')})")
def _(c):
    v, q = F.col("v"), F.col("q")
    kind = t.storage_kind(v, F.when(q % 2 == 0, "d"), F.when(q % 3 == 0, "u"))
    mark = t.mark_confidence(F.when(q % 5 == 0, " X").when(q % 5 == 1, "see"))
    return raw(c).select("line", "q", t.to_int(v).alias("whole"), t.to_float(v).alias("real"), t.safe_int(v).alias("cut"), t.maybe_float(v).alias("maybe"), t.flag(v).alias("flag"), t.loose_flag(F.trim(v)).alias("loose"), t.clean(v).alias("cleaned"), kind.alias("kind"), mark.alias("confidence"))


MORE = "chr(10) || 'slide_key=plate_1' || chr(10) || ' added=' || CAST(id % 3 AS STRING) || ' ' || chr(10) || chr(10) || 'slide_key=last-' || CAST(id % 4 AS STRING)"
UNITED = "list_filter(list_transform(string_split(coalesce(notes, ''), chr(10)) || string_split(" + MORE + ", chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query("f_notes", f"SELECT id, array_to_string(list_filter(ls, lambda x, i: list_position(ls, x) = i), chr(10)) AS united, 'last-' || CAST(id % 4 AS VARCHAR) AS slide_key, 'last ' || CAST(id % 4 AS VARCHAR) AS words, coalesce(scene, 'file ' || CAST(id AS VARCHAR)) AS title FROM (SELECT id, {UNITED} AS ls, CASE WHEN notes LIKE '%Scene%' THEN 'Scene ' || CAST(id % 5 AS VARCHAR) END AS scene FROM images)", "images")
def _(c):
    """Notes united with lines of which some are there already; the last line of a key counts."""
    more = c.images.select("id", "notes", F.expr(MORE).alias("more"))
    rows = more.select("id", t.note_union(F.col("notes"), F.col("more")).alias("united"), t.answer(t.note_value(F.col("notes"), "likely_model_or_scene")).alias("scene"))
    key = t.note_value(F.col("united"), "slide_key")
    return rows.select("id", "united", key.alias("slide_key"), t.humanized(key).alias("words"), loads.choose_title(F.col("scene"), F.lit("none"), F.concat(F.lit("file "), F.col("id").cast("string"))).alias("title"))


@query("j18_images_at_paths", "SELECT p.p_partkey AS part_id, i.id FROM part p JOIN images i ON i.id = p.p_partkey AND (i.id % 3 = 0) = (p.p_size % 10 < 4) WHERE i.id % 4 < 3", "images")
def _(c):
    """Notes of which some name a path twice, the last counting, and some none."""
    number = F.col("id").cast("string")
    first, late = F.concat(F.lit("\noriginal_media_path = media/"), number), F.when(F.col("id") % 3 == 0, F.concat(F.lit("\noriginal_media_path=late/"), number)).otherwise("")
    noted = c.images.select("id", F.when(F.col("id") % 4 < 3, F.concat(F.coalesce("notes", F.lit("")), first, late)).otherwise(F.col("notes")).alias("notes"))
    wanted = c.part.selectExpr("p_partkey AS part_id", "CASE WHEN p_size % 10 < 4 THEN 'late/' ELSE 'media/' END || p_partkey AS path")
    return wanted.join(loads.at_path(noted), "path").select("part_id", "id")


@query("f_urls_and_names", r"""SELECT id, CASE id % 3 WHEN 0 THEN CAST(id AS VARCHAR) END AS thread_id, CASE id % 5 WHEN 0 THEN 'https://h/a/' || id || '.PNG' WHEN 1 THEN 'https://x/' || id || '.jpg' WHEN 2 THEN 'https://h/' || id || '.webp' END AS image_url,
    CASE id % 4 WHEN 0 THEN 'Stored' WHEN 1 THEN n ELSE array_to_string(list_transform(string_split(n, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') END AS title, n || '_ v' || (id % 7) || '_' AS file, CASE WHEN id % 3 < 2 THEN id END AS slide, n AS bare, 'alpha|' || n AS tags
    FROM (SELECT p_partkey AS id, lower(p_name) AS n FROM part)""")
def _(c):
    n, k = F.lower("p_name"), F.col("p_partkey")
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    url = F.when(k % 3 == 0, text("https://b/forums/threads/", F.replace(n, F.lit(" "), F.lit("-")), ".", k, "/")).otherwise(text("https://b/forums/threads/", F.replace(n, F.lit(" "), F.lit("-"))))
    src = F.when(k % 5 == 0, text("/a/", k, ".PNG?size=2")).when(k % 5 == 1, text("//x/", k, ".jpg#top")).when(k % 5 == 2, text(k, ".webp")).when(k % 5 == 3, "data:image/png;base64,.png").otherwise(text("/a/", k, ".svg"))
    title = t.thread_title(F.when(k % 4 == 0, "Stored").otherwise(" "), F.when(k % 4 == 1, text("<html><TITLE>\n", n, " </title>")).otherwise(""), url)
    slide = t.ordinal(F.when(k % 3 == 0, text("slide", k, ".xml")).when(k % 3 == 1, text("p-", k, "-2.9.xml")).otherwise("slide.xml9"))
    return c.part.select(k.alias("id"), t.thread_id(url).alias("thread_id"), t.image_url(src, "https://h").alias("image_url"), title.alias("title"), t.safe_filename(text("  ", n, ":   v", k % 7, "?")).alias("file"), slide.cast("long").alias("slide"), t.without_date(text(" ", n, "\nDate: 1976\nSource: s")).alias("bare"), F.array_join(t.tag_list(text(" alpha,, ", n, " ,")), "|").alias("tags"))


# files, blobs and manifests

#: Documents as picture files: hidden ones, names that are hashes, and equal contents under several names.
FILES = """SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'a/' WHEN 1 THEN 'b/long/' ELSE '' END || name AS rel_path, name AS filename, n_chars AS size_bytes FROM (
        SELECT *, CASE doc_id % 5 WHEN 0 THEN '.hidden ' WHEN 1 THEN 'wing_' WHEN 2 THEN repeat('c', 20) ELSE '' END || CAST(doc_id AS STRING) || '.png' AS name FROM {documents})"""
FILES_SQL = f"""files AS (SELECT *, sha256(text) AS sha256, CASE WHEN doc_id % 5 = 2 THEN 0 ELSE 2 END + CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END + CASE WHEN length(filename) > 16 THEN 1 ELSE 0 END AS score FROM ({FILES.format(documents="documents")})),
    best AS (SELECT sha256, rel_path AS canonical_rel_path FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id % 5 = 0, score DESC, length(rel_path), rel_path) AS r FROM files) WHERE r = 1)"""


def pictures(c) -> DataFrame:
    """Files with a PNG's or a GIF's header before the text, or none."""
    rows = c.spark.sql(FILES, documents=c.documents)
    big = lambda x: F.unhex(F.lpad(F.hex(x), 8, "0"))
    small = lambda x: F.concat(F.unhex(F.lpad(F.hex(x % 256), 2, "0")), F.unhex(F.lpad(F.hex(F.floor(x / 256) % 256), 2, "0")))
    width, height = F.col("size_bytes") % 60000, F.col("doc_id") % 1000
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), big(width), big(height))
    gif = F.concat(F.unhex(F.lit("474946383961")), small(width), small(height))
    head = F.when(F.col("doc_id") % 3 == 0, png).when(F.col("doc_id") % 3 == 1, gif).otherwise(F.unhex(F.lit("89504E47")))
    return rows.select("doc_id", F.col("rel_path").alias("path"), "rel_path", "filename", F.lit(".png").alias("ext"), "size_bytes", F.concat(head, F.encode("text", "utf-8")).alias("content"))


def inventoried(c) -> DataFrame:
    rows = c.spark.sql(FILES, documents=c.documents)
    found = rows.select("doc_id", "rel_path", "filename", "size_bytes", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.encode("text", "utf-8").alias("content"))
    return files.inventory(found, terms=("Wing",))


@query("c2_picture_sizes", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN CAST(n_chars % 60000 AS INT) END AS width, CASE WHEN doc_id % 3 < 2 THEN CAST(doc_id % 1000 AS INT) END AS height FROM documents")
def _(c):
    return files.with_sizes(pictures(c)).select("doc_id", "width", "height")


@query("c3_file_inventory", f"SELECT * FROM (WITH {FILES_SQL} SELECT doc_id, sha256, doc_id % 5 = 0 AS is_hidden, count(*) OVER (PARTITION BY sha256) AS duplicate_count, canonical_rel_path, rel_path = canonical_rel_path AS is_canonical FROM files JOIN best USING (sha256))")
def _(c):
    return inventoried(c).select("doc_id", "sha256", "is_hidden", "duplicate_count", "canonical_rel_path", "is_canonical")


@query("c3_load_ready_files", f"SELECT * FROM (WITH {FILES_SQL} SELECT sha256, rel_path, (SELECT count(*) FROM files x WHERE x.sha256 = f.sha256) AS duplicate_count, 'REF-' || upper(left(sha256, 16)) AS suggested_image_code, 'Corpus - web' || CASE WHEN doc_id % 5 = 2 THEN '' ELSE ' - ' || replace(replace(filename, '.png', ''), '_', ' ') END AS suggested_title FROM files f JOIN best b USING (sha256) WHERE rel_path = canonical_rel_path)")
def _(c):
    return files.load_ready(inventoried(c), F.lit("Corpus"), F.lit("web")).select("sha256", "rel_path", "duplicate_count", "suggested_image_code", "suggested_title")


@query("s10_manifest_round_trip", "SELECT doc_id, sha256(coalesce(text, 'none')) AS sha256, lang, CASE doc_id % 3 WHEN 0 THEN ' \"a\\b\", ' || source || chr(10) || '\"' WHEN 1 THEN '\\' ELSE chr(13) || 'x' || chr(13) || chr(10) END AS note FROM documents")
def _(c):
    """Whole texts, quotes, backslashes, line ends and blanks at the ends, written as CSV and read back."""
    note = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(' "a\\b", '), "source", F.lit('\n"'))).when(F.col("doc_id") % 3 == 1, "\\").otherwise("\rx\r\n")
    rows = c.documents.select("doc_id", "text", "lang", note.alias("note"))
    path = new_path(c.spark, "manifest")
    tables.write_manifest(rows, path, ["doc_id"])
    return tables.read_manifest(c.spark, path, rows.schema).select("doc_id", F.sha2(F.coalesce("text", F.lit("none")), 256).alias("sha256"), "lang", "note")


@query("s11_written_blobs", "SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND text IS NOT NULL)")
def _(c):
    """The contents of good documents are in the store already."""
    content = c.documents.where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), F.encode("text", "utf-8").alias("content"))
    held = content.join(c.labels.where("quality = 1"), "doc_id", "left_semi").select("sha256")
    return tables.write_blobs(content, held, new_path(c.spark, "blobs"))


@query("s12_orphaned_blobs", "SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))")
def _(c):
    named = c.images.join(c.labels, F.col("id") == F.col("doc_id"), "left_semi")
    return tables.orphans(c.images.select("sha256").distinct(), named)


@query("s12_released_files", "SELECT sha256 FROM images GROUP BY sha256 HAVING bool_and(id IN (SELECT doc_id FROM labels))", "images")
def _(c):
    """The images of labelled documents go, some named twice; a file stays while an image of equal content does."""
    return tables.released(c.images, c.labels.select(F.col("doc_id").alias("id")).union(c.labels.select("doc_id")))


@query("h2_conformed_rows", "SELECT id, CAST(size AS BIGINT) AS size, part_label, CAST(NULL AS DOUBLE) AS weight, CAST(part_number AS INT) AS part_number FROM parts", "parts")
def _(c):
    return tables.conform(c.parts, T.StructType([T.StructField("id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("part_label", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("part_number", T.IntegerType())]))
