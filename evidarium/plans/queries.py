"""Registered queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import chains, counters, keywords, matching, merge, rules, spatial, spelling, windows
from ..sources import slides, threads
from ..sources.shared import new_path
from ..sources.snapshots import Snapshot
from ..streaming import changes
from . import catalog as q
from . import jobs
from . import search as lookup
from . import timelines
from .analog import Catalog, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(build: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Catalog(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql, *views)
        return build

    return add


def text_of(array: str, field: str) -> Column:
    return F.array_join(F.transform(array, lambda s: s[field].cast("string")), ",")


VIA = "placement_kit AS (SELECT p.*, coalesce(t.kit_id, p.kit_id) AS via_kit FROM placements p LEFT JOIN parts t ON p.part_id = t.id)"
PK = ("kits", "parts", "models", "placements")


def via(sql: str, extra: tuple[str, ...] = ()) -> tuple:
    """A query that also sees placement_kit."""
    return (f"SELECT * FROM (WITH {VIA} {sql})", *PK, *extra)


# catalog queries


@query("q9_connections", *via("SELECT kit_id, brand, name, model_count, model_names FROM (SELECT via_kit AS kit_id, count(DISTINCT model_id) AS model_count, string_agg(DISTINCT m.name, ',' ORDER BY m.name) AS model_names FROM placement_kit JOIN models m ON m.id = model_id WHERE via_kit IS NOT NULL GROUP BY via_kit HAVING count(DISTINCT model_id) >= 2) JOIN kits ON kits.id = kit_id"))
def _(c):
    return q.connections(c, placements=q.placement_kit(c))


@query("q9_connections_all", *via("SELECT kit_id, brand, name, model_count, model_names FROM (SELECT via_kit AS kit_id, count(DISTINCT model_id) AS model_count, string_agg(DISTINCT m.name, ',' ORDER BY m.name) AS model_names FROM placement_kit JOIN models m ON m.id = model_id WHERE via_kit IS NOT NULL GROUP BY via_kit HAVING count(DISTINCT model_id) >= 2) JOIN kits ON kits.id = kit_id"))
def _(c):
    return q.connections(c)


@query("q9_connections_with_assemblies", *via("SELECT kit_id, brand, name, model_count FROM (SELECT kit_id, count(DISTINCT model_id) AS model_count FROM (SELECT via_kit AS kit_id, model_id FROM placement_kit WHERE via_kit IS NOT NULL UNION ALL SELECT t.kit_id, p.model_id FROM placements p JOIN cast_assembly_parts a USING (cast_assembly_id) JOIN parts t ON t.id = a.part_id) GROUP BY kit_id HAVING count(DISTINCT model_id) >= 2) JOIN kits ON kits.id = kit_id", ("cast_assembly_parts",)))
def _(c):
    return q.connections(c, include_assemblies=True).select("kit_id", "brand", "name", "model_count")


@query("q1_kits_filtered", "SELECT id, brand, name, availability FROM kits WHERE availability = 'rare' AND (brand ILIKE '%1%' OR name ILIKE '%1%' OR coalesce(scale, '') ILIKE '%1%')", "kits")
def _(c):
    return q.kits(c, text="1", availability="rare").select("id", "brand", "name", "availability")


@query("q2_kit_profiles", *via("SELECT k.id, k.brand, (SELECT count(*) FROM parts t WHERE t.kit_id = k.id) AS parts, (SELECT string_agg(DISTINCT m.name, ',' ORDER BY m.name) FROM placement_kit p JOIN models m ON m.id = p.model_id WHERE p.via_kit = k.id) AS models, (SELECT count(*) FROM image_links l WHERE l.entity_type = 'kit' AND l.entity_id = k.id) AS images FROM kits k", ("image_links",)))
def _(c):
    return q.kit_profiles(c).select("id", "brand", F.size("parts").cast("long").alias("parts"), text_of("models", "model").alias("models"), F.size("images").cast("long").alias("images"))


@query("q3_parts_search", "SELECT p.id, p.part_number, p.part_label, brand FROM parts p JOIN kits k ON k.id = p.kit_id WHERE p.part_number ILIKE '%ring%' OR p.part_label ILIKE '%ring%' OR coalesce(p.notes, '') ILIKE '%ring%'", "parts", "kits")
def _(c):
    return q.parts(c, text="ring").select("id", "part_number", "part_label", "brand")


@query("q3_part_profiles", "SELECT p.id, p.part_number, coalesce(n, 0) AS placements, coalesce(copies, 0) AS copies, (SELECT count(*) FROM image_links l WHERE l.entity_type = 'part' AND l.entity_id = p.id) AS images FROM parts p LEFT JOIN (SELECT part_id, count(*) AS n, CAST(sum(copy_count) AS BIGINT) AS copies FROM placements GROUP BY part_id) x ON x.part_id = p.id", "parts", "placements", "image_links")
def _(c):
    copies = F.aggregate("placements", F.lit(0).cast("long"), lambda a, s: a + s["copy_count"])
    return q.part_profiles(c).select("id", "part_number", F.size("placements").cast("long").alias("placements"), copies.alias("copies"), F.size("images").cast("long").alias("images"))


@query("q4_model_kit_summary", *via("SELECT model_id, via_kit AS kit_id, count(DISTINCT part_id) AS parts, CAST(sum(copy_count) AS BIGINT) AS copies FROM placement_kit WHERE part_id IS NOT NULL GROUP BY model_id, via_kit"))
def _(c):
    return q.model_kit_summary(c)


@query("a2_model_kit_summary_all", *via("SELECT model_id, via_kit AS kit_id, count(DISTINCT part_id) AS parts, CAST(sum(copy_count) AS BIGINT) AS copies FROM placement_kit WHERE via_kit IS NOT NULL GROUP BY model_id, via_kit"))
def _(c):
    return q.model_kit_summary(c, part_level_only=False)


@query("a7_kit_models", *via("SELECT DISTINCT via_kit AS kit_id, model_id, m.name AS model, film FROM placement_kit JOIN models m ON m.id = model_id WHERE via_kit IS NOT NULL"))
def _(c):
    return q.kit_models(c)


@query("q5_maps", "SELECT m.id, m.model_id, m.name, i.filename AS base_image FROM maps m LEFT JOIN images i ON i.id = m.image_id", "maps", "images")
def _(c):
    return q.maps(c).select("id", "model_id", "name", "base_image")


CURRENT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY placement_id ORDER BY created_at DESC NULLS LAST, id DESC) AS r FROM placement_positions WHERE is_current = 1) WHERE r = 1)"


@query("q6_placements", f"SELECT * FROM (WITH {VIA}, now AS {CURRENT} SELECT p.id, m.name AS model, k.brand AS kit, t.part_number, a.name AS assembly, u.handle, n.id AS position_id, n.x_norm FROM placement_kit p JOIN models m ON m.id = p.model_id LEFT JOIN kits k ON k.id = p.via_kit LEFT JOIN parts t ON t.id = p.part_id LEFT JOIN cast_assemblies a ON a.id = p.cast_assembly_id LEFT JOIN contributors u ON u.id = p.attributed_to LEFT JOIN now n ON n.placement_id = p.id WHERE p.confidence = 'confirmed' AND p.film_version = 'F')", *PK, "placement_positions", "cast_assemblies", "contributors")
def _(c):
    return q.placements(c, confidence="confirmed", film_version="F").select("id", "model", "kit", "part_number", "assembly", "handle", "position_id", "x_norm")


@query("w1_current_positions", f"SELECT placement_id, id, created_at, status FROM {CURRENT}", "placement_positions")
def _(c):
    return windows.current_positions(c.placement_positions).select("placement_id", "id", "created_at", "status")


@query("q8_positions", "SELECT id, placement_id, map_id, x_norm, is_current FROM placement_positions WHERE status = 'active'", "placement_positions")
def _(c):
    return q.positions(c, status="active").select("id", "placement_id", "map_id", "x_norm", "is_current")


@query("w3_replacement_positions", "SELECT placement_id, map_id, id FROM (SELECT *, row_number() OVER (PARTITION BY placement_id, map_id ORDER BY created_at DESC NULLS LAST, id DESC) AS r FROM placement_positions WHERE status = 'active' AND id % 2 = 1 AND (placement_id, map_id) IN (SELECT (placement_id, map_id) FROM placement_positions WHERE is_current = 1 AND id % 2 = 0)) WHERE r = 1", "placement_positions")
def _(c):
    return windows.replacement_positions(c.placement_positions, c.placement_positions.where("id % 2 = 0")).select("placement_id", "map_id", "id")


@query("q10_assemblies", "SELECT a.id, a.name, (SELECT count(DISTINCT part_id) FROM cast_assembly_parts x WHERE x.cast_assembly_id = a.id) AS part_count, (SELECT count(DISTINCT model_id) FROM placements x WHERE x.cast_assembly_id = a.id) AS model_count FROM cast_assemblies a", "cast_assemblies", "cast_assembly_parts", "placements")
def _(c):
    return q.assemblies(c).select("id", "name", "part_count", "model_count")


@query("q10_assembly_profiles", "SELECT a.id, (SELECT string_agg(CAST(part_id AS STRING), ',' ORDER BY t.kit_id, t.part_number, part_id) FROM cast_assembly_parts x JOIN parts t ON t.id = x.part_id WHERE x.cast_assembly_id = a.id) AS parts, (SELECT string_agg(DISTINCT m.name, ',' ORDER BY m.name) FROM placements x JOIN models m ON m.id = x.model_id WHERE x.cast_assembly_id = a.id) AS models FROM cast_assemblies a", "cast_assemblies", "cast_assembly_parts", "placements", "parts", "models")
def _(c):
    blank = lambda x: F.nullif(x, F.lit(""))
    return q.assembly_profiles(c).select("id", blank(text_of("parts", "part_id")).alias("parts"), blank(text_of("models", "model")).alias("models"))


@query("q11_sources", "SELECT s.id, s.title, p.title AS parent_title, (SELECT count(*) FROM source_extracts e WHERE e.source_id = s.id) AS extract_count FROM sources s LEFT JOIN sources p ON p.id = s.parent_source_id WHERE s.title ILIKE '%1%' OR s.source_code ILIKE '%1%'", "sources", "source_extracts")
def _(c):
    return q.sources(c, text="1").select("id", "title", "parent_title", "extract_count")


@query("x3_source_paths", "SELECT * FROM (WITH RECURSIVE tree AS (SELECT id, 0 AS depth, source_code AS path FROM sources WHERE parent_source_id IS NULL UNION ALL SELECT s.id, depth + 1, path || '/' || s.source_code FROM sources s JOIN tree t ON s.parent_source_id = t.id) SELECT id, depth, path FROM tree)", "sources")
def _(c):
    return q.source_paths(c)


@query("q12_extracts", "SELECT e.id, s.title AS source_title, length(content) AS n FROM source_extracts e JOIN sources s ON s.id = e.source_id WHERE author_handle = 'user' AND (content ILIKE '%the%' OR author_handle ILIKE '%the%')", "source_extracts", "sources")
def _(c):
    return q.extracts(c, text="the", author="user").select("id", "source_title", F.length("content").cast("long").alias("n"))


@query("q13_families", "SELECT family_id, count(*) AS member_count, CAST(sum(is_hidden) AS BIGINT) AS hidden_count, arg_min(image_id, (1 - is_primary, sort_order, id)) AS primary_image_id FROM image_family_members GROUP BY family_id", "image_family_members")
def _(c):
    return q.families(c)


LIBRARY = "i.id, i.filename, f.family_id, (SELECT count(*) FROM image_regions r WHERE r.image_id = i.id) AS region_count, (SELECT count(DISTINCT claim_id) FROM (SELECT claim_id, CASE WHEN evidence_type = 'image' THEN evidence_id ELSE r.image_id END AS img FROM claim_evidence e LEFT JOIN image_regions r ON e.evidence_type = 'image_region' AND r.id = e.evidence_id WHERE evidence_type <> 'source_extract') x WHERE x.img = i.id) AS claim_count FROM images i LEFT JOIN image_family_members f ON f.image_id = i.id"
LIBRARY_VIEWS = ("images", "image_family_members", "image_regions", "claim_evidence", "image_tags")


@query("q14_image_library", f"SELECT {LIBRARY}", *LIBRARY_VIEWS)
def _(c):
    return q.image_library(c).select("id", "filename", "family_id", "region_count", "claim_count")


@query("q14_image_library_collapsed", f"SELECT {LIBRARY} WHERE (coalesce(title, '') ILIKE '%an%' OR filename ILIKE '%an%') AND i.id IN (SELECT image_id FROM image_tags WHERE tag = 'en') AND (f.family_id IS NULL OR f.is_primary = 1 OR f.is_hidden = 0)", *LIBRARY_VIEWS)
def _(c):
    return q.image_library(c, text="an", tag="en", collapse=True).select("id", "filename", "family_id", "region_count", "claim_count")


@query("a5_region_claims", "SELECT evidence_id AS region_id, count(DISTINCT claim_id) AS claim_count FROM claim_evidence WHERE evidence_type = 'image_region' GROUP BY evidence_id", "claim_evidence")
def _(c):
    return q.region_claims(c)


LABELS = """labels_of AS (
    SELECT 'kit' AS entity_type, id AS entity_id, brand || ' ' || name AS label FROM kits
    UNION ALL SELECT 'part', t.id, k.brand || ' ' || t.part_number || ' ' || t.part_label FROM parts t JOIN kits k ON k.id = t.kit_id
    UNION ALL SELECT 'cast_assembly', id, name FROM cast_assemblies
    UNION ALL SELECT 'placement', p.id, m.name || ' / ' || p.film_version FROM placements p JOIN models m ON m.id = p.model_id
    UNION ALL SELECT 'model', id, name FROM models
    UNION ALL SELECT 'map', x.id, m.name || ' ' || x.name FROM maps x JOIN models m ON m.id = x.model_id)"""
LABEL_VIEWS = ("kits", "parts", "models", "placements", "cast_assemblies", "maps")


@query("l1_entity_labels", f"SELECT * FROM (WITH {LABELS} SELECT * FROM labels_of)", *LABEL_VIEWS)
def _(c):
    return q.entity_labels(c)


@query("q17_image_links", f"SELECT * FROM (WITH {LABELS} SELECT l.id, l.image_id, l.entity_type, l.entity_id, coalesce(label, l.entity_type || ' #' || CAST(l.entity_id AS STRING)) AS label FROM image_links l LEFT JOIN labels_of USING (entity_type, entity_id))", *LABEL_VIEWS, "image_links")
def _(c):
    return q.image_links(c).select("id", "image_id", "entity_type", "entity_id", "label")


@query("q18_claims", f"SELECT * FROM (WITH {LABELS} SELECT k.id, predicate, text_value, label AS subject, (SELECT count(*) FROM claim_evidence e WHERE e.claim_id = k.id) AS evidence_count FROM claims k LEFT JOIN labels_of o ON o.entity_type = subject_type AND o.entity_id = subject_id WHERE status = 'active')", *LABEL_VIEWS, "claims", "claim_evidence")
def _(c):
    return q.claims(c, status="active").select("id", "predicate", "text_value", "subject", "evidence_count")


@query("j15_evidence_labels", "SELECT e.claim_id, e.evidence_type, e.evidence_id, CASE e.evidence_type WHEN 'image_region' THEN coalesce(nullif(trim(r.label), ''), CASE WHEN r.id IS NOT NULL THEN 'region' END) WHEN 'image' THEN coalesce(nullif(trim(i.title), ''), nullif(trim(i.filename), '')) ELSE CASE WHEN length(x.content) > 80 THEN left(x.content, 80) || '...' ELSE x.content END END AS label FROM claim_evidence e LEFT JOIN image_regions r ON e.evidence_type = 'image_region' AND r.id = e.evidence_id LEFT JOIN images i ON e.evidence_type = 'image' AND i.id = e.evidence_id LEFT JOIN source_extracts x ON e.evidence_type = 'source_extract' AND x.id = e.evidence_id", "claim_evidence", "image_regions", "images", "source_extracts")
def _(c):
    return q.evidence_labels(c).select("claim_id", "evidence_type", "evidence_id", "label")


@query("x2_contested_claims", "SELECT subject_type, subject_id, predicate, count(*) AS claims, count(DISTINCT text_value) AS n_values FROM claims WHERE status IN ('active', 'contested') GROUP BY ALL HAVING count(DISTINCT text_value) > 1", "claims")
def _(c):
    return q.contested(c)


@query("x9_edges", "SELECT src_type, dst_type, count(*) AS n FROM (SELECT 'placement' AS src_type, 'model' AS dst_type FROM placements UNION ALL SELECT 'placement', 'part' FROM placements WHERE part_id IS NOT NULL UNION ALL SELECT 'placement', 'kit' FROM placements WHERE kit_id IS NOT NULL UNION ALL SELECT 'part', 'kit' FROM parts UNION ALL SELECT entity_type, 'image' FROM image_links UNION ALL SELECT 'image_region', 'image' FROM image_regions UNION ALL SELECT 'claim', evidence_type FROM claim_evidence) GROUP BY ALL", "placements", "parts", "image_links", "image_regions", "claim_evidence")
def _(c):
    return q.edges(c).groupBy("src_type", "dst_type").agg(F.count(F.lit(1)).alias("n"))


@query("x9_reachable_from_claims", "SELECT type, id, min(hop) AS hop FROM (SELECT 'claim' AS type, id, 0 AS hop FROM claims WHERE status = 'contested' UNION ALL SELECT e.evidence_type, e.evidence_id, 1 FROM claims k JOIN claim_evidence e ON e.claim_id = k.id WHERE status = 'contested' UNION ALL SELECT 'image', r.image_id, 2 FROM claims k JOIN claim_evidence e ON e.claim_id = k.id JOIN image_regions r ON r.id = e.evidence_id WHERE status = 'contested' AND e.evidence_type = 'image_region') GROUP BY type, id", "claims", "claim_evidence", "image_regions")
def _(c):
    start = c.claims.where("status = 'contested'").select(F.lit("claim").alias("type"), "id")
    return q.reachable(c, start, 2)


ASKED = "asked AS (SELECT s_suppkey AS query_id, CASE s_suppkey % 4 WHEN 0 THEN 'ring' WHEN 1 THEN 'NATION_1' WHEN 2 THEN 'e' ELSE 'brand#2' END AS text FROM supplier WHERE s_suppkey % 11 = 0)"
INDEX = "idx AS (SELECT 'kit' AS type, id, brand || ' ' || name AS title, coalesce(scale || ' / ', '') || availability AS subtitle FROM kits UNION ALL SELECT 'part', t.id, t.part_number || ' ' || t.part_label, k.brand FROM parts t JOIN kits k ON k.id = t.kit_id UNION ALL SELECT 'model', id, name, film FROM models UNION ALL SELECT 'image', id, coalesce(nullif(trim(title), ''), filename), image_type FROM images UNION ALL SELECT 'source', id, title, source_code FROM sources)"


@query("q20_entity_search", f"SELECT * FROM (WITH {ASKED}, {INDEX}, hits AS (SELECT query_id, idx.*, row_number() OVER (PARTITION BY query_id, type ORDER BY title, id) AS r FROM idx JOIN asked ON length(trim(asked.text)) >= 2 AND (title ILIKE '%' || asked.text || '%' OR coalesce(subtitle, '') ILIKE '%' || asked.text || '%')) SELECT query_id, type, id, title, subtitle, CAST(row_number() OVER (PARTITION BY query_id ORDER BY type, title, id) AS INT) AS place FROM hits WHERE r <= 5 QUALIFY place <= 20)", "kits", "parts", "models", "images", "sources")
def _(c):
    text = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'ring' WHEN 1 THEN 'NATION_1' WHEN 2 THEN 'e' ELSE 'brand#2' END")
    return q.search(c, c.supplier.where("s_suppkey % 11 = 0").select(F.col("s_suppkey").alias("query_id"), text.alias("text"))).drop("badges")


#: A query for every customer: names, numbers, brands, wildcards with and without three letters in a row, two letters, nothing.
MANY = """CASE c_custkey % 8 WHEN 0 THEN 'picture ' || CAST(c_custkey AS STRING) WHEN 1 THEN CAST(c_custkey % 500 AS STRING) || ' ' WHEN 2 THEN 'Brand#' || CAST(c_custkey % 25 AS STRING) WHEN 3 THEN 'ATION_' || CAST(c_custkey % 30 AS STRING)
    WHEN 4 THEN 'r%ng' WHEN 5 THEN 'wid_et' WHEN 6 THEN 'ne' ELSE 'none ' || CAST(c_custkey AS STRING) END"""


@query("q20_posting_search", f"SELECT * FROM (WITH asked AS (SELECT c_custkey AS query_id, {MANY} AS text FROM customer), {INDEX}, texts AS (SELECT DISTINCT text FROM asked WHERE length(trim(text)) >= 2), hits AS (SELECT text, idx.*, row_number() OVER (PARTITION BY text, type ORDER BY title, id) AS r FROM idx JOIN texts ON title ILIKE '%' || text || '%' OR coalesce(subtitle, '') ILIKE '%' || text || '%') SELECT query_id, type, id, title, subtitle, CAST(row_number() OVER (PARTITION BY query_id ORDER BY type, title, id) AS INT) AS place FROM hits JOIN asked USING (text) WHERE r <= 5 QUALIFY place <= 20)", "kits", "parts", "models", "images", "sources")
def _(c):
    asked = c.customer.select(F.col("c_custkey").alias("query_id"), F.expr(MANY).alias("text"))
    return lookup.search_index(lookup.catalog_index(c), asked).drop("badges")


# aggregates and windows


@query("a8_duplicate_totals", "SELECT count(*) AS files, count(DISTINCT sha256) AS unique_files, count(*) - count(DISTINCT sha256) AS duplicates, (SELECT count(*) FROM (SELECT 1 FROM images GROUP BY sha256 HAVING count(*) > 1)) AS groups FROM images", "images")
def _(c):
    return counters.duplicate_totals(c.images)


@query("a9_counters", "SELECT * FROM (SELECT 'type' AS section, image_type AS key, count(*) AS count FROM images GROUP BY 2 UNION ALL SELECT 'source', CAST(source_id AS STRING), count(*) FROM images GROUP BY 2 UNION ALL SELECT 'both', image_type || '/' || CAST(source_id AS STRING), count(*) FROM images GROUP BY 2 UNION ALL SELECT 'all', '', count(*) FROM images)", "images")
def _(c):
    return counters.counters(c.images, {"type": F.col("image_type"), "source": F.col("source_id"), "both": F.concat_ws("/", "image_type", F.col("source_id").cast("string")), "all": F.lit("")})


@query("a9_top_counters", "SELECT section, key, count FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY count DESC, key) AS r FROM (SELECT 'type' AS section, image_type AS key, count(*) AS count FROM images GROUP BY 2 UNION ALL SELECT 'source', CAST(source_id AS STRING), count(*) FROM images GROUP BY 2)) WHERE r <= 3", "images")
def _(c):
    return counters.counters(c.images, {"type": F.col("image_type"), "source": F.col("source_id")}, top=3)


#: A deck derived from lineitem: pictures are its first lines, labels the others; a hundred orders share a slide.
DECK = """deck AS (SELECT CAST(floor(l_orderkey / 100) AS BIGINT) AS slide, l_orderkey * 10 + l_linenumber AS id, l_linenumber AS line, 'm' || CAST(min(l_partkey) % 7 AS STRING) AS media_name, min(l_tax) * 100 AS tx, min(l_discount) * 100 AS x, min(l_quantity) AS y, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
PICTURES = "pictures AS (SELECT slide, id AS idx, media_name, x, y, y / 10 AS cx, y / 10 AS cy, y * y AS area, flag = 'A' AS crop_any FROM deck WHERE line = 1)"
SAID = "said AS (SELECT slide, id AS label_id, tx AS x, y, 2.0 AS cx, 2.0 AS cy, CASE flag WHEN 'A' THEN 'identified_in_this_image' WHEN 'N' THEN 'identified_elsewhere' ELSE 'other_or_unstyled' END AS label_status FROM deck WHERE line > 1)"
NEAR = "near AS (SELECT * FROM (SELECT a.*, p.idx AS p_idx, p.media_name AS assigned_media, d, row_number() OVER (PARTITION BY label_id ORDER BY d, p_area DESC, p_i) AS r FROM said a LEFT JOIN LATERAL (SELECT p.idx, p.media_name, p.area AS p_area, p.idx AS p_i, sqrt(power(greatest(p.x - (a.x + 1), 0, a.x + 1 - (p.x + p.cx)), 2) + power(greatest(p.y - (a.y + 1), 0, a.y + 1 - (p.y + p.cy)), 2)) AS d FROM pictures p WHERE p.slide = a.slide) p ON true) WHERE r = 1)"
BASES = "bases AS (SELECT slide, media_name FROM (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY area DESC, idx) AS r FROM (SELECT *, row_number() OVER (PARTITION BY slide, media_name ORDER BY crop_any, area DESC, idx) AS k FROM pictures) WHERE k = 1) WHERE r = 1)"


def deck(c) -> tuple[DataFrame, DataFrame]:
    lines = c.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_tax").alias("tax"), F.min("l_discount").alias("disc"), F.min("l_quantity").alias("qty"), F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("flag"))
    own = ["CAST(floor(l_orderkey / 100) AS BIGINT) AS slide", "l_orderkey * 10 + l_linenumber AS id"]
    pictures = lines.where("l_linenumber = 1").selectExpr(*own, "'m' || CAST(part % 7 AS STRING) AS media_name", "disc * 100 AS x", "qty AS y", "qty / 10 AS cx", "qty / 10 AS cy", "qty * qty AS area", "flag = 'A' AS crop_any").withColumnRenamed("id", "idx")
    labels = lines.where("l_linenumber > 1").selectExpr(*own, "tax * 100 AS x", "qty AS y", "2D AS cx", "2D AS cy", "flag").withColumnRenamed("id", "label_id")
    color = F.when(F.col("flag") == "A", "00ff00").when(F.col("flag") == "N", "FFFF00")
    return labels.select("*", rules.status_of_color(color, "00FF00", "FFFF00").alias("label_status")).drop("flag"), pictures


def assigned(c) -> tuple[DataFrame, DataFrame]:
    """Labels with the picture they lie on; media m1 and m2 are known by content."""
    labels, pictures = deck(c)
    near = matching.nearest_picture(labels, pictures).withColumnRenamed("p_media_name", "assigned_media")
    return near.withColumn("original_name", F.when(F.col("assigned_media").isin("m1", "m2"), F.col("assigned_media"))), pictures


def of_deck(sql: str) -> str:
    return f"SELECT * FROM (WITH {DECK}, {PICTURES}, {SAID}, {NEAR}, {BASES} {sql})"


@query("a12_media_aggregates", of_deck("SELECT p.media_name, string_agg(DISTINCT CAST(p.slide AS STRING), ',' ORDER BY p.slide) AS slides, coalesce((SELECT count(*) FROM near n WHERE n.assigned_media = p.media_name), 0) AS label_total, (SELECT count(*) FROM pictures x JOIN bases b ON b.slide = x.slide AND b.media_name = x.media_name WHERE x.media_name = p.media_name) AS base_slide_count FROM pictures p GROUP BY p.media_name").replace("string_agg(DISTINCT CAST(p.slide AS STRING), ',' ORDER BY p.slide)", "array_to_string(list_sort(list_distinct(list(p.slide))), ',')"))
def _(c):
    return slides.media_table(*assigned(c))


@query("a11_slide_aggregates", of_deck("SELECT p.slide, p.picture_count, p.unique_media_count, b.media_name AS base_media, coalesce(n.any_match, false) AS any_match, coalesce(n.here_labels, 0) AS here_labels, coalesce(n.elsewhere_labels, 0) AS elsewhere_labels, coalesce(n.other_labels, 0) AS other_labels, p.unique_media_count < p.picture_count AS same_media_reuse FROM (SELECT slide, count(*) AS picture_count, count(DISTINCT media_name) AS unique_media_count FROM pictures GROUP BY slide) p LEFT JOIN bases b USING (slide) LEFT JOIN (SELECT slide, bool_or(assigned_media IN ('m1', 'm2')) AS any_match, count(*) FILTER (WHERE label_status = 'identified_in_this_image') AS here_labels, count(*) FILTER (WHERE label_status = 'identified_elsewhere') AS elsewhere_labels, count(*) FILTER (WHERE label_status = 'other_or_unstyled') AS other_labels FROM near GROUP BY slide) n USING (slide)"))
def _(c):
    return slides.slide_table(*assigned(c))


@query("w9_base_pictures", of_deck("SELECT slide, media_name FROM bases"))
def _(c):
    return windows.base_pictures(deck(c)[1]).select("slide", "media_name")


@query("w4_family_primaries", "SELECT family_id, arg_min(image_id, (1 - is_primary, sort_order, id)) AS image_id FROM image_family_members GROUP BY family_id", "image_family_members")
def _(c):
    return windows.family_primaries(c.image_family_members).select("family_id", "image_id")


@query("w5_canonical_files", "SELECT sha256, id FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY size_bytes DESC, width * height DESC, length(filename), filename, id) AS r FROM images) WHERE r = 1", "images")
def _(c):
    files = c.images.select("*", F.lit(False).alias("is_hidden"), F.concat("filename", F.lpad(F.col("id").cast("string"), 12, "0")).alias("rel_path"))
    return windows.canonical_files(files, F.lit(0)).select("sha256", "id")


ORACLES["w5_canonical_files"] = oracle("SELECT sha256, id FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY size_bytes DESC, width * height DESC, length(filename), filename || lpad(CAST(id AS STRING), 12, '0')) AS r FROM images) WHERE r = 1", "images")


@query("w7_first_labels", "SELECT image_id, string_agg(label, ' / ' ORDER BY k) AS labels FROM (SELECT image_id, label, row_number() OVER (PARTITION BY image_id ORDER BY min(id)) AS k FROM image_regions WHERE trim(label) <> '' GROUP BY image_id, label) WHERE k <= 3 GROUP BY image_id", "image_regions")
def _(c):
    return windows.first_labels(c.image_regions)


@query("s13_table_counts", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in ("kits", "parts", "models", "placements", "images", "claims")), "kits", "parts", "models", "placements", "images", "claims")
def _(c):
    from ..sources.tables import table_counts

    return table_counts({n: getattr(c, n) for n in ("kits", "parts", "models", "placements", "images", "claims")})


# merges and history


@query("j7_absent_insert", "SELECT DISTINCT p_brand AS brand, p_type AS kind, p_name AS name FROM part WHERE (p_brand, p_type, p_name) NOT IN (SELECT (p_brand, p_type, p_name) FROM part WHERE p_size <= 25)")
def _(c):
    rows = c.part.selectExpr("p_brand AS brand", "p_type AS kind", "p_name AS name", "p_size")
    return merge.insert_absent(rows.where("p_size <= 25").drop("p_size"), rows.drop("p_size"), ["brand", "kind", "name"])


@query("m2_upsert", "SELECT coalesce(a.id, b.id) AS id, coalesce(b.name, a.name) AS name, coalesce(b.notes, a.notes) AS notes, CASE WHEN a.id IS NULL THEN 'inserted' WHEN b.id IS NOT NULL THEN 'updated' ELSE 'kept' END AS merge_status FROM (SELECT p_partkey AS id, p_name AS name, p_type AS notes FROM part WHERE p_partkey % 3 > 0) a FULL JOIN (SELECT p_partkey AS id, upper(p_name) AS name, CASE WHEN p_size > 25 THEN p_brand END AS notes FROM part WHERE p_partkey % 2 = 0) b ON a.id = b.id")
def _(c):
    table = c.part.where("p_partkey % 3 > 0").selectExpr("p_partkey AS id", "p_name AS name", "p_type AS notes")
    incoming = c.part.where("p_partkey % 2 = 0").selectExpr("p_partkey AS id", "upper(p_name) AS name", "CASE WHEN p_size > 25 THEN p_brand END AS notes")
    return merge.upsert(table, incoming, ["id"])


@query("m3_fill_upsert", "SELECT coalesce(a.id, b.id) AS id, coalesce(nullif(trim(a.name), ''), b.name) AS name, nullif(concat_ws(chr(10), a.notes, CASE WHEN b.notes IS DISTINCT FROM a.notes THEN b.notes END), '') AS notes, CASE WHEN a.id IS NULL THEN 'inserted' WHEN b.id IS NOT NULL THEN 'updated' ELSE 'kept' END AS merge_status FROM (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN ' ' ELSE p_name END AS name, p_type AS notes FROM part WHERE p_partkey % 3 > 0) a FULL JOIN (SELECT p_partkey AS id, upper(p_name) AS name, CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS notes FROM part WHERE p_partkey % 2 = 0) b ON a.id = b.id")
def _(c):
    table = c.part.where("p_partkey % 3 > 0").selectExpr("p_partkey AS id", "CASE WHEN p_size % 4 = 0 THEN ' ' ELSE p_name END AS name", "p_type AS notes")
    incoming = c.part.where("p_partkey % 2 = 0").selectExpr("p_partkey AS id", "upper(p_name) AS name", "CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS notes")
    return merge.upsert(table, incoming, ["id"], mode="fill")


@query("m4_partial_update", "SELECT p.id, p.placement_id, CASE WHEN u.field = 'status' THEN u.value ELSE p.status END AS status, CASE WHEN u.field = 'map_id' THEN try_cast(u.value AS BIGINT) ELSE p.map_id END AS map_id FROM placement_positions p LEFT JOIN (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'status' ELSE 'map_id' END AS field, CASE WHEN event_id % 6 > 0 THEN CAST(event_id % 100 AS STRING) END AS value FROM events WHERE event_id % 5 < 2) u ON u.id = p.id", "placement_positions")
def _(c):
    fields = F.create_map(F.when(F.col("event_id") % 2 == 0, "status").otherwise("map_id"), F.when(F.col("event_id") % 6 > 0, (F.col("event_id") % 100).cast("string")))
    first = F.create_map(F.when(F.col("event_id") % 2 == 0, "status").otherwise("map_id"), F.lit("0"))
    some = c.events.where("event_id % 5 < 2")
    changes = some.select(F.col("event_id").alias("id"), F.lit(2).alias("change_seq"), fields.alias("fields")).union(some.select("event_id", F.lit(1), first))
    return merge.partial_update(c.placement_positions, changes, ["status", "map_id"]).select("id", "placement_id", "status", "map_id")


@query("m6_set_current", "SELECT p.id, CASE WHEN k.pick IS NULL THEN p.is_current WHEN k.pick = p.id THEN 1 ELSE 0 END AS is_current, CASE WHEN k.pick = p.id THEN 'active' ELSE p.status END AS status FROM placement_positions p LEFT JOIN (SELECT placement_id, map_id, arg_max(id, (created_at, id)) AS pick FROM placement_positions WHERE id % 4 = 1 GROUP BY ALL) k USING (placement_id, map_id)", "placement_positions")
def _(c):
    chosen = c.placement_positions.where("id % 4 = 1").select("id", F.col("created_at").alias("change_seq"))
    return merge.set_current(c.placement_positions, chosen).select("id", "is_current", "status")


@query("m7_supersede", "SELECT id, CASE WHEN o THEN 'superseded' ELSE status END AS status, CASE WHEN o THEN 0 ELSE is_current END AS is_current FROM (SELECT *, id IN (SELECT supersedes_id FROM placement_positions WHERE supersedes_id IS NOT NULL) AS o FROM placement_positions)", "placement_positions")
def _(c):
    return merge.supersede(c.placement_positions).select("id", "status", "is_current")


@query("m8_set_primary", "SELECT m.id, CASE WHEN k.pick IS NULL THEN is_primary WHEN k.pick = image_id THEN 1 ELSE 0 END AS is_primary, CASE WHEN k.pick = image_id THEN 'primary' WHEN k.pick IS NOT NULL AND is_primary = 1 THEN 'variant' WHEN is_primary = 1 THEN 'primary' ELSE 'duplicate' END AS relation_type FROM image_family_members m LEFT JOIN (SELECT family_id, max(image_id) AS pick FROM image_family_members WHERE family_id % 2 = 0 GROUP BY family_id) k USING (family_id)", "image_family_members")
def _(c):
    members = c.image_family_members.withColumn("relation_type", F.when(F.col("is_primary") == 1, "primary").otherwise("duplicate"))
    chosen = members.where("family_id % 2 = 0").groupBy("family_id").agg(F.max("image_id").alias("image_id"))
    return merge.set_primary(members, chosen).select("id", "is_primary", "relation_type")


@query("m9_change_history", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'create' WHEN b.id IS NULL THEN 'delete' ELSE 'update' END AS change, a.n AS prev_name, b.n AS new_name FROM (SELECT p_partkey AS id, p_name AS n FROM part WHERE p_partkey % 3 > 0) a FULL JOIN (SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS n FROM part WHERE p_partkey % 2 = 0) b ON a.id = b.id WHERE a.n IS DISTINCT FROM b.n")
def _(c):
    before = c.part.where("p_partkey % 3 > 0").selectExpr("p_partkey AS id", "p_name AS n")
    after = c.part.where("p_partkey % 2 = 0").selectExpr("p_partkey AS id", "CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS n")
    out = merge.changed_rows(before, after, ["n"])
    return out.select("id", "change", F.get_json_object("prev_values", "$.n").alias("prev_name"), F.get_json_object("new_values", "$.n").alias("new_name"))


@query("m9_changed_values", "SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'create' WHEN b.user_id IS NULL THEN 'delete' ELSE 'update' END AS change, a.n AS prev_n, a.top AS prev_top, b.n AS new_n, b.top AS new_top FROM (SELECT user_id, count(*) AS n, max(event_type) AS top FROM events WHERE event_id % 2 = 0 GROUP BY user_id) a FULL JOIN (SELECT user_id, count(*) AS n, max(event_type) AS top FROM events WHERE event_id % 2 = 1 GROUP BY user_id) b ON a.user_id = b.user_id WHERE a.n IS DISTINCT FROM b.n OR a.top IS DISTINCT FROM b.top")
def _(c):
    half = lambda k: c.events.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_type").alias("top"))
    out = merge.changed_rows(half(0), half(1), ["n", "top"], key="user_id")
    value = lambda side, f, kind: F.get_json_object(f"{side}_values", f"$.{f}").cast(kind).alias(f"{side}_{f}")
    return out.select("user_id", "change", value("prev", "n", "long"), value("prev", "top", "string"), value("new", "n", "long"), value("new", "top", "string"))


@query("m10_rejects", "SELECT id AS key, rule FROM (SELECT id, 'enum:status' AS rule FROM placement_positions WHERE status NOT IN ('active') UNION ALL SELECT id, 'required:x_norm' FROM placement_positions WHERE x_norm IS NULL OR x_norm = 0 UNION ALL SELECT id, 'unique:placement_id+created_at' FROM placement_positions WHERE (placement_id, created_at) IN (SELECT (placement_id, created_at) FROM placement_positions GROUP BY placement_id, created_at HAVING count(*) > 1) UNION ALL SELECT id, 'foreign:supersedes_id' FROM placement_positions WHERE supersedes_id IS NOT NULL AND supersedes_id NOT IN (SELECT id FROM placement_positions WHERE id % 2 = 0))", "placement_positions")
def _(c):
    p = c.placement_positions
    return merge.rejects(p, required=["x_norm"], enums={"status": ("active",)}, unique=["placement_id", "created_at"], foreign={"supersedes_id": p.where("id % 2 = 0")})


@query("m10_exactly_one", "SELECT id AS key, 'one_of:part_id+kit_id' AS rule FROM placements WHERE (part_id IS NOT NULL) = (kit_id IS NOT NULL)", "placements")
def _(c):
    return merge.rejects(c.placements, one_of=["part_id", "kit_id"])


@query("m10_map_match", "SELECT s.id AS key, 'map_of_model' AS rule FROM (SELECT id, id AS placement_id, (id % 25) * 10 AS map_id FROM placements) s JOIN placements p ON p.id = s.placement_id JOIN maps m ON m.id = s.map_id WHERE p.model_id <> m.model_id", "placements", "maps")
def _(c):
    positions = c.placements.select("id", F.col("id").alias("placement_id"), (F.col("id") % 25 * 10).alias("map_id"))
    return merge.map_rejects(positions, c.placements, c.maps)


@query("m11_cascade", "SELECT 'cascade' AS how, count(*) AS n FROM image_regions WHERE image_id % 2 = 1 UNION ALL SELECT 'set_null', count(*) FROM maps WHERE image_id IS NULL OR image_id % 2 = 1 UNION ALL SELECT 'blocked', count(*) FROM image_links WHERE image_id % 2 = 0", "image_regions", "maps", "image_links")
def _(c):
    gone = c.images.where("id % 2 = 0").select("id")
    odd = c.images.where("id % 2 = 1").select("id")
    count = lambda how, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(how).alias("how"), "n")
    out = count("cascade", merge.cascade(c.image_regions, "image_id", gone)).union(count("set_null", merge.cascade(c.maps, "image_id", odd, "set_null").where("image_id is null")))
    return out.union(count("blocked", merge.cascade(c.image_links, "image_id", gone, "blocked")))


@query("m12_replace_tags", "SELECT image_id, tag FROM image_tags WHERE image_id % 3 > 0 UNION ALL SELECT DISTINCT doc_id, 'new-' || lang FROM documents WHERE doc_id % 3 = 0", "image_tags")
def _(c):
    incoming = c.documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("image_id"), F.concat(F.lit("new-"), "lang").alias("tag"))
    return merge.replace_children(c.image_tags, "image_id", incoming)


GONE = "gone AS (SELECT image_id AS id FROM image_family_members WHERE image_id <> family_id AND image_id NOT IN (SELECT image_id FROM image_regions))"


def absorbed(c):
    images = c.images.withColumn("notes", F.concat(F.lit("file="), "filename"))
    duplicates = c.image_family_members.select(F.col("image_id").alias("id"), F.col("family_id").alias("survivor"))
    return merge.absorb(images, duplicates, c.image_regions.select(F.col("image_id").alias("id")), c.image_tags)


@query("m14_absorb", f"SELECT * FROM (WITH {GONE} SELECT id, title, array_to_string(list_distinct(list_concat(['file=' || filename], coalesce((SELECT list(line ORDER BY line) FROM (SELECT 'file=' || d.filename AS line FROM image_family_members m JOIN images d ON d.id = m.image_id WHERE m.family_id = i.id AND m.image_id <> m.family_id)), []))), chr(10)) AS notes FROM images i WHERE id NOT IN (SELECT id FROM gone))".replace("list_distinct(", "(").replace("SELECT list(line ORDER BY line)", "SELECT list(DISTINCT line ORDER BY line)").replace("WHERE m.family_id = i.id AND", "WHERE d.filename <> i.filename AND m.family_id = i.id AND"), "images", "image_family_members", "image_regions")
def _(c):
    return absorbed(c)[0].select("id", "title", "notes")


@query("m14_absorbed_tags", f"SELECT * FROM (WITH {GONE} SELECT DISTINCT image_id, tag FROM (SELECT image_id, tag FROM image_tags UNION ALL SELECT m.family_id, t.tag FROM image_tags t JOIN image_family_members m ON m.image_id = t.image_id WHERE m.image_id <> m.family_id) WHERE image_id NOT IN (SELECT id FROM gone))", "image_tags", "image_family_members", "image_regions")
def _(c):
    return absorbed(c)[2]


# matching, rules, extraction, geometry


@query("j10_unique_match", "SELECT p.id, CASE WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ambiguous_exact_match' ELSE 'no_exact_match' END AS match_status, CASE WHEN n = 1 THEN m END AS match_id FROM parts p LEFT JOIN (SELECT regexp_replace(lower(part_label), '[^a-z0-9]+', '', 'g') AS k, count(*) AS n, min(id) AS m FROM parts GROUP BY 1) x ON x.k = regexp_replace(lower(p.part_label), '[^a-z0-9]+', '', 'g')", "parts")
def _(c):
    return matching.unique_match(c.parts, "part_label", c.parts, "part_label").select("id", "match_status", "match_id")


@query("j11_nearest_picture", of_deck("SELECT label_id, p_idx, round(d, 6) AS d FROM near"))
def _(c):
    near = matching.nearest_picture(*deck(c))
    cx, cy = g.centre(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))
    return near.select("label_id", "p_idx", F.round(g.distance(cx, cy, F.col("p_x"), F.col("p_y"), F.col("p_cx"), F.col("p_cy")), 6).alias("d"))


@query("j9_content_crosswalk", "SELECT a.doc_id, b.other_name FROM (SELECT doc_id, sha1(text) AS h FROM documents WHERE doc_id % 2 = 0) a LEFT JOIN (SELECT sha1(text) AS h, min(doc_id) AS other_name FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) b ON a.h = b.h")
def _(c):
    docs = c.documents.select("doc_id", F.sha1("text").alias("h"))
    return matching.crosswalk(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "h", "doc_id").select("doc_id", "other_name")


@query("j12_fallback_match", "SELECT o_orderkey, coalesce(a.s_name, b.s_name) AS matched, CASE WHEN a.s_name IS NOT NULL THEN 'first' WHEN b.s_name IS NOT NULL THEN 'second' END AS matched_by FROM (SELECT *, o_orderkey % 1500 AS first, o_custkey % 300 AS second FROM orders) o LEFT JOIN supplier a ON a.s_suppkey = first LEFT JOIN supplier b ON b.s_suppkey = second")
def _(c):
    orders = c.orders.selectExpr("o_orderkey", "o_orderkey % 1500 AS first", "o_custkey % 300 AS second")
    return matching.fallback_match(orders, ["first", "second"], c.supplier, "s_suppkey", "s_name").select("o_orderkey", "matched", "matched_by")


@query("p10_whole_word", "SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])the([^a-z0-9]|$)') AS hit FROM documents")
def _(c):
    return c.documents.select("doc_id", t.whole_word(F.lower("text"), "the").alias("hit"))


@query("r1_taxonomy", "SELECT id, CASE WHEN lower(name) LIKE '%ring%' OR lower(name) LIKE '%bolt%' THEN 'metal' WHEN lower(name) LIKE '%widget%' AND lower(name) LIKE '%red%' THEN 'gadget' WHEN scale = '1/72' THEN 'aircraft' ELSE 'other' END AS category_family FROM (SELECT id, part_label AS name, CASE WHEN id % 2 = 0 THEN '1/72' END AS scale FROM parts)", "parts")
def _(c):
    kits = c.parts.select("id", F.col("part_label").alias("name"), F.when(F.col("id") % 2 == 0, "1/72").alias("scale"))
    table = [rules.Rule(("ring", "bolt"), ("metal", "part")), rules.Rule(("widget",), ("gadget", "part"), also=("red",))]
    return rules.taxonomy(kits, table, {"1/72": ("aircraft", "military_aircraft")}).select("id", "category_family")


@query("r5_buckets", "SELECT CASE WHEN source_id < 4 THEN 'needs_review' WHEN source_id < 8 THEN 'needs_review' WHEN image_type = 'fr' THEN 'needs_review' ELSE 'safe_to_stage' END AS bucket, CASE WHEN source_id < 4 THEN 'unknown_source_platform' WHEN source_id < 8 THEN 'low_source_confidence' WHEN image_type = 'fr' THEN 'render_or_cg' ELSE 'attributed_and_nonhistorical' END AS bucket_reason, count(*) AS n FROM images GROUP BY ALL", "images")
def _(c):
    platform = F.when(F.col("source_id") < 4, "unknown").otherwise("forum")
    confidence = F.when(F.col("source_id") < 8, "low").otherwise("high")
    kind = F.when(F.col("image_type") == "fr", "render_or_cg").otherwise("forum_capture")
    return c.images.select(rules.bucket(platform, confidence, kind).alias("b")).groupBy("b.bucket", "b.bucket_reason").agg(F.count(F.lit(1)).alias("n"))


HIT = "regexp_matches(w, '(^|[^a-z0-9]){}([^a-z0-9]|$)')"


@query("r6_title_scores", f"SELECT doc_id, CAST(2 * f + 3 * m + 2 * r + 2 * s AS INT) AS score, CASE WHEN m + r + s > 0 THEN 'strong' WHEN f > 0 THEN 'candidate' ELSE 'exclude' END AS tier FROM (SELECT *, CASE WHEN s0 = 1 AND f + m > 0 THEN 1 ELSE 0 END AS s FROM (SELECT doc_id, CAST(contains(text, 'lle') AS INT) AS f, CAST({HIT.format('the')} OR {HIT.format('de la')} AS INT) AS m, CAST({HIT.format('und')} AS INT) AS r, CAST({HIT.format('que')} AS INT) AS s0 FROM (SELECT doc_id, text, trim(regexp_replace(regexp_replace(lower(text), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS w FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]+', ' ', 'g') AS text FROM documents))))")
def _(c):
    """Without characters beyond ASCII, as SQL has no compatibility form."""
    plain = c.documents.select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]+", " ").alias("text"))
    scored = rules.score_titles(plain, ["the", "de-la"], ["und"], ["que"], F.col("text").contains("lle"), title="text")
    return scored.select("doc_id", "score", "tier")


@query("c6_page_links", "SELECT page_id, (SELECT count(DISTINCT u) FROM (SELECT unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS u) WHERE u LIKE 'http%' OR u LIKE '/%') AS links, trim(regexp_extract(html, '<title>(.*?)</title>', 1)) AS title FROM pages")
def _(c):
    """The links of a page as the pictures of one post: the extraction for threads, over pages whose links are made images."""
    marked = F.regexp_replace("html", '<a href="([^"]*)"', '<img src="$1"')
    post = F.concat(F.lit('<article data-content="p">'), F.regexp_replace(marked, "</?article[^>]*>", ""), F.lit("</article>"))
    pages = c.pages.select(F.col("page_id").cast("string").alias("thread"), F.lit(0).alias("page_no"), F.regexp_replace(post, 'src="((?:http|/)[^"?#]*)[^"]*"', 'src="$1.png"').alias("html"))
    found = threads.post_images(pages, "https://h").groupBy("thread").agg(F.count(F.lit(1)).alias("links"))
    titles = c.pages.select("page_id", t.thread_title(F.lit(None), F.col("html"), F.lit("")).alias("title"))
    return titles.join(found.select(F.col("thread").cast("long").alias("page_id"), "links"), "page_id", "left").select("page_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("title", F.lit("")).alias("title"))


@query("s8_thread_posts", "SELECT CAST(conv_id AS STRING) AS thread, turn AS number, role AS author, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM conversations")
def _(c):
    """Conversations written as exported threads and parsed again."""
    post = F.concat(F.lit("Post #"), F.col("turn").cast("string"), F.lit("  (forum post #1)\nAuthor : "), F.coalesce("role", F.lit("")), F.lit("\nDate : Mar 5, 2010 at 7:42 PM\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    files = c.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", post.alias("p")))), lambda x: x["p"]), "").alias("body"))
    posts = threads.parse_posts(files.select(F.concat(F.lit("THREAD : "), F.col("conv_id").cast("string"), F.lit("\nURL : https://x/1\n"), F.col("body")).alias("value")))
    return posts.select("thread", F.col("number").cast("long").alias("number"), "author", F.length(F.trim(F.regexp_replace("body", r"\s+", " "))).cast("long").alias("n"))


@query("f35_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def _(c):
    return c.events.select("event_id", t.to_int(t.json_field(F.col("props"), "$.k")).alias("k"))


@query("f_text_functions", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key, replace(lower(trim(p_name)), ' ', '-') AS slug, coalesce(nullif(upper(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-')), ''), 'UNKNOWN') AS code, concat_ws(' / ', nullif(trim(p_brand), ''), CASE WHEN p_size > 9 THEN p_type END) AS bits, 'REF-' || upper(left(sha256(p_name), 12)) AS image_code, CASE WHEN length(p_name || p_type) > 12 THEN left(p_name || p_type, 12) || '...' ELSE p_name || p_type END AS excerpt FROM part")
def _(c):
    name, kind = F.col("p_name"), F.col("p_type")
    return c.part.select("p_partkey", t.match_key(name).alias("key"), t.tag_slug(name).alias("slug"), t.slug_upper(kind).alias("code"), t.joined(" / ", F.col("p_brand"), F.when(F.col("p_size") > 9, kind)).alias("bits"), t.image_code("REF-", F.sha2(name, 256)).alias("image_code"), t.excerpt(F.concat(name, kind), 12).alias("excerpt"))


@query("f_number_functions", "SELECT l_orderkey, l_linenumber, l_partkey, try_cast(trunc(l_extendedprice) AS INT) AS whole, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS flag, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey AS STRING) || CASE WHEN l_suppkey % 3 = 0 THEN '#' ELSE CAST(l_suppkey % 3 AS STRING) END ELSE CAST(l_suppkey AS STRING) END AS reference FROM lineitem")
def _(c):
    base = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey"))
    flag = t.flag(F.when(F.col("l_linestatus") == "F", "Yes").otherwise("off"))
    return c.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", t.safe_int(F.col("l_extendedprice").cast("string")).alias("whole"), flag.alias("flag"), t.reference_number(F.col("l_suppkey"), base, F.col("l_suppkey") % 3).alias("reference"))


@query("g1_g4_projection", "SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(l_discount * 100 - l_quantity, 0, l_quantity - (l_discount * 100 + 20)), 6) AS d, round(l_tax + (l_quantity / 50) * (1 - l_tax - l_discount), 9) AS original FROM lineitem")
def _(c):
    x = F.col("l_discount") * 100
    d = g.distance(F.col("l_quantity"), F.lit(0.0), x, F.lit(-1.0), F.lit(20.0), F.lit(2.0))
    back = g.uncropped(g.relative(F.col("l_quantity"), F.lit(0.0), F.lit(50.0)), F.col("l_tax"), F.col("l_discount"))
    return c.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(d, 6).alias("d"), F.round(back, 9).alias("original"))


@query("g6_similarity", "SELECT event_id, round(2.0 * (0 * value - 1 * (event_id % 100) + 0) + 1, 6) AS x, round(2.0 * value + 2, 6) AS y, round(CAST(user_id AS DOUBLE) * 2 + 3, 6) AS z FROM events")
def _(c):
    points = c.events.select("event_id", F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"), F.col("user_id").cast("double").alias("z"))
    out = g.similarity(points, 2.0, [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [1.0, 2.0, 3.0])
    return out.select("event_id", *[F.round(k, 6).alias(k) for k in "xyz"])


@query("x8_token_similarity", "SELECT left_id, right_id, CAST(count(*) AS DOUBLE) / (max(m) + max(n) - count(*)) AS similarity FROM (SELECT id AS left_id, unnest(list_distinct(string_split(lower(part_label), ' '))) AS w, len(list_distinct(string_split(lower(part_label), ' '))) AS m FROM parts) JOIN (SELECT id AS right_id, unnest(list_distinct(string_split(lower(name), ' '))) AS w, len(list_distinct(string_split(lower(name), ' '))) AS n FROM kits) USING (w) GROUP BY ALL HAVING CAST(count(*) AS DOUBLE) / (max(m) + max(n) - count(*)) >= 0.5", "parts", "kits")
def _(c):
    """Part labels that may mean a kit."""
    return matching.token_similarity(c.parts.select("id", F.col("part_label").alias("name")), c.kits.select("id", "name"))


NAME_WORDS = "list_sort(list_distinct(string_split(lower(p_name), ' ')))"


@query("x8_word_sets", f"SELECT p_partkey AS id, array_to_string({NAME_WORDS}, ' ') AS words, len({NAME_WORDS}) AS n FROM part")
def _(c):
    return matching.word_sets(c.part.selectExpr("p_partkey AS id", "p_name AS name"))


@query("x8_similar_sets", f"SELECT * FROM (WITH s AS (SELECT DISTINCT array_to_string({NAME_WORDS}, ' ') AS words, len({NAME_WORDS}) AS m FROM part), e AS (SELECT words, m, unnest(string_split(words, ' ')) AS w FROM s) SELECT a.words AS left_words, b.words AS right_words, CAST(count(*) AS DOUBLE) / (max(a.m) + max(b.m) - count(*)) AS similarity FROM e a JOIN e b USING (w) GROUP BY a.words, b.words HAVING CAST(count(*) AS DOUBLE) / (max(a.m) + max(b.m) - count(*)) >= 0.5)")
def _(c):
    sets = matching.word_sets(c.part.selectExpr("p_partkey AS id", "p_name AS name"))
    return matching.similar_sets(sets, sets)


@query("j10_unique_match_all", "SELECT p.id, CASE WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ambiguous_exact_match' ELSE 'no_exact_match' END AS match_status, CASE WHEN n = 1 THEN m END AS match_id FROM parts p LEFT JOIN (SELECT regexp_replace(lower(part_label), '[^a-z0-9]+', '', 'g') AS k, count(*) AS n, min(id) AS m FROM parts GROUP BY 1) x ON x.k = regexp_replace(lower(p.part_label), '[^a-z0-9]+', '', 'g')", "parts")
def _(c):
    return matching.unique_match(c.parts, "part_label", c.parts, "part_label").select("id", "match_status", "match_id")


# jobs


@query("x1_kit_evidence", *via("SELECT DISTINCT * FROM (SELECT entity_id AS kit_id, image_id, 'kit' AS via FROM image_links WHERE entity_type = 'kit' UNION ALL SELECT t.kit_id, image_id, 'part' FROM image_links l JOIN parts t ON t.id = l.entity_id WHERE entity_type = 'part' UNION ALL SELECT via_kit, image_id, 'placement' FROM image_links l JOIN placement_kit p ON p.id = l.entity_id WHERE entity_type = 'placement' AND via_kit IS NOT NULL)", ("image_links",)))
def _(c):
    return jobs.kit_evidence(c)


@query("x1_source_claims", "SELECT source_id, count(DISTINCT claim_id) AS claims, count(DISTINCT x.id) AS extracts FROM claim_evidence e JOIN source_extracts x ON x.id = e.evidence_id WHERE evidence_type = 'source_extract' GROUP BY source_id", "claim_evidence", "source_extracts")
def _(c):
    return jobs.source_claims(c)


DATED = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'about ' || strftime(o_orderdate, '%Y') END"


@query("x4_partial_dates", f"SELECT o_orderkey, d, CASE length(d) WHEN 4 THEN CAST(d || '-01-01' AS DATE) WHEN 7 THEN CAST(d || '-01' AS DATE) WHEN 10 THEN CASE WHEN d LIKE 'about%' THEN NULL ELSE try_cast(d AS DATE) END END AS date_start, CASE length(d) WHEN 4 THEN CAST(d || '-12-31' AS DATE) WHEN 7 THEN last_day(CAST(d || '-01' AS DATE)) WHEN 10 THEN CASE WHEN d LIKE 'about%' THEN NULL ELSE try_cast(d AS DATE) END END AS date_end FROM (SELECT o_orderkey, {DATED} AS d FROM orders)")
def _(c):
    when = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, when("yyyy")).when(k == 1, when("yyyy-MM")).when(k == 2, when("yyyy-MM-dd")).otherwise(F.concat(F.lit("about "), when("yyyy")))
    return jobs.chronology(c.orders.select("o_orderkey", raw.alias("d")), "d")


FIRST_LABELS = "firsts AS (SELECT image_id, string_agg(label, ' / ' ORDER BY k) AS labels FROM (SELECT image_id, label, row_number() OVER (PARTITION BY image_id ORDER BY min(id)) AS k FROM image_regions WHERE trim(label) <> '' GROUP BY image_id, label) WHERE k <= 3 GROUP BY image_id)"
SHOWN = "shown AS (SELECT image_id, arg_min(json_extract_string(properties_json, '$.base_subject'), id) AS subject FROM image_regions WHERE properties_json IS NOT NULL GROUP BY image_id)"
GENERIC = "(coalesce(trim(i.title), '') = '' OR lower(trim(i.title)) IN ('n/a', 'open') OR regexp_full_match(lower(trim(i.title)), 'image[0-9]+[.](jpg|jpeg|png|gif|webp)'))"


@query("r8_retitle", f"SELECT * FROM (WITH {FIRST_LABELS}, {SHOWN}, x AS (SELECT i.id, i.title, i.caption, i.image_code, coalesce(CASE WHEN i.notes LIKE 'likely_model_or_scene=Scene%' THEN substr(split_part(i.notes, chr(10), 1), 23) END, s.subject, 'Overlay reference: ' || f.labels, replace(replace(split_part(i.notes, 'slide_key=', 2), '-', ' '), '_', ' ') || ' reference image') AS known FROM images i LEFT JOIN firsts f ON f.image_id = i.id LEFT JOIN shown s ON s.image_id = i.id WHERE {GENERIC}) SELECT id, title AS old_title, coalesce(known, CASE lower(trim(title)) WHEN 'n/a' THEN 'Malformed PPTX extract ' WHEN 'open' THEN 'Unreviewed PPTX extract ' ELSE 'PPTX extract ' END || image_code) AS new_title, coalesce(caption, CASE WHEN known IS NULL AND lower(trim(title)) = 'n/a' THEN 'file is malformed or not yet decodable' END) AS caption FROM x)", "images", "image_regions")
def _(c):
    return jobs.retitle(c.images, c.image_regions)


LINKED = "x AS (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS k, count(*) AS n, min(id) AS m FROM (SELECT id, 'Label ' || CAST(id % 12 AS STRING) AS name FROM kits) GROUP BY 1), hits AS (SELECT r.*, n, m FROM image_regions r LEFT JOIN x ON x.k = regexp_replace(lower(r.label), '[^a-z0-9]+', '', 'g') WHERE trim(r.label) <> '' AND r.entity_id IS NULL)"


def linked_regions(c):
    kits = c.kits.select("id", F.concat(F.lit("Label "), (F.col("id") % 12).cast("string")).alias("name"))
    return jobs.link_regions(c.image_regions, kits)


@query("m19_link_regions", f"SELECT * FROM (WITH {LINKED} SELECT id, label, CASE WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ambiguous_exact_match' ELSE 'no_exact_match' END AS match_status, CASE WHEN n = 1 THEN m END AS match_id FROM hits)", "image_regions", "kits")
def _(c):
    return linked_regions(c)[2]


@query("m19_linked_regions", f"SELECT * FROM (WITH {LINKED} SELECT r.id, r.label, CASE WHEN h.n = 1 THEN 'kit' ELSE r.entity_type END AS entity_type, CASE WHEN h.n = 1 THEN h.m ELSE r.entity_id END AS entity_id FROM image_regions r LEFT JOIN hits h ON h.id = r.id)", "image_regions", "kits")
def _(c):
    return linked_regions(c)[0].select("id", "label", "entity_type", "entity_id")


@query("m19_link_history", f"SELECT * FROM (WITH {LINKED} SELECT id, 'update' AS change, label, CAST(m AS STRING) AS new_id FROM hits WHERE n = 1)", "image_regions", "kits")
def _(c):
    return linked_regions(c)[1].select("id", "change", F.get_json_object("new_values", "$.label").alias("label"), F.get_json_object("new_values", "$.entity_id").alias("new_id"))


@query("x6_tag_posts", "SELECT id, keyword FROM source_extracts JOIN (SELECT unnest(['the', 'und', 'que']) AS keyword) ON regexp_matches(trim(regexp_replace(regexp_replace(lower(regexp_replace(content, '[^\\x00-\\x7F]+', ' ', 'g')), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')), '(^|[^a-z0-9])' || keyword || '([^a-z0-9]|$)')", "source_extracts")
def _(c):
    """Without characters beyond ASCII, as SQL has no compatibility form."""
    posts = c.source_extracts.select("id", F.regexp_replace("content", r"[^\x00-\x7F]+", " ").alias("content"))
    return jobs.tag_posts(posts, "content", ["the", "und", "que"]).select("id", "keyword")


def corpus(c):
    manifest = c.images.select("sha256", "filename", F.lit("forum").alias("source_platform"), F.concat(F.lit("c "), F.col("source_id").cast("string")).alias("source_collection"), F.concat(F.lit("src "), F.col("source_id").cast("string")).alias("subject"), F.col("image_type").alias("content_kind"))
    held = c.images.where("id < 0").selectExpr("sha256", "title", "image_code", "notes")
    return jobs.corpus_images(manifest, c.sources, held)


@query("m16_corpus_tags", "SELECT DISTINCT sha256, tag FROM (SELECT sha256, 'src-' || CAST(source_id AS STRING) AS tag FROM images UNION ALL SELECT sha256, image_type FROM images UNION ALL SELECT sha256, 'forum' FROM images UNION ALL SELECT sha256, 'c-' || CAST(source_id AS STRING) FROM images)", "images")
def _(c):
    return corpus(c)[2]


@query("m16_corpus_sources", "SELECT DISTINCT source_code, parent_code FROM (SELECT 'FORUM' AS source_code, NULL AS parent_code FROM images UNION ALL SELECT 'FORUM-C-' || CAST(source_id AS STRING), 'FORUM' FROM images)", "images")
def _(c):
    return corpus(c)[0]


@query("m16_corpus_images", "SELECT sha256, title, 'LOCREF-' || upper(left(sha256, 16)) AS image_code, notes, 'inserted' AS merge_status FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY title, notes) AS r FROM (SELECT sha256, 'src ' || CAST(source_id AS STRING) || ' - ' || replace(filename, '.png', '') AS title, 'subject=src ' || CAST(source_id AS STRING) || chr(10) || 'kind=' || image_type AS notes FROM images)) WHERE r = 1", "images")
def _(c):
    return corpus(c)[1]


# profiles and listings


def shown(array: str, *fields: str) -> Column:
    """An array of structs as text, to be compared with SQL."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ",").alias(array)


def agg(fields: str, order: str, rest: str) -> str:
    return f"coalesce((SELECT string_agg(concat_ws(':', {fields}), ',' ORDER BY {order}) FROM {rest}), '')"


def pictures_of(kind: str, own: str) -> str:
    return agg("l.image_id, pic.filename", "l.image_id, pic.filename", f"image_links l JOIN images pic ON pic.id = l.image_id WHERE l.entity_type = '{kind}' AND l.entity_id = {own}")


@query("q4_models", "SELECT id, name, slug, film FROM models", "models")
def _(c):
    return q.models(c).select("id", "name", "slug", "film")


@query("q4_model_profiles", *via(f"SELECT m.id, m.name, {agg('x.name, x.id', 'x.name, x.id', 'maps x WHERE x.model_id = m.id')} AS maps, {agg('s.copies, s.kit_id, s.brand, s.parts', 's.copies DESC, s.kit_id', '(SELECT model_id, via_kit AS kit_id, k.brand, count(DISTINCT part_id) AS parts, CAST(sum(copy_count) AS BIGINT) AS copies FROM placement_kit JOIN kits k ON k.id = via_kit WHERE part_id IS NOT NULL GROUP BY ALL) s WHERE s.model_id = m.id')} AS kit_summary, {pictures_of('model', 'm.id')} AS images FROM models m", ("maps", "image_links", "images")))
def _(c):
    return q.model_profiles(c).select("id", "name", shown("maps", "name", "map_id"), shown("kit_summary", "copies", "kit_id", "brand", "parts"), shown("images", "image_id", "filename"))


@query("q2_kit_histories", f"SELECT k.id, {agg('r.system, r.value', 'r.system, r.value', 'kit_references r WHERE r.kit_id = k.id')} AS refs, {agg('h.changed_at, h.change', 'h.changed_at DESC, h.change DESC', 'kit_history h WHERE h.kit_id = k.id')} AS history, {pictures_of('kit', 'k.id')} AS images FROM kits k", "kits", "kit_references", "kit_history", "image_links", "images")
def _(c):
    return q.kit_profiles(c).withColumnRenamed("references", "refs").select("id", shown("refs", "system", "value"), shown("history", "changed_at", "change"), shown("images", "image_id", "filename"))


@query("q3_part_files", f"SELECT p.id, {agg('f.file_type, f.url, f.id', 'f.file_type, f.url, f.id', 'part_files f WHERE f.part_id = p.id')} AS files FROM parts p", "parts", "part_files")
def _(c):
    return q.part_profiles(c).select("id", shown("files", "file_type", "url", "file_id"))


@query("q7_placement_profiles", f"SELECT p.id, m.name AS model, x.name AS map, {agg('u.handle, u.id', 'u.handle, u.id', 'placement_contributors pc JOIN contributors u ON u.id = pc.contributor_id WHERE pc.placement_id = p.id')} AS contributors, {agg('h.prev_part_id, u.handle', 'h.changed_at DESC, h.prev_part_id DESC, u.handle DESC', 'placement_history h LEFT JOIN contributors u ON u.id = h.changed_by WHERE h.placement_id = p.id')} AS history, {agg('s.is_current, s.id, s.status', 's.is_current DESC, s.created_at DESC, s.id DESC', 'placement_positions s WHERE s.placement_id = p.id')} AS positions, {pictures_of('placement', 'p.id')} AS images FROM placements p JOIN models m ON m.id = p.model_id LEFT JOIN maps x ON x.id = p.map_id", "placements", "models", "maps", "contributors", "placement_contributors", "placement_history", "placement_positions", "image_links", "images")
def _(c):
    return q.placement_profiles(c).select("id", "model", "map", shown("contributors", "handle", "contributor_id"), shown("history", "prev_part_id", "changed_by_handle"), shown("positions", "is_current", "position_id", "status"), shown("images", "image_id", "filename"))


@query("q11_source_profiles", f"SELECT s.id, s.title, {agg('e.id, e.author_handle', 'e.id, e.author_handle', 'source_extracts e WHERE e.source_id = s.id')} AS extracts, {agg('i.id, i.filename', 'i.id, i.filename', 'images i WHERE i.source_id = s.id')} AS images FROM sources s", "sources", "source_extracts", "images")
def _(c):
    return q.source_profiles(c).select("id", "title", shown("extracts", "extract_id", "author_handle"), shown("images", "image_id", "filename"))


MEMBERS = agg("m.id, m.is_hidden, i.title, i.filename, s.title", "m.is_primary DESC, m.sort_order, m.id", "image_family_members m JOIN images i ON i.id = m.image_id LEFT JOIN sources s ON s.id = i.source_id WHERE m.family_id = f.id")


@query("q13_family_payloads", f"SELECT f.id, f.title, {MEMBERS} AS members FROM image_families f", "image_families", "image_family_members", "images", "sources")
def _(c):
    return q.family_payloads(c).select("id", "title", shown("members", "member_id", "is_hidden", "title", "filename", "source_title"))


REGIONS = f"WITH {LABELS}, listed AS (SELECT r.id, r.image_id, r.label, CASE WHEN r.entity_type IS NOT NULL AND r.entity_id IS NOT NULL THEN coalesce(o.label, CAST(r.entity_id AS STRING)) END AS entity_label, (SELECT count(DISTINCT e.claim_id) FROM claim_evidence e WHERE e.evidence_type = 'image_region' AND e.evidence_id = r.id) AS claim_count FROM image_regions r LEFT JOIN labels_of o ON o.entity_type = r.entity_type AND o.entity_id = r.entity_id), claimed AS (SELECT k.*, s.label AS subject, o.label AS object FROM claims k LEFT JOIN labels_of s ON s.entity_type = k.subject_type AND s.entity_id = k.subject_id LEFT JOIN labels_of o ON o.entity_type = k.object_type AND o.entity_id = k.object_id)"


@query("q16_regions", f"SELECT * FROM ({REGIONS} SELECT * FROM listed)", *LABEL_VIEWS, "image_regions", "claims", "claim_evidence")
def _(c):
    return q.regions(c).select("id", "image_id", "label", "entity_label", "claim_count")


@query("q16_region_profiles", f"SELECT * FROM ({REGIONS} SELECT r.id, r.entity_label, {agg('h.changed_at, h.id, h.prev_label', 'h.changed_at DESC, h.id DESC', 'image_region_history h WHERE h.region_id = r.id')} AS history, {agg('k.id, k.text_value, k.subject, k.object', 'k.id DESC', 'claimed k WHERE k.id IN (SELECT e.claim_id FROM claim_evidence e WHERE e.evidence_type = %r AND e.evidence_id = r.id)' % 'image_region')} AS claims FROM listed r)", *LABEL_VIEWS, "image_regions", "claims", "claim_evidence", "image_region_history")
def _(c):
    return q.region_profiles(c).select("id", "entity_label", shown("history", "changed_at", "history_id", "prev_label"), shown("claims", "claim_id", "text_value", "subject", "object"))


@query("q15_image_profiles", f"SELECT * FROM ({REGIONS} SELECT i.id, s.title AS source_title, (SELECT count(DISTINCT e.claim_id) FROM claim_evidence e JOIN image_regions r ON r.id = e.evidence_id WHERE e.evidence_type = 'image_region' AND r.image_id = i.id) AS claim_count, {agg('l.entity_type, l.entity_id, coalesce(o.label, l.entity_type || chr(32) || chr(35) || CAST(l.entity_id AS STRING))', 'l.entity_type, l.entity_id, o.label', 'image_links l LEFT JOIN labels_of o USING (entity_type, entity_id) WHERE l.image_id = i.id')} AS links, coalesce((SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM image_tags t WHERE t.image_id = i.id), '') AS tags, {agg('r.id, r.label, r.entity_label, r.claim_count', 'r.id', 'listed r WHERE r.image_id = i.id')} AS regions, m.family_id, coalesce((SELECT count(*) FROM image_family_members x WHERE x.family_id = m.family_id), 0) AS family_size FROM images i LEFT JOIN sources s ON s.id = i.source_id LEFT JOIN image_family_members m ON m.image_id = i.id)", *LABEL_VIEWS, "images", "sources", "image_links", "image_tags", "image_regions", "claims", "claim_evidence", "image_family_members")
def _(c):
    return q.image_profiles(c).select("id", "source_title", "claim_count", shown("links", "entity_type", "entity_id", "label"), F.array_join("tags", ",").alias("tags"), shown("regions", "region_id", "label", "entity_label", "claim_count"), "family_id", F.coalesce("family_size", F.lit(0).cast("long")).alias("family_size"))


@query("q18_claim_profiles", f"SELECT * FROM ({REGIONS} SELECT k.id, k.subject, k.object, {agg('e.evidence_type, e.evidence_id', 'e.evidence_type, e.evidence_id', 'claim_evidence e WHERE e.claim_id = k.id')} AS evidence FROM claimed k WHERE k.id IN (SELECT e.claim_id FROM claim_evidence e WHERE e.evidence_type = 'source_extract'))", *LABEL_VIEWS, "image_regions", "claims", "claim_evidence")
def _(c):
    resting = c.source_extracts.select(F.lit("source_extract").alias("evidence_type"), F.col("id").alias("evidence_id")).union(c.claim_evidence.where("evidence_type = 'source_extract'").select("evidence_type", "evidence_id")).distinct()
    return q.claim_profiles(c, evidence=resting).select("id", "subject", "object", shown("evidence", "evidence_type", "evidence_id"))


@query("q19_contributors", "SELECT id, handle FROM contributors", "contributors")
def _(c):
    return q.contributors(c)


@query("q20_typed_search", f"SELECT * FROM (WITH {ASKED}, idx AS (SELECT 'model' AS type, id, name AS title, film AS subtitle, film AS badges FROM models UNION ALL SELECT 'map', x.id, x.name, m.name, '' FROM maps x JOIN models m ON m.id = x.model_id), hits AS (SELECT query_id, idx.*, row_number() OVER (PARTITION BY query_id, type ORDER BY title, id) AS r FROM idx JOIN asked ON length(trim(asked.text)) >= 2 AND (query_id % 2 = 0 OR type = 'map') AND (title ILIKE '%' || asked.text || '%' OR coalesce(subtitle, '') ILIKE '%' || asked.text || '%')) SELECT query_id, type, id, title, badges, CAST(row_number() OVER (PARTITION BY query_id ORDER BY type, title, id) AS INT) AS place FROM hits WHERE r <= 5 QUALIFY place <= least(greatest(query_id % 4, 1), 100))", "models", "maps")
def _(c):
    text = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'ring' WHEN 1 THEN 'NATION_1' WHEN 2 THEN 'e' ELSE 'brand#2' END")
    types = F.when(F.col("s_suppkey") % 2 == 1, F.array(F.lit("map"), F.lit("nothing"))).otherwise(F.array().cast("array<string>"))
    asked = c.supplier.where("s_suppkey % 11 = 0").select(F.col("s_suppkey").alias("query_id"), text.alias("text"), types.alias("types"), (F.col("s_suppkey") % 4).cast("int").alias("limit"))
    return q.search(c, asked, types=("model", "map")).select("query_id", "type", "id", "title", F.array_join("badges", ",").alias("badges"), "place")


@query("x1_kit_regions", "SELECT DISTINCT kit_id, region_id, image_id FROM (SELECT entity_id AS kit_id, id AS region_id, image_id FROM image_regions WHERE entity_type = 'kit' UNION ALL SELECT t.kit_id, r.id, r.image_id FROM image_regions r JOIN parts t ON t.id = r.entity_id WHERE r.entity_type = 'part')", "image_regions", "parts")
def _(c):
    return jobs.kit_regions(c)


@query("x1_kit_maps", *via("SELECT via_kit AS kit_id, s.map_id, count(*) AS placements FROM placement_kit p JOIN (SELECT DISTINCT placement_id, map_id FROM placement_positions WHERE map_id IS NOT NULL) s ON s.placement_id = p.id WHERE via_kit IS NOT NULL GROUP BY ALL", ("placement_positions",)))
def _(c):
    return jobs.kit_maps(c)


@query("x1_part_evidence", "SELECT DISTINCT part_id, evidence_type, evidence_id FROM (SELECT entity_id AS part_id, 'image' AS evidence_type, image_id AS evidence_id FROM image_links WHERE entity_type = 'part' UNION ALL SELECT entity_id, 'image_region', id FROM image_regions WHERE entity_type = 'part')", "image_links", "image_regions")
def _(c):
    return jobs.part_evidence(c)


@query("x1_position_evidence", "SELECT s.placement_id, s.id AS position_id, l.image_id FROM placement_positions s JOIN (SELECT DISTINCT entity_id, image_id FROM image_links WHERE entity_type = 'placement') l ON l.entity_id = s.placement_id", "placement_positions", "image_links")
def _(c):
    return jobs.position_evidence(c)


@query("x4_state_timeline", "SELECT o_custkey, state, date_start, date_end FROM (SELECT *, CAST(lead(date_start) OVER (PARTITION BY o_custkey ORDER BY date_start) - INTERVAL 1 DAY AS DATE) AS date_end FROM (SELECT *, lag(state) OVER (PARTITION BY o_custkey ORDER BY date_start) AS before FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS date_start, max(o_orderstatus) AS state FROM orders GROUP BY ALL)) WHERE before IS DISTINCT FROM state)")
def _(c):
    return jobs.timeline(c.orders.select("o_custkey", F.col("o_orderstatus").alias("state"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")), ["o_custkey"], "state", "d")


@query("c4_staging_buckets", "SELECT section, key, count FROM (SELECT 'bucket' AS section, bucket AS key, count(*) AS count FROM b GROUP BY 2 UNION ALL SELECT 'reason', bucket || ':' || reason, count(*) FROM b GROUP BY 2 UNION ALL SELECT section, key, count FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY count DESC, key) AS r FROM (SELECT CASE bucket WHEN 'safe_to_stage' THEN 'safe_sources' ELSE 'review_sources' END AS section, key, count(*) AS count FROM b GROUP BY ALL)) WHERE r <= 20)".replace("FROM b", "FROM (SELECT *, CASE WHEN reason = 'attributed_and_nonhistorical' THEN 'safe_to_stage' ELSE 'needs_review' END AS bucket FROM (SELECT 'p' || CAST(source_id % 3 AS STRING) || ':c' || CAST(source_id AS STRING) AS key, CASE WHEN source_id % 5 = 0 THEN 'low_source_confidence' WHEN image_type = 'fr' THEN 'render_or_cg' ELSE 'attributed_and_nonhistorical' END AS reason FROM images))"), "images")
def _(c):
    manifest = c.images.select("filename", F.col("title").alias("subject"), F.concat(F.lit("p"), (F.col("source_id") % 3).cast("string")).alias("source_platform"), F.concat(F.lit("c"), F.col("source_id").cast("string")).alias("source_collection"), F.when(F.col("source_id") % 5 == 0, "low").otherwise("medium").alias("source_confidence"), F.when(F.col("image_type") == "fr", "render_or_cg").otherwise("photo").alias("content_kind"))
    return jobs.staged(manifest)[2]


TAXONOMY = "CASE WHEN lower(name) LIKE '%ring%' OR lower(name) LIKE '%bolt%' THEN 'metal' WHEN scale = '1/72' THEN 'aircraft' ELSE 'other' END"


@query("s15_category_audit", f"SELECT id, brand, name, coalesce(scale, '') AS scale, {TAXONOMY} AS category_family FROM (SELECT id, part_number AS brand, part_label AS name, CASE WHEN id % 2 = 0 THEN '1/72' END AS scale FROM parts)", "parts")
def _(c):
    kits = c.parts.select("id", F.col("part_number").alias("brand"), F.col("part_label").alias("name"), F.when(F.col("id") % 2 == 0, "1/72").alias("scale"))
    return jobs.reclassified(kits, [rules.Rule(("ring", "bolt"), ("metal", "part"))], {"1/72": ("aircraft", "military_aircraft")})[1].drop("category_subject")


@query("a14_category_counts", f"SELECT {TAXONOMY} AS category_family, count(*) AS count FROM (SELECT part_label AS name, CASE WHEN id % 2 = 0 THEN '1/72' END AS scale FROM parts) GROUP BY 1", "parts")
def _(c):
    kits = c.parts.select("id", F.col("part_number").alias("brand"), F.col("part_label").alias("name"), F.when(F.col("id") % 2 == 0, "1/72").alias("scale"))
    return jobs.reclassified(kits, [rules.Rule(("ring", "bolt"), ("metal", "part"))], {"1/72": ("aircraft", "military_aircraft")})[2].select("category_family", "count")


@query("m7_supersede_depths", "SELECT * FROM (WITH RECURSIVE chain AS (SELECT id, CAST(0 AS BIGINT) AS depth, id AS first_id FROM placement_positions WHERE supersedes_id IS NULL OR supersedes_id NOT IN (SELECT id FROM placement_positions) UNION ALL SELECT p.id, depth + 1, first_id FROM placement_positions p JOIN chain c ON p.supersedes_id = c.id) SELECT * FROM chain)", "placement_positions")
def _(c):
    return merge.supersede_depths(c.placement_positions)


@query("m8_detached_members", "SELECT image_id, family_id, CASE WHEN NOT any_primary THEN CAST(row_number() OVER (PARTITION BY family_id ORDER BY sort_order, id) = 1 AS INT) ELSE is_primary END AS is_primary FROM (SELECT *, bool_or(is_primary = 1) OVER (PARTITION BY family_id) AS any_primary FROM image_family_members WHERE image_id % 3 > 0)", "image_family_members")
def _(c):
    members = c.image_family_members.withColumn("relation_type", F.when(F.col("is_primary") == 1, "primary").otherwise("duplicate"))
    return merge.detach_members(members, c.images.where("id % 3 = 0").select(F.col("id").alias("image_id"))).select("image_id", "family_id", "is_primary")


@query("a16_reference_counts", "SELECT filename, count(*) AS \"references\" FROM images GROUP BY filename", "images")
def _(c):
    from ..sources.tables import reference_counts

    return reference_counts(c.images, "filename")


@query("a15_merge_counts", "SELECT (SELECT count(*) FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0) AS inserted, (SELECT count(*) FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 > 0) AS updated, (SELECT count(*) FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 3 > 0) AS kept, (SELECT count(*) FROM part WHERE p_partkey % 2 = 0) AS skipped")
def _(c):
    table = c.part.where("p_partkey % 3 > 0").selectExpr("p_partkey AS id", "p_name AS name")
    incoming = c.part.where("p_partkey % 2 = 0").selectExpr("p_partkey AS id", "p_name AS name", "1 AS seq")
    twice = incoming.union(incoming.withColumn("seq", F.lit(2)))
    return merge.merge_counts(merge.upsert(table, twice, ["id"], sequence="seq"), twice, ["id"])


@query("g5_region_records", "SELECT id, CASE WHEN id % 3 = 0 THEN 'box' WHEN id % 3 = 1 THEN 'point' ELSE 'polygon' END AS kind, CAST(round(x_norm * 640) AS BIGINT) AS x_px, CASE WHEN id % 3 = 0 THEN CAST(round(0.25 * 640) AS BIGINT) END AS w_px, CASE WHEN id % 3 = 2 THEN 2 END AS points FROM image_regions", "image_regions")
def _(c):
    kind = F.when(F.col("id") % 3 == 0, "box").when(F.col("id") % 3 == 1, "point").otherwise("polygon")
    points = F.array(F.struct(F.lit(0.25).alias("x"), F.lit(0.5).alias("y")), F.struct(F.lit(0.5).alias("x"), F.lit(0.75).alias("y")))
    record = g.region(kind, F.col("x_norm"), F.lit(0.5), F.lit(0.25), F.lit(0.125), points, F.lit(640), F.lit(480))
    return c.image_regions.select("id", record.alias("r")).select("id", "r.kind", "r.x_px", "r.w_px", F.when(F.size("r.points_px") >= 0, F.size("r.points_px")).cast("int").alias("points"))


# keyword tables

#: Texts as some sites have them, with letters of full width; SQL sees the usual ones, which is what the compatibility form is.
WIDE = ("abcdefghijklmnopqrstuvwxyz", "".join(chr(0xFF41 + i) for i in range(26)))
#: The first two words of each text, its first word and the part names: thousands of keywords.
BARE = "trim(regexp_replace(regexp_replace(lower({}), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
LISTED = "SELECT p_name AS keyword FROM part UNION SELECT regexp_extract({t}, '^[a-z0-9]+ [a-z0-9]+') FROM documents UNION SELECT regexp_extract({t}, '^[a-z0-9]+') FROM documents".replace("{t}", BARE.format("text"))
#: Whether a keyword of letters, digits and single blanks stands in a text as whole words: other characters are made bars.
STANDS = " OR ".join(f"contains(y, '{a}' || keyword || '{b}')" for a in " |" for b in " |")


def listed(c) -> DataFrame:
    from ..functions.text import squeezed

    first = c.documents.select(F.regexp_extract(squeezed(F.col("text")), "^[a-z0-9]+( [a-z0-9]+)?", 0).alias("two"))
    own = F.array(F.when(F.contains("two", F.lit(" ")), F.col("two")).otherwise(""), F.substring_index("two", " ", 1))
    return c.part.select(F.col("p_name").alias("keyword")).union(first.distinct().select(F.explode(own).alias("keyword"))).distinct()


def typed(c) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, F.translate("text", *WIDE)).otherwise(F.col("text"))
    return c.documents.select(F.col("doc_id").alias("id"), text.alias("text"), F.contains("text", F.lit("lle")).alias("relevant"))


@query("j14_keyword_table", f"SELECT id, keyword FROM (SELECT doc_id AS id, ' ' || regexp_replace({BARE.format('text')}, '[^a-z0-9 ]', '|', 'g') || ' ' AS y FROM documents) JOIN ({LISTED}) ON keyword <> '' AND ({STANDS})")
def _(c):
    return keywords.keyword_matches(typed(c), listed(c), "text")


@query("r6_scored_by_table", f"SELECT id, tier, CAST(2 * f + 3 * m + 2 * r + 2 * s AS INT) AS score, concat_ws(',', CASE WHEN f = 1 THEN 'filter' END, 'model:' || first_m, 'resource:' || first_r, CASE WHEN s = 1 THEN 'research:' || first_s END) AS reasons FROM (SELECT *, CASE WHEN m + r + s > 0 THEN 'strong' WHEN f > 0 THEN 'candidate' ELSE 'exclude' END AS tier FROM (SELECT *, CAST(first_m IS NOT NULL AS INT) AS m, CAST(first_r IS NOT NULL AS INT) AS r, CAST(first_s IS NOT NULL AND (f = 1 OR first_m IS NOT NULL) AS INT) AS s FROM (SELECT d.id, max(f) AS f, min(CASE WHEN kind = 0 THEN keyword END) AS first_m, min(CASE WHEN kind = 1 THEN keyword END) AS first_r, min(CASE WHEN kind = 2 THEN keyword END) AS first_s FROM (SELECT doc_id AS id, CAST(contains(text, 'lle') AS INT) AS f, ' ' || regexp_replace({BARE.format('text')}, '[^a-z0-9 ]', '|', 'g') || ' ' AS y FROM documents) d LEFT JOIN (SELECT keyword, length(keyword) % 3 AS kind FROM ({LISTED}) WHERE contains(keyword, ' ')) ON {STANDS} GROUP BY d.id)))")
def _(c):
    kind = F.element_at(F.array(*map(F.lit, keywords.POINTS)), F.length("keyword") % 3 + 1)
    table = listed(c).where("contains(keyword, ' ')").withColumn("kind", kind)
    return keywords.scored_titles(typed(c), table, F.col("relevant"), "text").select("id", "tier", "score", F.array_join("reasons", ",").alias("reasons"))


@query("x6_tagged_by_table", f"SELECT id, source_id, keyword FROM (SELECT id, source_id, ' ' || regexp_replace({BARE.format('content')}, '[^a-z0-9 ]', '|', 'g') || ' ' AS y FROM source_extracts) JOIN ({LISTED}) ON keyword <> '' AND ({STANDS})", "source_extracts")
def _(c):
    return keywords.tagged_posts(c.source_extracts, "content", listed(c)).select("id", "source_id", "keyword")


# chains

def links(c) -> DataFrame:
    """Each order names the third one before: three chains as long as a third of the table. The first of the last chain
    names that chain's end, so it goes round."""
    key = F.col("o_orderkey")
    last = c.orders.where(key % 3 == 2).agg(F.max("o_orderkey").alias("last"))
    before = F.when(key >= 3, key - 3).when(key == 2, F.col("last"))
    return c.orders.join(F.broadcast(last)).select(key.alias("id"), before.alias("before"))


@query("x3_deep_chains", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey % 3 END AS root, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey // 3 END AS depth, CASE WHEN o_orderkey % 3 = 2 THEN CAST(2 AS BIGINT) END AS cycle, o_orderkey % 3 = 2 AS on_cycle, false AS dangling FROM orders")
def _(c):
    return chains.chains(links(c), "id", "before")


@query("m7_supersede_cycles", "SELECT CAST(2 AS BIGINT) AS cycle, count(*) FILTER (WHERE o_orderkey % 3 = 2) AS rows, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS leading FROM orders")
def _(c):
    """The second chain begins at the third, and so leads into its circle."""
    before = F.when(F.col("id") == 1, 2).otherwise(F.col("before"))
    return merge.supersede_cycles(links(c).select("id", before.alias("supersedes_id")))


# uncertain dates

#: Orders with the year, the month or the day alone.
ROUGHLY = "CASE o_orderkey % 3 WHEN 0 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4) WHEN 1 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END"
#: By definition, on each day on which something may change: a state is possible if no observation that surely follows one of
#: its own has surely been made by then.
SWEPT = f"""obs AS (SELECT DISTINCT o_custkey AS k, o_orderstatus AS s, CAST(CASE length(d) WHEN 4 THEN d || '-01-01' WHEN 7 THEN d || '-01' ELSE d END AS DATE) AS a, CASE length(d) WHEN 4 THEN CAST(d || '-12-31' AS DATE) WHEN 7 THEN last_day(CAST(d || '-01' AS DATE)) ELSE CAST(d AS DATE) END AS b FROM (SELECT *, {ROUGHLY} AS d FROM orders)),
    days AS (SELECT k, d, lead(d) OVER (PARTITION BY k ORDER BY d) AS n FROM (SELECT k, a AS d FROM obs UNION SELECT k, b FROM obs)),
    may AS (SELECT DISTINCT days.k, d, n, i.s FROM days JOIN obs i ON i.k = days.k AND i.a <= d WHERE NOT EXISTS (SELECT 1 FROM obs j WHERE j.k = i.k AND j.s <> i.s AND j.a > i.b AND j.b <= days.d)),
    must AS (SELECT k, d, n, min(s) AS s FROM may JOIN (SELECT k, min(b) AS known FROM obs GROUP BY k) USING (k) WHERE d >= known GROUP BY k, d, n HAVING count(*) = 1),
    marked AS (SELECT *, 'possible' AS kind FROM may UNION ALL SELECT k, d, n, s, 'certain' FROM must),
    parted AS (SELECT *, sum(CAST(b IS DISTINCT FROM d AS INT)) OVER (PARTITION BY k, s, kind ORDER BY d) AS g FROM (SELECT *, lag(n) OVER (PARTITION BY k, s, kind ORDER BY d) AS b FROM marked))"""


@query("x4_uncertain_timeline", f"SELECT * FROM (WITH {SWEPT} SELECT k AS o_custkey, s AS state, kind, min(d) AS date_start, CAST(nullif(arg_max(coalesce(n, DATE '9999-01-01'), d), DATE '9999-01-01') - INTERVAL 1 DAY AS DATE) AS date_end FROM parted GROUP BY k, s, kind, g)")
def _(c):
    seen = c.orders.select("o_custkey", F.col("o_orderstatus").alias("state"), F.expr(ROUGHLY).alias("d"))
    return timelines.uncertain_timeline(seen, ["o_custkey"], "state", "d")


@query("x4_contradictions", "SELECT grp, date, string_agg(s, ',' ORDER BY s) AS states FROM (SELECT DISTINCT o_custkey % 50 AS grp, CAST(o_orderdate AS DATE) AS date, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 = 2) GROUP BY grp, date HAVING count(*) > 1")
def _(c):
    seen = c.orders.select((F.col("o_custkey") % 50).alias("grp"), "o_orderstatus", F.expr(ROUGHLY).alias("d"))
    return timelines.contradictions(seen, ["grp"], "o_orderstatus", "d").withColumn("states", F.array_join("states", ","))


# regions by place

#: All on one image: pictures of a few sizes, some large, and labels on and between them, in whole numbers.
TILES = "tiles AS (SELECT p_partkey AS idx, p_partkey * 7919 % 4001 AS x, p_partkey * 104729 % 3989 AS y, CASE WHEN p_partkey % 97 = 0 THEN 900 ELSE p_size END AS cx, p_size % 23 AS cy, CAST(p_size % 5 AS DOUBLE) AS area FROM part)"
NOTES = "notes AS (SELECT l_orderkey * 10 + l_linenumber AS label_id, min(l_orderkey * 31 + l_linenumber * 577) % 4800 - 400 AS x, min(l_orderkey * 17 + l_linenumber * 911) % 4800 - 400 AS y FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@query("j11_nearest_on_one_image", f"SELECT * FROM (WITH {TILES}, {NOTES} SELECT n.label_id, arg_min(t.idx, struct_pack(d := power(greatest(t.x - (n.x + 1.0), 0, n.x + 1.0 - (t.x + t.cx)), 2) + power(greatest(t.y - (n.y + 1.0), 0, n.y + 1.0 - (t.y + t.cy)), 2), a := -t.area, i := t.idx)) AS p_idx FROM notes n CROSS JOIN tiles t GROUP BY n.label_id)")
def _(c):
    tiles = c.spark.sql(f"WITH {TILES} SELECT CAST(1 AS BIGINT) AS slide, * FROM tiles".replace("FROM part", "FROM {part}"), part=c.part)
    notes = c.spark.sql(f"WITH {NOTES} SELECT CAST(1 AS BIGINT) AS slide, *, 2 AS cx, 2 AS cy FROM notes".replace("FROM lineitem", "FROM {lineitem}"), lineitem=c.lineitem)
    return spatial.nearest_in_space(notes, tiles).select("label_id", "p_idx")


#: Boxes and notched squares, some large, and points on a few images.
SHAPES = "shapes AS (SELECT p_partkey AS id, p_partkey % 3 AS image_id, CAST(p_partkey * 7919 % 1009 AS DOUBLE) / 1024 AS x, CAST(p_partkey * 104729 % 1013 AS DOUBLE) / 1024 AS y, CAST(CASE WHEN p_partkey % 50 = 0 THEN 256 ELSE p_size + 1 END AS DOUBLE) / 512 AS w, p_size % 4 AS k FROM part)"
PLACES = "places AS (SELECT c_custkey AS place, c_custkey % 3 AS image_id, CAST(c_custkey * 31 % 2027 AS DOUBLE) / 2048 AS x, CAST(c_custkey * 17 % 2039 AS DOUBLE) / 2048 AS y FROM customer)"


@query("g5_regions_at", f"""SELECT * FROM (WITH {SHAPES}, {PLACES}, corners AS (SELECT id, image_id, k, x, y, w, CASE WHEN k = 0 THEN NULL ELSE [{{'x': x, 'y': y}}, {{'x': x + w, 'y': y}}, {{'x': x + w, 'y': y + w}}, {{'x': x + w / 2, 'y': y + w / 4}}, {{'x': x, 'y': y + w}}] END AS c FROM shapes),
    edges AS (SELECT id, image_id, c[i].x AS ax, c[i].y AS ay, c[i % 5 + 1].x AS zx, c[i % 5 + 1].y AS zy FROM corners, range(1, 6) t(i) WHERE k > 0)
    SELECT place, p.image_id, id AS region_id FROM places p JOIN edges e ON e.image_id = p.image_id AND (ay > p.y) <> (zy > p.y) AND p.x < ax + (zx - ax) * ((p.y - ay) / (zy - ay)) GROUP BY ALL HAVING count(*) % 2 = 1
    UNION ALL SELECT place, p.image_id, id FROM places p JOIN shapes s ON s.image_id = p.image_id AND k = 0 AND p.x >= s.x AND p.x < s.x + w AND p.y >= s.y AND p.y < s.y + w)""")
def _(c):
    shapes = c.spark.sql(f"WITH {SHAPES} SELECT id, image_id, x, y, w, w AS h, k FROM shapes".replace("FROM part", "FROM {part}"), part=c.part)
    corner = lambda dx, dy: F.struct((F.col("x") + dx * F.col("w")).alias("x"), (F.col("y") + dy * F.col("w")).alias("y"))
    outline = F.array(*[corner(F.lit(dx), F.lit(dy)) for dx, dy in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 0.25), (0.0, 1.0))])
    regions = shapes.select("id", "image_id", F.when(F.col("k") == 0, "box").otherwise("polygon").alias("kind"), "x", "y", "w", "h", F.when(F.col("k") > 0, outline).alias("points"))
    places = c.spark.sql(f"WITH {PLACES} SELECT * FROM places".replace("FROM customer", "FROM {customer}"), customer=c.customer)
    return spatial.regions_at(places, regions).select("place", "image_id", "region_id")


# spelling

#: Part names with a number, and those of customers' notes on them, some letters changed.
CODED = "coded AS (SELECT DISTINCT p_name || ' ' || CAST(p_partkey % 150 AS STRING) AS name FROM part)"
NOTED = "noted AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN replace(p_name, 'ring', 'rng') WHEN 1 THEN upper(p_name) || 's' WHEN 2 THEN ' ' || substr(p_name, 2) ELSE p_name END || ' ' || CAST(p_partkey % 170 AS STRING) AS name FROM part)"


@query("x8_close_names", f"SELECT * FROM (WITH {CODED}, {NOTED}, l AS (SELECT DISTINCT lower(trim(name)) AS left_name FROM coded), r AS (SELECT DISTINCT lower(trim(name)) AS right_name FROM noted) SELECT left_name, right_name, CAST(levenshtein(left_name, right_name) AS INTEGER) AS distance FROM l JOIN r ON abs(length(left_name) - length(right_name)) <= 2 AND levenshtein(left_name, right_name) <= 2)")
def _(c):
    named = lambda sql, name: c.spark.sql(f"WITH {sql} SELECT * FROM {name}".replace("FROM part", "FROM {part}"), part=c.part)
    return spelling.close_names(named(CODED, "coded"), named(NOTED, "noted"))


# tables changed in place


def changed_table(c) -> Snapshot:
    """Positions as a snapshot, changed by two batches: new states and ids, then deletions; the first is run twice."""
    rows = c.placement_positions.select("id", "placement_id", "status", "x_norm")
    table = Snapshot.create(c.spark, new_path(c.spark, "positions"), rows.schema, ["id"], 32)
    table.apply(rows, 0)
    some = rows.where("id % 500 = 3").withColumns({"status": F.lit("moved"), "x_norm": F.lit(None).cast("double")})
    fresh = rows.where("id % 500 = 4").withColumn("id", F.col("id") + 10_000_000)
    table.apply(some.unionByName(fresh), 1)
    table.apply(rows.withColumn("status", F.lit("again")), 1)
    table.apply(rows.where("id % 250 = 7").withColumn("gone", F.col("id") % 500 == 7), 2, deleted="gone")
    return table


@query("w11_table_versions", "SELECT v AS version, id, placement_id, CASE WHEN v > 1 AND id % 500 = 3 AND id < 10000000 THEN 'moved' ELSE status END AS status, x_norm FROM (SELECT id, placement_id, status, x_norm FROM placement_positions UNION ALL SELECT id + 10000000, placement_id, status, x_norm FROM placement_positions WHERE id % 500 = 4) CROSS JOIN (SELECT unnest([1, 2, 3]) AS v) WHERE (v > 1 OR id < 10000000) AND (v < 3 OR id % 500 <> 7 OR id >= 10000000)", "placement_positions")
def _(c):
    table, out = changed_table(c), None
    for v in table.versions():
        own = table.read(v).withColumn("version", F.lit(v))
        out = own if out is None else out.unionByName(own)
    return out.select("version", "id", "placement_id", "status", "x_norm")


def in_batches(c, results: DataFrame, schema: str, keys: list[str], batches: list[DataFrame]) -> DataFrame:
    table = Snapshot.create(c.spark, new_path(c.spark, "late"), schema, keys, 16)
    for number, batch in enumerate(batches):
        table.apply(results(batch), number, changes.later(keys))
    return table.read()


@query("m6_late_choices", "SELECT p.id, CASE WHEN k.pick IS NULL THEN p.is_current WHEN k.pick = p.id THEN 1 ELSE 0 END AS is_current, CASE WHEN k.pick = p.id THEN 'active' ELSE p.status END AS status FROM placement_positions p LEFT JOIN (SELECT placement_id, map_id, arg_max(id, (epoch_us(created_at), id)) AS pick FROM placement_positions WHERE id % 4 = 1 GROUP BY ALL) k USING (placement_id, map_id)", "placement_positions")
def _(c):
    """The choices of m6_set_current in three batches, the later ones first."""
    p = c.placement_positions
    chosen = p.where("id % 4 = 1").select("id", "placement_id", "map_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(created_at AS TIMESTAMP_NTZ))").alias("change_seq"))
    kept = in_batches(c, changes.last_choices, changes.CHOICES, ["placement_id", "map_id"], [chosen.where(F.col("id") % 3 == k) for k in (2, 0, 1)])
    return changes.with_choices(p, kept).select("id", "is_current", "status")


@query("m4_late_fields", "SELECT p.id, p.placement_id, CASE WHEN u.field = 'status' THEN u.value ELSE p.status END AS status, CASE WHEN u.field = 'map_id' THEN try_cast(u.value AS BIGINT) ELSE p.map_id END AS map_id FROM placement_positions p LEFT JOIN (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'status' ELSE 'map_id' END AS field, CASE WHEN event_id % 6 > 0 THEN CAST(event_id % 100 AS STRING) END AS value FROM events WHERE event_id % 5 < 2) u ON u.id = p.id", "placement_positions")
def _(c):
    """The changes of m4_partial_update, the last ones arriving first."""
    name = F.when(F.col("event_id") % 2 == 0, "status").otherwise("map_id")
    some, value = c.events.where("event_id % 5 < 2"), F.when(F.col("event_id") % 6 > 0, (F.col("event_id") % 100).cast("string"))
    made = lambda seq, v: some.select(F.col("event_id").alias("id"), F.lit(seq).alias("change_seq"), F.create_map(name, v).alias("fields"))
    kept = in_batches(c, changes.last_fields, changes.FIELDS, ["id", "field"], [made(2, value), made(1, F.lit("0"))])
    return changes.with_fields(c.placement_positions, kept, ["status", "map_id"]).select("id", "placement_id", "status", "map_id")


# pages

PAGED = "SELECT {key}, (r - 1) // 40 AS page, count(*) AS n, string_agg(CAST({id} AS STRING), ',' ORDER BY r) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS r FROM {table} WHERE {key} IS NOT NULL) GROUP BY 1, 2"


@query("q11_source_pages", f"SELECT 'extract' AS kind, * FROM ({PAGED.format(key='source_id', id='id', order='id', table='source_extracts')}) UNION ALL SELECT 'image', * FROM ({PAGED.format(key='source_id', id='id', order='id', table='images')})", "source_extracts", "images")
def _(c):
    texts, images = q.source_pages(c, 40)
    listed = lambda df, kind, array, key: df.select(F.lit(kind).alias("kind"), "source_id", "page", F.size(array).cast("long").alias("n"), text_of(array, key).alias("ids"))
    return listed(texts, "extract", "extracts", "extract_id").unionByName(listed(images, "image", "images", "image_id"))


@query("q2_kit_part_pages", PAGED.format(key="kit_id", id="id", order="part_number, id", table="parts"), "parts")
def _(c):
    return q.kit_part_pages(c, 40).select("kit_id", "page", F.size("parts").cast("long").alias("n"), text_of("parts", "part_id").alias("ids"))


# every branch of the links

#: Kits of which some labels name one, some two and some none.
SOME_KITS = "CASE WHEN id % 25 < 4 THEN 'Label ' || CAST(id % 25 AS STRING) WHEN id % 25 < 8 THEN 'LABEL-' || CAST(4 + id % 2 AS STRING) ELSE 'Kit ' || CAST(id AS STRING) END"
SOME_LINKED = LINKED.replace("'Label ' || CAST(id % 12 AS STRING)", SOME_KITS)


def some_linked(c):
    return jobs.link_regions(c.image_regions, c.kits.select("id", F.expr(SOME_KITS).alias("name")))


@query("c11_link_report", f"SELECT * FROM (WITH {SOME_LINKED} SELECT id, label, CASE WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ambiguous_exact_match' ELSE 'no_exact_match' END AS match_status, CASE WHEN n = 1 THEN m END AS match_id FROM hits)", "image_regions", "kits")
def _(c):
    return some_linked(c)[2]


@query("c11_linked_regions", f"SELECT * FROM (WITH {SOME_LINKED} SELECT r.id, r.label, CASE WHEN h.n = 1 THEN 'kit' ELSE r.entity_type END AS entity_type, CASE WHEN h.n = 1 THEN h.m ELSE r.entity_id END AS entity_id FROM image_regions r LEFT JOIN hits h ON h.id = r.id)", "image_regions", "kits")
def _(c):
    return some_linked(c)[0].select("id", "label", "entity_type", "entity_id")


@query("c11_link_history", f"SELECT * FROM (WITH {SOME_LINKED} SELECT id, 'update' AS change, label, CAST(m AS STRING) AS new_id FROM hits WHERE n = 1)", "image_regions", "kits")
def _(c):
    return some_linked(c)[1].select("id", "change", F.get_json_object("new_values", "$.label").alias("label"), F.get_json_object("new_values", "$.entity_id").alias("new_id"))


@query("j10_every_status", "SELECT p.id, CASE WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ambiguous_exact_match' ELSE 'no_exact_match' END AS match_status, CASE WHEN n = 1 THEN m END AS match_id FROM parts p LEFT JOIN (SELECT part_label, CASE WHEN part_label < 'c' THEN 1 WHEN part_label < 'r' THEN 2 END AS n, min(id) AS m FROM parts GROUP BY part_label) x ON x.part_label = p.part_label", "parts")
def _(c):
    """The names before c are one entity each, those before r two, the others none."""
    once = c.parts.where("part_label < 'r'").groupBy("part_label").agg(F.min("id").alias("id"))
    again = once.where("part_label >= 'c'").select(F.upper("part_label").alias("part_label"), -F.col("id"))
    return matching.unique_match(c.parts.select("id", "part_label"), "part_label", once.union(again), "part_label").select("id", "match_status", "match_id")


@query("q14_collapsed_pictures", f"SELECT {LIBRARY} WHERE (coalesce(title, '') ILIKE '%picture%' OR filename ILIKE '%picture%') AND i.id IN (SELECT image_id FROM image_tags WHERE tag = 'long') AND (f.family_id IS NULL OR f.is_primary = 1 OR f.is_hidden = 0)", *LIBRARY_VIEWS)
def _(c):
    return q.image_library(c, text="picture", tag="long", collapse=True).select("id", "filename", "family_id", "region_count", "claim_count")
