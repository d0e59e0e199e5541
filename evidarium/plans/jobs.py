"""Jobs that join several operators: loads, retitling, linking, tagging, lookups, chronologies. Each returns DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer, blank_to_null, first_filled, generic_title, hash_like, humanized, image_code, joined, json_field, mark_confidence, nfkc, note_value, squeezed, stem, tag_slug
from ..operators.counters import counters
from ..operators.matching import unique_match
from ..operators.merge import changed_rows, insert_absent, partial_update, upsert, with_ids
from ..operators.rules import SAFE, Rule, bucket, keyword_hits, score_titles, taxonomy
from ..operators.windows import first_labels, first_per


def partial_date(raw: Column) -> tuple[Column, Column]:
    """First and last day of 1975, 1975-05 or 1975-05-12; null for anything else."""
    padded = F.when(raw.rlike(r"^\d{4}$"), F.concat(raw, F.lit("-01-01"))).when(raw.rlike(r"^\d{4}-\d{2}$"), F.concat(raw, F.lit("-01"))).when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw)
    start = padded.try_cast("date")
    end = F.when(raw.rlike(r"^\d{4}$"), F.add_months(start, 12) - F.expr("INTERVAL 1 DAY")).when(raw.rlike(r"^\d{4}-\d{2}$"), F.last_day(start)).otherwise(start)
    return start, end.cast("date")


def chronology(events: DataFrame, date: str) -> DataFrame:
    """Events with date_start and date_end, ordered; undated ones last."""
    start, end = partial_date(F.col(date))
    return events.withColumns({"date_start": start, "date_end": end}).orderBy(F.asc_nulls_last("date_start"), F.asc_nulls_last("date_end"), date)


def workbook_parts(placed: DataFrame, parts: DataFrame, placements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sheet rows (kit_id, part_number, model_id, copy_count, mark) as new parts and new placements with ids; what the
    tables hold already is not repeated."""
    rows = placed.where("kit_id is not null and part_number is not null")
    new_parts = with_ids(parts, insert_absent(parts, rows.select("kit_id", "part_number").distinct(), ["kit_id", "part_number"]), ["kit_id", "part_number"])
    known = parts.select("id", "kit_id", "part_number").unionByName(new_parts.select("id", "kit_id", "part_number")).withColumnRenamed("id", "part_id")
    put = rows.join(known, ["kit_id", "part_number"]).select("model_id", "part_id", "copy_count", mark_confidence(F.col("mark")).alias("confidence"))
    fresh = insert_absent(placements, put, ["model_id", "part_id"])
    return new_parts, with_ids(placements, fresh, ["model_id", "part_id"])


def donors(marks: DataFrame, kits: DataFrame, models: DataFrame) -> DataFrame:
    """Marks of a donor matrix (brand, name, model, mark) with kit and model ids and a status."""
    named = models.select(F.lower("name").alias("_m"), F.col("id").alias("model_id"))
    k = kits.groupBy("brand", "name").agg(F.min("id").alias("kit_id"))
    out = marks.withColumn("_m", F.lower("model")).join(named, "_m", "left").join(k, ["brand", "name"], "left").drop("_m")
    return out.withColumns({"confidence": mark_confidence(F.col("mark")), "status": F.when(F.col("kit_id").isNull(), "no_kit").when(F.col("model_id").isNull(), "no_model").otherwise("matched")})


def corpus_images(manifest: DataFrame, sources: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A canonical manifest (sha256, filename, source_platform, source_collection, subject, content_kind, and if there are
    such columns rel_path, source_creator, source_confidence, year) as sources (one per collection under one per platform),
    images merged by content, and tags."""
    has = lambda c: F.col(c).cast("string") if c in manifest.columns else F.lit(None).cast("string")
    platforms = manifest.where("source_platform <> ''").select(F.upper("source_platform").alias("source_code"), F.lit(None).cast("string").alias("parent_code")).distinct()
    code = joined("-", F.upper("source_platform"), F.upper(F.regexp_replace("source_collection", "[^A-Za-z0-9]+", "-")))
    collections = manifest.where("source_platform <> '' and source_collection <> ''").select(code.alias("source_code"), F.upper("source_platform").alias("parent_code")).distinct()
    new_sources = platforms.unionByName(collections).join(sources.select("source_code"), "source_code", "left_anti")
    lines = {"subject": "subject", "kind": "content_kind", "original_path": "rel_path", "creator": "source_creator", "source_confidence": "source_confidence", "year": "year"}
    notes = joined("\n", *[F.concat(F.lit(f"{k}="), blank_to_null(has(c))) for k, c in lines.items()])
    detail = F.when(~hash_like(F.col("filename")), humanized(stem(F.col("filename"))))
    rows = manifest.select("sha256", first_filled(joined(" - ", F.col("subject"), detail), F.col("filename")).alias("title"), image_code("LOCREF-", F.col("sha256"), 16).alias("image_code"), notes.alias("notes"))
    merged = upsert(images.select("sha256", "title", "image_code", "notes"), first_per(rows, ["sha256"], [F.asc("title"), F.asc("notes")]), ["sha256"], mode="fill")
    words = [has(c) for c in ("subject", "source_platform", "content_kind", "source_collection", "source_creator", "year")]
    tags = manifest.select("sha256", F.explode(F.array_compact(F.array(*[F.nullif(tag_slug(w), F.lit("")) for w in words]))).alias("tag")).distinct()
    return new_sources, merged, tags


def seed_claims(claims: DataFrame, evidence: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """wanted: subject_type, subject_id, predicate, text_value, evidence_type, evidence_id. Claims that are not there yet,
    and evidence links by claim identity; a second run adds nothing."""
    identity = ["subject_type", "subject_id", "predicate", "text_value"]
    new_claims = with_ids(claims, insert_absent(claims, wanted.select(*identity), identity), identity)
    every = claims.select("id", *identity).unionByName(new_claims.select("id", *identity))
    same = F.lit(True)
    for c in identity:
        same = same & F.col(f"w.{c}").eqNullSafe(F.col(f"c.{c}"))
    links = wanted.alias("w").join(every.alias("c"), same).select(F.col("c.id").alias("claim_id"), "w.evidence_type", "w.evidence_id")
    return new_claims, insert_absent(evidence, links, ["claim_id", "evidence_type", "evidence_id"])


def link_regions(regions: DataFrame, kits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions whose label names exactly one kit are linked to it: the new regions, their history, and a report of all."""
    free = regions.where("trim(label) <> '' and entity_id is null")
    report = unique_match(free, "label", kits, "name").select("id", "label", "match_status", "match_id")
    hits = report.where("match_status = 'linked'").select("id", F.lit(1).alias("change_seq"), F.create_map(F.lit("entity_type"), F.lit("kit"), F.lit("entity_id"), F.col("match_id").cast("string")).alias("fields"))
    after = partial_update(regions, hits, ["entity_type", "entity_id"])
    return after, changed_rows(regions, after, ["entity_type", "entity_id", "label"]), report


# Wording of the titles and captions that retitling gives.
LABELS_TITLE, REGION_TITLE, NOTE_TITLE = "Overlay reference: ", " overlay reference", " reference image"
MALFORMED_TITLE, UNREVIEWED_TITLE, PLAIN_TITLE = "Malformed PPTX extract ", "Unreviewed PPTX extract ", "PPTX extract "
MALFORMED_CAPTION, UNREVIEWED_CAPTION = "file is malformed or not yet decodable", "not yet visually reviewed"


def retitle(images: DataFrame, regions: DataFrame, scene: str = "likely_model_or_scene", key: str = "slide_key") -> DataFrame:
    """id, old_title, new_title and caption of images without a title worth keeping (id, title, caption, notes, image_code).
    The first there is of: the note's scene; the scene or subject in the properties of the first region that has one; the
    first three labels; the key in a region's properties; the key in the note; else a title that says what is wrong."""
    props = F.col("properties_json") if "properties_json" in regions.columns else F.lit(None).cast("string")
    shown = F.coalesce(answer(json_field(props, "$.base_scene")), answer(json_field(props, "$.base_subject")))
    named = humanized(json_field(props, f"$.{key}"))
    first = lambda value, name: F.min_by(value, F.when(value.isNotNull(), F.col("id"))).alias(name)
    facts = regions.select("image_id", "id", shown.alias("_shown"), named.alias("_named"))
    facts = facts.groupBy(F.col("image_id").alias("id")).agg(first(F.col("_shown"), "shown"), first(F.col("_named"), "named"))
    out = images.where(generic_title(F.col("title"))).join(facts, "id", "left").join(first_labels(regions).withColumnRenamed("image_id", "id"), "id", "left")
    low, code = F.lower(F.trim("title")), first_filled(F.col("image_code"), F.col("id").cast("string"))
    last = F.when(low == "n/a", F.concat(F.lit(MALFORMED_TITLE), code)).when(low == "open", F.concat(F.lit(UNREVIEWED_TITLE), code)).otherwise(F.concat(F.lit(PLAIN_TITLE), code))
    known = F.coalesce(answer(note_value(F.col("notes"), scene)), "shown", F.concat(F.lit(LABELS_TITLE), "labels"), F.concat("named", F.lit(REGION_TITLE)), F.concat(humanized(note_value(F.col("notes"), key)), F.lit(NOTE_TITLE)))
    said = F.when(known.isNull() & (low == "n/a"), MALFORMED_CAPTION).when(known.isNull() & (low == "open"), UNREVIEWED_CAPTION)
    out = out.select("id", F.col("title").alias("old_title"), F.coalesce(known, last).alias("new_title"), F.coalesce(blank_to_null(F.col("caption")), said).alias("caption"), F.col("caption").alias("_caption"))
    return out.where(~(F.col("old_title").eqNullSafe(F.col("new_title")) & F.col("caption").eqNullSafe(F.col("_caption")))).drop("_caption")


def staged(manifest: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A canonical manifest with bucket and bucket_reason, parted into the rows that may be loaded and those to be reviewed,
    each in order, and the counters of reasons and of the sources of either (20 at most)."""
    b = bucket(F.col("source_platform"), F.col("source_confidence"), F.col("content_kind"))
    rows = manifest.withColumn("_b", b).select("*", "_b.bucket", "_b.bucket_reason").drop("_b")
    safe = rows.where(F.col("bucket") == SAFE).orderBy("subject", "source_platform", F.lower("filename"))
    review = rows.where(F.col("bucket") != SAFE).orderBy("bucket_reason", "subject", "source_platform", F.lower("filename"))
    label = F.coalesce(F.nullif(joined(":", F.col("source_platform"), F.col("source_collection")), F.lit("")), F.lit("unknown"))
    reasons = counters(rows, {"bucket": F.col("bucket"), "reason": F.concat_ws(":", "bucket", "bucket_reason")})
    top = lambda some, name: counters(some, {name: label}, top=20)
    return safe, review, reasons.unionByName(top(safe, "safe_sources")).unionByName(top(review, "review_sources"))


def reclassified(kits: DataFrame, rules: Sequence[Rule], scales: dict[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kits with their family and subject by the rules, the audit table of all kits by brand and name, and how many there
    are of each, the most common first."""
    names = ("category_family", "category_subject")
    out = taxonomy(kits.drop(*names), rules, scales)
    audit = out.select("id", "brand", "name", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("scale", "serial_number", "scalemates_url") if c in out.columns], *names).orderBy("brand", "name", "id")
    counts = out.groupBy(*names).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), *names)
    return out, audit, counts


def select_threads(manifest: DataFrame, models: Sequence[str], resources: Sequence[str], research: Sequence[str], relevant: Column, most: int | None = None) -> DataFrame:
    """Strong threads, best first; `most` takes the manifest's first ones before they are ranked."""
    scored = score_titles(manifest, models, resources, research, relevant).where("tier = 'strong'")
    if most is not None:
        scored = scored.orderBy("position").limit(most)
    return scored.orderBy(F.desc("score"), "title", "thread_id")


def tag_posts(posts: DataFrame, text: str, names: Sequence[str]) -> DataFrame:
    """(post columns, keyword) for every name that a post has as a whole word: candidates for review."""
    return posts.withColumn("_w", squeezed(nfkc(F.col(text)))).withColumn("keyword", F.explode(keyword_hits(F.col("_w"), names))).drop("_w")


def disposition(report: DataFrame) -> DataFrame:
    """Change records for linked, unclear and unmatched regions: accept, needs_review, hide."""
    status = F.when(F.col("match_status") == "linked", "accept").when(F.col("match_status") == "ambiguous_exact_match", "needs_review").otherwise("hide")
    return report.select("id", F.lit(1).alias("change_seq"), F.create_map(F.lit("review_status"), status).alias("fields"))


def short_title(title: Column, most: int = 40) -> Column:
    """The part before the first separator, cut at a word."""
    head = F.trim(F.regexp_extract(title, r"^(.*?)(?:\s+[-—/|:]\s+.*)?$", 1))
    return F.when(F.length(head) > most, F.regexp_replace(F.left(head, F.lit(most)), r"\s+\S*$", "")).otherwise(head)


def kit_evidence(c) -> DataFrame:
    """From kits back to their images: by links of the kit itself, of its parts, and of placements of either."""
    from .catalog import placement_kit

    links = c.image_links.select("entity_type", "entity_id", "image_id")
    own = links.where("entity_type = 'kit'").select(F.col("entity_id").alias("kit_id"), "image_id", F.lit("kit").alias("via"))
    parts = links.where("entity_type = 'part'").join(c.parts.select(F.col("id").alias("entity_id"), "kit_id"), "entity_id").select("kit_id", "image_id", F.lit("part").alias("via"))
    placed = links.where("entity_type = 'placement'").join(placement_kit(c).select(F.col("id").alias("entity_id"), F.col("via_kit").alias("kit_id")), "entity_id").where("kit_id is not null").select("kit_id", "image_id", F.lit("placement").alias("via"))
    return own.unionByName(parts).unionByName(placed).distinct()


def kit_regions(c) -> DataFrame:
    """(kit_id, region_id, image_id): regions that show a kit or one of its parts."""
    r = c.image_regions.select(F.col("id").alias("region_id"), "image_id", "entity_type", "entity_id")
    own = r.where("entity_type = 'kit'").select(F.col("entity_id").alias("kit_id"), "region_id", "image_id")
    parts = r.where("entity_type = 'part'").join(c.parts.select(F.col("id").alias("entity_id"), "kit_id"), "entity_id").select("kit_id", "region_id", "image_id")
    return own.union(parts).distinct()


def kit_maps(c) -> DataFrame:
    """(kit_id, map_id, placements): the maps on which a kit's placements have a position, with how many do."""
    from .catalog import placement_kit

    placed = placement_kit(c).where("via_kit is not null").select(F.col("id").alias("placement_id"), F.col("via_kit").alias("kit_id"))
    shown = c.placement_positions.where("map_id is not null").select("placement_id", "map_id").distinct()
    return placed.join(shown, "placement_id").groupBy("kit_id", "map_id").agg(F.count(F.lit(1)).alias("placements"))


def part_evidence(c) -> DataFrame:
    """(part_id, evidence_type, evidence_id): images linked to a part, and regions that show it."""
    links = c.image_links.where("entity_type = 'part'").select(F.col("entity_id").alias("part_id"), F.lit("image").alias("evidence_type"), F.col("image_id").alias("evidence_id"))
    shown = c.image_regions.where("entity_type = 'part'").select(F.col("entity_id").alias("part_id"), F.lit("image_region"), F.col("id"))
    return links.union(shown).distinct()


def position_evidence(c) -> DataFrame:
    """(placement_id, position_id, image_id): images linked to a placement beside each of its positions."""
    links = c.image_links.where("entity_type = 'placement'").select(F.col("entity_id").alias("placement_id"), "image_id").distinct()
    return c.placement_positions.select("placement_id", F.col("id").alias("position_id")).join(links, "placement_id")


def source_claims(c) -> DataFrame:
    """From sources to the claims that their extracts support."""
    e = c.claim_evidence.where("evidence_type = 'source_extract'").select("claim_id", F.col("evidence_id").alias("id"))
    return e.join(c.source_extracts.select("id", "source_id"), "id").groupBy("source_id").agg(F.countDistinct("claim_id").alias("claims"), F.countDistinct("id").alias("extracts"))


def timeline(states: DataFrame, keys: list[str], state: str, date: str) -> DataFrame:
    """Runs of one state of each object (keys) by partial date: state, date_start, and date_end, the day before the next run
    begins; null for the last. Rows without a date are left out; of several states on one day the greatest counts."""
    dated = states.withColumn("_start", partial_date(F.col(date))[0]).where("_start is not null")
    daily = dated.groupBy(*keys, "_start").agg(F.max(state).alias("_state"))
    order = Window.partitionBy(*keys).orderBy("_start")
    runs = daily.withColumn("_before", F.lag("_state").over(order)).where(~F.col("_state").eqNullSafe(F.col("_before")) | F.col("_before").isNull())
    end = F.date_sub(F.lead("_start").over(order), 1)
    return runs.select(*keys, F.col("_state").alias(state), F.col("_start").alias("date_start"), end.alias("date_end"))
