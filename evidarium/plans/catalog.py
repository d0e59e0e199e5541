"""Catalog queries: listings, profiles of all ids at once, connections, counts, labels, search.

Functions take a catalog (tables as attributes). Filters that are None do not apply. Profiles nest their children as
arrays of structs; filter by id for one. An array is as long as the entity has children of the kind, which is what a page
about it shows; where that may be too long for a row, the flat listings have the same children one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import excerpt, first_filled, joined, like_any
from ..operators.chains import chains
from ..operators.pages import children_pages
from ..operators.windows import current_positions, first_per
from ..sources.shared import checkpointed, kept


def filtered(df: DataFrame, **equal) -> DataFrame:
    """Conjunction of equalities; lists mean membership."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return df


def counted(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def with_counts(df: DataFrame, counts: DataFrame, key: str, name: str, own: str = "id") -> DataFrame:
    """df with a count of children, 0 where there are none."""
    return df.join(counts.withColumnRenamed(key, own), own, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def nested(children: DataFrame, key: str, name: str, *columns: str, newest: bool = False) -> DataFrame:
    """Children of each key as an array of structs, sorted by their columns; newest: falling."""
    rows = F.array_sort(F.collect_list(F.struct(*columns)))
    return children.groupBy(key).agg((F.reverse(rows) if newest else rows).alias(name))


def with_children(df: DataFrame, *sides: DataFrame) -> DataFrame:
    """df with the arrays of sides, which are keyed by df's id under whatever name; [] where there are no children."""
    for side in sides:
        key, name = side.columns
        df = df.join(side.withColumnRenamed(key, "id"), "id", "left").withColumn(name, F.coalesce(name, F.array()))
    return df


def linked_images(c, kind: str) -> DataFrame:
    """(entity_id, images) by links of one kind of entity."""
    links = c.image_links.where(F.col("entity_type") == kind).select("entity_id", "image_id")
    return nested(links.join(c.images.select(F.col("id").alias("image_id"), "filename"), "image_id"), "entity_id", "images", "image_id", "filename")


def placement_kit(c) -> DataFrame:
    """Placements with via_kit: the kit of their part, or their own."""
    parts = c.parts.select(F.col("id").alias("part_id"), F.col("kit_id").alias("part_kit"))
    return c.placements.join(parts, "part_id", "left").withColumn("via_kit", F.coalesce("part_kit", "kit_id")).drop("part_kit")


def kits(c, text: str | None = None, availability: str | None = None) -> DataFrame:
    """By brand and name."""
    df = filtered(c.kits, availability=availability)
    df = df if text is None else df.where(like_any(text, F.col("brand"), F.col("name"), F.col("scale")))
    return df.orderBy("brand", "name", "id")


def connections(c, min_models: int = 2, include_assemblies: bool = False, placements: DataFrame | None = None) -> DataFrame:
    """Kits on several models, by their parts or in whole; with include_assemblies also by the parts of cast assemblies."""
    pl = placement_kit(c) if placements is None else placements
    used = pl.where("via_kit is not null").select(F.col("via_kit").alias("kit_id"), "model_id")
    if include_assemblies:
        inner = c.cast_assembly_parts.join(c.parts.select(F.col("id").alias("part_id"), F.col("kit_id").alias("k")), "part_id").select("cast_assembly_id", "k").distinct()
        used = used.union(pl.join(inner, "cast_assembly_id").select("k", "model_id"))
    used = used.distinct().join(F.broadcast(c.models.select(F.col("id").alias("model_id"), F.col("name").alias("model"))), "model_id")
    many = used.groupBy("kit_id").agg(F.count(F.lit(1)).alias("model_count"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("model_names")).where(F.col("model_count") >= min_models)
    return many.join(c.kits.select(F.col("id").alias("kit_id"), "brand", "name"), "kit_id").select("kit_id", "brand", "name", "model_count", "model_names").orderBy(F.desc("model_count"), "brand", "name", "kit_id")


def model_kit_summary(c, part_level_only: bool = True) -> DataFrame:
    """Distinct parts and copies of each kit on each model."""
    pl = placement_kit(c)
    if part_level_only:
        pl = pl.where("part_id is not null")
    return pl.where("via_kit is not null").groupBy("model_id", F.col("via_kit").alias("kit_id")).agg(F.countDistinct("part_id").alias("parts"), F.sum("copy_count").alias("copies"))


def kit_models(c) -> DataFrame:
    """Distinct models of each kit."""
    pairs = placement_kit(c).where("via_kit is not null").select(F.col("via_kit").alias("kit_id"), "model_id").distinct()
    return pairs.join(c.models.select(F.col("id").alias("model_id"), F.col("name").alias("model"), "film"), "model_id")


def kit_history(c) -> DataFrame:
    """Changes to kits if the catalog keeps any: kit_id, changed_at, change."""
    return c.kit_history


def kit_profiles(c) -> DataFrame:
    """Kits with their parts, references in other systems, the models that use them, images, and changes, newest first."""
    parts = nested(c.parts.select("kit_id", "part_number", F.col("id").alias("part_id"), "part_label"), "kit_id", "parts", "part_number", "part_id", "part_label")
    references = nested(c.kit_references, "kit_id", "references", "system", "value")
    models = nested(kit_models(c), "kit_id", "models", "model", "model_id", "film")
    history = nested(kit_history(c), "kit_id", "history", "changed_at", "change", newest=True)
    return with_children(c.kits, parts, references, models, linked_images(c, "kit"), history)


def parts(c, text: str | None = None, kit_id: int | None = None) -> DataFrame:
    """By kit and part number."""
    return part_rows(c, text, kit_id).orderBy("brand", "kit_name", "part_number", "id")


def part_rows(c, text: str | None = None, kit_id: int | None = None) -> DataFrame:
    df = filtered(c.parts, kit_id=kit_id).join(c.kits.select(F.col("id").alias("kit_id"), "brand", F.col("name").alias("kit_name")), "kit_id")
    return df if text is None else df.where(like_any(text, F.col("part_number"), F.col("part_label"), F.col("notes")))


def kit_part_pages(c, size: int = 100) -> DataFrame:
    """The parts of every kit in pages of bounded length, by number."""
    return children_pages(c.parts.withColumnRenamed("id", "part_id"), "kit_id", "parts", "part_number", "part_id", "part_label", size=size)


def part_profiles(c) -> DataFrame:
    """Parts with their placements, images and files."""
    pl = nested(c.placements.where("part_id is not null").select("part_id", "id", "model_id", "copy_count"), "part_id", "placements", "id", "model_id", "copy_count")
    files = nested(c.part_files.withColumnRenamed("id", "file_id"), "part_id", "files", "file_type", "url", "file_id")
    return with_children(part_rows(c), pl, linked_images(c, "part"), files)


def models(c, film: str | None = None) -> DataFrame:
    return filtered(c.models, film=film).orderBy("film", "name", "id")


def model_profiles(c) -> DataFrame:
    """Models with their maps, the kits whose parts they have (most copies first) and images."""
    own = nested(c.maps.select("model_id", "name", F.col("id").alias("map_id")), "model_id", "maps", "name", "map_id")
    used = model_kit_summary(c).join(c.kits.select(F.col("id").alias("kit_id"), "brand", F.col("name").alias("kit_name")), "kit_id")
    used = used.select("model_id", "copies", (-F.col("kit_id")).alias("order"), "kit_id", "brand", "kit_name", "parts")
    summary = nested(used, "model_id", "kit_summary", "copies", "order", "kit_id", "brand", "kit_name", "parts", newest=True)
    return with_children(c.models, own, summary, linked_images(c, "model"))


def maps(c, model_id: int | None = None) -> DataFrame:
    base = c.images.select(F.col("id").alias("image_id"), F.col("filename").alias("base_image"))
    return filtered(c.maps, model_id=model_id).join(base, "image_id", "left").orderBy("model_id", "name", "id")


def placements(c, **filters) -> DataFrame:
    """placement_rows by model, kit and part number."""
    return placement_rows(c, **filters).orderBy("model", "kit", "part_number", "id")


def placement_rows(c, model_id: int | None = None, kit_id: int | None = None, confidence: str | None = None, film_version: str | None = None) -> DataFrame:
    """Placements with names and the position in force."""
    df = filtered(placement_kit(c), model_id=model_id, via_kit=kit_id, confidence=confidence, film_version=film_version)
    df = df.join(F.broadcast(c.models.select(F.col("id").alias("model_id"), F.col("name").alias("model"))), "model_id")
    df = df.join(c.kits.select(F.col("id").alias("via_kit"), F.col("brand").alias("kit")), "via_kit", "left")
    df = df.join(c.parts.select(F.col("id").alias("part_id"), "part_number"), "part_id", "left")
    df = df.join(c.cast_assemblies.select(F.col("id").alias("cast_assembly_id"), F.col("name").alias("assembly")), "cast_assembly_id", "left")
    df = df.join(c.contributors.select(F.col("id").alias("attributed_to"), "handle"), "attributed_to", "left")
    now = current_positions(c.placement_positions).select(F.col("placement_id").alias("id"), F.col("id").alias("position_id"), "map_id", "x_norm")
    return df.drop("map_id").join(now, "id", "left")


def placement_profiles(c) -> DataFrame:
    """Placements with what they name, their map, the people who contributed, images, changes (newest first), positions (in
    force, then the newest) and the position in force."""
    people = c.contributors.select(F.col("id").alias("contributor_id"), "handle")
    helpers = nested(c.placement_contributors.join(people, "contributor_id"), "placement_id", "contributors", "handle", "contributor_id")
    history = c.placement_history.join(people.select(F.col("contributor_id").alias("changed_by"), F.col("handle").alias("changed_by_handle")), "changed_by", "left")
    history = nested(history, "placement_id", "history", "changed_at", "prev_part_id", "changed_by_handle", newest=True)
    own = nested(c.placement_positions.select("placement_id", "is_current", "created_at", F.col("id").alias("position_id"), "map_id", "status", "x_norm"), "placement_id", "positions", "is_current", "created_at", "position_id", "map_id", "status", "x_norm", newest=True)
    out = placement_rows(c).withColumnRenamed("map_id", "position_map_id").join(c.placements.select("id", "map_id"), "id")
    out = out.join(c.maps.select(F.col("id").alias("map_id"), F.col("name").alias("map")), "map_id", "left")
    return with_children(out, helpers, linked_images(c, "placement"), history, own)


def positions(c, placement_id: int | None = None, status: str | None = None) -> DataFrame:
    """Current ones first, then the newest."""
    return filtered(c.placement_positions, placement_id=placement_id, status=status).orderBy("placement_id", F.desc("is_current"), F.desc("created_at"), F.desc("id"))


def assemblies(c) -> DataFrame:
    """Parts and models of each cast assembly; either side is counted by itself."""
    inner = c.cast_assembly_parts.groupBy("cast_assembly_id").agg(F.countDistinct("part_id").alias("part_count"))
    used = c.placements.where("cast_assembly_id is not null").groupBy("cast_assembly_id").agg(F.countDistinct("model_id").alias("model_count"))
    out = with_counts(c.cast_assemblies, inner, "cast_assembly_id", "part_count")
    return with_counts(out, used, "cast_assembly_id", "model_count")


def assembly_profiles(c) -> DataFrame:
    inner = c.cast_assembly_parts.join(c.parts.select(F.col("id").alias("part_id"), "kit_id", "part_number"), "part_id")
    used = c.placements.where("cast_assembly_id is not null").select("cast_assembly_id", "model_id").distinct().join(c.models.select(F.col("id").alias("model_id"), "name"), "model_id")
    out = c.cast_assemblies.join(nested(inner, "cast_assembly_id", "parts", "kit_id", "part_number", "part_id").withColumnRenamed("cast_assembly_id", "id"), "id", "left")
    out = out.join(nested(used.withColumnRenamed("name", "model"), "cast_assembly_id", "models", "model", "model_id").withColumnRenamed("cast_assembly_id", "id"), "id", "left")
    return out.withColumns({n: F.coalesce(n, F.array()) for n in ("parts", "models")})


def sources(c, text: str | None = None) -> DataFrame:
    """By title."""
    return source_rows(c, text).orderBy("title", "id")


def source_rows(c, text: str | None = None) -> DataFrame:
    df = with_counts(c.sources, counted(c.source_extracts, "source_id", "extract_count"), "source_id", "extract_count")
    parent = c.sources.select(F.col("id").alias("parent_source_id"), F.col("title").alias("parent_title"))
    df = df.join(parent, "parent_source_id", "left")
    return df if text is None else df.where(like_any(text, F.col("title"), F.col("source_code")))


def source_profiles(c) -> DataFrame:
    """Sources with the number and title of their parent, their extracts and their images."""
    texts = nested(c.source_extracts.select("source_id", F.col("id").alias("extract_id"), "author_handle", excerpt(F.col("content")).alias("excerpt")), "source_id", "extracts", "extract_id", "author_handle", "excerpt")
    images = nested(c.images.where("source_id is not null").select("source_id", F.col("id").alias("image_id"), "filename"), "source_id", "images", "image_id", "filename")
    return with_children(source_rows(c), texts, images)


def source_pages(c, size: int = 100) -> tuple[DataFrame, DataFrame]:
    """The extracts and the images of every source in pages of bounded length (operators/pages.py), for sources with more
    of them than a row of source_profiles should hold."""
    texts = c.source_extracts.select("source_id", F.col("id").alias("extract_id"), "author_handle", excerpt(F.col("content")).alias("excerpt"))
    images = c.images.select("source_id", F.col("id").alias("image_id"), "filename")
    return children_pages(texts, "source_id", "extracts", "extract_id", "author_handle", "excerpt", size=size), children_pages(images, "source_id", "images", "image_id", "filename", size=size)


def source_paths(c) -> DataFrame:
    """Depth and path from the root of every source, however deep. Sources below a missing one, or on a cycle, have no path
    from a root and are left out; chains(...) has them."""
    found = chains(c.sources, "id", "parent_source_id", "source_code").where("cycle is null and not dangling")
    return found.select("id", F.col("depth").cast("int").alias("depth"), "path")


def extracts(c, text: str | None = None, author: str | None = None) -> DataFrame:
    df = filtered(c.source_extracts, author_handle=author).join(c.sources.select(F.col("id").alias("source_id"), F.col("title").alias("source_title")), "source_id")
    df = df if text is None else df.where(like_any(text, F.col("content"), F.col("author_handle")))
    return df.orderBy("id")


def families(c) -> DataFrame:
    members = c.image_family_members
    out = members.groupBy("family_id").agg(F.count(F.lit(1)).alias("member_count"), F.sum("is_hidden").alias("hidden_count"))
    primary = first_per(members, ["family_id"], [F.desc("is_primary"), F.asc_nulls_first("sort_order"), F.asc("id")])
    return out.join(primary.select("family_id", F.col("image_id").alias("primary_image_id")), "family_id").orderBy(F.desc("family_id"))


def family_payloads(c) -> DataFrame:
    """Families with their members: the primary first, then by sort_order and id, each with its image and source."""
    images = c.images.select(F.col("id").alias("image_id"), "title", "filename", "source_id").join(c.sources.select(F.col("id").alias("source_id"), F.col("title").alias("source_title")), "source_id", "left")
    rows = c.image_family_members.withColumn("rank", -F.coalesce("is_primary", F.lit(0))).join(images, "image_id").withColumnRenamed("id", "member_id")
    members = nested(rows, "family_id", "members", "rank", "sort_order", "member_id", "image_id", "is_hidden", "title", "filename", "source_title")
    heads = families(c).withColumnRenamed("family_id", "id")
    return with_children(c.image_families.join(heads, "id", "left"), members)


def image_library(c, text: str | None = None, tag: str | None = None, family_id: int | None = None, collapse: bool = False) -> DataFrame:
    """Images with region and claim counts and their family; collapsed, hidden members that are not primary go."""
    df = c.images if text is None else c.images.where(like_any(text, F.col("title"), F.col("filename")))
    if tag is not None:
        df = df.join(c.image_tags.where(F.col("tag") == tag).select(F.col("image_id").alias("id")), "id", "left_semi")
    members = c.image_family_members.select(F.col("image_id").alias("id"), "family_id", "is_primary", "is_hidden")
    df = df.join(filtered(members, family_id=family_id), "id", "inner" if family_id is not None else "left")
    df = with_counts(df, counted(c.image_regions, "image_id", "region_count"), "image_id", "region_count")
    df = with_counts(df, image_claims(c).groupBy("image_id").agg(F.countDistinct("claim_id").alias("claim_count")), "image_id", "claim_count")
    return (df.where("family_id is null or is_primary = 1 or is_hidden = 0") if collapse else df).orderBy(F.desc("id"))


def image_claims(c) -> DataFrame:
    """(image_id, claim_id) by evidence of the image itself or one of its regions."""
    regions = c.image_regions.select(F.col("id").alias("evidence_id"), "image_id")
    by_region = c.claim_evidence.where("evidence_type = 'image_region'").join(regions, "evidence_id").select("image_id", "claim_id")
    return by_region.union(c.claim_evidence.where("evidence_type = 'image'").select("evidence_id", "claim_id"))


def region_claims(c) -> DataFrame:
    return c.claim_evidence.where("evidence_type = 'image_region'").groupBy(F.col("evidence_id").alias("region_id")).agg(F.countDistinct("claim_id").alias("claim_count"))


def regions(c, image_id: int | None = None, entity_type: str | None = None, entity_id: int | None = None) -> DataFrame:
    """Regions with the label of what they show and the number of claims that rest on them, by image and id."""
    df = filtered(c.image_regions, image_id=image_id, entity_type=entity_type, entity_id=entity_id)
    df = df.join(entity_labels(c).withColumnRenamed("label", "entity_label"), ["entity_type", "entity_id"], "left")
    known = F.when(F.col("entity_id").isNotNull() & F.col("entity_type").isNotNull(), F.coalesce("entity_label", F.col("entity_id").cast("string")))
    return with_counts(df.withColumn("entity_label", known), region_claims(c), "region_id", "claim_count").orderBy("image_id", "id")


def region_profiles(c) -> DataFrame:
    """Regions with their changes, newest first, and the claims that rest on them, newest first."""
    history = nested(c.image_region_history.withColumnRenamed("id", "history_id"), "region_id", "history", "changed_at", "history_id", "prev_label", newest=True)
    links = c.claim_evidence.where("evidence_type = 'image_region'").select("claim_id", F.col("evidence_id").alias("region_id")).distinct()
    claims = nested(links.join(claim_labels(c).withColumnRenamed("id", "claim_id"), "claim_id"), "region_id", "claims", "claim_id", "predicate", "text_value", "subject", "object", newest=True)
    return with_children(regions(c), history, claims)


def image_profiles(c) -> DataFrame:
    """Images with their links and what those name, tags, regions, source, the number of claims that rest on their regions,
    and the id, title and size of their family; its members stand once, in family_payloads."""
    links = nested(image_links(c), "image_id", "links", "entity_type", "entity_id", "label")
    tags = c.image_tags.groupBy("image_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    own = nested(regions(c).withColumnRenamed("id", "region_id"), "image_id", "regions", "region_id", "label", "entity_label", "claim_count")
    by_region = c.claim_evidence.where("evidence_type = 'image_region'").join(c.image_regions.select(F.col("id").alias("evidence_id"), "image_id"), "evidence_id")
    out = c.images.join(c.sources.select(F.col("id").alias("source_id"), F.col("title").alias("source_title")), "source_id", "left")
    out = with_counts(out, by_region.groupBy("image_id").agg(F.countDistinct("claim_id").alias("claim_count")), "image_id", "claim_count")
    whole = with_counts(c.image_families, counted(c.image_family_members, "family_id", "family_size"), "family_id", "family_size")
    whole = whole.select(F.col("id").alias("family_id"), F.col("title").alias("family_title"), "family_size")
    member = c.image_family_members.select(F.col("image_id").alias("id"), "family_id")
    return with_children(out.join(member, "id", "left").join(whole, "family_id", "left"), links, tags, own)


def contributors(c) -> DataFrame:
    return c.contributors.orderBy("handle", "id")


def entity_labels(c) -> DataFrame:
    """(entity_type, entity_id, label) of everything that links may name."""

    def side(kind: str, df: DataFrame, label: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id"), F.coalesce(F.nullif(label, F.lit("")), F.concat(F.lit(f"{kind} #"), F.col("id").cast("string"))).alias("label"))

    kit = c.kits.select(F.col("id").alias("kit_id"), "brand")
    named = c.models.select(F.col("id").alias("model_id"), F.col("name").alias("model"))
    out = side("kit", c.kits, joined(" ", F.col("brand"), F.col("name")))
    out = out.unionByName(side("part", c.parts.join(kit, "kit_id", "left"), joined(" ", F.col("brand"), F.col("part_number"), F.col("part_label"))))
    out = out.unionByName(side("cast_assembly", c.cast_assemblies, F.col("name")))
    pl = c.placements.join(named, "model_id", "left")
    out = out.unionByName(side("placement", pl, joined(" / ", F.col("model"), F.col("film_version"))))
    out = out.unionByName(side("model", c.models, F.col("name")))
    return out.unionByName(side("map", c.maps.join(named, "model_id", "left"), joined(" ", F.col("model"), F.col("name"))))


def image_links(c) -> DataFrame:
    """Links with the label of what they name; a dangling one shows type and id."""
    out = c.image_links.join(entity_labels(c), ["entity_type", "entity_id"], "left")
    return out.withColumn("label", F.coalesce("label", F.concat("entity_type", F.lit(" #"), F.col("entity_id").cast("string"))))


def claim_labels(c, status: str | None = None, subject_type: str | None = None, subject_id: int | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """Claims with the labels of their subject and object and the number of evidence links. evidence: only the claims that
    rest on one of its rows (evidence_type, evidence_id)."""
    df = filtered(c.claims, status=status, subject_type=subject_type, subject_id=subject_id)
    if evidence is not None:
        resting = c.claim_evidence.join(evidence.select("evidence_type", "evidence_id"), ["evidence_type", "evidence_id"], "left_semi")
        df = df.join(resting.select(F.col("claim_id").alias("id")), "id", "left_semi")
    for end in ("subject", "object"):
        labels = entity_labels(c).select(F.col("entity_type").alias(f"{end}_type"), F.col("entity_id").alias(f"{end}_id"), F.col("label").alias(end))
        df = df.join(labels, [f"{end}_type", f"{end}_id"], "left")
    return with_counts(df, counted(c.claim_evidence, "claim_id", "evidence_count"), "claim_id", "evidence_count")


def claims(c, **filters) -> DataFrame:
    """claim_labels, the newest first."""
    return claim_labels(c, **filters).orderBy(F.desc("id"))


def claim_profiles(c, **filters) -> DataFrame:
    """Claims as in claim_labels with their evidence: type, id and label of each link."""
    return with_children(claim_labels(c, **filters), nested(evidence_labels(c), "claim_id", "evidence", "evidence_type", "evidence_id", "label"))


def evidence_labels(c) -> DataFrame:
    """Each evidence link with the label of region, extract or image."""
    regions = c.image_regions.select(F.lit("image_region").alias("evidence_type"), F.col("id").alias("evidence_id"), F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("region")).alias("label"))
    texts = c.source_extracts.select(F.lit("source_extract").alias("evidence_type"), F.col("id").alias("evidence_id"), excerpt(F.col("content")).alias("label"))
    images = c.images.select(F.lit("image").alias("evidence_type"), F.col("id").alias("evidence_id"), first_filled(F.col("title"), F.col("filename")).alias("label"))
    return c.claim_evidence.join(regions.unionByName(texts).unionByName(images), ["evidence_type", "evidence_id"], "left")


def contested(c) -> DataFrame:
    """Subjects about which live claims give different values."""
    live = c.claims.where(F.col("status").isin("active", "contested"))
    return live.groupBy("subject_type", "subject_id", "predicate").agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("text_value").alias("n_values")).where("n_values > 1")


def edges(c) -> DataFrame:
    """The catalog as typed links; placements are gone through once for all that they name."""
    e = lambda df, a, x, b, y: df.where(f"{x} is not null and {y} is not null").select(F.lit(a).alias("src_type") if a else F.col("entity_type").alias("src_type"), F.col(x).alias("src_id"), F.lit(b).alias("dst_type"), F.col(y).alias("dst_id"))
    named = F.array(*[F.struct(F.lit(t).alias("dst_type"), F.col(f"{t}_id").alias("dst_id")) for t in ("model", "part", "kit")])
    out = c.placements.where("id is not null").select(F.lit("placement").alias("src_type"), F.col("id").alias("src_id"), F.inline(named)).where("dst_id is not null")
    out = out.union(e(c.parts, "part", "id", "kit", "kit_id")).union(e(c.image_links, None, "entity_id", "image", "image_id")).union(e(c.image_regions, "image_region", "id", "image", "image_id"))
    return out.union(c.claim_evidence.select(F.lit("claim"), "claim_id", "evidence_type", "evidence_id"))


def reachable(c, start: DataFrame, hops: int) -> DataFrame:
    """(type, id, hop): what start's (type, id) reach in up to hops steps along links in either direction. Links are worked
    out once, and each step starts from what the step before has left in reliable storage (checkpoint). Links are left as
    they are, repeated ones too: what a step meets is made distinct."""
    e = kept(edges(c), "links")
    both = e.select(F.col("src_type").alias("type"), F.col("src_id").alias("id"), F.col("dst_type").alias("t"), F.col("dst_id").alias("i")).union(e.select("dst_type", "dst_id", "src_type", "src_id"))
    seen = near = start.select("type", "id").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        new = near.join(both, ["type", "id"]).select(F.col("t").alias("type"), F.col("i").alias("id")).distinct()
        near = checkpointed(new.join(seen, ["type", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(near)
    return seen


#: Types that search offers, and those it takes where a query names none.
SEARCH_TYPES = ("kit", "part", "placement", "model", "map", "image", "source")


def entity_index(c, types: tuple[str, ...] = ("kit", "part", "model", "image", "source")) -> DataFrame:
    """What search looks through: type, id, title, subtitle, badges."""
    named = c.models.select(F.col("id").alias("model_id"), F.col("name").alias("model"))
    none = F.array().cast("array<string>")
    bits = lambda *b: F.array_compact(F.array(*[F.nullif(F.trim(x.cast("string")), F.lit("")) for x in b]))
    each = {
        "kit": lambda: c.kits.select(F.lit("kit").alias("type"), "id", joined(" ", F.col("brand"), F.col("name")).alias("title"), joined(" / ", F.col("scale"), F.col("availability")).alias("subtitle"), bits(F.col("scale"), F.col("availability")).alias("badges")),
        "part": lambda: part_rows(c).select(F.lit("part").alias("type"), "id", joined(" ", F.col("part_number"), F.col("part_label")).alias("title"), F.col("brand").alias("subtitle"), bits(F.col("part_number")).alias("badges")),
        "placement": lambda: placement_kit(c).join(named, "model_id").select(F.lit("placement").alias("type"), "id", joined(" / ", F.col("model"), F.col("film_version")).alias("title"), F.col("confidence").alias("subtitle"), bits(F.col("confidence"), F.col("film_version")).alias("badges")),
        "model": lambda: c.models.select(F.lit("model").alias("type"), "id", F.col("name").alias("title"), F.col("film").alias("subtitle"), bits(F.col("film")).alias("badges")),
        "map": lambda: c.maps.join(named, "model_id").select(F.lit("map").alias("type"), "id", F.col("name").alias("title"), F.col("model").alias("subtitle"), none.alias("badges")),
        "image": lambda: c.images.select(F.lit("image").alias("type"), "id", first_filled(F.col("title"), F.col("filename")).alias("title"), F.col("image_type").alias("subtitle"), bits(F.col("image_type")).alias("badges")),
        "source": lambda: c.sources.select(F.lit("source").alias("type"), "id", F.col("title"), F.col("source_code").alias("subtitle"), bits(F.col("source_type")).alias("badges")),
    }
    out = None
    for t in types:
        out = each[t]() if out is None else out.unionByName(each[t]())
    return out


#: Texts that are broadcast at a time; more go in blocks.
BLOCK_QUERIES = 1000


def search(c, queries: DataFrame, per_type: int = 5, limit: int = 20, types: tuple[str, ...] = ("kit", "part", "model", "image", "source")) -> DataFrame:
    """queries: query_id, text, and if there are such columns types (array; empty and unknown ones mean all) and limit (1 to
    100; else the given). Hits per query: the first of each type, then the first of all; texts under two characters find
    nothing. A hit's place is by type, title, id. A text that many queries ask for is compared once; where very many
    different texts are asked for, search.search_index gives the same through an index."""
    known = F.array(*map(F.lit, types))
    own = F.array_intersect(F.col("types"), known) if "types" in queries.columns else known
    most = F.least(F.greatest(F.coalesce(F.col("limit"), F.lit(limit)), F.lit(1)), F.lit(100)) if "limit" in queries.columns else F.lit(limit)
    asked = queries.where("length(trim(text)) >= 2").select("query_id", "text", F.when(F.size(F.coalesce(own, known)) > 0, own).otherwise(known).alias("_types"), most.alias("_limit"))
    asked = asked.withColumn("_types", F.coalesce("_types", known))
    asked = checkpointed(asked)
    texts = asked.select("text").distinct()
    blocks = max(1, -(-texts.count() // BLOCK_QUERIES))
    index, found = entity_index(c, types), None
    if blocks > 1:
        index = checkpointed(index)
    per_type, limit = min(max(per_type, 1), 100), min(max(limit, 1), 100)
    for b in range(blocks):
        mine = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        hits = index.join(F.broadcast(mine), like_any(F.col("text"), F.col("title"), F.col("subtitle")))
        found = hits if found is None else found.unionByName(hits)
    once = first_per(found, ["text", "type"], [F.asc("title"), F.asc("id")], per_type)
    hits = asked.join(once, "text").where(F.array_contains("_types", F.col("type")))
    top = first_per(hits, ["query_id", "type"], [F.asc("title"), F.asc("id")], per_type)
    return first_per(top, ["query_id"], [F.asc("type"), F.asc("title"), F.asc("id")], 100, rank="place").where("place <= _limit").select(*index.columns, "query_id", "place")
