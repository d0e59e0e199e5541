"""Loads of whole workbooks and slide decks into the catalog's tables. Each returns the new tables or the rows to add."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, image_code, maybe_float, note_map, note_union, reference_number, safe_int, tag_slug
from ..operators.counters import counters
from ..operators.matching import fallback_match
from ..operators.merge import absorbed_ids, absorbed_notes, absorbed_tags, insert_absent, refresh, upsert, with_ids
from ..sources.shared import checkpointed

# workbook


def kit_sheet(sheet: DataFrame, kits: DataFrame, references: DataFrame, system: str = "sheet") -> tuple[DataFrame, DataFrame]:
    """Rows of a kits sheet (brand, name, serial_number, scale, number, base, suffix) as new kits with ids and new
    references (kit_id, system, value). A kit is known by brand, name and serial number, null being equal to null."""
    identity = ["brand", "name", "serial_number"]
    rows = sheet.where("brand is not null and name is not null")
    fresh = with_ids(kits, insert_absent(kits, rows.select(*identity, "scale"), identity), identity)
    known = kits.select("id", *identity).unionByName(fresh.select("id", *identity)).groupBy(*identity).agg(F.min("id").alias("kit_id"))
    number, base, suffix = (safe_int(F.col(c)) for c in ("number", "base", "suffix"))
    value = F.when(suffix == 0, number.cast("string")).otherwise(reference_number(number, base, suffix))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in identity]
    named = rows.where(number.isNotNull()).withColumn("value", value).alias("r").join(known.alias("k"), same[0] & same[1] & same[2])
    return fresh, insert_absent(references, named.select("k.kit_id", F.lit(system).alias("system"), "r.value"), ["kit_id", "system", "value"])


def map_sheet(sheet: DataFrame, maps: DataFrame, model_id: int) -> DataFrame:
    """The maps with the rows of a sheet (name, url, version) for one model: known ones get what the sheet gives, new ones an
    id."""
    keys = ["model_id", "name"]
    rows = sheet.where("name is not null").select(F.lit(model_id).cast("long").alias("model_id"), "name", "url", "version")
    fresh = with_ids(maps, insert_absent(maps, rows.select(*keys), keys), keys)
    return upsert(maps.unionByName(fresh, allowMissingColumns=True), rows, keys)


def part_rows(sheet: DataFrame, references: DataFrame, parts: DataFrame, system: str = "sheet") -> DataFrame:
    """Sheet rows (number, part_number, ...) with kit_id, part_id and status: matched, no_kit or no_part. Rows without a
    number or part are left out."""
    number = safe_int(F.col("number"))
    rows = sheet.withColumn("_n", number.cast("string")).where("_n is not null and part_number is not null")
    by_number = references.where(F.col("system") == system).groupBy(F.col("value").alias("_n")).agg(F.min("kit_id").alias("kit_id"))
    own = parts.groupBy("kit_id", "part_number").agg(F.min("id").alias("part_id"))
    out = rows.join(by_number, "_n", "left").join(own, ["kit_id", "part_number"], "left").drop("_n")
    return out.withColumn("status", F.when(F.col("kit_id").isNull(), "no_kit").when(F.col("part_id").isNull(), "no_part").otherwise("matched"))


def file_sheet(sheet: DataFrame, references: DataFrame, parts: DataFrame, files: DataFrame, providers: list[str], system: str = "sheet") -> tuple[DataFrame, DataFrame]:
    """Rows of a sheet of printable parts (number, part_number, notes and a column for each provider) as new files of parts,
    one for each provider named, and counters of matched rows and misses."""
    found = part_rows(sheet, references, parts, system)
    each = found.where("status = 'matched'").select("part_id", "notes", F.explode(F.array_compact(F.array(*[clean(F.col(p)) for p in providers]))).alias("source"))
    each = each.select("part_id", F.lit("scan").alias("file_type"), F.lit(None).cast("string").alias("url"), "source", "notes")
    keys = ["part_id", "file_type", "source"]
    return with_ids(files, insert_absent(files, each, keys), keys), counters(found, {"status": F.col("status")})


# decks

# Tags, note keys and codes that users of an earlier load know are written below as they are.


def note(key: str, value: Column) -> Column:
    """A key=value line; null without a value."""
    return F.concat(F.lit(f"{key}="), clean(value.cast("string")))


def note_lines(*lines: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def choose_title(scene: Column, subject: Column, file: Column) -> Column:
    return F.coalesce(clean(scene), clean(subject), file)


def by_content(rows: DataFrame) -> DataFrame:
    """Rows (sha256, file, title, caption, notes, source_id, tags) of one content as one: the first file's title, caption and
    source, the notes of all, the tags of all."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("file"))).alias(c)
    notes = F.transform(F.array_sort(F.collect_list(F.struct("file", "notes"))), lambda x: x["notes"])
    out = rows.groupBy("sha256").agg(first("title"), first("caption"), first("source_id"), F.array_join(notes, "\n").alias("notes"), F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags"))
    return out.withColumns({"notes": note_union(F.col("notes")), "image_code": image_code("PPTXIMG-", F.col("sha256"), 8)})


def merge_images(images: DataFrame, tags: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """images with the rows of by_content: the first image of a content is filled in, contents that none has get an id; tags
    are united."""
    first = images.groupBy("sha256").agg(F.min("id").alias("id"))
    known = rows.join(first, "sha256")
    fresh = with_ids(images, rows.join(first, "sha256", "left_anti"), ["sha256"])
    fields = ["sha256", "title", "caption", "image_code", "notes", "source_id"]
    merged = upsert(images, known.select("id", *fields), ["id"], mode="fill").drop("merge_status")
    merged = merged.unionByName(fresh.select("id", *fields), allowMissingColumns=True)
    named = known.select("id", "tags").union(fresh.select("id", "tags")).select(F.col("id").alias("image_id"), F.explode("tags").alias("tag"))
    return merged, tags.select("image_id", "tag").union(named.select("image_id", tag_slug(F.col("tag")).alias("tag"))).where("tag <> ''").distinct()


def tag_array(*values: Column) -> Column:
    return F.array_compact(F.array(*[clean(v) for v in values]))


def at_path(images: DataFrame) -> DataFrame:
    """(id, path) of images whose note says where the file came from."""
    return images.select("id", note_map(F.col("notes"))["original_media_path"].alias("path")).where("path is not null")


class Deck:
    """What deck_load gives: the new tables images, tags and regions, and counts: overlay rows by what became of them, added,
    repeated or unmapped. A table is worked out when it is first asked for; what several need is worked out once."""

    def __init__(self, images: DataFrame, tags: DataFrame, regions: DataFrame, links: DataFrame, timeline: DataFrame, manifest: DataFrame, media: DataFrame, crosswalk: DataFrame, overlays: DataFrame, sources: tuple[int, int], import_source: str):
        self._held, self._links, self._media, self._crosswalk = (images, tags, regions), links, media, crosswalk
        self._timeline, self._manifest, self._overlays, self._sources, self._import_source = timeline, manifest, overlays, sources, import_source

    @cached_property
    def _first(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Images and tags with the timeline's files, and the image of each file."""
        m = self._timeline.join(self._manifest, "file", "left").where("not lower(coalesce(notes, '')) like '%malformed%'")
        keys = ("nearest_slide_anchor", "likely_program", "likely_model_or_scene", "likely_date_window", "confidence")
        rows = m.select(
            "sha256", "file", choose_title(F.col("likely_model_or_scene"), F.col("visible_subject"), F.col("file")).alias("title"), clean(F.col("visible_subject")).alias("caption"),
            note_lines(*[note(k, F.col(k)) for k in keys], clean(F.col("notes"))).alias("notes"), F.lit(self._sources[0]).cast("long").alias("source_id"),
            tag_array(F.lit("pptx-extract"), F.lit("timeline-deck"), F.col("likely_program"), F.col("likely_model_or_scene"), F.col("confidence")).alias("tags"),
        )
        images, tags = merge_images(*self._held[:2], checkpointed(by_content(rows)))
        images = checkpointed(images)
        first = images.groupBy("sha256").agg(F.min("id").alias("image_id"))
        return images, tags, checkpointed(m.select("file", "sha256").distinct().join(first, "sha256").select("file", "image_id"))

    @cached_property
    def _kit(self) -> DataFrame:
        """The kit deck's media, with the image that the timeline has of them."""
        by_file = self._first[2].select(F.col("file").alias("timeline_media"), F.col("image_id").alias("linked"))
        k = self._media.join(self._crosswalk.where("kit_media is not null"), "kit_media").join(by_file, "timeline_media", "left")
        noted = note_lines(F.concat(F.lit("crosswalk_timeline_media="), F.coalesce(clean(F.col("timeline_media")), F.lit("none"))), note("base_slide_count", F.col("base_slide_count")), note("label_total", F.col("label_total")), clean(F.col("timeline_subject")), clean(F.col("timeline_scene")), F.when(F.col("linked").isNotNull(), note("original_media_path", F.col("path"))))
        return checkpointed(k.select(
            "kit_media", "path", "linked", "sha256", F.col("kit_media").alias("file"), choose_title(F.col("timeline_scene"), F.col("timeline_subject"), F.col("kit_media")).alias("title"), clean(F.col("timeline_subject")).alias("caption"),
            noted.alias("notes"), F.lit(self._sources[1]).cast("long").alias("source_id"), tag_array(F.lit("pptx-extract"), F.lit("kit-deck"), F.col("timeline_scene"), F.col("timeline_subject")).alias("tags"),
        ))

    @cached_property
    def _both(self) -> tuple[DataFrame, DataFrame]:
        """Images and tags with the files of both decks."""
        images, tags, _ = self._first
        linked = by_content(self._kit.where("linked is not null").withColumn("sha256", F.col("linked").cast("string"))).withColumn("id", F.col("sha256").cast("long"))
        linked = checkpointed(linked)
        tags = tags.union(linked.select(F.col("id").alias("image_id"), F.explode("tags").alias("tag")).select("image_id", tag_slug(F.col("tag")))).distinct()
        images = upsert(images, linked.select("id", "title", "caption", "notes", F.lit(self._sources[0]).cast("long").alias("source_id")), ["id"], mode="fill").drop("merge_status")
        images, tags = merge_images(checkpointed(images), tags, checkpointed(by_content(self._kit.where("linked is null"))))
        return checkpointed(images), tags

    @cached_property
    def _doubles(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Earlier images and the timeline's images of linked media, by path, and the ids of the former that go."""
        earlier = checkpointed(at_path(self._first[0]))
        survivors = checkpointed(self._kit.where("linked is not null and path is not null").select("path", F.col("linked").alias("id")).distinct())
        used = self._held[2].select(F.col("image_id").alias("id")).union(self._links.select("image_id")).union(self._first[2].select("image_id"))
        return earlier, survivors, checkpointed(absorbed_ids(earlier, survivors, "path", used))

    @cached_property
    def images(self) -> DataFrame:
        earlier, survivors, gone = self._doubles
        return checkpointed(absorbed_notes(self._both[0], earlier, survivors, "path").join(gone, "id", "left_anti"))

    @cached_property
    def tags(self) -> DataFrame:
        earlier, survivors, gone = self._doubles
        tags = absorbed_tags(checkpointed(self._both[1]), earlier, survivors, "path")
        return checkpointed(tags.join(gone.withColumnRenamed("id", "image_id"), "image_id", "left_anti"))

    @cached_property
    def _placed(self) -> tuple[DataFrame, Column]:
        """The overlays with the image and the place that each lies on, and whether it has both."""
        left = self._both[0].select("id", "sha256").join(self._doubles[2], "id", "left_anti")
        by_media = self._kit.join(left.groupBy("sha256").agg(F.min("id").alias("own")), "sha256", "left").select("kit_media", F.coalesce("linked", "own").alias("image_id")).distinct()
        files = self._first[2].select(F.concat(F.lit("t:"), "file").alias("medium"), "image_id").union(by_media.select(F.concat(F.lit("k:"), "kit_media"), "image_id")).where("image_id is not null")
        some = lambda *c: F.coalesce(*[clean(F.col(x)) for x in c])
        o = self._overlays.withColumns({"_t": F.concat(F.lit("t:"), some("assigned_timeline_media", "base_timeline_media")), "_k": F.concat(F.lit("k:"), some("assigned_media", "base_media"))})
        o = fallback_match(o, ["_t", "_k"], checkpointed(files), "medium", "image_id").withColumnRenamed("matched", "image_id")
        place = lambda projected, own: F.coalesce(F.when(F.col("matched_by") == "_t", maybe_float(F.col(projected))), maybe_float(F.col(own)))
        o = o.withColumns({"x_norm": place("projected_x", "x_norm_in_assigned"), "y_norm": place("projected_y", "y_norm_in_assigned"), "label": clean(F.col("label_text"))})
        return o, F.col("image_id").isNotNull() & F.col("x_norm").isNotNull() & F.col("y_norm").isNotNull()

    @cached_property
    def _refreshed(self) -> DataFrame:
        """The regions with the points of the overlays, which have no id yet."""
        o, mapped = self._placed
        carried = [c for c in ("slide", "slide_key", "slide_title", "label_status", "mapping_quality", "assigned_media", "base_media", "base_subject", "base_scene") if c in o.columns]
        points = o.where(mapped).select(
            "image_id", F.lit("point").alias("region_type"), "x_norm", "y_norm", "label", F.round("x_norm", 6).alias("_x"), F.round("y_norm", 6).alias("_y"), F.coalesce("label_status", F.lit("")).alias("_status"),
            note_lines(*[note(c, F.col(c)) for c in ("slide", "slide_key", "label_status", "mapping_quality") if c in o.columns]).alias("notes"),
            F.to_json(F.struct(F.lit(self._import_source).alias("import_source"), *[F.col(c).cast("string").alias(c) for c in carried])).alias("properties_json"),
        )
        held = self._held[2].withColumns({"_x": F.round("x_norm", 6), "_y": F.round("y_norm", 6), "_status": F.coalesce(F.get_json_object("properties_json", "$.label_status"), F.lit(""))})
        signature = ["image_id", "label", "_status", "_x", "_y"]
        return checkpointed(refresh(held, points, F.get_json_object("properties_json", "$.import_source") == self._import_source, signature).drop("_x", "_y", "_status"))

    @cached_property
    def regions(self) -> DataFrame:
        after = self._refreshed
        fresh = with_ids(self._held[2], after.where("id is null"), ["image_id", "label", "x_norm", "y_norm"])
        return after.where("id is not null").unionByName(fresh.select(*after.columns))

    @cached_property
    def counts(self) -> DataFrame:
        o, mapped = self._placed
        added = self._refreshed.agg(F.count_if(F.col("id").isNull()).alias("n"))
        seen = o.agg(F.count_if(mapped).alias("m"), F.count_if(~F.coalesce(mapped, F.lit(False))).alias("u"))
        return added.join(seen).select(F.explode(F.array(F.struct(F.lit("added").alias("key"), F.col("n").alias("count")), F.struct(F.lit("repeated").alias("key"), (F.col("m") - F.col("n")).alias("count")), F.struct(F.lit("unmapped").alias("key"), F.col("u").alias("count")))).alias("c")).select("c.*")


def deck_load(images: DataFrame, tags: DataFrame, regions: DataFrame, links: DataFrame, timeline: DataFrame, manifest: DataFrame, media: DataFrame, crosswalk: DataFrame, overlays: DataFrame, sources: tuple[int, int], import_source: str) -> Deck:
    """Two decks into the catalog.

    timeline (file, sha256) with manifest (file, nearest_slide_anchor, likely_program, likely_model_or_scene,
    visible_subject, likely_date_window, confidence, notes): each content an image, malformed files left out. media
    (kit_media, sha256, path) with crosswalk (kit_media, timeline_media, timeline_subject, timeline_scene, base_slide_count,
    label_total): what is known from the timeline enriches that image and takes up earlier images of the same path, but for those that a timeline file has;
    the rest are images of their own. overlays (label_text, label_status, the media that a label lies on, places): points on the
    timeline's image where there is one, else on the kit deck's; points of an earlier load (import_source in their
    properties) are replaced, and what another point repeats is left out. Each step starts from the tables that the step
    before has left in reliable storage. Earlier images and those that take them up meet by path, never pair by pair.
    """
    return Deck(images, tags, regions, links, timeline, manifest, media, crosswalk, overlays, sources, import_source)
