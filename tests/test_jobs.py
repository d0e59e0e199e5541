from pyspark.sql import functions as F

from evidarium.operators import rules
from evidarium.plans import jobs, loads


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_workbook_and_donors(spark):
    parts = spark.createDataFrame([(1, 1, "10")], "id long, kit_id long, part_number string")
    placements = spark.createDataFrame([(1, 5, 1)], "id long, model_id long, part_id long")
    sheet = spark.createDataFrame([(1, "10", 5, 2, "x"), (1, "A3", 5, 1, "?"), (None, "B", 5, 1, "x"), (1, "A3", 5, 1, "?")], "kit_id long, part_number string, model_id long, copy_count int, mark string")
    new_parts, new_placements = jobs.workbook_parts(sheet, parts, placements)
    assert rows(new_parts, "id", "kit_id", "part_number") == [(2, 1, "A3")]
    assert rows(new_placements, "id", "part_id", "confidence") == [(2, 2, "probable")]
    marks = spark.createDataFrame([("Acme", "k", "M1", "X"), ("Acme", "none", "M1", "x"), ("Acme", "k", "M9", "see")], "brand string, name string, model string, mark string")
    kits = spark.createDataFrame([(4, "Acme", "k")], "id long, brand string, name string")
    models = spark.createDataFrame([(9, "m1")], "id long, name string")
    assert rows(jobs.donors(marks, kits, models), "kit_id", "model_id", "confidence", "status") == sorted([(4, 9, "confirmed", "matched"), (None, 9, "confirmed", "no_kit"), (4, None, "probable", "no_model")], key=repr)


def test_claims_are_seeded_once(spark):
    claims = spark.createDataFrame([], "id long, subject_type string, subject_id long, predicate string, text_value string")
    evidence = spark.createDataFrame([], "claim_id long, evidence_type string, evidence_id long")
    wanted = spark.createDataFrame([("kit", 1, "is", None, "image", 7), ("kit", 1, "is", None, "image", 8)], "subject_type string, subject_id long, predicate string, text_value string, evidence_type string, evidence_id long")
    new_claims, links = jobs.seed_claims(claims, evidence, wanted)
    assert rows(new_claims, "id") == [(1,)] and rows(links, "claim_id", "evidence_id") == [(1, 7), (1, 8)]
    again = jobs.seed_claims(new_claims.select(*claims.columns), links, wanted)
    assert again[0].count() == 0 and again[1].count() == 0


def test_links_history_and_disposition(spark):
    regions = spark.createDataFrame([(1, "Gun", None, None), (2, "Hull", None, None), (3, "gone", None, None), (4, "Gun", "kit", 9)], "id long, label string, entity_type string, entity_id long")
    kits = spark.createDataFrame([(5, "gun!"), (6, "Hull"), (7, "hull")], "id long, name string")
    after, history, report = jobs.link_regions(regions, kits)
    assert rows(after, "id", "entity_id") == [(1, 5), (2, None), (3, None), (4, 9)] and rows(history, "id", "change") == [(1, "update")]
    assert rows(jobs.disposition(report).select("id", F.col("fields")["review_status"].alias("s")), "id", "s") == [(1, "accept"), (2, "needs_review"), (3, "hide")]


def test_dates_titles_threads(spark):
    d = spark.createDataFrame([("1976",), ("1976-02",), ("1976-02-03",), ("spring",), (None,)], "d string")
    got = [(r["d"], str(r["date_start"]), str(r["date_end"])) for r in jobs.chronology(d, "d").collect()]
    assert got[:3] == [("1976", "1976-01-01", "1976-12-31"), ("1976-02-03", "1976-02-03", "1976-02-03"), ("1976-02", "1976-02-01", "1976-02-29")] or sorted(got[:3]) == sorted([("1976", "1976-01-01", "1976-12-31"), ("1976-02-03", "1976-02-03", "1976-02-03"), ("1976-02", "1976-02-01", "1976-02-29")])
    t = spark.createDataFrame([("Hull - port side",), ("a" * 30 + " " + "b" * 30,)], "t string")
    assert [r[0] for r in t.select(jobs.short_title(F.col("t"))).collect()] == ["Hull", "a" * 30]
    threads = spark.createDataFrame([("1", "X-Wing build", 0), ("2", "kit scans", 1), ("3", "red five cockpit", 2), ("4", "crossbow", 3)], "thread_id string, title string, position int")
    picked = jobs.select_threads(threads, ["x wing"], ["kit scan", "kit scans"], ["red five"], F.col("title").contains("cockpit"))
    assert [(r["thread_id"], r["score"]) for r in picked.collect()] == [("3", 4), ("1", 3), ("2", 2)]


def test_file_rules(spark):
    files = spark.createDataFrame([("Dave Jones/a.jpg",), ("x/Forum pics/map.png",), ("misc/b.jpg",)], "rel_path string")
    out = rules.infer_source(files, {"davejones": "Dave Jones"}, [(("forum",), rules.Source("forum", "F", "F", "high"))])
    out = out.withColumns({"kind": rules.content_kind(F.col("source_platform"), F.col("rel_path")), "subject": rules.infer_subject(F.col("rel_path"), [("pics", "Pictures")], F.lit("Other"))})
    assert [tuple(r) for r in out.select("source_platform", "source_creator", "kind", "subject").collect()] == [("personal_archive", "Dave Jones", "reference_image", "Other"), ("forum", "F", "map_or_markup", "Pictures"), ("unknown", "", "reference_image", "Other")]


def test_retitling_takes_the_first_there_is(spark):
    images = [
        (1, None, None, "likely_model_or_scene=Scene A\nslide_key=k", "C1"), (2, "n/a", None, "likely_model_or_scene=unknown", "C2"), (3, " Open ", "own", None, None), (4, "image7.png", None, None, "C4"),
        (5, "", None, "slide_key=side_hull-2", "C5"), (6, "N/A", None, None, "C6"), (7, "Fine", None, "likely_model_or_scene=x", "C7"), (8, "open", None, None, "C8"), (9, None, None, None, None),
    ]
    images = spark.createDataFrame(images, "id long, title string, caption string, notes string, image_code string")
    regions = [(1, 2, "b", '{"base_scene":"open","base_subject":"Hull"}'), (2, 2, "a", '{"base_scene":"Later"}'), (3, 3, "b", "{}"), (4, 3, "a", None), (5, 3, "b", None), (6, 3, "c", None), (7, 3, "d", None), (8, 4, " ", '{"slide_key":"wing_3"}')]
    regions = spark.createDataFrame(regions, "id long, image_id long, label string, properties_json string")
    want = [
        (1, "Scene A", None), (2, "Hull", None), (3, "Overlay reference: b / a / c", "own"), (4, "wing 3 overlay reference", None), (5, "side hull 2 reference image", None), (6, "Malformed PPTX extract C6", "file is malformed or not yet decodable"),
        (8, "Unreviewed PPTX extract C8", "not yet visually reviewed"), (9, "PPTX extract 9", None),
    ]
    assert rows(jobs.retitle(images, regions), "id", "new_title", "caption") == want


def test_staging_and_reclassification(spark):
    manifest = [("B.png", "s", "forum", "f", "high", "photo"), ("a.png", "s", "forum", "f", "medium", "photo"), ("c.png", "s", "", "", "high", "photo"), ("d.png", "s", "unknown", "x", "high", "photo"), ("e.png", "s", "forum", "", "low", "photo"), ("f.png", "s", "forum", "f", "high", "render_or_cg"), ("g.png", "s", "forum", "f", "high", "historical_reference")]
    safe, review, counts = jobs.staged(spark.createDataFrame(manifest, "filename string, subject string, source_platform string, source_collection string, source_confidence string, content_kind string"))
    assert [r["filename"] for r in safe.collect()] == ["a.png", "B.png"]
    assert [(r["filename"], r["bucket_reason"]) for r in review.collect()] == [("g.png", "historical_compilation"), ("e.png", "low_source_confidence"), ("f.png", "render_or_cg"), ("c.png", "unknown_source_platform"), ("d.png", "unknown_source_platform")]
    assert ("review_sources", "unknown", 1) in rows(counts, "section", "key", "count") and ("safe_sources", "forum:f", 2) in rows(counts, "section", "key", "count")
    kits = spark.createDataFrame([(1, "B", "Tank", None), (2, "A", "Jet", "1/72"), (3, "A", "Thing", None)], "id long, brand string, name string, scale string")
    out, audit, count = jobs.reclassified(kits, [rules.Rule(("tank",), ("armor", "tank"))], {"1/72": ("aircraft", "jet")})
    assert [(r["id"], r["category_family"], r["scale"]) for r in audit.collect()] == [(2, "aircraft", "1/72"), (3, "other", ""), (1, "armor", "")]
    assert out.count() == 3 and [r["count"] for r in count.collect()] == [1, 1, 1]


def test_workbook_kits_maps_and_files(spark):
    kits = spark.createDataFrame([(7, "Acme", "Jet", None)], "id long, brand string, name string, serial_number string")
    references = spark.createDataFrame([(7, "sheet", "10")], "kit_id long, system string, value string")
    sheet = [("Acme", "Jet", None, "1/72", "10.0", None, "0"), ("Acme", "Jet", "S1", None, "12", "11", None), ("Acme", "Jet", "S1", None, "13", "11", "2"), (None, "Lost", None, None, "1", None, None), ("Bolt", "Car", None, None, None, None, None)]
    sheet = spark.createDataFrame(sheet, "brand string, name string, serial_number string, scale string, number string, base string, suffix string")
    fresh, named = loads.kit_sheet(sheet, kits, references)
    got = {(r["brand"], r["name"], r["serial_number"]): r["id"] for r in fresh.collect()}
    assert set(got) == {("Acme", "Jet", "S1"), ("Bolt", "Car", None)} and set(got.values()) == {8, 9}
    assert rows(named, "kit_id", "value") == sorted([(got["Acme", "Jet", "S1"], "11#"), (got["Acme", "Jet", "S1"], "112")])
    maps = spark.createDataFrame([(1, 5, "Plan", "u1", None)], "id long, model_id long, name string, url string, version string")
    rows_ = spark.createDataFrame([("Plan", None, "v2"), ("New", "u2", None), (None, "u", "v")], "name string, url string, version string")
    assert rows(loads.map_sheet(rows_, maps, 5), "id", "name", "url", "version") == [(1, "Plan", "u1", "v2"), (2, "New", "u2", None)]
    parts = spark.createDataFrame([(3, 7, "A1")], "id long, kit_id long, part_number string")
    files = spark.createDataFrame([(1, 3, "scan", None, "P1", None)], "id long, part_id long, file_type string, url string, source string, notes string")
    printed = spark.createDataFrame([("10", "A1", "P1", "P2", "n"), ("10", "A9", "P1", None, None), ("99", "A1", "P1", None, None), (None, "A1", "P1", None, None)], "number string, part_number string, one string, two string, notes string")
    new, counts = loads.file_sheet(printed, references, parts, files, ["one", "two"])
    assert rows(new, "id", "part_id", "source", "notes") == [(2, 3, "P2", "n")]
    assert rows(counts, "key", "count") == [("matched", 1), ("no_kit", 1), ("no_part", 1)]


def test_deck_load(spark):
    frame = spark.createDataFrame
    images = frame([(1, "aaaa", "Held", None, "I1", "x=1", None), (2, "old1", None, None, "I2", "original_media_path=k/m1.png\ny=2", None), (3, "old2", None, None, "I3", "original_media_path=k/m1.png", None)], "id long, sha256 string, title string, caption string, image_code string, notes string, source_id long")
    tags = frame([(2, "old-tag"), (3, "other")], "image_id long, tag string")
    regions = frame([(1, 3, "point", 0.5, 0.5, "Own", None, None), (2, 1, "point", 0.1, 0.1, "Gone", None, '{"import_source":"deck","label_status":"s"}'), (3, 1, "point", 0.25, 0.5, "Gun", None, '{"label_status":"here"}')], "id long, image_id long, region_type string, x_norm double, y_norm double, label string, notes string, properties_json string")
    links = frame([], "image_id long")
    timeline = frame([("t1.png", "aaaa"), ("t2.png", "bbbb"), ("t3.png", "cccc"), ("t4.png", "bbbb")], "file string, sha256 string")
    manifest = [("t1.png", "s1", "Prog", "Scene 1", "Subject 1", "1976", "high", None), ("t2.png", "s2", "Prog", None, "Subject 2", None, "low", "note"), ("t3.png", None, None, None, None, None, None, "Malformed file")]
    manifest = frame(manifest, "file string, nearest_slide_anchor string, likely_program string, likely_model_or_scene string, visible_subject string, likely_date_window string, confidence string, notes string")
    media = frame([("m1.png", "mmm1", "k/m1.png"), ("m2.png", "mmm2", "k/m2.png")], "kit_media string, sha256 string, path string")
    crosswalk = frame([("m1.png", "t1.png", "Sub", "Sc", "2", "5"), ("m2.png", None, None, None, "0", "1"), ("m9.png", None, None, None, "0", "0")], "kit_media string, timeline_media string, timeline_subject string, timeline_scene string, base_slide_count string, label_total string")
    overlays = [("Gun", "here", "t1.png", None, "m1.png", None, "0.25", "0.5", "0.9", "0.9"), ("Hull", "here", "t1.png", None, "m1.png", None, "0.75", "0.5", "0.9", "0.9"), ("Hull", "here", "t1.png", None, "m1.png", None, "0.75", "0.5", "0.1", "0.1"), ("Fin", "else", None, None, None, "m2.png", "0.3", "0.3", "0.125", "n/a"), ("Fin", "else", None, None, None, "m2.png", "0.3", "0.3", "0.125", "0.5"), ("Lost", "else", None, None, "m7.png", None, "0.3", "0.3", "0.3", "0.3")]
    overlays = frame(overlays, "label_text string, label_status string, assigned_timeline_media string, base_timeline_media string, assigned_media string, base_media string, projected_x string, projected_y string, x_norm_in_assigned string, y_norm_in_assigned string")
    deck = loads.deck_load(images, tags, regions, links, timeline, manifest, media, crosswalk, overlays, (100, 101), "deck")
    got = {r["sha256"]: r for r in deck.images.collect()}
    assert set(got) == {"aaaa", "bbbb", "mmm2", "old2"}  # the image with a region of its own stays, the other goes into the first
    assert got["aaaa"]["title"] == "Held" and got["aaaa"]["caption"] == "Subject 1" and got["aaaa"]["source_id"] == 100
    lines = got["aaaa"]["notes"].split("\n")
    assert lines[0] == "x=1" and "likely_model_or_scene=Scene 1" in lines and "original_media_path=k/m1.png" in lines and "y=2" in lines
    assert got["bbbb"]["title"] == "Subject 2" and got["bbbb"]["image_code"] == "PPTXIMG-BBBB" and got["mmm2"]["title"] == "m2.png" and got["mmm2"]["source_id"] == 101
    assert "crosswalk_timeline_media=none" in got["mmm2"]["notes"]
    of = lambda sha: {r["tag"] for r in deck.tags.collect() if r["image_id"] == got[sha]["id"]}
    assert of("aaaa") == {"pptx-extract", "timeline-deck", "kit-deck", "prog", "scene-1", "high", "sub", "sc", "old-tag", "other"} and of("mmm2") == {"pptx-extract", "kit-deck"}
    points = rows(deck.regions, "image_id", "label", "x_norm", "y_norm")
    assert points == sorted([(3, "Own", 0.5, 0.5), (1, "Gun", 0.25, 0.5), (1, "Hull", 0.75, 0.5), (got["mmm2"]["id"], "Fin", 0.125, 0.5)], key=repr)
    assert len({r["id"] for r in deck.regions.collect()}) == 4
    assert dict(rows(deck.counts, "key", "count")) == {"added": 2, "repeated": 2, "unmapped": 2}
    again = loads.deck_load(deck.images, deck.tags, deck.regions, links, timeline, manifest, media, crosswalk, overlays, (100, 101), "deck")
    assert rows(again.images, *deck.images.columns) == rows(deck.images, *deck.images.columns) and rows(again.regions, "image_id", "label", "x_norm") == rows(deck.regions, "image_id", "label", "x_norm")


def test_a_deck_table_is_worked_out_when_asked_for(spark):
    frame = spark.createDataFrame
    images = frame([(1, "aaaa", None, None, "I1", "original_media_path=k/m", None), (2, "bbbb", None, None, "I2", "original_media_path=k/m", None)], "id long, sha256 string, title string, caption string, image_code string, notes string, source_id long")
    regions = frame([], "id long, image_id long, region_type string, x_norm double, y_norm double, label string, notes string, properties_json string")
    timeline = frame([("t1", "aaaa")], "file string, sha256 string")
    manifest = frame([], "file string, nearest_slide_anchor string, likely_program string, likely_model_or_scene string, visible_subject string, likely_date_window string, confidence string, notes string")
    crosswalk = frame([("m", "t1", None, None, None, None)], "kit_media string, timeline_media string, timeline_subject string, timeline_scene string, base_slide_count string, label_total string")
    fields = "label_text string, label_status string, assigned_timeline_media string, base_timeline_media string, assigned_media string, base_media string, projected_x string, projected_y string, x_norm_in_assigned string, y_norm_in_assigned string"
    broken = frame([("a",) * 10], fields).withColumn("label_text", F.raise_error(F.lit("overlays were read")))
    deck = loads.deck_load(images, frame([(2, "tag")], "image_id long, tag string"), regions, frame([], "image_id long"), timeline, manifest, frame([("m", "mmmm", "k/m")], "kit_media string, sha256 string, path string"), crosswalk, broken, (100, 101), "deck")
    assert rows(deck.tags.where("tag = 'tag'"), "image_id") == [(1,)]


def test_state_timeline(spark):
    states = spark.createDataFrame([(1, "a", "1976"), (1, "a", "1976-03"), (1, "b", "1976-05-02"), (1, "a", "1977"), (1, "x", "spring"), (2, "c", "1975")], "id long, state string, d string")
    assert [(r[0], r[1], str(r[2]), str(r[3])) for r in jobs.timeline(states, ["id"], "state", "d").orderBy("id", "date_start").collect()] == [(1, "a", "1976-01-01", "1976-05-01"), (1, "b", "1976-05-02", "1976-12-31"), (1, "a", "1977-01-01", "None"), (2, "c", "1975-01-01", "None")]
