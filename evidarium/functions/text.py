"""Scalar expressions: cleaning, keys, titles, notes, URLs. All of them are built from SQL functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, endings and titles that catalogs of this kind use.
TRUE_WORDS, FALSE_WORDS = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")
PLACEHOLDERS = ("none", "nan", "—", "-")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".gif", ".webp", ".bmp")
EMPTY_TITLES = ("n/a", "open")
EMPTY_ANSWERS = ("none", "n/a", "open", "unknown")
# Names of files that say nothing of what they show.
HASH_NAME = r"(?i)^[0-9a-f]{20,}(-[0-9a-z]+)?$"
SOCIAL_NAME = r"(?i)(^|_)[0-9]{6,}_[0-9]{6,}_[0-9]{6,}_[no](\.[a-z0-9]+)?$"
SOCIAL_PART = r"(?i)_[0-9]{8,}_[0-9]{8,}_[0-9]{8,}_[no]\b"
NUMBERED_NAME = r"^image[0-9]+\.(jpg|jpeg|png|gif|webp)$"


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x.cast("string")), F.lit(""))


def to_int(x: Column) -> Column:
    """Whole numbers only: "3.7" is null."""
    return F.when(F.trim(x.cast("string")).rlike(r"^[+-]?[0-9]+$"), F.trim(x.cast("string")).try_cast("int"))


def to_float(x: Column) -> Column:
    return blank_to_null(x).try_cast("double")


def safe_int(x: Column) -> Column:
    """Cut off to a whole number: "3.7" is 3; what is no number, or too large, is null."""
    return to_float(x).try_cast("int")


def maybe_float(x: Column) -> Column:
    return F.when(F.lower(F.trim(x)) != "n/a", to_float(x))


def flag(x: Column, default: int | None = None) -> Column:
    v = F.lower(F.trim(x.cast("string")))
    return F.when(v.isin(*TRUE_WORDS), 1).when(v.isin(*FALSE_WORDS), 0).otherwise(F.lit(default).cast("int"))


def loose_flag(x: Column) -> Column:
    return F.when(F.lower(x.cast("string")).isin("0", "false", "no"), 0).otherwise(1)


def clean(x: Column) -> Column:
    """Trimmed; placeholders and blanks are null."""
    return F.when(~F.lower(F.trim(x)).isin(*PLACEHOLDERS), blank_to_null(x))


def tag_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda v: F.trim(v)), lambda t: t != "")


def tag_slug(x: Column) -> Column:
    return F.replace(F.lower(F.trim(x)), F.lit(" "), F.lit("-"))


def squeezed(x: Column) -> Column:
    """Lower case, underscores and hyphens as spaces, white space squeezed. What is compared should be in compatibility
    form first: see nfkc."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[_-]+", " "), r"\s+", " "))


def nfkc(x: Column) -> Column:
    """Unicode compatibility form, in batches by Python's tables: Spark has no function for it, and Arrow's leaves characters
    apart that the form puts together."""
    from pyspark.sql.pandas.functions import arrow_udf

    def normalized(batch):
        import pyarrow as pa

        return pa.array([s if s is None or s.isascii() else unicodedata.normalize("NFKC", s) for s in batch.to_pylist()], pa.string())

    return arrow_udf(normalized, "string")(x)


def match_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def slug_upper(x: Column, default: str = "UNKNOWN") -> Column:
    return F.coalesce(F.nullif(F.upper(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")), F.lit("")), F.lit(default))


def safe_filename(x: Column, default: str = "thread") -> Column:
    named = F.trim(F.left(F.trim(F.regexp_replace(F.regexp_replace(x, r'[\\/:*?"<>|]', "_"), r"\s+", " ")), F.lit(180)))
    return F.coalesce(F.nullif(named, F.lit("")), F.lit(default))


def image_code(prefix: str, digest: Column, length: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.left(digest, F.lit(length))))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def hash_like(name: Column) -> Column:
    """Whether a file name is a hash, with a part behind a hyphen or without."""
    return stem(name).rlike(HASH_NAME)


def social_export(name: Column) -> Column:
    """Whether a file has the name that a social network gives to what is saved from it."""
    return name.rlike(SOCIAL_NAME) | name.rlike(SOCIAL_PART)


def file_score(name: Column, terms: Sequence[str] = (), long: int = 12) -> Column:
    """How much a file name says: 2 if it is no hash, 1 for each of the terms in it, 1 if it is longer than so many letters."""
    low = F.lower(name)
    points = [F.when(hash_like(name), 0).otherwise(2), *[low.contains(t.lower()).cast("int") for t in terms], (F.length(stem(name)) > long).cast("int")]
    return reduce(lambda a, b: a + b, points)


def joined(sep: str, *parts: Column) -> Column:
    """Parts that are not blank, with a separator between."""
    return F.array_join(F.array_compact(F.array(*[blank_to_null(p) for p in parts])), sep)


def first_filled(*parts: Column) -> Column:
    return F.coalesce(*[blank_to_null(p) for p in parts])


def thread_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/forums/threads/[^/]+\.([0-9]+)/?$", 1), F.lit(""))


def image_url(src: Column, base: str) -> Column:
    """Absolute, without query; null for data URLs and what is no image."""
    whole = F.when(src.rlike("^https?://"), src).when(src.startswith("//"), F.concat(F.lit("https:"), src)).when(src.startswith("/"), F.concat(F.lit(base), src)).otherwise(F.concat(F.lit(base + "/"), src))
    bare = F.regexp_replace(whole, "[?#].*$", "")
    return F.when(~src.startswith("data:") & F.lower(bare).rlike("(" + "|".join(map(re.escape, IMAGE_EXTENSIONS)) + ")$"), bare)


def without_date(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?s)\s*Date:.*$", ""))


def ordinal(name: Column) -> Column:
    return F.regexp_extract(stem(name), "([0-9]+)", 1).try_cast("int")


def note_union(*notes: Column) -> Column:
    """Lines of all notes, each once, in order of first appearance."""
    lines = F.concat(*[F.split(F.coalesce(n, F.lit("")), "\n") for n in notes])
    return F.nullif(F.array_join(F.array_distinct(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")), "\n"), F.lit(""))


def note_value(notes: Column, key: str) -> Column:
    """The last value of key=value lines; works without building a map."""
    lines = F.filter(F.split(F.coalesce(notes, F.lit("")), "\n"), lambda x: F.trim(F.substring_index(x, "=", 1)) == key)
    lines = F.filter(lines, lambda x: x.contains("="))
    return F.trim(F.regexp_replace(F.try_element_at(lines, F.lit(-1)), "^[^=]*=", ""))


def note_map(notes: Column) -> Column:
    """key=value lines as a map, the last of a key counting."""
    lines = F.filter(F.split(F.coalesce(notes, F.lit("")), "\n"), lambda x: x.contains("="))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def generic_title(title: Column) -> Column:
    """Whether a title says nothing: missing, blank, a word for missing, or an image file by number alone."""
    low = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return (low == "") | low.isin(*EMPTY_TITLES) | low.rlike(NUMBERED_NAME)


def answer(value: Column) -> Column:
    """The trimmed value; blanks and words for missing are null."""
    text = blank_to_null(value)
    return F.when(~F.lower(text).isin(*EMPTY_ANSWERS), text)


def humanized(key: Column) -> Column:
    """A key as words: underscores and hyphens as spaces, white space squeezed; null where there is no answer."""
    return answer(F.regexp_replace(F.translate(answer(key), "_-", "  "), r"\s+", " "))


def region_signature(*numbers: Column) -> Column:
    return F.struct(*[F.round(F.coalesce(n, F.lit(0.0)), 6).alias(f"c{i}") for i, n in enumerate(numbers)])


def fill(existing: Column, incoming: Column) -> Column:
    return F.coalesce(blank_to_null(existing), incoming)


def excerpt(x: Column, most: int = 80) -> Column:
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("..."))).otherwise(x)


def reference_number(number: Column, base: Column, suffix: Column) -> Column:
    """base+suffix if there is a base; a missing suffix, or 0, is written #."""
    tail = F.when(suffix.isNull() | (suffix == 0), F.lit("#")).otherwise(suffix.cast("string"))
    return F.when(base.isNotNull(), F.concat(base.cast("string"), tail)).otherwise(number.cast("string"))


def storage_kind(given: Column, drive_id: Column, url: Column) -> Column:
    return F.coalesce(blank_to_null(given), F.when(blank_to_null(drive_id).isNotNull(), "drive").when(blank_to_null(url).isNotNull(), "url").otherwise("other"))


def mark_confidence(mark: Column) -> Column:
    return F.when(F.lower(F.trim(mark)) == "x", "confirmed").otherwise("probable")


def thread_title(stored: Column, page: Column, url: Column) -> Column:
    from_page = F.regexp_extract(page, r"(?is)<title>\s*(.*?)\s*</title>", 1)
    from_url = F.initcap(F.replace(F.regexp_extract(url, r"/threads/([^/.]+)", 1), F.lit("-"), F.lit(" ")))
    return first_filled(stored, from_page, from_url)


def json_field(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


# predicates


def like_any(query: str | Column, *columns: Column) -> Column:
    """Substring search over several columns; % and _ in the query stay wildcards, a backslash is itself."""
    q = F.lit(query.replace("\\", "\\\\")) if isinstance(query, str) else F.replace(query, F.lit("\\"), F.lit("\\\\"))
    pattern = F.concat(F.lit("%"), q, F.lit("%"))
    return reduce(lambda a, b: a | b, [F.ilike(F.coalesce(c, F.lit("")), pattern) for c in columns])


def exactly_one(*columns: Column) -> Column:
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns]) == 1


def whole_word(text: Column, word: str) -> Column:
    return text.rlike(f"(?<![a-z0-9]){re.escape(word)}(?![a-z0-9])")


def any_of(text: Column, *terms: str) -> Column:
    return text.rlike("|".join(map(re.escape, terms)))
