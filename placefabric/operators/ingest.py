"""Source mapping: raw records to canonical rows."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Price words, and the confidence of words.
PRICE_WORDS = {"free": 0, "inexpensive": 1, "cheap": 1, "moderate": 2, "expensive": 3, "very expensive": 4}
CONFIDENCE = {"low": 0.3, "medium": 0.6, "high": 0.9}
_GOOGLE = r"(^|\.)google\.[a-z.]+$|(^|\.)goo\.gl$"


def parse_list(text: str | None) -> list[str]:
    """A Python or JSON list, or text parted by commas or semicolons; trimmed, empty ones left out, first occurrence kept."""
    t = (text or "").strip()
    value: object = None
    if t[:1] in "[({":
        for read in (json.loads, ast.literal_eval):
            try:
                value = read(t)
                break
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                continue
    if isinstance(value, dict):
        value = list(value)
    items = list(value) if isinstance(value, list | tuple | set) else t.strip("[](){}").replace(";", ",").split(",")
    return list(dict.fromkeys(s for x in items if x is not None and (s := str(x).strip().strip("\"'"))))


def listish(texts: Column) -> Column:
    @F.pandas_udf("array<string>")
    def parsed(part: pd.Series) -> pd.Series:
        return part.map(parse_list)

    return parsed(texts)


def ai_tags(text: Column) -> Column:
    """Tags of a JSON array of strings or of objects (tag, confidence, polarity), without low or negative ones; sorted, distinct."""
    objects = F.from_json(text, "array<struct<tag:string,confidence:string,polarity:string>>")
    strings = F.from_json(text, "array<string>")
    good = F.filter(objects, lambda t: t["tag"].isNotNull() & (F.lower(F.coalesce(t["confidence"], F.lit(""))) != "low") & (F.lower(F.coalesce(t["polarity"], F.lit(""))) != "negative"))
    plain = F.filter(strings, lambda s: s.isNotNull() & ~F.startswith(F.trim(s), F.lit("{")))
    both = F.concat(F.transform(F.coalesce(good, F.array().cast("array<struct<tag:string,confidence:string,polarity:string>>")), lambda t: t["tag"]), F.coalesce(plain, F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(both, lambda t: F.lower(F.trim(t))), lambda t: t != "")))


def price_level(text: Column) -> Column:
    """Price words, ladders of $, or a number 0 to 4."""
    t = F.lower(F.trim(text))
    words = F.create_map(*[F.lit(x) for pair in PRICE_WORDS.items() for x in pair])
    number = t.try_cast("int")
    return F.coalesce(F.try_element_at(words, F.translate(t, "_", " ")), F.when(t.rlike(r"^\$+$"), F.least(F.length(t), F.lit(4))), F.when(number.between(0, 4), number))


def axis_bucket(value: Column) -> Column:
    return F.when(value.isNull(), None).when(value < 20, "very low").when(value < 40, "low").when(value < 60, "medium").when(value < 80, "high").otherwise("very high")


def website(url: Column) -> Column:
    """The url unless its host is a search engine's, else null."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(host.isNotNull() & ~host.rlike(_GOOGLE), url)


def leftovers(df: DataFrame, known: list[str]) -> Column:
    """The other columns that aren't blank, as a JSON object."""
    pairs = [x for c in df.columns if c not in known for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return F.to_json(F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (F.trim(v) != ""))) if pairs else F.lit("{}")


def array_literal(items: Column) -> Column:
    """{a,"b c"}: quoted where an item has blanks, commas, quotes, braces or a backslash, or is empty."""
    quote = lambda x: F.when(x.rlike(r'[\s,"{}\\]') | (x == ""), F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))).otherwise(x)
    return F.concat(F.lit("{"), F.array_join(F.transform(items, quote), ","), F.lit("}"))


def embedding_text(parts: dict[str, Column]) -> Column:
    """Labelled lines of the parts that aren't blank."""
    return F.concat_ws("\n", *[F.when(F.trim(c) != "", F.concat(F.lit(f"{label}: "), c)) for label, c in parts.items()])


def info_score(parts: list[tuple[Column, float]]) -> Column:
    """Weighted share of present parts."""
    total = sum(w for _, w in parts)
    out = F.lit(0.0)
    for c, w in parts:
        out = out + F.when(c.isNotNull() & (F.trim(c.cast("string")) != ""), w / total).otherwise(0.0)
    return out


def subtype(primary: Column, summary: Column, name: Column, by_type: dict[str, str], by_word: dict[str, str]) -> Column:
    """Subtype by primary type, else by the first word found in the summary, else in the name."""
    out = F.try_element_at(F.create_map(*[F.lit(x) for pair in by_type.items() for x in pair]), primary)
    for hay in (summary, name):
        found: Column = F.lit(None).cast("string")
        for w, s in reversed(by_word.items()):
            found = F.when(F.contains(F.lower(hay), F.lit(w)), s).otherwise(found)
        out = F.coalesce(out, found)
    return out


def photo_manifest(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines `<cid>/<NN>_<kind>.<ext>` -> (photos, rejected lines)."""
    pattern = r"^(\d+)/(\d+)_([a-z]+)\.(jpg|jpeg|png|webp)$"
    ok = F.coalesce(F.col(column).rlike(pattern), F.lit(False))
    photos = lines.where(ok).select(F.regexp_extract(column, pattern, 1).alias("cid"), F.regexp_extract(column, pattern, 2).cast("int").alias("photo_index"), F.regexp_extract(column, pattern, 3).alias("kind"), F.regexp_extract(column, pattern, 4).alias("extension"))
    return photos, lines.where(~ok)


def safe_segment(x: Column) -> Column:
    return F.regexp_replace(x, r"[^a-zA-Z0-9._-]", "_")


def first_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row of each numeric key by input order."""
    good = df.where(F.col(key).rlike(r"^\d+$"))
    return good.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """Content hash of a row: SHA-256 of its columns by name as JSON."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def violations(places: DataFrame) -> DataFrame:
    """One row of counts: what a catalog bundle must not hold."""
    bad = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias
    dup = places.groupBy("id").count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, 1).otherwise(0)), F.lit(0)).alias("duplicate_ids"))  # one row
    one = places.agg(
        F.count(F.lit(1)).alias("n_rows"), bad(F.trim(F.coalesce("name", F.lit(""))) == "")("blank_names"), bad(~F.coalesce(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180), F.lit(False)))("bad_coordinates"),
        bad(~F.coalesce(F.col("visibility").between(0, 100), F.lit(True)))("bad_scores"), bad(F.col("photo_path").isNull())("without_photo"),
    )
    return one.crossJoin(F.broadcast(dup))


def embedding_outputs(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Batch results -> (place_row, vector) of status 200, and the failed custom ids."""
    r = F.from_json(column, "custom_id string, response struct<status_code:int, body: struct<data: array<struct<embedding: array<double>>>>>")
    rows = lines.select(r.alias("r")).select("r.*")
    ok = F.coalesce(F.col("response.status_code") == 200, F.lit(False))
    return rows.where(ok).select(F.regexp_extract("custom_id", r"^location_(\d+)_", 1).cast("long").alias("place_row"), F.col("response.body.data")[0]["embedding"].alias("vector")), rows.where(~ok).select("custom_id")
