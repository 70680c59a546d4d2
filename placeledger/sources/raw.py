"""Raw source records: JSON files in and out, and the parsers that bring each source to the common record shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger import schemas
from placeledger.functions import text as tx
from placeledger.session import cut, small


def read_raw(spark: SparkSession, path: str, source: str, multiline: bool = True) -> DataFrame:
    """Raw records from JSON files, under the declared schema.

    A missing path or a record that breaks the schema is an error. Arrays written as one document need ``multiline``;
    files with one record per line (``multiline=False``) are split over tasks.
    """
    reader = spark.read.schema(schemas.RAW[source]).option("mode", "FAILFAST").option("multiLine", multiline)
    return reader.json(path)


def write_raw(df: DataFrame, path: str) -> None:
    """One JSON record per line, so that the files can be read back in parallel."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def common(df: DataFrame, **columns: Column) -> DataFrame:
    """The common record: given columns, typed nulls for the rest."""
    out = [
        (columns[name].cast(kind) if name in columns else F.lit(None).cast(kind)).alias(name)
        for name, kind in schemas.RAW_COMMON
    ]
    return df.select(*out)


def number_records(df: DataFrame, column: str = "seq", start: int = 0) -> DataFrame:
    """Rows just read from files, with ``column``: start, start + 1, ... by file path and place in the file.

    Equal records get different numbers, and the numbers do not depend on how files are dealt to tasks. ``df`` must come
    straight from a file reader. The rows are written once, so that their places count for good; a file's split gives one row
    to the prefix sum over all splits.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).alias("_split")
    rows = cut(df.select("*", place, F.monotonically_increasing_id().alias("_at")))
    splits = rows.groupBy("_split").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("_split", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    number = F.col("_base") + F.col("_at") - F.col("_first") + start
    return rows.join(small(bases), "_split").withColumn(column, number.cast("bigint")).select(*df.columns, column)


def _sequence(df: DataFrame) -> Column:
    """The record's turn: its own number if it has one (see :func:`number_records`), else a hash of the record, never negative."""
    return F.col("seq") if "seq" in df.columns else F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), 1)


def parse_wpn(df: DataFrame) -> DataFrame:
    """Locator records with the postal address split at commas.

    Five or more parts: street, city, state, ZIP, country. Four or three parts: as many of these. Two parts or one:
    street only. Records without an address, a street or a name are dropped.
    """
    parts = F.transform(F.split("postalAddress", ","), lambda p: F.trim(p))
    rows = df.withColumn("parts", parts).withColumn("n", F.size("parts"))

    def part(i: int, least: int) -> Column:
        return F.when(F.col("n") >= least, F.get("parts", F.lit(i))).otherwise("")

    kept = rows.filter(tx.present(F.col("postalAddress")) & tx.present(part(0, 1)) & tx.present(F.col("name")))
    return common(
        kept, source=F.lit("wpn"), external_id=F.col("id"), name=F.col("name"), street=part(0, 1), city=part(1, 3),
        state=part(2, 3), zip_code=part(3, 4), country=part(4, 5), phone=F.col("phoneNumber"), email=F.col("emailAddress"),
        website=F.col("website"), latitude=F.col("latitude"), longitude=F.col("longitude"), wpn_id=F.col("id"),
        wpn_level=F.when(F.coalesce("isPremium", F.lit(False)), "premium").otherwise("core"), seq=_sequence(df),
    )


def parse_google(df: DataFrame) -> DataFrame:
    """Place records; the formatted address is parsed when it has the usual form, else the address parts are null.

    Records without an id, a name or an address are dropped.
    """
    name = F.col("displayName.text")
    kept = df.filter(tx.present(F.col("id")) & tx.present(name) & tx.present(F.col("formattedAddress")))
    a = tx.parse_formatted_address("formattedAddress")
    return common(
        kept, source=F.lit("google_places"), external_id=F.col("id"), name=name, street=a["street"], city=a["city"],
        state=a["state"], zip_code=a["zip_code"], country=F.lit("US"), phone=F.col("nationalPhoneNumber"),
        website=F.col("websiteUri"), latitude=F.col("location.latitude"), longitude=F.col("location.longitude"),
        google_place_id=F.col("id"), place_types=F.col("types"), seq=_sequence(df),
    )


def parse_gw(df: DataFrame) -> DataFrame:
    """US retailer records with ``store_type``; those without id, name, street or city are dropped."""
    name = F.when(tx.present(F.col("displayName")), F.col("displayName")).otherwise(F.col("name"))
    kept = df.filter(
        (F.col("countryCode") == "US") & tx.present(F.col("objectID")) & tx.present(name)
        & tx.present(F.col("addressLine1")) & tx.present(F.col("city"))
    )
    return common(
        kept, source=F.lit("games_workshop"), external_id=F.col("objectID"), name=name, street=F.col("addressLine1"),
        city=F.col("city"), state=F.coalesce("region", F.lit("")), zip_code=F.coalesce("postalCode", F.lit("")),
        country=F.col("countryCode"), phone=F.col("phone"), website=F.col("websiteUrl"), latitude=F.col("_geoloc.lat"),
        longitude=F.col("_geoloc.lng"), seq=_sequence(df),
        store_type=F.when(F.coalesce("isWarHammerStore", F.lit(False)), "GW Store").otherwise("Independent Retailer"),
    )


def address_parts(address) -> Column:
    """Loose address struct: street and city from commas, state before a ZIP, ZIP the first five-digit number.

    A five-digit house number therefore wins over the ZIP.
    """
    c = tx.col(address)
    parts = F.transform(F.split(c, ","), lambda p: F.trim(p))
    return F.struct(
        F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("street"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("city"),
        F.regexp_extract(c, r"(?U),\s*([A-Z]{2})\s+\d{5}", 1).alias("state"),
        F.regexp_extract(c, r"(?U)\b(\d{5})(?:-\d{4})?\b", 1).alias("zip_code"),
    )


def google_to_vertical(df: DataFrame, source: str) -> DataFrame:
    """Place records as records of a vertical source (comic or retro stores); street and city are required."""
    places = df.filter(tx.present(F.col("id")) & tx.present(F.col("displayName.text")) & tx.present(F.col("formattedAddress")))
    rows = places.withColumn("a", address_parts("formattedAddress"))
    kept = rows.filter(tx.present(F.col("a.street")) & tx.present(F.col("a.city")))
    return common(
        kept, source=F.lit(source), external_id=F.col("id"), name=F.col("displayName.text"), street=F.col("a.street"),
        city=F.col("a.city"), state=F.col("a.state"), zip_code=F.col("a.zip_code"), country=F.lit("US"),
        phone=F.col("nationalPhoneNumber"), website=F.col("websiteUri"), latitude=F.col("location.latitude"),
        longitude=F.col("location.longitude"), seq=_sequence(df),
    )


def parse_vertical(df: DataFrame) -> DataFrame:
    """Stored comic and retro records as common records."""
    return common(
        df, source=F.col("source"), external_id=F.col("source_id"), name=F.col("name"), street=F.col("street"),
        city=F.col("city"), state=F.col("state"), zip_code=F.col("zip_code"), country=F.coalesce("country", F.lit("US")),
        phone=F.col("phone"), website=F.col("website"), latitude=F.col("latitude"), longitude=F.col("longitude"),
        seq=_sequence(df),
    )


PARSERS = {"wpn": parse_wpn, "google_places": parse_google, "games_workshop": parse_gw, "vertical": parse_vertical}


def load_source(spark: SparkSession, path: str, source: str, multiline: bool = True) -> DataFrame:
    """Files of one source as common records; the turn of a record is its place among the files."""
    return PARSERS[source](number_records(read_raw(spark, path, source, multiline)))


PAGE_COLUMNS = ["Page", "Top pages", "URL", "Url", "page", "url"]


def read_search_export(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Search-console CSV exports as (row_no, page, impressions).

    The page is the first non-empty of the known URL columns. Exports differ in their columns, so each file keeps its
    own header. ``row_no`` goes by export, then by file and place in the file, so "the last row of a page" is that of the exports.
    """
    parts = []
    for number, path in enumerate(paths):
        df = spark.read.option("header", True).option("escape", '"').csv(path)
        names = {c: c.lstrip("\ufeff") for c in df.columns}
        by_name = {name: F.col(f"`{c}`") for c, name in names.items()}
        held = [F.when(tx.present(by_name[c]), by_name[c]) for c in PAGE_COLUMNS if c in by_name]
        page = F.coalesce(*held) if held else F.lit(None).cast("string")
        rows = number_records(df.select(page.alias("page"), by_name.get("Impressions", F.lit("0")).alias("impressions")), "row_no", number << 50)
        parts.append(rows.filter(F.col("page").isNotNull()).select("row_no", "page", "impressions"))
    if not parts:
        raise ValueError("no export given")
    return reduce(DataFrame.unionByName, parts)


def read_dossiers(spark: SparkSession, path: str, min_confidence: float = 0.65, whole_files: bool = True) -> DataFrame:
    """One report row per JSON dossier of a folder (a document per file, or per line); wrong types count as missing."""
    raw = spark.read.text(path, wholetext=whole_files).select("value", F.col("_metadata.file_path").alias("json_path"))
    parsed = raw.withColumn("d", F.from_json("value", schemas.DOSSIER))
    d = F.col("d")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    confidence = F.coalesce(d["confidence"], F.lit(0.0))
    events = F.coalesce(d["has_events"], F.lit(False))
    action = dossier_action(confidence, size(d["products"]), size(d["pages_fetched"]), events, min_confidence)
    text = lambda c: F.coalesce(c, F.lit(""))
    listed = lambda c: text(F.array_join(c, "|"))
    return parsed.select(
        text(d["store_id"]).alias("store_id"), text(d["store_name"]).alias("name"), text(d["slug"]).alias("slug"),
        text(d["address"]["city"]).alias("city"), text(d["address"]["state"]).alias("state"),
        text(d["website_url"]).alias("website"), tx.fixed(confidence, 2).alias("confidence"),
        text(d["recommended_next_step"]).alias("recommended_next_step"), action.alias("action"),
        listed(d["products"]).alias("products"), events.cast("string").alias("has_events"),
        text(d["event_url"]).alias("event_url"), size(d["events_next_30_days"]).alias("events_next_30_days"),
        listed(d["phones"]).alias("phones"), listed(d["hours_text"]).alias("hours_text"),
        size(d["pages_fetched"]).alias("pages_fetched"),
        F.coalesce(F.to_json(d["skipped_urls"]), F.lit("[]")).alias("skipped_urls"), "json_path",
    )


def dossier_action(confidence: Column, products: Column, pages: Column, has_events: Column, least: float = 0.65) -> Column:
    """What to do with one enrichment result: apply, look again, or review."""
    return (
        F.when((confidence >= least) & (products > 0), "auto_apply")
        .when(pages == 0, "retry_or_debug")
        .when((products == 0) & ~has_events, "not_lgs_or_manual_review")
        .otherwise("manual_review")
    )


def write_report(df: DataFrame, path: str, group: str | None = None) -> None:
    """CSV report with a header; with ``group`` one folder per value of that column."""
    plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    writer = df.write.mode("errorifexists").options(**plain)
    (writer.partitionBy(group) if group else writer).csv(path)


KNOWN_SOURCES = sorted(cat.DEFAULT_CATEGORIES)
