"""Declared schemas: directory tables, raw source records and JSON payloads. Nothing is inferred."""

from __future__ import annotations

CONTENT_PAYLOAD = """
description string, products array<string>, has_events boolean, event_url string, confidence string,
events_next_30_days array<struct<title: string, start_date: string, end_date: string, timezone: string,
  source_url: string, service_id: string, event_id: string, status: string, price: string, location: string,
  product_url: string, description: string, is_not_bookable: boolean>>
"""

ENRICHMENT_PAYLOAD = """
enriched_at string, rating double, user_rating_count bigint, photo_refs array<string>,
hours struct<weekday_text: array<string>, periods: array<struct<
  open: struct<day: int, hour: int, minute: int>, close: struct<day: int, hour: int, minute: int>>>>
"""

CHECK_RESULT = """
status string, http_status int, error string, url string, products array<string>, products_found int,
confidence string, method string, is_closed boolean, reason string
"""

# Raw records as the sources deliver them.
RAW = {
    "wpn": """
        id string, name string, postalAddress string, latitude double, longitude double, isPremium boolean,
        phoneNumber string, emailAddress string, website string, distance double
    """,
    "google_places": """
        id string, displayName struct<text: string>, formattedAddress string, nationalPhoneNumber string,
        websiteUri string, location struct<latitude: double, longitude: double>, rating double, types array<string>
    """,
    "games_workshop": """
        objectID string, displayName string, name string, addressLine1 string, city string, region string,
        postalCode string, countryCode string, phone string, websiteUrl string,
        _geoloc struct<lat: double, lng: double>, isWarHammerStore boolean
    """,
    "vertical": """
        source_id string, source string, name string, street string, city string, state string, zip_code string,
        country string, phone string, website string, latitude double, longitude double
    """,
}

# The shape every source is brought to before ingest.
RAW_COMMON = [
    ("source", "string"), ("external_id", "string"), ("name", "string"), ("street", "string"), ("city", "string"),
    ("state", "string"), ("zip_code", "string"), ("country", "string"), ("phone", "string"), ("email", "string"),
    ("website", "string"), ("latitude", "double"), ("longitude", "double"), ("wpn_id", "string"),
    ("wpn_level", "string"), ("google_place_id", "string"), ("place_types", "array<string>"), ("store_type", "string"),
    ("seq", "bigint"),
]

DOSSIER = """
store_id string, store_name string, slug string, address struct<street: string, city: string, state: string,
zip_code: string>, website_url string, confidence double, recommended_next_step string, products array<string>,
has_events boolean, event_url string, events_next_30_days array<struct<title: string, start_date: string>>,
phones array<string>, hours_text array<string>, pages_fetched array<string>,
skipped_urls array<struct<url: string, reason: string>>
"""

CONTENT_EVENTS = """array<struct<title: string, start_date: string, end_date: string, timezone: string,
  source_url: string, service_id: string, event_id: string, status: string, price: string, location: string,
  product_url: string, description: string, is_not_bookable: boolean>>"""

PERIODS = """array<struct<open: struct<day: int, hour: int, minute: int>, close: struct<day: int, hour: int, minute: int>>>"""

PLACE_DETAILS = f"""
regularOpeningHours struct<weekdayDescriptions: array<string>, periods: {PERIODS}>, rating double,
userRatingCount bigint, photos array<struct<name: string>>
"""
