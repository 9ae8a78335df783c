"""Domains, thresholds and row types of the catalogue. Thresholds are fixed values that results depend on."""

from __future__ import annotations

SOURCES = ("vlm", "ocr", "manual", "googleBooks", "ndl", "openbd", "barcode")
STATUSES = ("unverified", "confirmed", "needsReview", "conflict", "notFound", "excluded")

# Fixed values.
AUTO_CONFIRM = 0.82
CANDIDATE_FLOOR = 0.35
TITLE_EXACT, AUTHOR_MATCH = 0.95, 0.8
MIN_QUERY_LENGTH, MAX_LOOKUPS = 4, 6
DISAGREEMENT_TITLE, AGREEMENT_DEPTH = 0.8, 3
CAPTURE_WINDOW_MS, RECENT_OBSERVATIONS = 8000, 80
SAME_TEXT, SAME_BAND = 0.72, 0.5
SAME_HASH_BITS, NEW_SHELF_BITS = 6, 18
BRIGHTNESS, MOST_BLOWOUT, LEAST_SHARPNESS, BLOWOUT_LEVEL = (0.15, 0.95), 0.45, 0.035, 254
STILL, STABLE_TICKS, RESCUE_MS, FORCE_MS, RESCUE_RATIO = 0.06, 3, 4000, 8000, 0.85
NEW_SHELF, RETRY_MS = 0.1, 10_000
CSV_HEADER = ("タイトル", "副題", "著者", "出版社", "出版年", "ISBN", "シリーズ", "出典", "状態")
MARKDOWN_HEADER = ("タイトル", "著者", "出版社", "出版年", "ISBN")

BOX = "struct<x: double, y: double, width: double, height: double>"
RECORD = (
    "title string, subtitle string, authors array<string>, publisher string, published string, isbn13 string, "
    "isbnRaw string, series string, coverUrl string, description string, source string, sourceUrl string"
)
MENTION = (
    f"title string, authors array<string>, publisher string, confidence double, box {BOX}, "
    f"fragments array<struct<text: string, confidence: double, box: {BOX}>>, engine string"
)
RECORD_FIELDS = tuple(f.split()[0] for f in RECORD.split(", "))
DIFF_FIELDS = ("title", "authors", "publisher", "published", "isbn13")
