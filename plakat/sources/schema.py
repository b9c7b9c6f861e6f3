"""Schemas shared by sources."""

from __future__ import annotations

OFFER = "struct<provider: string, url: string, price: string, is_primary: boolean>"
RAW_EVENT = (
    "source string, title string, date_text string, time_text string, date_start date, date_end date, time_start string, url string, venue string, stage string, address string, "
    "category string, price string, organizer string, description string, image_url string, ord bigint"
)
PLACE = (
    "place_id string, name string, poi_group string, raw_amenity string, lat double, lon double, street string, housenumber string, city string, phone string, website string, wheelchair string"
)
