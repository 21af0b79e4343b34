"""Schemas of the logical inputs; only declared fields are read."""

from __future__ import annotations

REVIEW = "review_id string, user_id string, business_id string, stars double, text string, date string"
TEST_REVIEW = "user_id string, business_id string"
BUSINESS = "business_id string, categories string, state string, city string"
CITY = "city string"
USER_BUSINESS = "user_id string, business_id string"
SIMILAR_BUSINESSES = "b1 string, b2 string, sim double"
SIMILAR_USERS = "u1 string, u2 string, sim double"
#: One file with two kinds of rows, told apart by which id is there.
CONTENT_MODEL = "business_id string, user_id string, features array<long>"
TAGGED_EVENT = "event_id long, entities struct<hashtags: array<struct<text: string>>>"
