"""Registered queries by area. Importing this package registers all of them."""

from siftline.plans.queries import curation, feeds, identity, market, rules, scoring, serving, storage  # noqa: F401
