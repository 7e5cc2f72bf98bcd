"""The registered queries and their SQL."""

from __future__ import annotations

from newsloom.plans import news, providers, sports, stored, views

QUERIES = news.QUERIES | sports.QUERIES | views.QUERIES | stored.QUERIES | providers.QUERIES
ORACLES = news.ORACLES | sports.ORACLES | views.ORACLES | stored.ORACLES | providers.ORACLES
