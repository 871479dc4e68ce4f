"""Operators above single queries: rulesets, reports, name resolution."""
