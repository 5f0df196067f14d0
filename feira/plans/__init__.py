"""Curated tables, reports and the growth funnel."""
