"""DataFrame operators the curated tables and reports are composed of."""
