"""Plan-building helpers: sessions, lineage and skew."""
