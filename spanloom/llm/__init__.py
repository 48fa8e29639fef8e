"""Operators for preparing training data: tokens, filters, deduplication, shards. Nothing else in the library imports this subpackage."""
