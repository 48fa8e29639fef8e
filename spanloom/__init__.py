"""Analytics over documents with overlapping, nested and multi-label character spans, on Spark."""
