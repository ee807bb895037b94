"""Siltstone: an analytics engine on PySpark for owned, versioned state."""
