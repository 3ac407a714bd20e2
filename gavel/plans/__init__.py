"""Query catalogue: Spark plans over the fixture tables with their SQL equivalents."""
