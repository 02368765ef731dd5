"""Plan helpers: staged tables that cut lineage."""
