"""Plans: registered queries over the test tables, the lazy pipeline and the read-only query API."""
