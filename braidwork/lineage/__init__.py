"""Documents about a graph: catalog, HTML, DBML, entity-relationship diagrams."""
