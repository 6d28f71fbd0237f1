"""DataFrame operators: tables, taxonomy, insights, graph, quality, intake, retrieval."""
