"""DataFrame operators: shape, filters, joins, aggregates, keyed merges, scores."""
