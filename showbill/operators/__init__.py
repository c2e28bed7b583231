"""DataFrame operators: filters, joins, rollups, ranking, generators and checks."""
