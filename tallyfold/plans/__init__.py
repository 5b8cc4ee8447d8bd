"""Read queries, the workload over the star schema, and registered queries."""
