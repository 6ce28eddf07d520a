"""Plan-tree features and the relational workload shapes."""
