"""Where rows come from and go to: external Parquet tables, and versioned tables of the engine."""
