"""Where rows come from and go to: Parquet folders, foreign tables by wrapper, files."""
