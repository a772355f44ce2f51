"""Record-linkage and catalog ETL on Spark: every stage is a DataFrame-to-DataFrame function."""
