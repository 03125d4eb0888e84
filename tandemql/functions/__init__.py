"""The scalar and aggregate functions of both dialects, as templates of Spark SQL."""
