"""Change-impact analytics over dependency graphs, built on the Spark DataFrame API."""
