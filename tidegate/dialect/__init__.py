"""The dialect's front-end: it reads statements and writes Spark SQL."""
