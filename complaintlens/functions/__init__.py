"""Column expressions. All are built-in Spark SQL expressions, no Python at run time."""
