"""Registry analytics and corpus operators as Spark DataFrame functions."""
