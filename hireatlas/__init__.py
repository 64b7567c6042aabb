"""Company, page and job-posting analytics as PySpark DataFrame operators."""
