"""quern: file-system image analytics and corpus preparation on PySpark."""
