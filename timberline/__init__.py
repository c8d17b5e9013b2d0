"""Log analytics on Spark: header splitting, template mining, accuracy and diversity measures."""
