"""millrace: text-retrieval analytics and large-table data work as Spark DataFrame plans."""
