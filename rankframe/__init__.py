"""rankframe: ranked-retrieval analytics and corpus preparation as Spark DataFrame plans."""
