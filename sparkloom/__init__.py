"""sparkloom: retrieval, corpus and knowledge-base operators as Spark DataFrame plans."""
