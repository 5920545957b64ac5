"""rollscope: last-name geography and language analytics as Spark DataFrame jobs."""
