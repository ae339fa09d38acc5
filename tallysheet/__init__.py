"""tallysheet: run-time-schema record processing as Spark DataFrame jobs."""
