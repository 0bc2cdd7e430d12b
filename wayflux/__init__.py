"""wayflux: transport-network and corpus analytics written as Spark DataFrame jobs."""
