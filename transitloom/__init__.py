"""transitloom: vehicle-telemetry analytics and corpus preparation as Spark jobs."""
