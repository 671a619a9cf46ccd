"""lakegauge: analytics over data-platform telemetry, written as Spark DataFrame operators."""
