"""weirflow: data-driven dataflow topologies compiled to Spark DataFrames and Structured Streaming queries."""
