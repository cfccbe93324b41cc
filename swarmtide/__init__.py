"""swarmtide: analytics on time-ordered particle snapshots, expressed as Spark DataFrames."""
