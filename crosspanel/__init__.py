"""Entity-by-month panel analytics and cost-aware portfolio research on Spark DataFrames."""
