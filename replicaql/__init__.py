"""replicaql: declarative queries and replica reconciliation on Spark DataFrames."""
