"""shardloom: partitioned keyed-collection analytics, planned by Catalyst."""
