"""Writers: partitioned Parquet tables and text lists.

All writers take the ``rebalance`` hint on their partition columns: adaptive
execution then writes even files and splits a partition that holds most rows.
Nothing is deleted, and inputs are never touched.
"""
