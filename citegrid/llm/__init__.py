"""Operators for large training-data pipelines. Nothing else in citegrid imports this subpackage."""
