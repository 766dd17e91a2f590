"""A page-view analytics engine on Spark."""
