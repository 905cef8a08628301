"""Streaming influence analytics on Spark: the most influential k nodes of a stream of interactions that expire."""
