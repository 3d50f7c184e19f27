"""promospark.operators"""
