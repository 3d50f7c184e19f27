"""promospark.sources"""
