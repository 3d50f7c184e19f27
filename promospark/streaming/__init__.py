"""promospark.streaming"""
