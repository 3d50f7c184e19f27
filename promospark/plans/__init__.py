"""promospark.plans"""
