"""Strength-training log analytics as Spark DataFrame transformations.

Every operator takes the table mapping ``t`` (name -> DataFrame) and returns a
lazy DataFrame covering all users at once; ``users=`` narrows it to some of them.
"""
