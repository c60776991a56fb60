"""Training-data operators: scoring, privacy, counting, de-duplication, extraction and packing.

Nothing outside this folder imports it; ``registry`` lists its queries.
"""
