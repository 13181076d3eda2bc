"""Training-data operators: each module holds one operator over document tables.

Nothing outside this subpackage imports it; the repository's entry module adds
its queries when it is present.
"""
