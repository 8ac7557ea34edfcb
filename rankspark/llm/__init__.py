"""Training-data operators: one module per operator, queries in ``registry``.

Nothing outside this folder imports it. Each operator selects the columns it
needs by name, so extra columns of the input (also ones named like its
outputs) never reach or disturb it.
"""
