"""A reactive analytics engine on PySpark.

Apps are sources, inputs, cells and panes.  Cells are pipelines of table verbs, compiled
to DataFrames; a driver-side graph decides which cells a change reaches.
"""
