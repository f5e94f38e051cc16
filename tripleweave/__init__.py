"""tripleweave: a PySpark-native engine for knowledge graphs.

Graphs are DataFrames, SPARQL is compiled to Spark plans, SHACL shapes become
set-based violation queries, and relational tables can be queried as virtual
graphs without ever materialising their triples.
"""
