"""Training-data operators: de-duplication, tokenisation, scoring, extraction, packing.

Nothing else in the library imports this subpackage. Each operator module
has a general interface over any DataFrame; ``queries.py`` applies the ten
operators to the fixture tables with their production parameters.
"""
