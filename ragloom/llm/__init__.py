"""Large-scale training-data operators.

Every module holds one operator that works on any DataFrame with an id and a
text column; :mod:`ragloom.llm.queries` binds them to the driver's tables.
Nothing outside this subpackage imports it.
"""
