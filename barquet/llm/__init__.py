"""Training-data operators: document, vector and conversation operators and their queries.

Nothing else in the library imports this subpackage. Each module holds one
operator; :mod:`barquet.llm.queries` binds them to the driver's tables and
:mod:`barquet.llm.oracles` holds the SQL for the queries that SQL can express.
"""
