"""Training-data operators over documents and web pages.

Nothing outside this folder imports it. Each module holds one operator and
the query that applies it to a whole table; ``registry`` lists the queries.
"""
