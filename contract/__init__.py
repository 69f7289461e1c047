"""Driver contract: registered queries on the given tables and their SQL checks.

``derived``     event tables made of the given tables, one text for both engines
``catalogue``   the catalogue analyses over the derived tables
``operators``   operators, reshaping and described analyses over the given tables
``oracle_*``    the SQL that checks them, written apart from the library
"""
