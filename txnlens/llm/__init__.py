"""Training-data operators: deduplication, filters, search, formatting, packing, scans.

Each module holds one operator with a general DataFrame interface;
:mod:`txnlens.llm.queries` registers the thin ``opN_<name>`` queries and
:mod:`txnlens.llm.oracle` their DuckDB twins. Nothing else in the library
imports this subpackage.
"""
