"""Compositions of operators into dataset preparations, studies and queries."""
