"""Readers, and views of plain tables as task, run and event tables."""
