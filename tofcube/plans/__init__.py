"""Queries over the driver's tables, each with DuckDB SQL of the same meaning where SQL can say it.

The tables stand in for detector data: events are neutron events (value as TOF in microseconds),
their types are runs (view: sample, click: open beam), lineitem months are bins of larger cubes,
embeddings are spectra.
"""
