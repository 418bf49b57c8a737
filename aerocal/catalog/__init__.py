"""Registered queries: every operator run over the driver's tables.

The tables stand in for sensor data. ``events`` is a raw report (``event_type`` is the
variable or series, ``user_id`` the sensor, ``value`` the signal, ``k`` in ``props`` a
covariate); ``lineitem`` is a fused table (supplier = sensor, ship date = time).
"""

from aerocal.catalog.registry import oracle_sql, queries  # noqa: F401
from aerocal.catalog import ingest, models, series, statistics, tables, trees  # noqa: F401
