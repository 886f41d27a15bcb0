"""Every registered query with the SQL that must give the same rows."""

from parcelspark.plans import areas, decisions, events, footprints, raster, site, small, vector

QUERIES = {**vector.QUERIES, **raster.QUERIES, **events.QUERIES, **decisions.QUERIES, **site.QUERIES, **small.QUERIES, **footprints.QUERIES, **areas.QUERIES}
ORACLES = {**vector.ORACLES, **raster.ORACLES, **events.ORACLES, **decisions.ORACLES, **site.ORACLES, **small.ORACLES, **footprints.ORACLES, **areas.ORACLES}
