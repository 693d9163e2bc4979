"""Rules over tag columns of typed nodes and ways; a missing tag is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that results must equal.
STATION_KINDS = ["station", "halt", "tram_stop"]
NOT_PASSENGER = ["tourism", "training", "military", "test", "industrial"]
WALKABLE = [
    "footway", "path", "pedestrian", "steps", "corridor", "living_street", "residential", "unclassified", "service", "track", "road",
    "tertiary", "tertiary_link", "secondary", "secondary_link", "primary", "primary_link", "trunk", "trunk_link", "cycleway",
]


def _has(tag: str, *values: str) -> Column:
    """The tag has one of the values; false without the tag."""
    return F.coalesce(F.col(tag).isin(*values), F.lit(False))


def not_train() -> Column:
    """A stop of buses, ferries or cable cars, by any of its tags."""
    return _has("bus", "yes") | _has("highway", "bus_stop") | _has("ferry", "yes") | F.col("aerialway").isNotNull() | _has("amenity", "bus_station", "ferry_terminal")


def stop_node() -> Column:
    """A node that a line may stop at: a railway tag decides; a transport tag only where no other means stops."""
    return _has("railway", *STATION_KINDS) | (_has("public_transport", "station", "stop_position") & ~not_train())


def passenger_station() -> Column:
    """A station that may be put into a line's gaps: open to passengers, no monorail, no signal point."""
    return _has("railway", "station", "halt") & ~_has("usage", *NOT_PASSENGER) & ~_has("monorail", "yes") & ~F.coalesce(F.col("name").endswith("信号場"), F.lit(False))


def walkable() -> Column:
    """A way to walk on; a foot tag outweighs an access ban."""
    return _has("highway", *WALKABLE) & ~_has("foot", "no", "private") & ~(_has("access", "no", "private") & F.col("foot").isNull())
