"""The import jobs: from read records to stored visits and movements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellpath.operators import ingest as I
from dwellpath.sources.exports import revise_movements
from dwellpath.sources.scratch import staged

#: Columns of a stored movement before it is linked, whatever it came from, with their types.
MOVEMENT = {
    "subject_id": "bigint", "id": "bigint", "source": "string", "movement_type": "string", "activity_type": "string", "confidence": "double",
    "start_time": "timestamp_ntz", "end_time": "timestamp_ntz", "duration_minutes": "int", "local_start_ts": "timestamp_ntz", "local_end_ts": "timestamp_ntz",
    "start_lat": "double", "start_lon": "double", "end_lat": "double", "end_lon": "double", "distance_meters": "double", "route": "array<struct<lon:double,lat:double>>", "metadata": "map<string,string>",
}


def stored_form(movements: DataFrame) -> DataFrame:
    """Movements in the columns of MOVEMENT, each once; what a kind of record doesn't have is null.

    Of records with one natural key (subject, source, type, times, points) the first in file order
    stays. One that brings no id is named by a digest of that key, wherever in its file it stands.
    """
    m = I.dedupe_movements(movements)
    m = m if "id" in m.columns else m.withColumn("id", F.xxhash64(*I.movement_key()))
    return m.select(*[(F.col(c) if c in m.columns else F.lit(None)).cast(t).alias(c) for c, t in MOVEMENT.items()])


def timeline_movements(records: DataFrame) -> DataFrame:
    """All movements of routed timeline records; trails in UTC get the clocks of the nearest written offset."""
    trails = I.movements_from_breadcrumbs(records)
    first, *rest = [I.movements_from_activities(records, "activity"), I.movements_from_activities(records, "segment"), I.with_local_clocks(trails, I.written_offsets(records))]
    for k in rest:
        first = first.unionByName(k, allowMissingColumns=True)
    return stored_form(first)


def import_visits(raw: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new visits, rejected records) of a timeline export; visits stored already are left out."""
    records = staged(I.route_records(raw))
    visits = I.dedupe_visits(I.visits_from_timeline(records), stored)
    if "id" not in visits.columns:
        visits = visits.withColumn("id", F.xxhash64("subject_id", "start_time", "end_time", F.round("lat", 6), F.round("lon", 6)))
    return visits, I.rejected_visits(records)


def _enriched(visits: DataFrame):
    return lambda movements: I.route_length(I.link_visits(movements, visits))


def import_movements(raw: DataFrame, visits: DataFrame, stored: DataFrame | None = None, force: bool = False) -> DataFrame:
    """The stored movements after a timeline export came in: linked to visits, with lengths of trails.

    The last week of the stored ones is replaced; ``force`` replaces all of this source. Records
    are parsed once and staged, as each kind goes through all of them.
    """
    new = staged(timeline_movements(staged(I.route_records(raw))))
    if stored is None:
        return _enriched(visits)(new)
    merge = I.force_reload if force else I.merge_revision_window
    return merge(stored, new, "phone", prepare=_enriched(visits))


def revise_stored(raw: DataFrame, visits: DataFrame, path: str) -> set[tuple[str, ...]]:
    """``import_movements`` on the table stored at ``path``: only the months that change are written; returns their partitions."""
    new = staged(timeline_movements(staged(I.route_records(raw))))
    return revise_movements(new, path, "phone", prepare=_enriched(visits))


def import_tracker(items: DataFrame, visits: DataFrame, stored: DataFrame | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(stored movements, visits) after tracker items came in: movements once a subject, visits with names.

    ``force`` replaces all movements of this source; naming visits again gives the same names.
    """
    items = staged(items)
    new = staged(stored_form(I.movements_from_tracker(items)))
    if stored is None:
        movements = _enriched(visits)(new)
    else:
        merge = I.force_reload if force else I.import_once
        movements = merge(stored, new, "tracker", prepare=_enriched(visits))
    return movements, I.label_places(visits, I.tracker_labels(items))
