from postpulse.streaming.counts import compact_daily_counts, read_daily_counts, store_daily_counts, stream_daily_counts
from postpulse.streaming.ingest import stream_ingest
from postpulse.streaming.sightings import best_sightings, read_sightings, store_sightings

__all__ = ["best_sightings", "compact_daily_counts", "read_daily_counts", "read_sightings", "store_daily_counts", "store_sightings", "stream_daily_counts", "stream_ingest"]
