"""Explicit schemas: no source infers any. They are DDL strings, which need no session to be made."""

from __future__ import annotations

import re


class schema(str):
    @property
    def names(self) -> list[str]:
        """Top-level column names."""
        flat = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", self))
        return [part.split()[0] for part in flat.split(",")]


POS = schema(
    "track_id STRING, epoch BIGINT, ts TIMESTAMP, lat DOUBLE, lon DOUBLE, height DOUBLE, q INT, ns INT, "
    "sdn DOUBLE, sde DOUBLE, sdu DOUBLE, sdne DOUBLE, sdeu DOUBLE, sdun DOUBLE, age DOUBLE, ratio DOUBLE"
)
POS_FIXED = schema(
    "date STRING, time STRING, lat DOUBLE, lon DOUBLE, height DOUBLE, q INT, ns INT, sdn DOUBLE, sde DOUBLE, sdu DOUBLE, "
    "sdne DOUBLE, sdeu DOUBLE, sdun DOUBLE, age DOUBLE, ratio DOUBLE"
)
GATED_CSV = schema("lat DOUBLE, lon DOUBLE, timestamp BIGINT, hdop DOUBLE, sats INT")
CLEANED_CSV = schema("epoch BIGINT, lat DOUBLE, lon DOUBLE, height DOUBLE, Q INT")
PARTICLE_CSV = schema("lat DOUBLE, lon DOUBLE, particle_confidence DOUBLE, epoch BIGINT")
SMOOTHED_CSV = schema(
    "date STRING, time STRING, lat_raw DOUBLE, lon_raw DOUBLE, lat_smoothed DOUBLE, lon_smoothed DOUBLE, "
    "height_m DOUBLE, sdn_m DOUBLE, sde_m DOUBLE, interpolated INT"
)
FIXES_CSV = schema("utc STRING, lat DOUBLE, lon DOUBLE, height DOUBLE")
UI_POINT = schema("x DOUBLE, y DOUBLE, z DOUBLE, v DOUBLE, lat DOUBLE, lon DOUBLE, time STRING, milli BIGINT, file STRING, Surface STRING, Condition STRING")
CHANNEL_CSV = schema("key0 STRING, time STRING, value DOUBLE")
MERGED_TEXT = schema("t DOUBLE, x DOUBLE, y DOUBLE, z DOUBLE, lat DOUBLE, lon DOUBLE, speed DOUBLE, azimuth DOUBLE, pitch DOUBLE, roll DOUBLE, image_no INT")
TRAINING_TEXT = schema("rmsd_y FLOAT, rmsd_x FLOAT, rmsd_z FLOAT, speed FLOAT, class INT")
SENSOR_ROWS = schema("_id INT, x STRING, y STRING, z STRING, speed STRING, latitude STRING, longitude STRING, time STRING, location STRING, file STRING")
EDGES = schema("u BIGINT, v BIGINT, key INT, highway STRING, oneway BOOLEAN, coords ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>")
