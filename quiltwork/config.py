"""Constants that are part of the semantics (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    lat_m: float = 110540.0
    lng_m: float = 111320.0
    server_lat_km: float = 110.574
    server_lng_km: float = 111.320
    max_area_km2: float = 50.0
    max_partitions: int = 200
    route_budget: int = 5000
    snap_reach_m: float = 500.0
    sliver_m2: float = 25.0
    territory_fraction: float = 0.05
    passes: int = 5
    gap_floor_m2: float = 200.0
    remainder_m2: float = 50.0
    slice_m2: float = 1.0
    slice_share: float = 0.02
    cell_m: float = 10.0
    cell_cap: int = 400_000
    reach_m: float = 60.0
    outlier_k: int = 3
    outlier_factor: float = 3.0
    outlier_floor_m: float = 120.0
    outlier_link: float = 1.5
    outlier_span: float = 0.025
    outlier_group: int = 8
    snap_node: float = 0.6
    snap_edge: float = 1.7
    detour_ratio: float = 1.75
    detour_extra_m: float = 300.0
    cache_days: int = 60
    max_zoom: int = 19
    lru_size: int = 256
    geocode_interval_s: int = 1
    history: int = 30
    bridge_groups: int = 40
    bridge_rounds: int = 3
    highways: tuple[str, ...] = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential")
    retryable: tuple[int, ...] = (408, 425, 429, 500, 502, 503, 504)
    payload_version: int = 3


CONFIG = Config()
