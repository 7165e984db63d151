"""All registered queries of the media-stream library, with the SQL that checks them."""

from __future__ import annotations

from riffle.plans import continuity_queries, link_queries, long_queries, meta_queries, ordered_queries, packet_queries, reassembly_queries, residual_queries, signal_queries, sound_queries, syntax_queries, transport_queries, unit_queries

MODULES = [continuity_queries, ordered_queries, signal_queries, sound_queries, packet_queries, meta_queries, reassembly_queries, syntax_queries, transport_queries, unit_queries, residual_queries, long_queries, link_queries]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
#: Columns whose SQL type would differ from Spark's: the types that Spark gives.
TYPES = {
    "cc_shift_repair": "cc BIGINT, repaired_cc BIGINT", "di_update": "cc BIGINT", "ts_clocks": "pcr INTEGER, cc INTEGER", "rtp_clocks": "seq INTEGER", "amplify_clip": "pos INTEGER", "pcm_quantise": "pos INTEGER", "stereo_to_mono": "pos INTEGER",
    "scan_until": "size INTEGER", "frames_reassembled": "size INTEGER", "flv_tags": "size INTEGER", "psi_with_meta": "size INTEGER", "h264_split": "nals BIGINT", "h264_predicates": "n_units INTEGER, from_sps INTEGER", "mjpeg_split": "size INTEGER",
    "h264_units": "size INTEGER", "h265_units": "size INTEGER", "jpeg_scans": "size INTEGER", "exp_golomb": "n_bits INTEGER, pos INTEGER", "sps_parse": "width_mbs BIGINT, height_units BIGINT, width BIGINT, height BIGINT, n_mbs BIGINT", "amf_round_trip": "size INTEGER",
}


def typed(name: str, sql: str) -> str:
    casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in (x.split() for x in TYPES.get(name, "").split(", ") if x))
    return f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql


ORACLES = {name: typed(name, sql) for m in MODULES for name, sql in m.ORACLES.items()}
