import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riffle.functions import units


def read(spark, bits, syntax, **context):
    data = int(bits.replace(" ", "").ljust(-(-len(bits.replace(" ", "")) // 8) * 8, "0"), 2).to_bytes(-(-len(bits.replace(" ", "")) // 8), "big")
    known = F.create_map(*[x for k, v in context.items() for x in (F.lit(k), F.lit(v).cast("long"))]) if context else None
    r = spark.range(1).select(units.parsed(F.lit(data), syntax, known).alias("r")).first().r
    return r.fields, r.err


def test_extensions(spark):
    assert read(spark, "0 000010 0000000011 001 1 0 0", units.mvc_extension) == ({"non_idr": 0, "priority": 2, "view": 3, "temporal": 1, "anchor": 1, "inter_view": 0, "reserved": 0}, None)
    assert read(spark, "00000010 1 0 001 1 0", units.depth_extension)[0] == {"view_index": 2, "depth": 1, "non_idr": 0, "temporal": 1, "anchor": 1, "inter_view": 0}
    fields, err = read(spark, "0 000010 1 001 0010 010 1 0 1 11", units.svc_extension)
    assert fields == {"idr": 0, "priority": 2, "no_inter_layer": 1, "dependency": 1, "quality": 2, "temporal": 2, "use_base": 1, "discardable": 0, "output": 1, "reserved": 3} and err is None
    assert read(spark, "0 0000", units.mvc_extension)[1] == "ended early"


def test_weights_and_marks_of_a_b_slice(spark):
    fields, err = read(spark, "1 010 1 0001 1 1 010 010 0 0 010 1 1 1 0 0 1 010 1 1 1", units.slice_header, frame_num_bits=4, frames_only=1, order_type=2, weighted_b=1, nal_ref=0)
    assert err is None
    assert fields["slice_type"] == 1 and fields["frame_num"] == 1 and fields["refs0_less_1"] == fields["refs1_less_1"] == 1
    assert fields["luma_denominator"] == 1 and fields["luma_weighted0[0]"] == 1 and fields["luma_weight0[0]"] == 0 and fields["luma_weight1[1]"] == 1 and fields["qp_delta"] == 0 and "chroma_denominator" not in fields


def test_groups_of_each_map_unit(spark):
    fields, err = read(spark, "1 1 0 0 011 00111 010 00 01 1 1 0 00 1 1 1 0 0 0 1", units.picture_parameters)
    assert err is None and fields["more_groups"] == 2 and fields["map_type"] == 6 and fields["group[0]"] == 0 and fields["group[1]"] == 1 and "transform_8x8" not in fields


@pytest.mark.parametrize("syntax", [units.mvc_extension, units.depth_extension, units.svc_extension, units.picture_parameters, units.usability, units.slice_header])
def test_random_bytes_give_fields_or_an_error(syntax):
    rng = np.random.default_rng(1)
    names = "separate_planes frames_only order_type delta_always_zero chroma_format bottom_order_present redundant_present weighted weighted_b cabac deblocking_present more_groups map_type nal_ref".split()
    for size in [*range(60), 300, 2_000]:
        for density in (0.02, 0.5, 0.9):
            data = np.packbits(rng.random(8 * size) < density).tobytes()
            context = {n: int(rng.integers(0, 4)) for n in names} | {"frame_num_bits": 4, "order_bits": 6, "change_bits": 3, "nal_type": int(rng.integers(1, 6))}
            fields, err = units.read(data, syntax, context)
            assert err in (None, "ended early", "code too long")
            assert all(abs(v) < 1 << 34 for v in fields.values())


def test_codes_have_32_leading_zeros_at_most():
    long = (1).to_bytes(5, "big") + b"\xff" * 5  # 39 zeros before a one
    assert units.read(long, units.picture_parameters, {}) == ({}, "code too long")
    bits = "0" * 32 + "1" + "0" * 31 + "1" + "1" * 7
    fields, _ = units.read(int(bits, 2).to_bytes(9, "big"), units.picture_parameters, {})
    assert fields["id"] == 2**32
    assert units.read(b"\0\0", units.picture_parameters, {}) == ({}, "ended early")


def test_more_data_is_what_stands_before_the_stop_bit():
    texts = ("1", "10", "01", "0001", "1000000010", "0", "")
    cursor = units.Cursor(pa.array([int(t.ljust(16, "0"), 2).to_bytes(2, "big") if t else b"" for t in texts]))
    for at in range(16):
        cursor.at[:] = at
        assert cursor.more(cursor.all).tolist() == ["1" in t and at < t.rindex("1") for t in texts]


def codes(*values):
    """(code, number) pairs as bits."""
    out = ""
    for code, v in values:
        if code in ("ue", "se"):
            v = v if code == "ue" else 2 * v - 1 if v > 0 else -2 * v
            b = bin(v + 1)[2:]
            out += "0" * (len(b) - 1) + b
        else:
            out += bin(v)[2:].zfill(code)
    return out


@pytest.mark.parametrize("profile", [66, 100, 244])
@pytest.mark.parametrize("order", [0, 1, 2])
def test_sequence_parameters_of_all_profiles(profile, order):
    fields = [("profile", 8, profile), ("constraints", 8, 3), ("level", 8, 31), ("id", "ue", 5)]
    if profile != 66:
        fields += [("chroma_format", "ue", 3 if profile == 244 else 1)] + [("separate_planes", 1, 0)] * (profile == 244)
        fields += [("luma_depth_less_8", "ue", 2), ("chroma_depth_less_8", "ue", 1), ("bypass", 1, 0), ("scaling_matrix", 1, 1)]
        for i in range(12 if profile == 244 else 8):
            fields.append((f"scaling_present[{i}]", 1, i % 2))
            if i % 2:
                fields += [(f"scaling[{i}][0]", "se", 4), (f"scaling[{i}][1]", "se", -12)]  # 8 + 4 - 12: the list ends
    fields += [("frame_num_bits_less_4", "ue", 4), ("order_count_type", "ue", order)]
    fields += {0: [("order_bits_less_4", "ue", 2)], 1: [("delta_always_zero", 1, 1), ("offset_not_reference", "se", -7), ("offset_top_to_bottom", "se", 2), ("cycle", "ue", 2), ("offset_reference[0]", "se", 9), ("offset_reference[1]", "se", -1)], 2: []}[order]
    fields += [("ref_frames", "ue", 4), ("gaps", 1, 0), ("width_less_1", "ue", 119), ("height_less_1", "ue", 67), ("frames_only", 1, 0), ("adaptive", 1, 1), ("direct_8x8", 1, 1), ("cropping", 1, 1)]
    fields += [("crop_left", "ue", 0), ("crop_right", "ue", 0), ("crop_top", "ue", 0), ("crop_bottom", "ue", 4), ("vui_present", 1, 1), ("aspect_present", 1, 1), ("aspect", 8, 255), ("sar_width", 16, 4), ("sar_height", 16, 3)]
    fields += [(n, 1, 0) for n in ("overscan_present", "signal_present", "chroma_place_present", "timing_present", "nal_hrd_present", "vcl_hrd_present", "picture_structure", "restricted")]
    text = codes(*[(c, v) for _, c, v in fields]) + "1"
    data = int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
    assert units.read(data, units.sequence_parameters) == ({n: v for n, _, v in fields}, None)
    assert units.read(data[:3], units.sequence_parameters)[1] == "ended early"


def test_units_of_a_batch_do_not_disturb_each_other():
    rng = np.random.default_rng(7)
    data = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in rng.integers(0, 40, 300)]
    names = ("frame_num_bits", "order_bits", "chroma_format", "weighted", "weighted_b", "nal_ref", "refs0_less_1")
    contexts = [{n: int(rng.integers(0, 5)) for n in names} for _ in data]
    for syntax in (units.slice_header, units.picture_parameters, units.usability, units.sequence_parameters):
        cursor = units.Cursor(pa.array([None, *data]).slice(1), pa.array([None, *[list(c.items()) for c in contexts]], pa.map_(pa.string(), pa.int64())).slice(1))
        syntax(cursor)
        assert [(dict(r["fields"]), r["err"]) for r in cursor.result().to_pylist()] == [units.read(d, syntax, c) for d, c in zip(data, contexts, strict=True)]
