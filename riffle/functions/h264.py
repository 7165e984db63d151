"""Pieces of H.264 syntax as Column expressions: Exp-Golomb codes, headers, geometry, slice group maps and binarisations.

Bits are text of 0 and 1. What needs a decoder that never gives a picture (macroblock layer, arithmetic decoding) is not here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riffle.functions.bytesx import let

# Coded block pattern of each code number, for intra and inter prediction, with chroma of half resolution and without or with full chroma.
CBP = {
    (True, True): (47, 31, 15, 0, 23, 27, 29, 30, 7, 11, 13, 14, 39, 43, 45, 46, 16, 3, 5, 10, 12, 19, 21, 26, 28, 35, 37, 42, 44, 1, 2, 4, 8, 17, 18, 20, 24, 6, 9, 22, 25, 32, 33, 34, 36, 40, 38, 41),
    (True, False): (0, 16, 1, 2, 4, 8, 32, 3, 5, 10, 12, 15, 47, 7, 11, 13, 14, 6, 9, 31, 35, 37, 42, 44, 33, 34, 36, 40, 39, 43, 45, 46, 17, 18, 20, 24, 19, 21, 26, 28, 23, 27, 29, 30, 22, 25, 38, 41),
    (False, True): (15, 0, 7, 11, 13, 14, 3, 5, 10, 12, 1, 2, 4, 8, 6, 9),
    (False, False): (0, 1, 2, 4, 8, 3, 5, 10, 12, 15, 7, 11, 13, 14, 6, 9),
}
# Names of macroblock types of P and B slices.
P_TYPES = ("P_L0_16x16", "P_L0_L0_16x8", "P_L0_L0_8x16", "P_8x8", "P_8x8ref0")
B_TYPES = (
    "B_Direct_16x16", "B_L0_16x16", "B_L1_16x16", "B_Bi_16x16", "B_L0_L0_16x8", "B_L0_L0_8x16", "B_L1_L1_16x8", "B_L1_L1_8x16", "B_L0_L1_16x8", "B_L0_L1_8x16", "B_L1_L0_16x8", "B_L1_L0_8x16",
    "B_L0_Bi_16x8", "B_L0_Bi_8x16", "B_L1_Bi_16x8", "B_L1_Bi_8x16", "B_Bi_L0_16x8", "B_Bi_L0_8x16", "B_Bi_L1_16x8", "B_Bi_L1_8x16", "B_Bi_Bi_16x8", "B_Bi_Bi_8x16", "B_8x8",
)


def ue_bits(v: Column) -> Column:
    """An unsigned number as an Exp-Golomb code."""
    b = F.bin(v.cast("long") + 1)
    return F.lpad(b, 2 * F.length(b) - 1, F.lit("0"))


def se_bits(v: Column) -> Column:
    return ue_bits(F.when(v > 0, v * 2 - 1).otherwise(v * -2))


def signed(code: Column) -> Column:
    """The signed number of a code number: 0, 1, -1, 2, -2 and so on."""
    return F.when(code % 2 == 1, F.floor((code + 1) / 2)).otherwise(-F.floor(code / 2)).cast("long")


def te_value(bits: Column, most: Column) -> Column:
    """A truncated code at the start of the bits: with a largest value of 1 it is one bit, inverted."""
    return F.when(most > 1, F.get(ue_values(bits, F.lit(1)), F.lit(0))).when(most == 1, F.when(F.startswith(bits, F.lit("0")), 1).otherwise(0))


def ue_values(bits: Column, n: Column) -> Column:
    """The first ``n`` Exp-Golomb codes; fewer where the bits end."""
    kind = "struct<at:int,found:array<bigint>>"

    def read(s: Column, _: Column) -> Column:
        zeros = F.locate("1", F.substring(bits, s["at"], F.lit(80))) - 1

        def take(z: Column) -> Column:
            code = F.substring(bits, s["at"] + z, z + 1)
            ok = (z >= 0) & (F.length(code) == z + 1)
            return F.when(ok, F.struct((s["at"] + 2 * z + 1).cast("int").alias("at"), F.concat(s["found"], F.array((F.conv(code, 2, 10).cast("long") - 1))).alias("found")).cast(kind)).otherwise(s)

        return let(zeros, take)

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<bigint>").alias("found")).cast(kind)
    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, read)["found"]


def sps_fields(bits: Column) -> Column:
    """Of the bits of a baseline SPS (behind the NAL header): profile, level, ids, sizes in macroblocks and the frame flag. Order count types 0 and 2."""
    number = lambda a, n: F.conv(F.substring(bits, a + 1, n), 2, 10).cast("int")
    width = lambda v: 2 * F.length(F.bin(v + 1)) - 1
    beyond = lambda text, codes: F.substring(text, F.aggregate(codes, F.lit(1), lambda a, v: (a + width(v)).cast("int")), F.lit(1 << 30))

    def with_ids(v: Column) -> Column:
        """Three codes, and a fourth for the size of order counts of type 0; then the reference frames and the gaps flag."""
        after = beyond(v["rest"], F.slice(v["codes"], F.lit(1), F.when(v["codes"][2] == 0, 4).otherwise(3)))
        return let(F.struct(v["codes"].alias("codes"), after.alias("after")), lambda w: let(F.struct(w["codes"].alias("codes"), w["after"].alias("after"), ue_values(w["after"], F.lit(1)).alias("frames")), with_frames))

    def with_frames(v: Column) -> Column:
        then = F.substring(beyond(v["after"], v["frames"]), F.lit(2), F.lit(1 << 30))
        return let(F.struct(v["codes"].alias("codes"), v["frames"].alias("frames"), then.alias("then")), lambda w: let(F.struct(w["codes"].alias("codes"), w["frames"].alias("frames"), w["then"].alias("then"), ue_values(w["then"], F.lit(2)).alias("size")), result))

    def result(v: Column) -> Column:
        flag = F.substring(beyond(v["then"], v["size"]), F.lit(1), F.lit(1)) == "1"
        return F.struct(number(0, 8).alias("profile"), number(16, 8).alias("level"), v["codes"][0].alias("sps_id"), v["codes"][2].alias("order_count_type"), v["frames"][0].alias("ref_frames"), (v["size"][0] + 1).alias("width_mbs"), (v["size"][1] + 1).alias("height_units"), flag.alias("frame_mbs_only"))

    rest = F.substring(bits, F.lit(25), F.lit(1 << 30))
    return let(F.struct(rest.alias("rest"), ue_values(rest, F.lit(4)).alias("codes")), with_ids)


def picture_size(width_mbs: Column, height_units: Column, frame_mbs_only: Column) -> dict[str, Column]:
    """Luma samples and macroblocks of a frame."""
    rows = height_units * F.when(frame_mbs_only, 1).otherwise(2)
    return {"width": width_mbs * 16, "height": rows * 16, "n_mbs": width_mbs * rows}


def interleaved_groups(n_units: Column, run_lengths: Column) -> Column:
    """Slice group of each map unit, map type 0: runs of the given lengths in turn."""
    total = F.aggregate(run_lengths, F.lit(0).cast("long"), lambda a, r: a + r)
    ends = F.transform(run_lengths, lambda r, i: F.aggregate(F.slice(run_lengths, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    return F.transform(F.sequence(F.lit(0), (n_units - 1).cast("int")), lambda i: F.size(F.filter(ends, lambda e: e <= i % total)))


def dispersed_groups(n_units: Column, width_mbs: Column, groups: Column) -> Column:
    """Map type 1."""
    return F.transform(F.sequence(F.lit(0), (n_units - 1).cast("int")), lambda i: ((i % width_mbs + F.floor(F.floor(i / width_mbs) * groups / 2)) % groups).cast("int"))


def foreground_groups(n_units: Column, width_mbs: Column, top_left: Column, bottom_right: Column) -> Column:
    """Map type 2: rectangles of map units between two corners, the ones of smaller number in front; what is left belongs to the last group."""

    def group(unit: Column) -> Column:
        x, y = unit % width_mbs, F.floor(unit / width_mbs)

        def inside(g: Column) -> Column:
            first, last = F.get(top_left, g), F.get(bottom_right, g)
            return (x >= first % width_mbs) & (x <= last % width_mbs) & (y >= F.floor(first / width_mbs)) & (y <= F.floor(last / width_mbs))

        at = F.transform(top_left, lambda _, g: F.when(inside(g), g))
        return F.coalesce(F.array_min(at), F.size(top_left)).cast("int")

    return F.transform(F.sequence(F.lit(0), (n_units - 1).cast("int")), group)


def order_count_idr(kind: Column, lsb: Column, bottom_delta: Column) -> dict[str, Column]:
    """Picture order counts of an IDR picture: the reference can be nothing but zero."""
    return {"top": F.when(kind == 0, lsb).otherwise(0), "bottom": F.when(kind == 0, lsb + bottom_delta).otherwise(0)}


def coded_block(cbp: Column) -> dict[str, Column]:
    return {"luma": cbp % 16, "chroma": F.floor(cbp / 16)}


def clip3(low: Column, high: Column, v: Column) -> Column:
    return F.greatest(low, F.least(high, v))


def unary(v: Column) -> Column:
    return F.concat(F.repeat(F.lit("1"), v.cast("int")), F.lit("0"))


def truncated_unary(v: Column, most: Column) -> Column:
    return F.when(v < most, unary(v)).when(v == most, F.repeat(F.lit("1"), v.cast("int")))


def fixed_length(v: Column, most: Column) -> Column:
    """In as many bits as the largest value needs."""
    return F.lpad(F.bin(v.cast("long")), F.ceil(F.log2(most + F.lit(1))).cast("int"), F.lit("0"))


def ueg(v: Column, cut: int, k: int, with_sign: bool) -> Column:
    """A truncated unary prefix up to ``cut``, an Exp-Golomb suffix of order ``k``, and a sign."""
    size = F.abs(v)
    rest = size - cut
    # the suffix: groups grow by one bit as long as the rest does not fit
    steps = F.floor(F.log2(F.shiftright(rest, k) + F.lit(1))).cast("int") if k else F.floor(F.log2(rest + F.lit(1))).cast("int")
    bits = steps + k
    left = rest - (F.pow(F.lit(2.0), bits).cast("long") - (1 << k))
    suffix = F.concat(F.repeat(F.lit("1"), steps), F.lit("0"), F.when(bits > 0, F.lpad(F.bin(left.cast("long")), bits, F.lit("0"))).otherwise(""))
    body = F.when(size < cut, unary(size)).otherwise(F.concat(F.repeat(F.lit("1"), F.lit(cut)), suffix))
    return F.concat(body, F.when(v > 0, "0").when(v < 0, "1").otherwise("")) if with_sign else body


def me_value(code: Column, half_chroma: bool, intra: bool) -> Column:
    """The coded block pattern of a code number; null beyond the table."""
    return F.get(F.array(*map(F.lit, CBP[half_chroma, intra])), code.cast("int"))


def macroblock_name(slice_type: Column, kind: Column) -> Column:
    """The name of a macroblock type. Behind the types of P and B slices come those of I slices, whose names follow from the number."""
    own = F.when(slice_type == "P", F.get(F.array(*map(F.lit, P_TYPES)), kind.cast("int"))).when(slice_type == "B", F.get(F.array(*map(F.lit, B_TYPES)), kind.cast("int")))
    i = kind - F.when(slice_type == "P", len(P_TYPES)).when(slice_type == "B", len(B_TYPES)).otherwise(0)
    j = i - 1
    text = lambda v: v.cast("int").cast("string")
    whole = F.concat(F.lit("I_16x16_"), text(j % 4), F.lit("_"), text(F.floor(j / 4) % 3), F.lit("_"), F.when(j >= 12, "1").otherwise("0"))
    return F.coalesce(own, F.when(i == 0, "I_NxN").when(i == 25, "I_PCM").when((i > 0) & (i < 25), whole))


def prediction_mode(slice_type: Column, kind: Column, large_transform: Column, partition: Column | None = None) -> Column:
    """``mode, err`` of the first partition of a macroblock; types without one mode, other partitions and unknown slices give an error."""
    intra = F.when(kind == 0, F.when(large_transform, "Intra_8x8").otherwise("Intra_4x4")).when((kind > 0) & (kind < 25), "Intra_16x16")
    one = F.when((kind >= 0) & ~kind.isin(3, 4), "Pred_L0")
    two = F.when(kind.isin(1, 4, 5, 8, 9, 12, 13), "Pred_L0").when(kind.isin(2, 6, 7, 10, 11, 14, 15), "Pred_L1").when((kind == 3) | kind.between(16, 21), "BiPred").when(kind == 22, None).otherwise("Direct")
    mode = F.when(slice_type == "I", intra).when(slice_type == "SI", F.when(kind == 0, "Intra_4x4")).when(slice_type.isin("P", "SP"), one).when(slice_type == "B", two)
    other = F.lit(False) if partition is None else partition != 0
    err = F.when(other, "not the first partition").when(~slice_type.isin("I", "SI", "P", "SP", "B"), "unknown slice type").when(mode.isNull(), "no mode for this type")
    return F.struct(F.when(err.isNull(), mode).alias("mode"), err.alias("err"))


def chroma_size(chroma_format: Column, separate_planes: Column) -> dict[str, Column]:
    """Chroma samples of a macroblock: formats 1 to 3 are 4:2:0, 4:2:2 and 4:4:4."""
    none = (chroma_format == 0) | separate_planes
    return {"chroma_width": F.when(none, 0).when(chroma_format == 3, 16).otherwise(8), "chroma_height": F.when(none, 0).when(chroma_format == 1, 8).otherwise(16)}


def layer_offset(reference: Column, size: Column) -> Column:
    """Offset of a sample from the macroblock of a reference layer; ``reference`` counts sixteenths, ``size`` is the macroblock's."""
    return F.shiftleft(F.shiftright((reference - 64).cast("long"), 8), 4) - F.shiftright(size.cast("long"), 1)


def layer_place(at: Column, offset: Column, size: Column) -> Column:
    """The place in that macroblock."""
    return (at + offset) % size


def layer_distance(place: Column, size: Column) -> Column:
    """The distance to the nearer edge: negative in the upper half."""
    return F.when(place >= F.floor(size / 2), place - size).otherwise(place + 1)


def layer_neighbour(distance: Column, size: Column, sign: Column) -> Column:
    return distance - (F.floor(size / 2) + 1) * sign


def context_state(m: Column, n: Column, slice_qp: Column) -> Column:
    """The starting state of an arithmetic coding context, before it is split into index and most probable symbol."""
    return clip3(F.lit(1), F.lit(126), F.shiftright(m * clip3(F.lit(0), F.lit(51), slice_qp), 4) + n)
