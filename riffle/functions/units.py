"""Syntax of H.264 units whose fields depend on each other: sequence and picture parameter sets, usability information, slice headers and header extensions.

A syntax is a function that asks a cursor for fields by name and code; the cursor reads the field of all units of a batch at
once, at the place that each has come to, and gives their values as an array. Conditions are masks over the units. The
result is ``fields``, a map of name to number in which the elements of lists have their place in brackets, and ``err`` where
the bytes end early or hold a code of more than 32 leading zeros; fields before the fault are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "struct<fields:map<string,bigint>,err:string>"
#: Leading zeros of a code at most: numbers of the syntax have 32 bits.
MOST_ZEROS = 32
ERRORS = (None, "ended early", "code too long", "no such token", "invalid context number", "invalid state")
Mask = np.ndarray
Syntax = Callable[["Cursor"], None]


class Cursor:
    """Reads many units from their starts, a field at a time."""

    def __init__(self, data: pa.Array, context: pa.Array | None = None):
        data = data.fill_null(b"").cast(pa.large_binary())
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        flat = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(data) and data.buffers()[2] else np.zeros(0, np.uint8)
        self.start, self.size = offsets[:-1] - offsets[0], 8 * np.diff(offsets)
        self.flat = np.concatenate([flat, np.zeros(16, np.uint8)])
        self.all = np.ones(len(data), bool)
        self.at = np.zeros(len(data), np.int64)
        self.fault = np.zeros(len(data), np.int8)
        self.found: list[tuple[str, np.ndarray, np.ndarray]] = []
        self.context = context
        ones = np.flatnonzero(flat)
        last = np.searchsorted(ones, offsets[1:] - offsets[0]) - 1
        byte = ones[np.maximum(last, 0)] if len(ones) else np.zeros(len(data), np.int64)
        lowest = np.frexp((self.flat[byte] & -self.flat[byte].astype(np.int16)).astype(float))[1]
        #: The place of the last one of each unit, the stop bit.
        self.stop = np.where((last >= 0) & (byte >= self.start), 8 * (byte - self.start + 1) - lowest, 0)

    def known(self, name: str) -> np.ndarray:
        """A number of the context; 0 where it is not named."""
        out = np.zeros(len(self.at), np.int64)
        if self.context is not None and len(self.context):
            offsets = self.context.offsets.to_numpy()
            keys = self.context.keys.slice(offsets[0], offsets[-1] - offsets[0])
            own = np.flatnonzero(np.array(pa.compute.equal(keys, name).fill_null(False)))
            items = self.context.items.slice(offsets[0], offsets[-1] - offsets[0]).fill_null(0).to_numpy(zero_copy_only=False)
            out[np.searchsorted(offsets[1:] - offsets[0], own, side="right")] = items[own]
        return out

    def _peek(self, rows: np.ndarray, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """``n`` bits, 33 at most, at place ``at`` of each unit of ``rows``."""
        first = np.minimum(self.start[rows] + (at >> 3), len(self.flat) - 8)
        word = self.flat[first[:, None] + np.arange(8)].view(">u8")[:, 0].astype(np.uint64)
        word = word << (at & 7).astype(np.uint64)
        n = np.broadcast_to(np.asarray(n, np.uint64), word.shape)
        return np.where(n > 0, word >> (np.uint64(64) - np.maximum(n, np.uint64(1))), 0).astype(np.int64)

    def _keep(self, name: str, rows: np.ndarray, value: np.ndarray) -> np.ndarray:
        if name:
            self.found.append((name, rows, value))
        out = np.zeros(len(self.at), np.int64)
        out[rows] = value
        return out

    def bits(self, name: str, n: np.ndarray | int, where: Mask) -> np.ndarray:
        """A number of ``n`` bits."""
        rows = np.flatnonzero(where & (self.fault == 0))
        n = n[rows] if isinstance(n, np.ndarray) else np.full(len(rows), n)
        fine = self.at[rows] + n <= self.size[rows]
        self.fault[rows[~fine]] = 1
        rows, n = rows[fine], n[fine]
        value = self._peek(rows, self.at[rows], n)
        self.at[rows] += n
        return self._keep(name, rows, value)

    def ue(self, name: str, where: Mask, with_sign: bool = False) -> np.ndarray:
        """An Exp-Golomb code."""
        rows = np.flatnonzero(where & (self.fault == 0))
        left = self.size[rows] - self.at[rows]
        ahead = np.minimum(MOST_ZEROS + 1, left)
        zeros = ahead - np.frexp(self._peek(rows, self.at[rows], ahead).astype(float))[1]
        fault = np.where(zeros < ahead, np.where(2 * zeros + 1 > left, 1, 0), np.where(ahead > MOST_ZEROS, 2, 1))
        self.fault[rows] = fault
        rows, zeros = rows[fault == 0], zeros[fault == 0]
        value = self._peek(rows, self.at[rows] + zeros, zeros + 1) - 1
        self.at[rows] += 2 * zeros + 1
        return self._keep(name, rows, np.where(value % 2 == 1, (value + 1) // 2, -(value // 2)) if with_sign else value)

    def zeros(self, where: Mask) -> np.ndarray:
        """The number of zeros before a one, which is read too."""
        rows = np.flatnonzero(where & (self.fault == 0))
        left = self.size[rows] - self.at[rows]
        ahead = np.minimum(MOST_ZEROS + 1, left)
        zeros = ahead - np.frexp(self._peek(rows, self.at[rows], ahead).astype(float))[1]
        fault = np.where(zeros < ahead, 0, np.where(ahead > MOST_ZEROS, 2, 1))
        self.fault[rows] = fault
        rows, zeros = rows[fault == 0], zeros[fault == 0]
        self.at[rows] += zeros + 1
        return self._keep("", rows, zeros)

    def lookup(self, tables: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
        """What ``tables[kind]`` has for the next 16 bits: the length of a code, which is read, and numbers."""
        rows = np.flatnonzero(self.fault == 0)
        left = self.size[rows] - self.at[rows]
        word = self._peek(rows, self.at[rows], 16)
        word = word >> np.maximum(16 - left, 0) << np.maximum(16 - left, 0)  # what is behind the end counts as zeros
        found = tables[kind[rows], word]
        length = found[:, 0]
        fault = np.where((length > left) | ((length == 0) & (left < 16)), 1, np.where(length == 0, ERRORS.index("no such token"), 0))
        self.fault[rows] = fault
        rows, found = rows[fault == 0], found[fault == 0]
        self.at[rows] += found[:, 0]
        return tuple(self._keep("", rows, found[:, i]) for i in range(1, found.shape[1]))

    def se(self, name: str, where: Mask) -> np.ndarray:
        return self.ue(name, where, True)

    def each(self, where: Mask, *fields: tuple[str, object]) -> None:
        """Fields one after another: a number of bits, "ue" or "se"."""
        for name, code in fields:
            if code in ("ue", "se"):
                self.ue(name, where, code == "se")
            else:
                self.bits(name, code, where)

    def more(self, where: Mask) -> Mask:
        """Whether data is left before the stop bit."""
        return where & (self.fault == 0) & (self.at < self.stop)

    def turns(self, n: np.ndarray, where: Mask) -> Iterator[tuple[int, Mask]]:
        """0, 1, 2 and so on with the units that have as many turns."""
        i = 0
        while (now := where & (self.fault == 0) & (i < n)).any():
            yield i, now
            i += 1

    def result(self) -> pa.Array:
        rows = np.concatenate([r for _, r, _ in self.found] or [np.zeros(0, np.int64)])
        order = np.argsort(rows, kind="stable")
        names = np.repeat(np.arange(len(self.found)), [len(r) for _, r, _ in self.found])[order]
        keys = pa.array([n for n, _, _ in self.found], pa.string()).take(pa.array(names))
        values = np.concatenate([v for _, _, v in self.found] or [np.zeros(0, np.int64)])[order]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(self.at)))]).astype(np.int32)
        maps = pa.MapArray.from_arrays(pa.array(offsets), keys, pa.array(values))
        return pa.StructArray.from_arrays([maps, pa.array(ERRORS, pa.string()).take(pa.array(self.fault))], names=["fields", "err"])


    def columns(self, names: list[str]) -> list[pa.Array]:
        """Some fields as arrays, null where a unit lacks them, and the number of fields of each unit."""
        out = {n: (np.zeros(len(self.at), np.int64), np.ones(len(self.at), bool)) for n in names}
        count = np.zeros(len(self.at), np.int32)
        for name, rows, value in self.found:
            count[rows] += 1
            if name in out:
                out[name][0][rows] = value
                out[name][1][rows] = False
        return [*[pa.array(v, mask=missing) for v, missing in out.values()], pa.array(count)]


def read(data: bytes, syntax: Syntax, context: dict[str, int] | None = None) -> tuple[dict[str, int], str | None]:
    """The fields of one unit, and what is wrong with it."""
    cursor = Cursor(pa.array([data]), pa.array([list((context or {}).items())], pa.map_(pa.string(), pa.int64())))
    syntax(cursor)
    r = cursor.result()[0].as_py()
    return dict(r["fields"]), r["err"]


def parsed(data: Column, syntax: Syntax, context: Column | None = None) -> Column:
    """``fields, err`` of payload bytes. context: a map of numbers from other units that the syntax depends on."""

    @F.arrow_udf(KIND)
    def run(column: pa.Array, known: pa.Array) -> pa.Array:
        cursor = Cursor(column, known)
        syntax(cursor)
        return cursor.result()

    return run(data, context if context is not None else F.create_map().cast("map<string,bigint>"))


def fields_of(data: Column, syntax: Syntax, names: dict[str, str], context: Column | None = None) -> Column:
    """Some fields, under names of their own, with ``n_fields`` and ``err``, where those are known that are wanted; cheaper than ``parsed``."""
    labels = [*names.values(), "n_fields", "err"]

    @F.arrow_udf(f"struct<{', '.join(f'`{a}`:bigint' for a in names.values())}, n_fields:int, err:string>")
    def run(column: pa.Array, known: pa.Array) -> pa.Array:
        cursor = Cursor(column, known)
        syntax(cursor)
        return pa.StructArray.from_arrays([*cursor.columns(list(names)), pa.array(ERRORS, pa.string()).take(pa.array(cursor.fault))], names=labels)

    return run(data, context if context is not None else F.create_map().cast("map<string,bigint>"))


def mvc_extension(c: Cursor) -> None:
    c.each(c.all, ("non_idr", 1), ("priority", 6), ("view", 10), ("temporal", 3), ("anchor", 1), ("inter_view", 1), ("reserved", 1))


def depth_extension(c: Cursor) -> None:
    c.each(c.all, ("view_index", 8), ("depth", 1), ("non_idr", 1), ("temporal", 3), ("anchor", 1), ("inter_view", 1))


def svc_extension(c: Cursor) -> None:
    c.each(c.all, ("idr", 1), ("priority", 6), ("no_inter_layer", 1), ("dependency", 3), ("quality", 4), ("temporal", 3), ("use_base", 1), ("discardable", 1), ("output", 1), ("reserved", 2))


def _scaling_lists(c: Cursor, n: np.ndarray, where: Mask) -> None:
    """``n`` lists: six of 16 numbers, then of 64. A list ends where the number that would follow is 0."""
    for i, own in c.turns(n, where):
        present = own & (c.bits(f"scaling_present[{i}]", 1, own) == 1)
        last = following = np.full(len(own), 8)
        for j in range(16 if i < 6 else 64):
            if not (now := present & (following != 0)).any():
                break
            following = np.where(now, (last + c.se(f"scaling[{i}][{j}]", now)) % 256, following)
            last = np.where(following != 0, following, last)


#: Profiles whose sequence parameters name a chroma format and bit depths.
HIGH_PROFILES = (100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135)


def sequence_parameters(c: Cursor) -> None:
    """Of all profiles, order count types and crops, with usability information at the end."""
    w = c.all
    profile = c.bits("profile", 8, w)
    c.each(w, ("constraints", 8), ("level", 8), ("id", "ue"))
    high = np.isin(profile, HIGH_PROFILES)
    colour = c.ue("chroma_format", high)
    c.bits("separate_planes", 1, high & (colour == 3))
    c.each(high, ("luma_depth_less_8", "ue"), ("chroma_depth_less_8", "ue"), ("bypass", 1))
    _scaling_lists(c, np.where(colour == 3, 12, 8), high & (c.bits("scaling_matrix", 1, high) == 1))
    c.ue("frame_num_bits_less_4", w)
    order = c.ue("order_count_type", w)
    c.ue("order_bits_less_4", order == 0)
    one = order == 1
    c.each(one, ("delta_always_zero", 1), ("offset_not_reference", "se"), ("offset_top_to_bottom", "se"))
    for i, own in c.turns(c.ue("cycle", one), one):
        c.se(f"offset_reference[{i}]", own)
    c.each(w, ("ref_frames", "ue"), ("gaps", 1), ("width_less_1", "ue"), ("height_less_1", "ue"))
    frames = c.bits("frames_only", 1, w)
    c.bits("adaptive", 1, frames == 0)
    c.bits("direct_8x8", 1, w)
    crop = c.bits("cropping", 1, w) == 1
    c.each(crop, ("crop_left", "ue"), ("crop_right", "ue"), ("crop_top", "ue"), ("crop_bottom", "ue"))
    _usability(c, c.bits("vui_present", 1, w) == 1)


def picture_parameters(c: Cursor) -> None:
    """context: ``chroma_format`` of the sequence, 1 unless it is 3."""
    w = c.all
    c.each(w, ("id", "ue"), ("sps_id", "ue"), ("cabac", 1), ("bottom_order_present", 1))
    groups = c.ue("more_groups", w)
    several = groups > 0
    kind = c.ue("map_type", several)
    for i, own in c.turns(groups + 1, several & (kind == 0)):
        c.ue(f"run_length_less_1[{i}]", own)
    for i, own in c.turns(groups, several & (kind == 2)):
        c.each(own, (f"top_left[{i}]", "ue"), (f"bottom_right[{i}]", "ue"))
    c.each(several & (kind >= 3) & (kind <= 5), ("change_direction", 1), ("change_rate_less_1", "ue"))
    six = several & (kind == 6)
    width = np.frexp(groups.astype(float))[1]  # as many bits as the largest group number has
    for i, own in c.turns(c.ue("map_units_less_1", six) + 1, six):
        c.bits(f"group[{i}]", np.minimum(width, MOST_ZEROS), own)
    c.each(w, ("refs0_less_1", "ue"), ("refs1_less_1", "ue"), ("weighted", 1), ("weighted_b", 2), ("qp_less_26", "se"), ("qs_less_26", "se"), ("chroma_offset", "se"))
    c.each(w, ("deblocking_present", 1), ("constrained_intra", 1), ("redundant_present", 1))
    more = c.more(w)
    large = c.bits("transform_8x8", 1, more)
    lists = 6 + np.where(c.known("chroma_format") == 3, 6, 2) * large
    _scaling_lists(c, lists, more & (c.bits("scaling_matrix", 1, more) == 1))
    c.se("second_chroma_offset", more)


def _reference_decoder(c: Cursor, name: str, where: Mask) -> None:
    n = c.ue(f"{name}.buffers_less_1", where)
    c.each(where, (f"{name}.rate_scale", 4), (f"{name}.size_scale", 4))
    for i, own in c.turns(n + 1, where):
        c.each(own, (f"{name}.rate_less_1[{i}]", "ue"), (f"{name}.size_less_1[{i}]", "ue"), (f"{name}.constant[{i}]", 1))
    c.each(where, *[(f"{name}.{field}", 5) for field in ("initial_delay_bits_less_1", "delay_bits_less_1", "output_delay_bits_less_1", "time_offset_bits")])


def _usability(c: Cursor, w: Mask) -> None:
    flag = lambda name, where: where & (c.bits(name, 1, where) == 1)
    extended = c.bits("aspect", 8, flag("aspect_present", w)) == 255
    c.each(extended, ("sar_width", 16), ("sar_height", 16))
    c.bits("overscan_fits", 1, flag("overscan_present", w))
    signal = flag("signal_present", w)
    c.each(signal, ("format", 3), ("full_range", 1))
    c.each(flag("colour_present", signal), ("primaries", 8), ("transfer", 8), ("matrix", 8))
    c.each(flag("chroma_place_present", w), ("chroma_top", "ue"), ("chroma_bottom", "ue"))
    c.each(flag("timing_present", w), ("units_in_tick", 32), ("time_scale", 32), ("fixed_rate", 1))
    nal = flag("nal_hrd_present", w)
    _reference_decoder(c, "nal_hrd", nal)
    vcl = flag("vcl_hrd_present", w)
    _reference_decoder(c, "vcl_hrd", vcl)
    c.bits("low_delay", 1, nal | vcl)
    c.bits("picture_structure", 1, w)
    c.each(flag("restricted", w), ("vectors_over_edges", 1), *[(f, "ue") for f in ("bytes_denominator", "bits_denominator", "vector_bits_x", "vector_bits_y", "reorder_frames", "buffered_frames")])


def usability(c: Cursor) -> None:
    """Video usability information of a sequence, with the reference decoder's parameters in it."""
    _usability(c, c.all)


P, B, I, SP, SI = range(5)


def slice_header(c: Cursor) -> None:
    """context: ``nal_type``, ``nal_ref`` and fields of the parameter sets: ``separate_planes, frame_num_bits, frames_only, order_type, order_bits,
    delta_always_zero, chroma_format, bottom_order_present, redundant_present, refs0_less_1, refs1_less_1, weighted, weighted_b, cabac,
    deblocking_present, more_groups, map_type, change_bits``; 0 unless they are named. Sizes in bits count up to 32."""
    k, w = c.known, c.all
    size = lambda name: np.clip(k(name), 0, MOST_ZEROS)
    c.ue("first_mb", w)
    kind = c.ue("slice_type", w) % 5
    c.ue("pps_id", w)
    c.bits("colour_plane", 2, k("separate_planes") != 0)
    c.bits("frame_num", size("frame_num_bits"), w)
    field = c.bits("field", 1, k("frames_only") == 0)
    c.bits("bottom", 1, field == 1)
    idr, both = k("nal_type") == 5, (k("bottom_order_present") != 0) & (field == 0)
    c.ue("idr_id", idr)
    order = k("order_type")
    c.bits("order_lsb", size("order_bits"), order == 0)
    c.se("delta_bottom", (order == 0) & both)
    deltas = (order == 1) & (k("delta_always_zero") == 0)
    c.se("delta[0]", deltas)
    c.se("delta[1]", deltas & both)
    c.ue("redundant_count", k("redundant_present") != 0)
    c.bits("direct_spatial", 1, kind == B)
    inter, two = np.isin(kind, (P, SP, B)), kind == B
    own_refs = inter & (c.bits("refs_override", 1, inter) == 1)
    refs = [np.where(own_refs, c.ue("refs0_less_1", own_refs), k("refs0_less_1"))]
    refs.append(np.where(own_refs & two, c.ue("refs1_less_1", own_refs & two), k("refs1_less_1")))
    lists = [inter, two]
    for x in range(2):
        now, n = lists[x] & (c.bits(f"modified{x}", 1, lists[x]) == 1), 0
        while (now := now & (c.fault == 0)).any():
            now = now & (c.ue(f"modification{x}[{n}]", now) != 3)
            c.ue(f"modification_value{x}[{n}]", now)
            n += 1
    weights = ((k("weighted") != 0) & np.isin(kind, (P, SP))) | ((k("weighted_b") == 1) & two)
    colour = weights & (k("chroma_format") != 0)
    c.ue("luma_denominator", weights)
    c.ue("chroma_denominator", colour)
    for x in range(2):
        for i, own in c.turns(refs[x] + 1, weights & lists[x]):
            c.each(own & (c.bits(f"luma_weighted{x}[{i}]", 1, own) == 1), (f"luma_weight{x}[{i}]", "se"), (f"luma_offset{x}[{i}]", "se"))
            own = own & colour
            c.each(own & (c.bits(f"chroma_weighted{x}[{i}]", 1, own) == 1), *[(f"chroma_{what}{x}[{i}][{j}]", "se") for j in range(2) for what in ("weight", "offset")])
    used = k("nal_ref") != 0
    c.each(used & idr, ("no_prior_output", 1), ("long_term", 1))
    marks = used & ~idr
    now, n = marks & (c.bits("adaptive_marking", 1, marks) == 1), 0
    while (now := now & (c.fault == 0)).any():
        op = c.ue(f"marking[{n}]", now)
        for number, ops in (("difference", (1, 3)), ("long_picture", (2,)), ("long_frame", (3, 6)), ("most_long", (4,))):
            c.ue(f"{number}[{n}]", now & np.isin(op, ops))
        now, n = now & (op != 0), n + 1
    c.ue("cabac_start", (k("cabac") != 0) & ~np.isin(kind, (I, SI)))
    c.se("qp_delta", w)
    c.bits("switch", 1, kind == SP)
    c.se("qs_delta", np.isin(kind, (SP, SI)))
    filtered = k("deblocking_present") != 0
    c.each(filtered & (c.ue("deblocking_off", filtered) != 1), ("alpha_half", "se"), ("beta_half", "se"))
    c.bits("change_cycle", size("change_bits"), (k("more_groups") != 0) & (k("map_type") >= 3) & (k("map_type") <= 5))
