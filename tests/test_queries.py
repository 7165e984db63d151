"""Every registered query of the library against its SQL; those without SQL must give rows."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from riffle.plans import catalog
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    if name in catalog.ORACLES:
        n, extra, missing = same(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)
        assert n and not extra and not missing, (extra, missing)
    else:
        assert catalog.QUERIES[name](spark, SF).count()


def test_angles_half_a_turn_apart_go_the_way_of_the_sql(spark, tmp_path):
    pairs = [(0.08, 180.08), (0.1, 540.1), (180.08, 0.08), (540.1, 0.1), (10.0, 190.0), (-0.1, 179.9), (3.2, 97.4)]
    rows = [(datetime.datetime(2024, 1, day, 0, k, side), 2 * (20 * day + k) + side, side, v) for day in range(1, len(pairs) + 1) for k, pair in enumerate(pairs[:day]) for side, v in enumerate(pair)]
    ts, frame, user, value = zip(*rows, strict=True)
    pq.write_table(pa.table({"event_id": pa.array(frame), "ts": pa.array(ts, pa.timestamp("us")), "user_id": pa.array(user), "value": pa.array(value)}), tmp_path / "events.parquet")
    n, extra, missing = same(spark, catalog.QUERIES["sync_statistics"], catalog.ORACLES["sync_statistics"], str(tmp_path))
    assert n == len(pairs) and not extra and not missing, (extra, missing)


def test_of_equal_areas_the_first_row_of_the_table_counts(spark, tmp_path):
    numbers = [4, 1, 7, 2, 6, 3, 5]
    rows = [(key, number, 20_000.0 if key == 0 else 40_000.0 + (k in tied)) for k, number in enumerate(numbers) for key, tied in enumerate([(), (1, 5), (0, 6), range(7), (3,), (2, 4, 6)])]
    key, number, price = zip(*rows, strict=True)
    lines = pa.table({"l_orderkey": pa.array(key), "l_linenumber": pa.array(number, pa.int32()), "l_extendedprice": pa.array(price)})
    (whole := tmp_path / "whole").mkdir()
    pq.write_table(lines, whole / "lineitem.parquet")
    n, extra, missing = same(spark, catalog.QUERIES["largest_contour"], catalog.ORACLES["largest_contour"], str(whole))
    assert n == 5 and not extra and not missing, (extra, missing)
    # files of unequal size, which Spark does not read in order
    (parts := tmp_path / "parts" / "lineitem.parquet").mkdir(parents=True)
    for i, (a, b) in enumerate([(0, 6), (6, 9), (9, 40), (40, 42)]):
        pq.write_table(lines.slice(a, b - a), parts / f"part-{i}.parquet")
    got = catalog.QUERIES["largest_contour"](spark, str(tmp_path / "parts")).collect()
    assert sorted((r.l_orderkey, r.l_linenumber, r.area) for r in got) == [(1, 1, 40_001.0), (2, 4, 40_001.0), (3, 4, 40_001.0), (4, 2, 40_001.0), (5, 7, 40_001.0)]
