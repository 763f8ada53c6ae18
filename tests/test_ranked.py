"""Pages from ranges against the whole table sorted."""

import random

import pytest

from tradeledger.sources import ranked


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, "a", "b", "bb", "zz"]), rng.randint(0, 5)) for i in range(3000)]
    rng.shuffle(rows)
    path = str(tmp_path_factory.mktemp("ranked") / "t")
    frame = spark.createDataFrame(rows, "id bigint, name string, size int")
    ranked.store(frame, path, ["name", "size"], "id", 12)
    return path, sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2], r[0]))


@pytest.mark.parametrize("skip, take", [(0, 20), (7, 0), (249, 3), (250, 500), (1490, 20), (2995, 20), (3000, 5), (9000, 5)])
def test_pages_of_any_depth(spark, table, skip, take):
    path, rows = table
    got = ranked.page(spark, path, ["name", "size"], "id", skip, take)
    assert [tuple(r) for r in got.collect()] == rows[skip:skip + take]
    files = set(got.inputFiles())
    assert len(files) <= 2 + take // 150 and len(files) < 12


def test_pages_after_a_position_and_ranks(spark, table):
    path, rows = table
    whole = [r for r in rows if r[1] is not None]
    for k in (0, 1, 333, 1200, len(whole) - 3, len(whole) - 1):
        last = (whole[k][1], whole[k][2], whole[k][0])
        assert [tuple(r) for r in ranked.page_after(spark, path, ["name", "size"], "id", last, 10).collect()] == whole[k + 1:k + 11]
        assert ranked.rank_of(spark, path, ["name", "size"], "id", last) == rows.index(whole[k])
    assert [tuple(r) for r in ranked.page_after(spark, path, ["name", "size"], "id", ("b", 99, 0), 5).collect()] == [r for r in whole if r[1] > "b"][:5]
    assert ranked.page_after(spark, path, ["name", "size"], "id", ("zzz", 0, 0)).count() == 0


def test_an_empty_table_has_empty_pages(spark, tmp_path):
    ranked.store(spark.createDataFrame([], "id bigint, name string"), str(tmp_path / "t"), ["name"], "id", 4)
    assert ranked.page(spark, str(tmp_path / "t"), ["name"], "id").count() == 0
    assert ranked.page_after(spark, str(tmp_path / "t"), ["name"], "id", ("a", 1)).count() == 0
