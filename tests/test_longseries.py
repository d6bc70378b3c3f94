import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from panelwatch.operators import longseries as LS
from panelwatch.sources import landed


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    data = [("all", i, r.choice([None, r.random()]), r.randint(0, 1)) for i in range(900)] + [(f"k{i % 40}", i // 40, float(i), 1) for i in range(120)] + [(None, 1, 2.0, 0)]
    r.shuffle(data)
    return spark.createDataFrame(data, "k string, t int, v double, c int")


@pytest.mark.parametrize("pieces", [3, 25])
def test_equal_to_plain_windows(rows, pieces):
    keys, order = ["k"], ["t"]
    ranged = LS.in_ranges(rows, keys, order, pieces)
    got = LS.lags(ranged, keys, order, {"l1": ("v", 1), "l60": ("v", 60)})
    got = LS.running_sum(LS.last_known(got, keys, order, {"known": "v"}), keys, order, {"total": "c", "sums": "v"})
    w, upto = Window.partitionBy("k").orderBy("t"), Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumns({"l1": F.lag("v", 1).over(w), "l60": F.lag("v", 60).over(w), "known": F.last("v", True).over(upto), "total": F.sum("c").over(upto), "sums": F.sum("v").over(upto)})
    names = ["k", "t", "v", "c", "l1", "l60", "known", "total", "sums"]
    key = lambda x: (str(x.k), x.t)
    a, b = (sorted(d.select(*names).collect(), key=key) for d in (got, want))
    assert len({x[0] for x in ranged.where("k = 'all'").select(LS.RANGE).distinct().collect()}) > 1
    assert [x[:8] for x in a] == [x[:8] for x in b]
    assert all(x.sums == pytest.approx(y.sums) for x, y in zip(a, b))


def test_as_of_join_against_a_loop(spark):
    r = random.Random(6)
    day = datetime(2024, 1, 1)
    at = lambda: day + timedelta(minutes=r.randint(0, 4000))
    left = [(i, r.choice(["a", "b", "c"]), at()) for i in range(200)] + [(900, None, at()), (901, "a", None)]
    right = [(r.choice(["a", "b"]), at(), i) for i in range(150)] + [("a", None, 7), ("a", left[0][2], 500), ("a", left[0][2], 501)]
    ls, rs = spark.createDataFrame(left, "id int, k string, ts timestamp_ntz"), spark.createDataFrame(right, "k string, ts timestamp_ntz, w int")
    for forward in (False, True):
        got = {x.id: (x.matched_ts, x.w) for x in LS.as_of_join(ls, rs, ["k"], "ts", ["w"], tolerance="300 MINUTES", forward=forward, pieces=5).collect()}
        for i, k, t in left:
            near = [(abs(t - s), s, w) for q, s, w in right if q == k and s is not None and t is not None and (s >= t if forward else s <= t) and abs(t - s) <= timedelta(minutes=300)]
            want = max((x for x in near if x[0] == min(near)[0]), key=lambda x: x[2])[1:] if near else (None, None)
            assert got[i] == want
    assert len(got) == len(left)


def test_interval_join_against_all_pairs(spark):
    r = random.Random(7)
    points = [(i, r.choice("ab"), r.randint(-500, 5000)) for i in range(400)] + [(900, "a", None)]
    spans = [(i, r.choice("ab"), a := r.randint(-500, 5000), a + r.choice([0, 3, 50, 900, 5000])) for i in range(120)] + [(800, "a", 10, 5), (801, "b", None, 4)]
    p, s = spark.createDataFrame(points, "p int, k string, t long"), spark.createDataFrame(spans, "s int, k string, a long, b long")
    got = sorted((x.p, x.s) for x in LS.interval_join(p, s, ["k"], "t", "a", "b", width=10, fan=4).collect())
    assert got == sorted((i, j) for i, k, t in points for j, q, a, b in spans if k == q and t is not None and a is not None and a <= t <= b)
    assert LS.interval_join(p, s.limit(0), ["k"], "t", "a", "b", width=10).count() == 0


def test_folder_of_three_separators(spark, tmp_path):
    for i, sep in enumerate(landed.SEPARATORS):
        head = [" id", "value "] if i < 2 else ["id", "note", "value"]
        lines = [sep.join(head)] + [sep.join([str(10 * i + j), *(["n"] if i == 2 else []), f"{i}.{j}"]) for j in range(3)]
        (tmp_path / f"f{i}.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "none.csv").write_text("")
    df = landed.scan_delimited(spark, str(tmp_path))
    assert set(df.columns) == {"id", "value", "note"}
    assert sorted((x.id, x.value, x.note) for x in df.collect()) == sorted((str(10 * i + j), f"{i}.{j}", "n" if i == 2 else None) for i in range(3) for j in range(3))
