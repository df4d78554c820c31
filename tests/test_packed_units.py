import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadframe.operators.impute import chained_imputation, edge_observations, group_fills, held_out, imputed_edges
from roadframe.operators.packed import HIGHWAY, MAXSPEED, OSMID, explode_packed, split_packed
from roadframe.operators.units import foreign_speeds, parse_speed, parse_speeds, speeds_in_metres, unit_of_note


def members(text, packing):
    return split_packed(pa.array([text], pa.string()), packing).to_pylist()[0]


@pytest.mark.parametrize("text, expected", [
    ("50", ["50"]), ("12,5", ["12,5"]), ("12,5|100 km/h", ["12,5", "100 km/h"]), ("['9', '12,5']", ["9", "12,5"]), ('9;"9";9', ["9", "9", "9"]),
    ("50 @ (22:00-06:00; Su)", ["50 @ (22:00-06:00; Su)"]), ("none", ["none"]), ("None", None), ("[]", None), ("  ", None), (None, None), ("n/a", None),
    ("50 km/h / 30 mi/h", ["50 km/h", "30 mi/h"]), ("1000；300", ["1000", "300"]), ("10\t10", ["10", "10"]), ("9 ; ; 9;", ["9", "9"]), ("", None),
])
def test_maxspeed_members(text, expected):
    assert members(text, MAXSPEED) == expected


def test_other_fields():
    assert members('"footway","road (closed; works)"', HIGHWAY) == ["footway", "road (closed; works)"]
    assert members("O'Brien; D'Arcy", HIGHWAY) == ["O'Brien", "D'Arcy"]
    assert members("['it\"s', 'b']", HIGHWAY) == ['it"s', "b"]
    assert members("a / b", HIGHWAY) == ["a", "b"]
    assert members("none", HIGHWAY) is None
    assert members("[9 9 9]", OSMID) == ["9", "9", "9"]
    assert members("1,2", OSMID) == ["1", "2"]
    long = ";".join(str(i) for i in range(20_000))
    assert members(long, OSMID) == [str(i) for i in range(20_000)]
    assert split_packed(pa.array([], pa.string()), OSMID).to_pylist() == []
    assert members("[[[[[[1,2]]]]]]", OSMID) == ["1", "2"] and members("{[({[(1;2)]})]}", OSMID) == ["1", "2"]
    assert members("[" * 3000 + "7;8" + "]" * 3000, OSMID) == ["7", "8"] and members("(a); (b)", HIGHWAY) == ["(a)", "(b)"]
    assert members("[(a), (b)]", HIGHWAY) == ["(a)", "(b)"] and members("['a]', 'b[']", HIGHWAY) == ["a]", "b["]
    assert members("( ( a;b ) )", HIGHWAY) == ["a", "b"] and members("[]", HIGHWAY) is None and members("[", HIGHWAY) == ["["]
    # neighbours in a batch do not touch each other
    batch = ["10 mi/h", "signals", "5,", "5", "'a", "b'"]
    assert split_packed(pa.array(batch), MAXSPEED).to_pylist() == [["10 mi/h"], ["signals"], ["5"], ["5"], ["'a"], ["b'"]]


def test_mixed_quotes_against_a_plain_reader():
    """The scan of composed states gives what reading character by character gives, in one batch."""
    import random

    import numpy as np

    from roadframe.operators import packed

    def plain(text):
        marks, opened, start = [False] * len(text), "", 0
        word = lambda c: c.isalnum()
        for i, c in enumerate(text):
            if c not in "\"'" or (0 < i < len(text) - 1 and word(text[i - 1]) and word(text[i + 1])):
                continue
            if not opened:
                opened, start = c, i
            elif c == opened:
                marks[start:i] = [True] * (i - start)
                opened = ""
        return marks

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab;\"' ,") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts = [t for t in texts if '"' in t and "'" in t]
    data, offsets = packed._bytes(pa.array(texts))
    got = packed._inside_quotes(data, offsets)
    both = [(plain(t), got[a:b].tolist()) for t, a, b in zip(texts, offsets[:-1], offsets[1:])]
    counted = [i for i, t in enumerate(texts) if all(any(c == q and not (0 < k < len(t) - 1 and t[k - 1].isalnum() and t[k + 1].isalnum()) for k, c in enumerate(t)) for q in "\"'")]
    assert len(counted) > 1000 and all(both[i][0] == both[i][1] for i in counted) and isinstance(got, np.ndarray)


EDGES = "ord bigint, u bigint, v bigint, key int, osmid string, highway string, maxspeed string, speed_kph double, extract_id int, item string"
EXTRACTS = "extract_id int, extract_name string, speed_note string, channel string, published_at timestamp"


def test_notes():
    assert unit_of_note("Bare figures are tenths of a km/h.") == "tenth_kmh"
    assert unit_of_note("Street lengths come in miles, limits without suffix stay metric (km/h).") == "kmh"
    assert unit_of_note("Contains former mph signs; these always keep their suffix.") is None
    assert unit_of_note("plain limits mean knots") == "kn"
    assert unit_of_note("") is None and unit_of_note(None) is None


def test_units_and_fills(spark):
    rows = [
        (1, 1, 2, 0, "7", "service", "30", 50.0, 1, "x"), (2, 1, 2, 0, "7", None, "nan", None, 1, None), (3, 1, 2, 0, "7", "[]", "30 mph", -1.0, 2, None),
        (4, None, 2, 0, "8", "a;b", "20|25 kn", float("nan"), 2, None), (5, 1, 2, 0, None, None, None, None, None, None), (6, 3, 3, 0, "9", "x", "MPH 10 @ (wet)", 0.0, 1, None),
        (7, 3, 3, 0, "7", "service", "QD:urban", 50.0, 1, None),
    ]
    edges = spark.createDataFrame(rows, EDGES)
    extracts = spark.createDataFrame([(1, "a", "limits in mph unless noted", "x", None), (2, "b", None, None, None)], EXTRACTS)
    got = {(r.ord, r.pos): r.m_per_h for r in foreign_speeds(edges, extracts).collect()}
    assert got == {(1, 1): 48280, (3, 1): 48280, (4, 1): 37040, (4, 2): 46300, (6, 1): 16093}
    fills = {(r.ord, r.field): r.fill for r in group_fills(edges, extracts).collect()}
    assert fills == {(2, "highway"): "service", (3, "highway"): "service", (2, "maxspeed"): "48280", (2, "speed_kph"): "50000", (3, "speed_kph"): "50000"}
    every = imputed_edges(edges, extracts).collect()
    assert {r.source for r in every} == {"group", "model"} and not [r for r in every if r.ord == 4 and r.field == "highway"]
    empty = edges.limit(0)
    assert speeds_in_metres(empty, extracts).count() == 0 and group_fills(empty, extracts).count() == 0
    assert explode_packed(empty, {"osmid": OSMID}, ["ord"]).count() == 0
    with pytest.raises(ValueError):
        explode_packed(edges, {"osmid": OSMID}, ["item"])


def test_mixture_finds_units_without_notes(spark):
    """Numbers in five units without a word on it, beside a source with written units: recall of each unit."""
    rows, n = [], 0
    limits = {"kmh": (20, 30, 50, 60, 70, 80, 100, 120), "mph": (15, 20, 25, 30, 35, 45, 55, 65), "kn": (4, 5, 6, 8, 10, 12), "ms": (5, 8.3, 13.9, 16.7, 22.2), "tenth_kmh": (200, 300, 500, 700, 800, 1000)}
    written = {"kmh": "km/h", "mph": "mph", "kn": "knots", "ms": "m/s"}
    for source, (unit, numbers) in enumerate(limits.items(), 1):
        for k in range(120):
            number = numbers[k * 7 % len(numbers)]
            n += 1
            rows.append((n, 1, 2, 0, "1", "x", str(number), None, source, None))
            if unit in written:
                n += 1
                rows.append((n, 1, 2, 0, "1", "x", f"{number} {written[unit]}", None, 99, None))
    edges = spark.createDataFrame(rows, EDGES)
    extracts = spark.createDataFrame([(i, "a", None, None, None) for i in range(1, 6)], EXTRACTS)
    by_mixture = speeds_in_metres(edges, extracts, follow_remarks=False).join(edges.select("ord", "extract_id"), "ord").where("extract_id < 99")
    got = {(r.extract_id, r.unit): r["count"] for r in by_mixture.groupBy("extract_id", "unit").count().collect()}
    for source, unit in enumerate(limits, 1):
        assert got[source, unit] >= 0.9 * 120, unit
    # the definition takes km/h where there is no remark: numbers whose peaks say otherwise are flagged
    checked = speeds_in_metres(edges, extracts).join(edges.select("ord", "extract_id"), "ord").where("extract_id < 99").collect()
    assert {r.unit for r in checked} == {"kmh"}
    flagged = [r for r in checked if r.extract_id > 1]
    assert sum(r.uncertain for r in flagged) >= 0.9 * len(flagged) and not any(r.uncertain for r in checked if r.extract_id == 1)


def test_mixture_on_real_sources(spark):
    """On the test tables the posterior alone finds the unit that each source's remark states."""
    d = "/root/testdata/sf0.01"
    edges, extracts = spark.read.parquet(f"{d}/edges.parquet"), spark.read.parquet(f"{d}/extracts.parquet")
    rows = speeds_in_metres(edges, extracts).where("posterior < 1 OR unit <> mixture_unit").groupBy((F.col("unit") == F.col("mixture_unit")).alias("same")).count().collect()
    count = {r.same: r["count"] for r in rows}
    assert count.get(False, 0) <= 0.01 * sum(count.values())


def test_parse_speed():
    assert parse_speed("50") == (50.0, None) and parse_speed("12,5 km/h @ (wet)") == (12.5, "kmh") and parse_speed("MPH 10") == (10.0, "mph")
    assert parse_speed("signals") == (None, None) and parse_speed("") == (None, None) and parse_speed("1" * 12) == (None, None)
    assert parse_speeds(["20", "25 kn"], {}) == [{"number": 20.0, "written": "kn"}, {"number": 25.0, "written": "kn"}]
    assert parse_speeds(["20 mph", "25 kn", "5"], {})[2] == {"number": 5.0, "written": None} and parse_speeds(None, {}) is None and parse_speeds([], {}) == []


def test_held_out_accuracy(spark):
    """A tenth of the known values masked: what the chain fills, by group and by model."""
    d = "/root/testdata/sf0.01"
    rows = edge_observations(spark.read.parquet(f"{d}/edges.parquet"), spark.read.parquet(f"{d}/extracts.parquet"))
    got = {(r.field, r.source): r for r in held_out(rows).collect()}
    for c in ("highway", "maxspeed", "speed_kph"):
        assert got[c, "group"].exact >= 0.95 and got[c, "group"].n > 50
    common = rows.where("highway IS NOT NULL").groupBy("highway").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert got["highway", "model"].exact >= 0.6 * common  # draws keep the variation, so they hit less often than the commonest value would
    spread = rows.where("maxspeed > 0").agg(F.stddev(F.ln("maxspeed"))).first()[0]
    assert got["maxspeed", "model"].error < 0.6 * spread and got["speed_kph", "model"].error < 0.6 * spread


def test_chain_fits_on_observed_values_and_converges(spark):
    rows = [(i, str(i // 4) if i % 3 else None, "abc"[i % 3], 30_000 + 10_000 * (i % 3), 29_000 + 10_000 * (i % 3)) for i in range(300)]
    rows = [(o, w, None if o % 7 == 0 else h, None if o % 5 == 0 else m, None if o % 11 == 0 else s) for o, w, h, m, s in rows]
    df = spark.createDataFrame([(*r, r[2] is None, r[3] is None, r[4] is None) for r in rows],
                               "ord bigint, way string, highway string, maxspeed bigint, speed_kph bigint, highway_missing boolean, maxspeed_missing boolean, speed_kph_missing boolean")
    chain = chained_imputation(df)
    done = {r.ord: r for r in chain.state.collect()}
    assert len(done) == 300 and all(done[o].highway and done[o].maxspeed and done[o].speed_kph for o, *_ in rows)
    assert all(done[o].highway == h for o, _, h, _, _ in rows if h) and all(done[o].maxspeed == m for o, _, _, m, _ in rows if m)  # what was observed stays
    assert all(done[o].highway_source == ("observed" if h else done[o].highway_source) for o, _, h, _, _ in rows)
    # the category settles both numbers, so a model fill lies near the only value of its category
    near = [abs(done[o].maxspeed - (30_000 + 10_000 * "abc".index(h))) for o, w, h, m, _ in rows if m is None and h and w is None]
    assert sorted(near)[len(near) // 2] < 1500
    last = max(h["round"] for h in chain.history)
    assert 2 <= last < 5 and all(h["moved"] < 0.01 for h in chain.history if h["round"] == last)
    assert chained_imputation(df.limit(0)).state.count() == 0
    nothing = chained_imputation(df.withColumn("highway", F.lit(None).cast("string")).withColumn("highway_missing", F.lit(True)))
    assert nothing.state.where("highway IS NOT NULL").count() == 0
