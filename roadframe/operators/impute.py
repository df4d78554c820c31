"""Filling missing values from similar records by chained equations (problem 7).

Fields are completed in turn, each from the others as they stand: in every round a
model of the field is fitted on the records where it was *observed* (never on its
own fills), and then drawn from for the records that lack it. The record's group
(here the way) is a predictor of every model:

* a number is regressed on the category (one intercept each) and the other number,
  which gives a mean and a residual spread; the group's observed values give
  another; the two are weighted by their precisions and a hashed normal residual is
  drawn from what variation is left. A group whose values all agree has no spread,
  so its weight is infinite and nothing is drawn: the fill is that value;
* a category is drawn from its frequencies given the binned numbers, or from the
  group's observed values with a weight that grows with their number; a group whose
  values all agree leaves nothing to draw.

All fits are sums per category or bin, made by aggregation over all records: those
without a gap are summed once, and only records with a gap pass through the
rounds. Rounds end when the fitted parameters move less than ``TOLERANCE``, after
``ROUNDS`` at most; ``Chain.history`` reports them. Draws are hashed from the
record's key, so a lost executor draws the same again and rounds can settle.

Masks of what was missing are kept throughout. Defined cases: a field with two or
more members is neither missing nor usable and is never overwritten; a record
without a group takes part in the other predictors only; if no record has a usable
value of a field, its missing values stay null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadframe.operators.packed import HIGHWAY, OSMID
from roadframe.operators.units import assign_units, metres_per_hour, source_key, speed_bin, speed_lists, speed_members
from roadframe.session import materialize

ROUNDS = 5
TOLERANCE = 0.01
#: Width of the bins of ln(value) that the classifier sees.
BIN = 0.25
NUMBERS = {"maxspeed": "speed_kph", "speed_kph": "maxspeed"}
FIELDS = ("highway", "maxspeed", "speed_kph")


def edge_observations(edges: DataFrame, extracts: DataFrame) -> DataFrame:
    """``(ord, way, highway, maxspeed, speed_kph, *_missing)``: usable values or null, speeds in metres per hour.

    ``way`` is null unless ``osmid`` has exactly one member. Every text is parsed once.
    """
    lists = materialize(speed_lists(edges, ["ord", "speed_kph", "extract_id"], {"osmid": OSMID, "highway": HIGHWAY}), "lists")
    units = materialize(assign_units(speed_members(lists), extracts), "units").select("extract_key", "bin", F.col("unit").alias("_unit"))
    one = lambda c: F.when(F.size(c) == 1, F.element_at(c, 1))
    kph = F.when((F.col("speed_kph") > 0) & ~F.isnan("speed_kph") & (F.col("speed_kph") < 1e12),
                 F.round(F.col("speed_kph") * 1000).cast("bigint"))
    rows = lists.withColumn("_s", one("speeds")).withColumn("extract_key", source_key()).withColumn("bin", F.when(F.col("_s.written").isNull(), speed_bin(F.col("_s.number"))))
    rows = rows.join(units, ["extract_key", "bin"], "left")  # a bounded number of bins per source
    return rows.select("ord", one("osmid_members").alias("way"), one("highway_members").alias("highway"),
                       metres_per_hour(F.col("_s.number"), F.coalesce("_s.written", "_unit")).alias("maxspeed"), kph.alias("speed_kph"),
                       F.col("highway_members").isNull().alias("highway_missing"), F.col("speeds").isNull().alias("maxspeed_missing"),
                       kph.isNull().alias("speed_kph_missing"))


def group_predictors(rows: DataFrame) -> DataFrame:
    """Per group what its observed values say of each field.

    ``g_<c>``: the value on which all agree, else null. For numbers that differ, ``trust_<c>`` is the precision of
    the logarithm and ``pull_<c>`` precision times mean. For the category ``n_highway`` counts the values and
    ``pick_highway`` is one of them by hash, a draw from the group.
    """
    stats = [F.min("highway").alias("lo_highway"), F.max("highway").alias("hi_highway"), F.count("highway").alias("n_highway"),
             F.min_by("highway", F.when(F.col("highway").isNotNull(), F.xxhash64("ord"))).alias("pick_highway")]
    for c in NUMBERS:
        stats += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.avg(_log(c)).alias(f"mean_{c}"), F.var_samp(_log(c)).alias(f"var_{c}")]
    found = rows.where("way IS NOT NULL").groupBy("way").agg(*stats)
    agreed = [F.when(F.col(f"lo_{c}") == F.col(f"hi_{c}"), F.col(f"lo_{c}")).alias(f"g_{c}") for c in FIELDS]
    trust = [F.try_divide(F.lit(1.0), F.col(f"var_{c}")) for c in NUMBERS]
    pulls = [x for c, t in zip(NUMBERS, trust) for x in (t.alias(f"trust_{c}"), (t * F.col(f"mean_{c}")).alias(f"pull_{c}"))]
    return found.select("way", "n_highway", "pick_highway", *agreed, *pulls)


def _uniform(*columns: Column) -> Column:
    """Hashed uniform in (0, 1): the same record draws the same number again, also after a lost executor."""
    return (F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) + 0.5) / (1 << 30)


def _log(c: str) -> Column:
    return F.when(F.col(c) > 0, F.ln(F.col(c).cast("double")))


def _bins(c: str) -> Column:
    return F.coalesce(F.floor(_log(c) / BIN), F.lit(-1)).cast("int")


#: Status of a field in a record: observed, to be filled, or neither (several members, or no usable text).
SEEN, OPEN, LEFT_OUT = 0, 1, 2


# ---- sums that the fits are made of ---------------------------------------------

def _class_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(_bins("maxspeed").alias("b1"), _bins("speed_kph").alias("b2"), "highway").agg(F.count(F.lit(1)).alias("c"))


def _moments(rows: DataFrame, y: str) -> DataFrame:
    both = rows.select("highway", _log(y).alias("ly"), _log(NUMBERS[y]).alias("lx")).where("ly IS NOT NULL AND lx IS NOT NULL")
    lx, ly = F.col("lx"), F.col("ly")
    return both.groupBy("highway").agg(F.count(F.lit(1)).alias("c"), F.sum(lx).alias("sx"), F.sum(ly).alias("sy"), F.sum(lx * lx).alias("sxx"),
                                       F.sum(lx * ly).alias("sxy"), F.sum(ly * ly).alias("syy"))


@dataclass
class Chain:
    """The completed records, and one entry per round and field of the parameters and how far they moved."""

    state: DataFrame
    history: list[dict] = field(default_factory=list)


class _Models:
    """Fits each field on the records where it was observed: the closed ones summed once, the open ones anew."""

    def __init__(self, closed: DataFrame) -> None:
        m, k = F.col("_m"), F.col("_k")
        logs = closed.select("highway", _bins("maxspeed").alias("b1"), _bins("speed_kph").alias("b2"), _log("maxspeed").alias("_m"), _log("speed_kph").alias("_k"))
        both = F.when(m.isNotNull() & k.isNotNull(), 1)
        sums = materialize(logs.groupBy("b1", "b2", "highway").agg(
            F.count(F.lit(1)).alias("c"), F.count(both).alias("n"), *[F.coalesce(F.sum(both * v), F.lit(0.0)).alias(a) for a, v in (("m", m), ("k", k), ("mm", m * m), ("mk", m * k), ("kk", k * k))]), "sums")
        pair = lambda *names: sums.where("n > 0").select("highway", F.col("n").alias("c"), *[F.col(a).alias(b) for a, b in zip(names, ("sx", "sy", "sxx", "sxy", "syy"))])
        self.closed = {"highway": sums.where("highway IS NOT NULL").select("b1", "b2", "highway", "c"),
                       "maxspeed": pair("k", "m", "kk", "mk", "mm"), "speed_kph": pair("m", "k", "mm", "mk", "kk")}

    def classify(self, state: DataFrame) -> tuple[DataFrame, dict]:
        """Add ``m_highway``: the group's value, or a draw given the bins of the numbers, backing off to all records."""
        counts = self.closed["highway"].unionByName(_class_counts(state.where(F.col("highway_status") == SEEN)))
        counts = counts.groupBy("b1", "b2", "highway").agg(F.sum("c").alias("c"))
        whole = counts.groupBy("highway").agg(F.sum("c").alias("c")).select(F.lit(-9).alias("b1"), F.lit(-9).alias("b2"), "highway", "c")
        # one entry per category seen with a pair of bins: grows with the number of categories, not with the records
        table = materialize(counts.unionByName(whole).groupBy("b1", "b2").agg(
            F.array_sort(F.collect_list(F.struct("highway", "c"))).alias("e"), F.sum("c").alias("total")), "classifier")
        base = table.where("b1 = -9").select(F.col("e").alias("e0"), F.col("total").alias("t0"))
        doubt = F.aggregate("e", F.lit(0.0), lambda a, x: a - x["c"] * F.ln(x["c"] / F.col("total")))
        n, lost = table.agg(F.sum(F.when(F.col("b1") == -9, F.col("total"))), F.sum(F.when(F.col("b1") != -9, doubt))).first()
        if not n:
            return state.withColumn("m_highway", F.lit(None).cast("string")), {}
        # the table is joined as its written size allows: broadcast when small, else shuffled
        out = state.withColumn("b1", _bins("maxspeed")).withColumn("b2", _bins("speed_kph")).join(table, ["b1", "b2"], "left")
        out = out.join(F.broadcast(base), F.lit(True), "left")  # a single row
        target = _uniform(F.col("ord"), F.lit("highway")) * F.coalesce("total", "t0")
        walk = F.aggregate(F.coalesce("e", "e0"), F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("string").alias("pick")),
                           lambda a, x: F.struct((a["seen"] + x["c"]).alias("seen"),
                                                 F.coalesce(a["pick"], F.when(a["seen"] + x["c"] >= target, x["highway"])).alias("pick")))
        drawn = F.coalesce("g_highway", "own_highway", walk["pick"])
        return out.withColumn("m_highway", F.when(F.col("highway_status") == OPEN, drawn)).drop("b1", "b2", "e", "total", "e0", "t0"), {"entropy": lost / n}

    def regress(self, state: DataFrame, y: str) -> tuple[DataFrame, dict]:
        """Add ``m_<y>``: the precision-weighted mean of regression and group, with a residual of the spread that is left."""
        x = NUMBERS[y]
        sums = self.closed[y].unionByName(_moments(state.where(F.col(f"{y}_status") == SEEN), y))
        sums = materialize(sums.groupBy("highway").agg(*[F.sum(c).alias(c) for c in ("c", "sx", "sy", "sxx", "sxy", "syy")]), "regression")
        within = lambda a, b, ab: F.sum(F.col(ab) - F.col(a) * F.col(b) / F.col("c"))
        got = sums.agg(within("sx", "sy", "sxy"), within("sx", "sx", "sxx"), within("sy", "sy", "syy"), F.sum("c"), F.sum("sx"), F.sum("sy")).first()
        sxy, sxx, syy, n, sx, sy = (float(v or 0) for v in got)
        if n == 0:
            return state.withColumn(f"m_{y}", F.lit(None).cast("bigint")), {}
        slope = sxy / sxx if sxx > 1e-9 else 0.0
        spread = max((max(syy - slope * sxy, 0.0) / n) ** 0.5, 1e-6)
        table = sums.where("highway IS NOT NULL").select("highway", ((F.col("sy") - slope * F.col("sx")) / F.col("c")).alias("a"))
        out = state.join(table, "highway", "left")
        mean = F.coalesce("a", F.lit((sy - slope * sx) / n)) + slope * F.coalesce(_log(x), F.lit(sx / n))
        left = 1.0 / (F.coalesce(f"trust_{y}", F.lit(0.0)) + 1.0 / spread**2)
        centre = left * (F.coalesce(f"pull_{y}", F.lit(0.0)) + mean / spread**2)
        normal = F.sqrt(-2 * F.ln(_uniform(F.col("ord"), F.lit(y)))) * F.cos(6.283185307179586 * _uniform(F.col("ord"), F.lit(y), F.lit(1)))
        drawn = F.round(F.exp(F.least(centre + F.sqrt(left) * normal, F.lit(40.0)))).cast("bigint")
        filled = F.when(F.col(f"{y}_status") == OPEN, F.coalesce(f"g_{y}", drawn))
        return out.withColumn(f"m_{y}", filled).drop("a"), {"slope": slope, "intercept": (sy - slope * sx) / n, "spread": spread}


def chained_imputation(rows: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Chain:
    """Records ``(ord, <field>, <field>_source, g_<field>)`` with every field completed.

    Sources: ``observed``; ``group`` where the record's group leaves no variation; ``model``; null where nothing could
    be filled or the field holds several members.
    """
    rows = materialize(rows, "observations")
    gap = F.col("highway_missing") | F.col("maxspeed_missing") | F.col("speed_kph_missing")
    status = [F.when(F.col(c).isNotNull(), SEEN).when(F.col(f"{c}_missing"), OPEN).otherwise(LEFT_OUT).cast("byte").alias(f"{c}_status") for c in FIELDS]
    # a group of n values is drawn from with weight n against one for the classifier
    own = F.when(_uniform(F.col("ord"), F.lit("way")) < F.col("n_highway") / (F.col("n_highway") + 1), F.col("pick_highway"))
    predictors = [*[f"g_{c}" for c in FIELDS], *[f"{k}_{c}" for c in NUMBERS for k in ("trust", "pull")]]
    groups = materialize(group_predictors(rows), "groups")
    closed = rows.where(~gap)
    state = materialize(rows.where(gap).join(groups, "way", "left").select("ord", *FIELDS, *status, own.alias("own_highway"), *predictors), "state")
    models, history = _Models(closed), []
    for number in range(1, rounds + 1):
        moved = 0.0
        for c in FIELDS:
            state, found = models.classify(state) if c == "highway" else models.regress(state, c)
            state = state.withColumn(c, F.coalesce(f"m_{c}", c)).drop(f"m_{c}")
            before = {h["parameter"]: h["value"] for h in history if h["field"] == c and h["round"] == number - 1}
            for name, value in found.items():
                shift = abs(value - before[name]) if name in before else None
                moved = max(moved, 1.0 if shift is None else shift)
                history.append({"round": number, "field": c, "parameter": name, "value": value, "moved": shift})
        state = materialize(state, "state")
        if moved < tolerance:
            break
    done = state.select("ord", *FIELDS, *[f"g_{c}" for c in FIELDS], *[
        F.when(F.col(f"{c}_status") == SEEN, "observed").when((F.col(f"{c}_status") == OPEN) & F.col(c).isNotNull(), F.when(F.col(f"g_{c}").isNotNull(), "group").otherwise("model"))
        .alias(f"{c}_source") for c in FIELDS])
    whole = closed.select("ord", *FIELDS, *[F.when(F.col(c).isNotNull(), "observed").alias(f"{c}_source") for c in FIELDS])
    return Chain(done.unionByName(whole, allowMissingColumns=True), history)


def _cells(chain: Chain) -> DataFrame:
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("fill"), F.col(f"{c}_source").alias("source"),
                              (F.col(c) == F.col(f"g_{c}")).alias("fits")) for c in FIELDS])
    return chain.state.select("ord", F.explode(each).alias("_f")).select("ord", "_f.*")


def fills(chain: Chain) -> DataFrame:
    """``(ord, field, fill, source)``: one row per filled value."""
    return _cells(chain).where("source IN ('group', 'model')").drop("fits")


def imputed_edges(edges: DataFrame, extracts: DataFrame) -> DataFrame:
    return fills(chained_imputation(edge_observations(edges, extracts)))


def group_fills(edges: DataFrame, extracts: DataFrame) -> DataFrame:
    """``(ord, field, fill)``: the chain's fills of records whose group leaves no variation, checked exactly against the group's one value."""
    return _cells(chained_imputation(edge_observations(edges, extracts))).where("source = 'group' AND fits").select("ord", "field", "fill").distinct()


def convergence(edges: DataFrame, extracts: DataFrame) -> DataFrame:
    """``(round, field, parameter, value, moved)`` of the fits; ``moved`` is null in the first round."""
    history = chained_imputation(edge_observations(edges, extracts)).history
    rows = [(h["round"], h["field"], h["parameter"], h["value"], h["moved"]) for h in history]
    return edges.sparkSession.createDataFrame(rows, "round int, field string, parameter string, value double, moved double")


def held_out(rows: DataFrame, every: int = 10, rounds: int = ROUNDS) -> DataFrame:
    """``(field, source, n, exact, error)``: observed values masked by hash, filled by the chain and compared.

    One record in ``every`` loses each field (other records for other fields). ``exact`` is the share of equal values,
    ``error`` the mean absolute difference of the logarithms of numbers.
    """
    rows = materialize(rows, "observations")
    masked = rows
    for c in FIELDS:
        hide = F.col(c).isNotNull() & (F.pmod(F.xxhash64(F.lit(c), "ord"), F.lit(every)) == 0)
        masked = masked.withColumn(f"_{c}", F.when(hide, F.col(c))).withColumn(f"{c}_missing", F.col(f"{c}_missing") | hide).withColumn(c, F.when(~hide, F.col(c)))
    truth = masked.select("ord", *[F.col(f"_{c}").alias(f"true_{c}") for c in FIELDS])
    done = chained_imputation(masked.drop(*[f"_{c}" for c in FIELDS]), rounds).state.join(truth, "ord")
    gap = lambda c: F.lit(None).cast("double") if c == "highway" else F.abs(F.ln(F.col(c) / F.col(f"true_{c}")))
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"true_{c}").cast("string").alias("truth"), F.col(c).cast("string").alias("fill"),
                              F.col(f"{c}_source").alias("source"), gap(c).alias("gap")) for c in FIELDS])
    cells = done.select(F.explode(each).alias("_f")).select("_f.*").where("truth IS NOT NULL AND fill IS NOT NULL")
    return cells.groupBy("field", "source").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("truth") == F.col("fill")).cast("int")).alias("exact"), F.avg("gap").alias("error"))
