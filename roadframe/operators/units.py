"""One quantity recorded in different units (problem 5).

Numbers with a written unit fix the common log-scale distribution of speeds: a
mixture of narrow normals in ln(km/h), since limits cluster on few values, and one
wide one. Numbers without a unit follow the same mixture shifted by the known
conversion factor of their unknown unit. The evidence of all numbers of a source
gives its posterior over the units, that and the number itself the number's, and
the unit of the highest posterior is assigned.

An exact check follows: by the data's definition a remark of the source decides,
else km/h, so where the posterior names another unit the definition overrules it
and the number is flagged. ``follow_remarks=False`` leaves the check out. Everything
is fitted on histograms of fixed bins, so the fit sees all rows but its size does
not grow with them.

Defined cases: texts without a number (``none``, ``signals``, ``QD:urban``) have
no speed; zero is a number but tells nothing about its unit; a null or unknown
extract says nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadframe.operators.packed import MAXSPEED, Packing, split_packed, split_repeated
from roadframe.session import broadcast_if_small, materialize

#: Metres per hour in one unit (fixed values).
M_PER_H = {"kmh": 1000.0, "mph": 1609.344, "kn": 1852.0, "ms": 3600.0, "tenth_kmh": 100.0}
UNITS = tuple(M_PER_H)
BIN = 1 / 64
COMPONENTS = 48
#: Share of a source's numbers that may follow none of its units' peaks, and posterior below which a number is flagged.
STRAY, SURE = 0.02, 0.9

#: Up to nine digits before the sign and after it; longer runs of digits are no speed.
_NUMBER = r"([0-9]{1,9}(?:[.,][0-9]{1,9})?)"
_KMH = r"km\s?/\s?h(?:r|our)?|km\s?h|kmph|kph|k\.p\.h\.?|kilomet(?:er|re)s?\s?(?:/|per|an)\s?h(?:r|our)?"
_MPH = r"mph|m\.p\.h\.?|mi\s?/\s?h(?:r|our)?|miles?\s?(?:/|per|an)\s?h(?:r|our)?"
_KN = r"kn|kts?\.?|knots?|nmi\s?/\s?h|nautical miles?\s?(?:/|per|an)\s?h(?:r|our)?"
_MS = r"m\s?/\s?s(?:ec(?:ond)?)?|mps|met(?:er|re)s?\s?(?:/|per|a)\s?s(?:ec(?:ond)?)?"
_PATTERNS = {"kmh": _KMH, "mph": _MPH, "kn": _KN, "ms": _MS}
_ANY = "|".join(_PATTERNS.values())
_TENTH = r"(?:0[.,]1|1/10|tenths?(?:\s+of)?(?:\s+an?)?)\s?(?:%s)" % _KMH


_WHOLE = re.compile(rf"(?:({_ANY})\s*)?{_NUMBER}\s*({_ANY})?", re.ASCII)


def parse_speed(item: str) -> tuple[float | None, str | None]:
    """Number of a member and the code of the unit written before or after it.

    Both null when the member, without a condition after ``@``, is not number and unit.
    """
    found = _WHOLE.fullmatch(item.split("@", 1)[0].strip().lower())
    if found is None:
        return None, None
    unit = found[3] or found[1]
    code = next((c for c, p in _PATTERNS.items() if re.fullmatch(p, unit, re.ASCII)), None) if unit else None
    return float(found[2].replace(",", ".")), code


def parse_speeds(members: list[str] | None, memo: dict[str, tuple]) -> list[dict] | None:
    """Number and unit of each member; where only the last one has a unit, it holds for all."""
    if members is None:
        return None
    out = []
    for item in members:
        known = memo.get(item)
        if known is None:
            if len(memo) > 200_000:
                memo.clear()
            known = memo[item] = parse_speed(item)
        out.append(known)
    shared = out[-1][1] if len(out) > 1 and not any(unit for _, unit in out[:-1]) else None
    return [{"number": number, "written": unit or shared} for number, unit in out]


SPEEDS = T.ArrayType(T.StructType([T.StructField("number", T.DoubleType()), T.StructField("written", T.StringType())]))


def speed_lists(df: DataFrame, keep: list[str], fields: dict[str, Packing] | None = None) -> DataFrame:
    """``keep`` columns, an array of members per further field, and ``speeds``: number and written unit of each member of ``maxspeed``."""
    fields = fields or {}
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(f"{f}_members", T.ArrayType(T.StringType())) for f in fields),
                           T.StructField("speeds", SPEEDS)])
    kind = pa.list_(pa.struct([("number", pa.float64()), ("written", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple] = {}
        for batch in batches:
            lists = [split_repeated(batch.column(f), p) for f, p in fields.items()]
            coded = batch.column("maxspeed").cast(pa.string()).dictionary_encode()
            speeds = [parse_speeds(m, memo) for m in split_packed(coded.dictionary, MAXSPEED).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *lists, pa.array(speeds, kind).take(coded.indices)], names=schema.names)

    return df.select(*dict.fromkeys([*keep, *fields, "maxspeed"])).mapInArrow(run, schema)


def unit_of_note(note: str | None) -> str | None:
    """What a free-text remark says of numbers without a unit; null when it says nothing.

    Only speed units count (a length in miles says nothing). Where several are
    named, a clause about bare numbers decides, then the remark's last word on it;
    a clause saying that a unit is always written says nothing of bare numbers.
    """
    if not note:
        return None
    text = note.lower()
    always = re.compile(r"(?:keep|carry|have|show|bear|retain)s?\s+(?:their|its|the|an?)\s+(?:unit|suffix)|always (?:with|written)")
    bare = re.compile(r"without|no (?:unit|suffix)|lack|bare|plain|undecorated|alone|unitless|naked|default|dropped|lost|as is|unless")
    clauses = [c for c in re.split(r"[;,]|\.(?=\s|$)(?<!m\.p\.h\.)(?<!k\.p\.h\.)", text) if c.strip()]
    named: list[tuple[bool, str]] = []
    carried: str | None = None
    for clause in clauses:
        if always.search(clause):
            if carried is not None and named:
                named.pop()  # the clause before speaks of the signs that keep their unit
            continue
        found = _unit_in(clause)
        carried = found
        if found:
            named.append((bool(bare.search(clause)), found))
    if not named:
        return None
    return max(enumerate(named), key=lambda x: (x[1][0], x[0]))[1][1]


def _unit_in(clause: str) -> str | None:
    if re.search(_TENTH, clause):
        return "tenth_kmh"
    best = None
    for code, pattern in _PATTERNS.items():
        for m in re.finditer(rf"(?<![a-z0-9])(?:{pattern})(?![a-z0-9])", clause):
            if best is None or m.start() > best[0]:
                best = (m.start(), code)
    return best[1] if best else None


def speed_members(lists: DataFrame) -> DataFrame:
    """``(ord, extract_id, pos, n, number, written)``: members of ``speed_lists`` that state a number."""
    rows = lists.where("speeds IS NOT NULL").select("ord", "extract_id", F.size("speeds").alias("n"), F.posexplode("speeds").alias("_p", "s"))
    return rows.where("s.number IS NOT NULL").select("ord", "extract_id", (F.col("_p") + 1).alias("pos"), "n", "s.number", "s.written")


def speed_bin(value: Column) -> Column:
    """Bin of ln(value); zero has a bin of its own."""
    return F.when(value > 0, F.floor(F.ln(value) / BIN)).otherwise(F.lit(-100_000)).cast("int")


def source_key() -> Column:
    return F.coalesce("extract_id", F.lit(-1))


def fit_mixture(centres: np.ndarray, counts: np.ndarray, components: int = COMPONENTS, rounds: int = 40) -> np.ndarray:
    """Rows ``(weight, mean, sd)`` of a normal mixture fitted by EM to a histogram; the last, wide one keeps a twentieth."""
    c = counts.astype(float)
    peaks: list[float] = []
    for i in np.lexsort((centres, -c)):
        if len(peaks) < components - 1 and all(abs(centres[i] - m) > 2.5 * BIN for m in peaks):
            peaks.append(centres[i])
    middle = (centres * c).sum() / c.sum()
    mean = np.array([*peaks, middle])
    sd = np.full(len(mean), BIN)
    sd[-1] = max(math.sqrt((c * (centres - middle) ** 2).sum() / c.sum()), 0.25)
    weight = np.full(len(mean), 1 / len(mean))
    for _ in range(rounds):
        dens = weight * np.exp(-0.5 * ((centres[:, None] - mean) / sd) ** 2) / sd + 1e-300
        resp = dens / dens.sum(1, keepdims=True) * c[:, None]
        mass = resp.sum(0) + 1e-9
        weight = np.maximum(mass / mass.sum(), 1e-6)
        weight[-1] = max(weight[-1], 0.05)
        weight /= weight.sum()
        mean[:-1] = ((resp * centres[:, None]).sum(0) / mass)[:-1]
        sd[:-1] = np.clip(np.sqrt((resp * (centres[:, None] - mean) ** 2).sum(0) / mass), 0.012, 0.1)[:-1]
    return np.column_stack((weight, mean, sd))


def unit_posteriors(centres: np.ndarray, counts: np.ndarray, mixture: np.ndarray) -> np.ndarray:
    """Posterior over ``UNITS`` of each bin of one source's numbers."""
    shift = np.log(np.array([M_PER_H[u] for u in UNITS]) / 1000.0)
    z = centres[:, None] + shift
    w, mu, sd = mixture.T
    dens = (w * np.exp(-0.5 * ((z[..., None] - mu) / sd) ** 2) / sd).sum(-1) / math.sqrt(2 * math.pi)
    total = (counts[:, None] * np.log((1 - STRAY) * dens + STRAY * 0.1)).sum(0)
    source = np.exp(total - total.max())
    source = (1 - STRAY) * source / source.sum() + STRAY / len(UNITS)
    post = source * (dens + 1e-9)
    return post / post.sum(1, keepdims=True)


def assign_units(members: DataFrame, extracts: DataFrame, follow_remarks: bool = True) -> DataFrame:
    """``(extract_key, bin, unit, mixture_unit, posterior)`` for each source and bin of numbers without a unit.

    ``mixture_unit`` has the highest posterior, ``posterior`` is that of ``unit``.
    """
    known = members.where("written IS NOT NULL AND number > 0")
    factor = F.create_map(*[F.lit(x) for u in UNITS for x in (u, M_PER_H[u] / 1000.0)])
    histogram = known.groupBy(speed_bin(F.col("number") * factor[F.col("written")]).alias("b")).count()
    bare = members.where("written IS NULL").groupBy(source_key().alias("extract_key"), speed_bin(F.col("number")).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    rows = histogram.collect()  # bins of a fixed width over at most 18 decades: some thousand rows at any size
    if not rows:  # nothing is written with a unit: take the numbers as they stand
        rows = bare.where("bin > -100000").groupBy(F.col("bin").alias("b")).agg(F.sum("c").alias("count")).collect()
    centres = np.array([(r["b"] + 0.5) * BIN for r in rows] or [math.log(50.0)])
    mixture = fit_mixture(centres, np.array([r["count"] for r in rows] or [1]))

    notes = extracts.where("extract_id IS NOT NULL").groupBy(F.col("extract_id").alias("extract_key")).agg(
        F.max_by("speed_note", F.struct("published_at")).alias("note"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        note = frame["note"].iloc[0]
        bins, counts = frame["bin"].to_numpy(), frame["c"].to_numpy().astype(float)
        zero = bins <= -100_000
        post = unit_posteriors(np.where(zero, 0.0, (bins + 0.5) * BIN), np.where(zero, 0.0, counts), mixture)
        post[zero] = 1 / len(UNITS)  # zero is zero in every unit
        found = post.argmax(1)
        stated = UNITS.index(unit_of_note(note if isinstance(note, str) else None) or "kmh")
        unit = np.full(len(found), stated) if follow_remarks else found
        return pd.DataFrame({"extract_key": frame["extract_key"], "bin": bins, "unit": [UNITS[i] for i in unit], "mixture_unit": [UNITS[i] for i in found],
                             "posterior": post[np.arange(len(found)), unit]})

    return bare.join(broadcast_if_small(notes), "extract_key", "left").groupBy("extract_key").applyInPandas(
        fit, "extract_key int, bin int, unit string, mixture_unit string, posterior double")


def metres_per_hour(number: Column, unit: Column) -> Column:
    factor = F.create_map(*[F.lit(x) for u in UNITS for x in (u, M_PER_H[u])])
    return F.round(number * factor[unit]).cast("bigint")


def speeds_in_metres(edges: DataFrame, extracts: DataFrame, follow_remarks: bool = True) -> DataFrame:
    """``(ord, pos, n, number, unit, m_per_h, mixture_unit, posterior, uncertain)`` of every member of ``maxspeed`` with a number.

    ``uncertain`` marks assigned units with a posterior below ``SURE``; written units have the posterior one.
    """
    members = materialize(speed_members(speed_lists(edges, ["ord", "extract_id"])), "speeds")
    units = broadcast_if_small(materialize(assign_units(members, extracts, follow_remarks), "units"))
    key = members.withColumn("extract_key", source_key()).withColumn("bin", speed_bin(F.col("number")))
    written = key.where("written IS NOT NULL").select(
        "ord", "pos", "n", "number", F.col("written").alias("unit"), F.col("written").alias("mixture_unit"), F.lit(1.0).alias("posterior"))
    bare = key.where("written IS NULL").join(units, ["extract_key", "bin"]).select("ord", "pos", "n", "number", "unit", "mixture_unit", "posterior")
    return written.unionByName(bare).withColumn("m_per_h", metres_per_hour(F.col("number"), F.col("unit"))).withColumn("uncertain", F.col("posterior") < SURE)


def foreign_speeds(edges: DataFrame, extracts: DataFrame) -> DataFrame:
    """``(ord, pos, m_per_h)`` of the members stated in another unit than km/h."""
    return speeds_in_metres(edges, extracts).where("unit <> 'kmh'").select("ord", "pos", "m_per_h").distinct()
