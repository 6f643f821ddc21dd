"""The selection language against predicates over rows in plain Python."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import selection as S
from strandlake.functions.syntax import SelectionError

ATOMS = []
_names = ["N", "CA", "C", "O", "CB", "CG", "H", "1HB"]
for k in range(12):
    res = ["ALA", "GLY", "SER", "HIS", "ASP", "LYS", "MSE", "HOH", "ZN", "DA", "GLC", "VAL"][k]
    for n in {"HOH": ["O"], "ZN": ["ZN"], "DA": ["P", "C5", "N1"], "GLC": ["C1", "O1"]}.get(res, _names):
        i = len(ATOMS)
        ATOMS.append(
            dict(atom_index=i, serial=i * 2 + 1, name=n, resname=res, resnum=k - 2 if k < 6 else k, icode="A" if k == 4 else "", chain="ABC "[k // 3].strip(), segment="S" if k < 6 else "T",
                 altloc=" " if k % 2 else "", secondary="HEC"[k % 3], x=math.sin(i) * 9, y=math.cos(2 * i) * 9, z=float(i % 7), beta=float(i % 5) * 10, occupancy=1.0, resindex=k, chindex=k // 3, segindex=k // 6, temp=None if i % 10 == 0 else float(i))
        )
BONDS = [(i, i + 1) for i in range(len(ATOMS) - 1) if ATOMS[i]["resindex"] == ATOMS[i + 1]["resindex"]]


@pytest.fixture(scope="module")
def table(spark):
    schema = "atom_index int, serial int, name string, resname string, resnum int, icode string, chain string, segment string, altloc string, secondary string, x double, y double, z double, beta double, occupancy double, resindex int, chindex int, segindex int, temp double"
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple(a[c] for c in names) for a in ATOMS], schema)
    return S.AtomTable(df, bonds=spark.createDataFrame(BONDS, "i int, j int"))


def near(r, inside):
    pts = [np.array([a["x"], a["y"], a["z"]]) for a in ATOMS if inside(a)]
    return lambda a: any(((np.array([a["x"], a["y"], a["z"]]) - p) ** 2).sum() <= r * r for p in pts)


AMINO = {"ALA", "GLY", "SER", "HIS", "ASP", "LYS", "MSE", "VAL"}
protein = lambda a: a["resname"] in AMINO
hydrogen = lambda a: bool(re.match("[0-9]?H.*", a["name"])) and a["resname"] != "ZN"
first = lambda a: a["atom_index"] == 0

CASES = {
    "protein": protein,
    "aminoacid and not water": protein,
    "calpha": lambda a: a["name"] == "CA" and a["resname"] in AMINO,
    "ca": lambda a: a["name"] == "CA" and a["resname"] in AMINO,
    "backbone": lambda a: protein(a) and a["name"] in {"CA", "C", "O", "N"},
    "sidechain": lambda a: protein(a) and a["name"] not in {"CA", "C", "O", "N", "H"},
    "hydrogen": hydrogen,
    "noh hetero not water": lambda a: not hydrogen(a) and a["resname"] in {"ZN", "GLC", "HOH"} and a["resname"] != "HOH",
    "not water hetero": lambda a: a["resname"] in {"ZN", "GLC"},
    "acidic": lambda a: a["resname"] == "ASP",
    "charged calpha": lambda a: a["name"] == "CA" and a["resname"] in {"ASP", "LYS", "HIS"},
    "nonstdaa": lambda a: a["resname"] == "MSE",
    "nucleic or ion or sugar": lambda a: a["resname"] in {"DA", "ZN", "GLC"},
    "helix": lambda a: a["secondary"] == "H",
    "carbon": lambda a: a["name"].startswith("C"),
    "all": lambda a: True,
    "none": lambda a: False,
    "resname ALA GLY name CA CB": lambda a: a["resname"] in {"ALA", "GLY"} and a["name"] in {"CA", "CB"},
    "chain _": lambda a: a["chain"] == "",
    "altloc _": lambda a: True,
    "chid A or segname T": lambda a: a["chain"] == "A" or a["segment"] == "T",
    "resnum 1": lambda a: a["resnum"] == 1,
    "resid `-2 to 1`": lambda a: -2 <= a["resnum"] <= 1,
    "resnum 0:3": lambda a: 0 <= a["resnum"] < 3,
    "resnum 0:9:3": lambda a: a["resnum"] in {0, 3, 6},
    "resnum 1to3 7": lambda a: 1 <= a["resnum"] <= 3 or a["resnum"] == 7,
    "resnum 2A": lambda a: a["resnum"] == 2 and a["icode"] == "A",
    "resnum 2_": lambda a: a["resnum"] == 2 and a["icode"] == "",
    "index 0:10:2 50": lambda a: a["atom_index"] in {0, 2, 4, 6, 8, 50},
    "serial 1 3 5": lambda a: a["serial"] in {1, 3, 5},
    "beta 10 40": lambda a: a["beta"] in {10, 40},
    "-3 <= x < 5": lambda a: -3 <= a["x"] < 5,
    "x ** 2 + y ^ 2 < 50 and z > 2": lambda a: a["x"] ** 2 + a["y"] ** 2 < 50 and a["z"] > 2,
    "sqrt(sq(x) + sq(y)) >= 9": lambda a: math.sqrt(a["x"] ** 2 + a["y"] ** 2) >= 9,
    "ceil(beta / 7) == 3": lambda a: math.ceil(a["beta"] / 7) == 3,
    "-x > 2": lambda a: -a["x"] > 2,
    "x % 3 < 1": lambda a: a["x"] % 3 < 1,
    "2 ** 3 ** 0 * z = 6": lambda a: 2 * a["z"] == 6,
    "(x + 1) * 2 > 3 or (name CA and z < 3)": lambda a: (a["x"] + 1) * 2 > 3 or (a["name"] == "CA" and a["z"] < 3),
    "abs(x) < 1 log10(beta + 1) > 1": lambda a: abs(a["x"]) < 1 and math.log10(a["beta"] + 1) > 1,
    'resname "[AG]L.*"': lambda a: re.match("[AG]L.*", a["resname"]) is not None,
    'name "C(A|B)"': lambda a: re.match("C(A|B)", a["name"]) is not None,
    "within 4 of index 0": near(4, first),
    "exwithin 4 of index 0": lambda a: near(4, first)(a) and not first(a),
    "within 5 of (resname ALA and name CA) and not chain A": lambda a: near(5, lambda b: b["resname"] == "ALA" and b["name"] == "CA")(a) and a["chain"] != "A",
    "same residue as index 0": lambda a: a["resindex"] == 0,
    "same chain as resname GLC": lambda a: a["chindex"] == 3,
    "same segment as within 1 of index 0": lambda a: a["segindex"] == 0 or any(near(1, first)(b) and b["segindex"] == a["segindex"] for b in ATOMS),
    "bonded to index 0": lambda a: a["atom_index"] in {0, 1},
    "bonded 2 to index 3": lambda a: a["atom_index"] in {1, 2, 3, 4, 5},
    "exbonded to index 3": lambda a: a["atom_index"] in {2, 4},
    "exbonded 2 to index 3": lambda a: a["atom_index"] in {1, 3, 5},
    "bonded 0 to index 0": lambda a: False,
    "not not not not index 1": lambda a: a["atom_index"] == 1,
    "temp < 10": lambda a: a["temp"] is not None and a["temp"] < 10,
    "not temp < 10": lambda a: not (a["temp"] is not None and a["temp"] < 10),
    "sequence AGS": lambda a: a["resindex"] in {0, 1, 2},
    'ca sequence "H.*|D"': lambda a: a["name"] == "CA" and a["resname"] in {"HIS", "ASP", "LYS"},
}


@pytest.mark.parametrize("text", CASES)
def test_case(table, text):
    got = sorted(r[0] for r in S.select(table, text).select("atom_index").collect())
    assert got == [a["atom_index"] for a in ATOMS if CASES[text](a)]


@pytest.mark.parametrize(
    "text",
    ["", "11 > 10", "chain A and and chain B", "same none as chain A", "x -1 to 2", "resnum 5 to 1", "resnum 5:5", "nonsense", "chain < 3", "not", "resnum", "within of chain A", "within x of chain A", 'name ""', "name ``", 'name "("', "(chain A", "chain A)", "x ! 3", "name CA or", "resnum ABC", "bonded x to index 0", "sqrt(x < 3", "same fragment as index 0"],
)
def test_errors_show_where(table, text):
    with pytest.raises(SelectionError) as e:
        S.select(table, text)
    assert "^" in str(e.value)


def test_division_by_zero(table):
    with pytest.raises(Exception, match="division by zero"):
        S.select(table, "x / (z - z) > 1").collect()


def test_named_points_flags_and_macros(table):
    got = {r[0] for r in S.select(table, "within 6 of centre", centre=(0.0, 0.0, 3.0)).select("atom_index").collect()}
    assert got == {a["atom_index"] for a in ATOMS if a["x"] ** 2 + a["y"] ** 2 + (a["z"] - 3) ** 2 <= 36}
    S.define_macro("tiny", "resname ALA GLY")
    try:
        assert S.is_macro("tiny") and S.select(table, "tiny ca").count() == 2
        with pytest.raises(ValueError):
            S.define_macro("protein", "all")
        with pytest.raises(ValueError):
            S.define_macro("Bad1", "all")
        with pytest.raises(SelectionError):
            S.define_macro("broken", "resname")
    finally:
        S.delete_macro("tiny")
    with pytest.raises(ValueError):
        S.select(table, "within 3 of water", water=(0, 0, 0))
    t = S.AtomTable(table.df, user_flags={"mine": F.col("atom_index") < 3})
    assert S.select(t, "mine and not index 1").count() == 2
    t.flags.add_nonstandard("GLC", "small")
    assert S.select(t, "nonstdaa").count() == 8 and "GLC" in t.flags.amino_acids()
    assert S.uses_coordinates("name CA and x < 3") and not S.uses_coordinates("chain A")


def test_set_operations(table):
    key = ("atom_index",)
    a, b = S.select(table, "chain A"), S.select(table, "name CA")
    ids = lambda d: sorted(r[0] for r in d.select("atom_index").collect())
    assert ids(S.intersection(a, b, key)) == ids(S.select(table, "chain A and name CA"))
    assert ids(S.union(a, b, key)) == ids(S.select(table, "chain A or name CA"))
    assert ids(S.complement(table.df, a, key)) == ids(S.select(table, "not chain A"))
    assert S.contains(table.df, a, key) and not S.contains(a, b, key)
    both = S.concatenation(a, a, "atom_index")
    assert both.count() == 2 * a.count() and both.agg(F.max("position")).first()[0] == both.count() - 1


def test_filters_reach_the_scan(spark, table, tmp_path):
    table.df.write.parquet(f"{tmp_path}/atoms.parquet")
    t = S.AtomTable(spark.read.parquet(f"{tmp_path}/atoms.parquet"))
    plan = S.select(t, "chain A and x < 3").select("atom_index")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(chain,A)" in plan and "LessThan(x,3.0)" in plan
    spatial = S.select(t, "within 5 of chain A")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in spatial and "Cartesian" not in spatial


def test_scopes_do_not_mix(spark):
    rows = [(s, i, float(i)) for s in ("a", "b") for i in range(5)]
    df = spark.createDataFrame(rows, "sid string, atom_index int, x double").withColumn("y", F.lit(0.0)).withColumn("z", F.lit(0.0)).withColumn("name", F.concat("sid", F.col("atom_index").cast("string")))
    t = S.AtomTable(df, scope=("sid",))
    got = {tuple(r) for r in S.select(t, "within 1 of name a2").select("sid", "atom_index").collect()}
    assert got == {("a", 1), ("a", 2), ("a", 3)}
