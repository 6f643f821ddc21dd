"""Readers against hand-written files, and round trips."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.sources import matrices as X
from strandlake.sources import sequences as Q
from strandlake.sources import structures as T

PDB = """\
HEADER    TEST
HELIX    1   1 ALA A    1  ALA A    2  1                                   2
SHEET    1   A 1 GLY B  10  GLY B  11  0
MODEL        1
ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00  0.50      SEG1 N
ANISOU    1  N   ALA A   1     2406   1892   1614    198    519   -328       N
ATOM      2  CA AALA A   1A     12.000   6.000  -6.000  0.60  1.00      SEG1 C
ATOM      3  CA BALA A   1A     12.500   6.000  -6.000  0.40  1.00      SEG1 C
HETATM    4 ZN    ZN B 300      -1.000  -2.000   3.500  1.00 20.00          ZN2+
TER
ENDMDL
MODEL        2
ATOM      1  N   ALA A   1      21.104   6.134  -6.504  1.00  0.50      SEG1 N
ATOM      2  CA AALA A   1A     22.000   6.000  -6.000  0.60  1.00      SEG1 C
ATOM      3  CA BALA A   1A     22.500   6.000  -6.000  0.40  1.00      SEG1 C
HETATM    4 ZN    ZN B 300      -1.000  -2.000   9.500  1.00 20.00          ZN2+
ENDMDL
END
"""


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(tmp_path / name)

    return write


def test_pdb(spark, put, tmp_path):
    path = put("one.pdb", PDB)
    atoms = T.read_pdb(spark, path).orderBy("cset", "atom_index")
    rows = atoms.collect()
    assert [(r.cset, r.atom_index, r.name, r.resname, r.chain, r.resnum, r.icode) for r in rows[:3]] == [(0, 0, "N", "ALA", "A", 1, ""), (0, 1, "CA", "ALA", "A", 1, "A"), (0, 2, "ZN", "ZN", "B", 300, "")]
    assert (rows[0].x, rows[0].y, rows[0].z, rows[0].beta, rows[0].segment, rows[0].element) == (11.104, 6.134, -6.504, 0.5, "SEG1", "N")
    assert rows[0].anisou == [0.2406, 0.1892, 0.1614, 0.0198, 0.0519, -0.0328] and rows[1].anisou is None
    assert rows[2].hetatm and rows[2].charge == "2+" and rows[3].x == 21.104 and len(rows) == 6
    assert T.read_pdb(spark, path, model=2).count() == 3 and T.read_pdb(spark, path, altloc=None).count() == 8
    assert T.read_pdb(spark, path, chain="B").count() == 2 and T.read_pdb(spark, path, subset="ca").count() == 2
    T.write_pdb(atoms, f"{tmp_path}/out")
    again = T.read_pdb(spark, f"{tmp_path}/out/structure_id=one").orderBy("cset", "atom_index")
    same = [c for c in atoms.columns if c not in ("anisou", "structure_id")]
    assert again.select(same).collect() == atoms.select(same).collect()
    codes = {(r.chain, r.resnum): r.code for r in T.header_ranges(spark, path).collect()}
    assert codes == {("A", 1): "H", ("A", 2): "H", ("B", 10): "E", ("B", 11): "E"}
    assert T.files_by_name(spark, str(tmp_path)).where("name = 'one'").count() == 1


def test_pqr(spark, put, tmp_path):
    path = put("q.pqr", "ATOM 1 N ALA A 1 1.0 2.0 3.0 -0.3 1.8\nATOM 2 CA ALA 2 4.0 5.0 6.0 0.1 2.2\nEND\n")
    rows = T.read_pqr(spark, path).orderBy("atom_index")
    assert [(r.chain, r.resnum, r.x, r.charge, r.radius) for r in rows.collect()] == [("A", 1, 1.0, -0.3, 1.8), ("", 2, 4.0, 0.1, 2.2)]
    T.write_pqr(rows, f"{tmp_path}/out")
    assert T.read_pqr(spark, f"{tmp_path}/out/structure_id=q").drop("structure_id").orderBy("atom_index").collect() == rows.drop("structure_id").collect()


CIF = """\
data_TEST
_entry.id   TEST
#
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.auth_comp_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.pdbx_PDB_ins_code
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.B_iso_or_equiv
_atom_site.pdbx_PDB_model_num
ATOM 1 N N ALA A 1 ? 1.0 2.0 3.0 1.00 5.0 1
ATOM 2 O "O5'" DA A 2 B 1.5 2.0 3.0 1.00 5.0 1
HETATM 3 O O HOH B 3 ? 9.0 2.0 3.0 1.00 5.0 2
#
"""


def test_mmcif_and_star(spark, put, tmp_path):
    path = put("t.cif", CIF)
    atoms = T.read_mmcif(spark, path).orderBy("serial")
    rows = atoms.collect()
    assert [(r.cset, r.name, r.resname, r.chain, r.resnum, r.icode, r.x, r.hetatm) for r in rows] == [(0, "N", "ALA", "A", 1, "", 1.0, False), (0, "O5'", "DA", "A", 2, "B", 1.5, False), (1, "O", "HOH", "B", 3, "", 9.0, True)]
    loops = T.read_loops(spark, path)
    assert loops.where("item = 'entry.id'").first().value == "TEST"
    T.write_mmcif(atoms, f"{tmp_path}/out")
    again = T.read_mmcif(spark, f"{tmp_path}/out/structure_id=t").orderBy("serial")
    same = [c for c in atoms.columns if c not in ("structure_id", "atom_index")]
    assert again.select(same).collect() == atoms.select(same).collect()
    star = put("s.star", "data_\nloop_\n_rlnA #1\n_rlnB #2\n1 'two words'\n3 four\n")
    long = T.read_loops(spark, star)
    assert {(r.row, r.item): r.value for r in long.collect()} == {(0, "rlnA"): "1", (0, "rlnB"): "two words", (1, "rlnA"): "3", (1, "rlnB"): "four"}
    T.write_loops(long, f"{tmp_path}/stars")
    back = T.read_loops(spark, f"{tmp_path}/stars/file=s.star")
    assert {(r.row, r.item): r.value for r in back.collect()} == {(r.row, r.item): r.value for r in long.collect()}


def test_psf(spark, put):
    text = "PSF\n\n       1 !NTITLE\n REMARKS x\n\n       3 !NATOM\n 1 MAIN 1 ALA N NH1 -0.47 14.007 0\n 2 MAIN 1 ALA CA CT1 0.07 12.011 0\n 3 MAIN 1 ALA C C 0.51 12.011 0\n\n       2 !NBOND: bonds\n       1       2       2       3\n\n"
    atoms, bonds = T.read_psf(spark, put("a.psf", text))
    assert [(r.atom_index, r.name, r.charge) for r in atoms.orderBy("atom_index").collect()] == [(0, "N", -0.47), (1, "CA", 0.07), (2, "C", 0.51)]
    assert {(r.i, r.j) for r in bonds.collect()} == {(0, 1), (1, 2)}


def test_alignments(spark, put, tmp_path):
    want = [(0, "A/1-6", "AC-DEF"), (1, "B", "acgd-F")]
    texts = {
        "fasta": ">A/1-6\nAC-\nDEF\n>B\nacgd-F\n",
        "selex": "A/1-6   AC-DEF\nB   acgd-F\n",
        "stockholm": "# STOCKHOLM 1.0\n#=GF ID x\nA/1-6 AC-DEF\nB acgd-F\n//\n",
        "clustal": "CLUSTAL W (1.8)\n\nA/1-6  AC-D\nB  acgd\n       * *\n\nA/1-6  EF\nB  -F\n",
        "pir": ">P1;A/1-6\ndescription\nAC-\nDEF*\n>P1;B\nother\nacgd-F*\n",
    }
    for kind, text in texts.items():
        msa = Q.read_msa(spark, put(f"m_{kind}.txt", text), kind)
        assert [tuple(r)[1:] for r in msa.orderBy("seq_idx").collect()] == want, kind
        Q.write_msa(msa, f"{tmp_path}/out_{kind}", kind)
        back = Q.read_msa(spark, f"{tmp_path}/out_{kind}/file=m_{kind}.txt", kind)
        assert [tuple(r)[1:] for r in back.orderBy("seq_idx").collect()] == want, kind
    path = put("f.fasta", texts["fasta"])
    assert Q.read_msa(spark, path, "fasta", keep=F.col("label") == "B", columns=(1, 4)).first().seq == "cgd"


def test_numbers(spark, put, tmp_path):
    m = X.read_array(spark, put("m.txt", "# c\n1 2.5\n3 4\n"))
    assert {(r.i, r.j): r.value for r in m.collect()} == {(0, 0): 1, (0, 1): 2.5, (1, 0): 3, (1, 1): 4}
    X.write_array(m, f"{tmp_path}/arr", 1)
    assert X.read_array(spark, f"{tmp_path}/arr").collect() and X.read_array(spark, f"{tmp_path}/arr").where("value = 2.5").count() == 1
    t = X.read_triples(spark, put("t.coo", "1 1 2.0\n2 1 -1.0\n"), symmetric=True)
    assert {(r.i, r.j): r.value for r in t.collect()} == {(0, 0): 2.0, (1, 0): -1.0, (0, 1): -1.0}
    X.write_triples(t, f"{tmp_path}/coo")
    assert sorted(map(tuple, X.read_triples(spark, f"{tmp_path}/coo").collect())) == sorted(map(tuple, t.collect()))
    hic = X.read_contact_map(spark, put("h.txt", "0 10 5\n10 10 2\n3 12 1\n"), 10)
    assert {(r.i, r.j): r.value for r in hic.collect()} == {(0, 1): 6.0, (1, 0): 6.0, (1, 1): 2.0}
    dense = X.read_contact_map(spark, put("d.txt", "0 1 2 3\n1 0 0 0\n2 0 0 0\n3 0 0 0\n"))
    assert dense.count() == 6


def test_trajectories(spark, put):
    xyz = np.random.default_rng(0).normal(size=(6, 4, 3)).astype(np.float32)
    for name, cell in (("a.dcd", None), ("b.dcd", [10, 0, 11, 0, 0, 12])):
        frames = X.read_dcd(spark, put(name, X.dcd_bytes(xyz, cell))).orderBy("frame").collect()
        assert np.allclose([r.xyz for r in frames], xyz) and frames[0].unitcell == cell
    some = X.read_dcd(spark, put("c.dcd", X.dcd_bytes(xyz)), start=1, stop=6, step=2)
    assert [r.frame for r in some.orderBy("frame").collect()] == [1, 3, 5]
    assert X.frame_atoms(some).count() == 12


def test_modes_ontology_trees_snapshots(spark, put, tmp_path):
    text = "name x\nmode 1 2.0 0.1 0.2 0.3 0.4 0.5 0.6\nmode 2 1.5 1 0 0 0 0 1\n"
    modes = X.read_modes(spark, put("m.nmd", text))
    assert {(r.mode, r.node, r.axis): r.v for r in modes.collect()}[1, 1, 2] == 1.0 and modes.where("mode = 0").first().variance == 4.0
    atoms = spark.createDataFrame([(i, "CA", "ALA", "A", i, 1.0, 2.0, 3.0) for i in range(2)], "atom_index int, name string, resname string, chain string, resnum int, x double, y double, z double")
    X.write_modes(modes, atoms, f"{tmp_path}/nmd")
    assert sorted(map(tuple, X.read_modes(spark, f"{tmp_path}/nmd").collect())) == sorted(map(tuple, modes.collect()))
    obo = "format-version: 1.2\n\n[Term]\nid: G:1\nname: root\nnamespace: f\n\n[Term]\nid: G:2\nname: kid\nnamespace: f\nis_a: G:1 ! root\n\n[Term]\nid: G:3\nname: old\nis_obsolete: true\n\n[Typedef]\nid: part_of\n"
    terms, edges = X.read_obo(spark, put("o.obo", obo))
    assert {r.id: r.name for r in terms.collect()} == {"G:1": "root", "G:2": "kid"} and [tuple(r) for r in edges.collect()] == [("G:2", "G:1")]
    gaf = X.read_gaf(spark, put("g.gaf", "!h\nPDB\t1ABC\tsym\tinv\tG:1\tref\tIEA\t\tF\n"))
    assert tuple(gaf.first()) == ("PDB", "1ABC", "sym", "inv", "G:1", "IEA", "F")
    tree = {r.name: r for r in X.read_newick(spark, put("t.nwk", "((a:1,b:2)x:0.5,c:3);")).collect() if r.name}
    assert set(tree) == {"a", "b", "c", "x"} and tree["a"].parent == tree["x"].child and tree["b"].length == 2.0
    X.save(atoms, f"{tmp_path}/snap", ("chain",))
    assert X.load(spark, f"{tmp_path}/snap").count() == 2


def test_density_annotations_heatmaps(spark, put, tmp_path):
    from strandlake.sources import annotations as N

    grid = np.arange(24, dtype=float).reshape(2, 3, 4)
    v = N.read_density(spark, put("a.mrc", N.density_bytes(grid, 2.0, (1.0, 0.0, 0.0))), low=5)
    got = {(r.i, r.j, r.k): (r.density, r.x, r.z) for r in v.collect()}
    assert got == {tuple(map(int, at)): (grid[tuple(at)], 1.0 + 2 * at[0], 2.0 * at[2]) for at in np.argwhere(grid >= 5)}
    assert N.thresholded(v, high=10).where("density > 10").isEmpty()
    head = "  #  RESIDUE AA STRUCTURE BP1 BP2  ACC\n"
    line = "    1    5 A M  H              0   0  123".ljust(103) + " -60.1 -45.0\n"
    blank = "    2    6AA G                 0   0   12".ljust(103) + " 360.0 120.0\n"
    rows = N.read_dssp(spark, put("x.dssp", "junk\n" + head + line + blank)).orderBy("resnum").collect()
    assert [(r.chain, r.resnum, r.icode, r.code, r.phi, r.psi) for r in rows] == [("A", 5, "", "H", -60.1, -45.0), ("A", 6, "A", "C", 360.0, 120.0)]
    ss = N.read_stride(spark, put("x.stride", "REM x\nASG  ALA A    5    1    H   AlphaHelix   -60.00   -45.00      12.3\n")).first()
    assert (ss.chain, ss.resnum, ss.code, ss.phi, ss.accessible) == ("A", 5, "H", -60.0, 12.3)
    cells = spark.createDataFrame([(0, 0, 1.5), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)], "i int, j int, value double")
    text = "\n".join(r.line for r in N.heatmap_lines(cells, title="T x", min="0").orderBy("order").collect())
    settings, back = N.read_heatmap(spark, put("h.hm", text + "\n"))
    assert settings == {"title": "T x", "min": "0"} and sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))
    atoms = spark.createDataFrame([(0, "A", 5, ""), (1, "B", 1, "")], "atom_index int, chain string, resnum int, icode string")
    named = {r.atom_index: r.code for r in N.annotated(atoms, N.read_dssp(spark, put("y.dssp", head + line)), ("code",)).collect()}
    assert named == {0: "H", 1: None}
