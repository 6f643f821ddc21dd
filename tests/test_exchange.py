"""Round trips of topologies, trees, bridges, lists, clusters, arrows and binary structures."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strandlake.sources import exchange as X
from strandlake.sources.matrices import read_newick
from strandlake.sources.structures import read_psf


def test_psf(spark, tmp_path):
    rows = [("a", 10 * k, "S" if k % 2 else "", k, "ALA", f"C{k}", "CT1", 0.25 * k, 12.011) for k in range(6)] + [("b", 0, None, None, None, "X", None, None, None)]
    atoms = spark.createDataFrame(rows, "file string, atom_index int, segment string, resnum int, resname string, name string, type string, charge double, mass double")
    bonds = spark.createDataFrame([("a", 10 * i, 10 * j) for i in range(6) for j in range(i)], "file string, i int, j int")
    X.write_psf(atoms, bonds, str(tmp_path / "psf"))
    back, linked = read_psf(spark, str(tmp_path / "psf/*/*"))
    got = {(("a" if "file=a" in r.file else "b"), r.atom_index): r for r in back.collect()}
    assert len(got) == 7 and got["a", 3].name == "C3" and got["a", 3].segment == "S" and got["a", 2].segment == "UNK" and got["a", 3].charge == 0.75 and got["b", 0].resname == "UNK"
    assert {(r.i, r.j) for r in linked.collect()} == {(j, i) for i in range(6) for j in range(i)}


def test_newick(spark, tmp_path):
    text = "((a:1.5,b:2.0)ab:0.25,(c:1.0,(d:0.5,e:0.125):3.0):1.0);"
    (tmp_path / "t.nwk").write_text(text)
    edges = read_newick(spark, str(tmp_path / "t.nwk"))
    assert X.newick_texts(edges).first().newick == text
    deep = spark.createDataFrame([("deep", k, k - 1 if k else None, 1.0 if k else None, "tip" if k == 3000 else "") for k in range(3001)], "file string, child long, parent long, length double, name string")
    X.write_newick(deep, str(tmp_path / "trees"))
    assert read_newick(spark, str(tmp_path / "trees/*/*")).count() == 3001


def test_bridges(spark, tmp_path):
    rows = [("w", 0, [1, 5], [9]), ("w", 2, [2, 7], [11, 12]), ("w", 2, [3], [])]
    X.write_bridges(spark.createDataFrame(rows, "file string, frame int, proteins array<int>, waters array<int>"), str(tmp_path / "wb"))
    back = X.read_bridges(spark, str(tmp_path / "wb/*/*")).collect()
    assert sorted((r.frame, r.proteins, r.waters) for r in back) == sorted((f, p, w) for _, f, p, w in rows)


def test_bridges_of_a_file_in_blocks(spark, tmp_path):
    """No task holds a whole file; frames are counted across blocks, without bridges too."""
    rows = [(f, k // 50, [k, k + 1], [k % 7] * (k % 3)) for f in ("u", "v") for k in range(1000) if k // 50 not in (0, 5, 19)]
    X.write_bridges(spark.createDataFrame(rows, "file string, frame int, proteins array<int>, waters array<int>"), str(tmp_path / "wb"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        found = X.read_bridges(spark, str(tmp_path / "wb/*/*")).withColumn("at", F.spark_partition_id())
        back = found.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(("u" if "file=u" in r.file else "v", r.frame, r.proteins, r.waters) for r in back) == sorted(rows)
    assert len({r.at for r in back if "file=u" in r.file}) > 1


def test_lists_and_clusters(spark, tmp_path):
    X.write_chain_list(spark.createDataFrame([("l", "1abc_ca", "A"), ("l", "2xyz", "B")], "file string, title string, chain string"), str(tmp_path / "list"))
    assert sorted(tuple(r)[1:] for r in X.read_chain_list(spark, str(tmp_path / "list/*/*")).collect()) == [("1abc", "ca", "A"), ("2xyz", None, "B")]
    (tmp_path / "bc.out").write_text("1ABC_1 AF_AFP1_2\n\n2XYZ_1 1ABC_2 \n")
    clusters = X.read_clusters(spark, str(tmp_path / "bc.out"))
    assert sorted(tuple(r) for r in X.cluster_of(clusters, "1abc", "2").collect()) == [("1ABC", "2"), ("2XYZ", "1")]
    assert ("AF_AFP1", "2") in {(r.structure_id, r.entity) for r in clusters.collect()} and X.cluster_of(clusters, "9zzz").count() == 0


def test_arrows(spark, tmp_path):
    modes = spark.createDataFrame([(m, e, 1 / e if e else 0.0, 0, k, v) for m, e, vs in ((0, 4.0, (0.6, 0.8, 0.0)), (1, 0.0, (1.0, 0.0, 0.0))) for k, v in enumerate(vs)], "mode int, eigval double, variance double, node int, axis int, v double")
    coords = spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "node int, x double, y double, z double")
    assert [r.line for r in X.arrow_lines(modes, coords, 10.0).collect()] == [".arrow 1.000 2.000 3.000 4.000 6.000 3.000"]
    X.write_arrows(modes, coords, str(tmp_path / "bild"), "m", 10.0)
    lines = [r.value for r in spark.read.text(str(tmp_path / "bild/file=m_1")).collect()]
    assert lines == [".comment mode 1 0.50", ".arrow 1.000 2.000 3.000 4.000 6.000 3.000"]


def test_codecs():
    head = lambda c, n, p: struct.pack(">iii", c, n, p)
    ints = lambda a, s: np.array(a, f">i{s}").tobytes()
    assert X.decoded(head(7, 5, 0) + ints([4, 3, -1, 2], 4)).tolist() == [4, 4, 4, -1, -1]
    assert X.decoded(head(8, 4, 0) + ints([1, 3, 5, 1], 4)).tolist() == [1, 2, 3, 8]
    assert X.decoded(head(9, 3, 100) + ints([150, 2, -25, 1], 4)).tolist() == [1.5, 1.5, -0.25]
    assert X.decoded(head(10, 3, 1000) + ints([32767, 233, 500, -32768, -232], 2)).tolist() == [33.0, 33.5, 0.5]
    assert X.decoded(head(11, 2, 10) + ints([5, -15], 2)).tolist() == [0.5, -1.5]
    assert X.decoded(head(14, 2, 0) + ints([32767, 3, 7], 2)).tolist() == [32770, 7] and X.decoded(head(15, 2, 0) + ints([127, 0, -128, -2], 1)).tolist() == [127, -130]
    assert X.decoded(head(6, 3, 0) + ints([0, 2, 65, 1], 4)) == ["", "", "A"] and X.decoded(head(5, 2, 4) + b"A\0\0\0BC\0\0") == ["A", "BC"]
    value = {"a": [1, -5, 300, 2**40, -(2**40), 1.5, None, True], "b": {"c": b"xyz", "d": "text"}, "e": list(range(40))}
    assert X._unpack(X._pack(value))[0] == value
    short = bytes([0x82, 0xA1, 0x61, 0x93, 0x01, 0xFF, 0xCC, 0xC8, 0xA1, 0x62, 0xC4, 0x02, 0x09, 0x08])
    assert X._unpack(short)[0] == {"a": [1, -1, 200], "b": b"\t\x08"}


def test_mmtf(spark, tmp_path):
    rows, n = [], 0
    for model in range(2):
        index = 0
        for chain, resnum, resname, het, names in (("A", 5, "ALA", False, ("N", "CA")), ("A", 6, "GLY", False, ("N", "CA", "C")), ("B", 1, "HOH", True, ("O",)), ("A", 9, "ALA", False, ("N", "CA"))):
            for name in names:
                n += 1
                rows.append(("1abc", model, index, n, name, "A" if n == 3 else "", resname, chain, "S" + chain, resnum, "B" if resnum == 6 else "", n * 0.5, -n * 1.25, float(n), 1.0, 20.5, name[0], 0, het))
                index += 1
    atoms = spark.createDataFrame(rows, X.BINARY)
    for r in X.mmtf_bytes(atoms).collect():
        (tmp_path / f"{r.structure_id}.mmtf").write_bytes(bytes(r.content))
    back = X.read_mmtf(spark, str(tmp_path / "*.mmtf")).orderBy("serial").toPandas()
    pd.testing.assert_frame_equal(back, atoms.orderBy("serial").toPandas(), check_dtype=False)
    assert X.mmtf_bytes(atoms.where(F.lit(False))).count() == 0
