"""Topology, tree, bridge, chain-list, cluster, arrow and binary structure files.

Text files are written as one text a file by a shuffle on the file's name;
binary ones are read whole, a file a row, so that any number is read side by
side.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.plans.iteration import stored
from strandlake.session import workers_find_package
from strandlake.sources.structures import numbered_lines


def _write_lines(lines: DataFrame, path: str, order: Sequence[str]) -> None:
    """``line`` of each ``file`` in order."""
    lines.repartition("file").sortWithinPartitions("file", *order).select("file", "line").write.partitionBy("file").text(path)


# ---- topologies --------------------------------------------------------------


def write_psf(atoms: DataFrame, bonds: DataFrame, path: str) -> None:
    """X-PLOR topologies, one a ``file``, with atoms and bonds.

    ``atoms`` has (``file``, atom_index, segment, resnum, resname, name, type,
    charge, mass), ``bonds`` (``file``, i, j) by atom_index; atoms are numbered
    from 1 in order. Empty or missing texts are written as UNK (types as 0),
    missing numbers as 0. A file without atoms is not written.
    """
    text = lambda c, other: F.when(F.coalesce(F.trim(c), F.lit("")) == "", other).otherwise(F.trim(c))
    by = Window.partitionBy("file").orderBy("atom_index")
    number = F.row_number().over(by)
    listed = atoms.select("file", "atom_index", number.alias("n"), *[c for c in atoms.columns if c not in ("file", "atom_index")])
    line = F.format_string(
        "%8d %-4s %-4d %-4s %-4s %-4s %10.6f %13.4f %11d",
        F.col("n"), text("segment", "UNK"), F.coalesce("resnum", F.lit(1)), text("resname", "UNK"), text("name", "UNK"), text("type", "0"),
        F.coalesce(F.col("charge").cast("double"), F.lit(0.0)), F.coalesce(F.col("mass").cast("double"), F.lit(0.0)), F.lit(0),
    )
    rows = listed.select("file", F.lit(1).alias("part"), F.col("n").cast("long").alias("k"), line.alias("line"))
    total = listed.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max(F.length(text("type", "0"))).alias("wide"))
    head = F.array(F.concat(F.lit("PSF"), F.when(F.col("wide") > 4, " NAMD").otherwise("")), F.lit(""), F.format_string("%8d !NTITLE", F.lit(1)), F.lit(" REMARKS topology"), F.lit(""), F.format_string("%8d !NATOM", F.col("n")))
    top = total.select("file", F.lit(0).alias("part"), F.posexplode(head).alias("k", "line"))
    ends = listed.select("file", "atom_index", "n")
    side = lambda c: ends.withColumnsRenamed({"atom_index": c, "n": "n" + c})
    linked = bonds.select("file", "i", "j").distinct().join(side("i"), ["file", "i"]).join(side("j"), ["file", "j"]).select("file", F.least("ni", "nj").alias("a"), F.greatest("ni", "nj").alias("b")).distinct()
    place = F.row_number().over(Window.partitionBy("file").orderBy("a", "b")) - 1
    four = linked.withColumn("k", place).groupBy("file", F.floor(F.col("k") / 4).alias("row")).agg(F.sort_array(F.collect_list(F.struct("k", "a", "b"))).alias("s"))  # four bonds a line
    bond_lines = four.select("file", F.lit(3).alias("part"), F.col("row").alias("k"), F.array_join(F.transform("s", lambda s: F.format_string("%8d%8d", s["a"], s["b"])), "").alias("line"))
    count = total.join(linked.groupBy("file").agg(F.count(F.lit(1)).alias("m")), "file", "left")
    middle = F.array(F.lit(""), F.format_string("%8d !NBOND: bonds", F.coalesce("m", F.lit(0))))
    bond_head = count.select("file", F.lit(2).alias("part"), F.posexplode(middle).alias("k", "line"))
    parts = [p.withColumn("k", F.col("k").cast("long")) for p in (top, rows, bond_head, bond_lines)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    _write_lines(out, path, ("part", "k"))


# ---- trees -------------------------------------------------------------------


def newick_texts(edges: DataFrame) -> DataFrame:
    """(``file``, ``newick``) of trees as edges (see ``read_newick``); children in order of their numbers. One task a tree."""
    workers_find_package(edges.sparkSession)

    def text(pdf: pd.DataFrame) -> pd.DataFrame:
        below: dict = {}
        for r in pdf.sort_values("child").itertuples():
            below.setdefault(None if pd.isna(r.parent) else int(r.parent), []).append(r)
        # children are joined before their parent: a stack, so that depth has no bound
        done: dict = {}
        stack = [(r, False) for r in below.get(None, [])]
        while stack:
            r, ready = stack.pop()
            inner = below.get(int(r.child), [])
            if not ready:
                stack.append((r, True))
                stack += [(c, False) for c in inner]
                continue
            body = "(" + ",".join(done.pop(int(c.child)) for c in inner) + ")" if inner else ""
            length = "" if r.length is None or pd.isna(r.length) else f":{r.length!r}"
            done[int(r.child)] = body + (r.name or "") + length
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "newick": ["".join(done.values()) + ";"]})

    named = edges.select("file", "child", "parent", "length", F.col("name"))
    return named.groupBy("file").applyInPandas(text, "file string, newick string")


def write_newick(edges: DataFrame, path: str) -> None:
    _write_lines(newick_texts(edges).withColumnRenamed("newick", "line"), path, ())


# ---- water bridges, chains, clusters, arrows ----------------------------------


def write_bridges(bridges: DataFrame, path: str) -> None:
    """Bridges (``file``, ``frame``, ``proteins``, ``waters``: atom numbers) as lines ``1 2 | 3``; a frame ends with ENDFRAME, also one without bridges."""
    last = bridges.groupBy("file").agg(F.max("frame").alias("m")).select("file", F.explode(F.sequence(F.lit(0).cast(bridges.schema["frame"].dataType), "m")).alias("frame"))
    numbers = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), " ")
    each = bridges.select("file", "frame", F.lit(0).alias("end"), F.concat(numbers("proteins"), F.lit(" | "), numbers("waters")).alias("line"))
    _write_lines(each.unionByName(last.select("file", "frame", F.lit(1).alias("end"), F.lit("ENDFRAME").alias("line"))), path, ("frame", "end", "line"))


def read_bridges(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(``file``, ``frame``, ``proteins``, ``waters``) of such files.

    Files are read by blocks, so that no task holds a file: lines are stored
    with their frame in the block, each block with the frames that end in it,
    and the frames of the blocks before are added.
    """
    paths = [path] if isinstance(path, str) else list(path)
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    text = spark.read.option("lineSep", "\n").text(paths).select(*at, F.regexp_replace("value", "\r$", "").alias("line"))
    workers_find_package(spark)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, frame = None, 0
        rows = lambda file, start, frames, lines: pa.RecordBatch.from_arrays([pa.array([file] * len(frames), pa.string()), pa.array([start] * len(frames), pa.int64()), pa.array(frames, pa.int32()), lines], ["file", "start", "frame", "line"])
        for batch in batches:
            files, starts = batch["file"].dictionary_encode(), batch["start"].to_numpy()
            trimmed = pc.utf8_trim(batch["line"], " ")
            ended = pc.equal(trimmed, "ENDFRAME").to_numpy(zero_copy_only=False)
            keep = ~ended & pc.not_equal(trimmed, "").to_numpy(zero_copy_only=False)
            code = files.indices.to_numpy()
            cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(starts) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(code)] if len(code) else []):
                own = (files.dictionary[int(code[i])].as_py(), int(starts[i]))
                if own != part:
                    if part:
                        yield rows(*part, [frame], pa.nulls(1, pa.string()))
                    part, frame = own, 0
                past = np.cumsum(ended[i:j])
                yield rows(*part, (frame + past)[keep[i:j]], batch["line"].slice(i, j - i).filter(pa.array(keep[i:j])))
                frame += int(past[-1])
        if part:
            yield rows(*part, [frame], pa.nulls(1, pa.string()))

    held = stored(text.mapInArrow(numbered, "file string, start long, frame int, line string"), "bridges")
    by = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = held.where("line IS NULL").select("file", "start", F.coalesce(F.sum("frame").over(by), F.lit(0)).alias("before"))
    framed = held.where("line IS NOT NULL").join(F.broadcast(before), ["file", "start"]).withColumn("frame", (F.col("frame") + F.col("before")).cast("int"))  # one row a block of a file
    side = lambda k: F.transform(F.filter(F.split(F.split("line", r"\|")[k], r"\s+"), lambda x: x != ""), lambda x: x.cast("int"))
    return framed.select("file", "frame", side(0).alias("proteins"), side(1).alias("waters"))


def write_chain_list(chains: DataFrame, path: str) -> None:
    """Lines ``title chain`` of (``file``, ``title``, ``chain``)."""
    _write_lines(chains.select("file", F.concat_ws(" ", "title", "chain").alias("line")), path, ("line",))


def read_chain_list(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(``file``, ``structure_id``, ``subset``, ``chain``): the title's parts before and after its first ``_``."""
    words = F.split(F.trim("line"), r"\s+")
    lines = numbered_lines(spark, path).where("trim(line) <> ''")
    title = F.split(words[0], "_")
    return lines.select("file", title[0].alias("structure_id"), F.get(title, F.lit(1)).alias("subset"), F.get(words, F.lit(1)).alias("chain"))


def read_clusters(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Sequence clusters, one a line: (``file``, ``cluster``, ``structure_id``, ``entity``), members parted at their last ``_``."""
    lines = numbered_lines(spark, path).where("trim(line) <> ''")
    each = lines.select("file", F.col("line_no").alias("cluster"), F.explode(F.split(F.trim("line"), r"\s+")).alias("m"))
    return each.select("file", "cluster", F.regexp_extract("m", r"^(.*)_[^_]*$", 1).alias("structure_id"), F.regexp_extract("m", r"_([^_]*)$", 1).alias("entity"))


def cluster_of(clusters: DataFrame, structure: str, entity: str = "1") -> DataFrame:
    """All members of the clusters a structure's entity is in."""
    hit = clusters.where((F.upper("structure_id") == structure.upper()) & (F.col("entity") == entity)).select("file", "cluster").distinct()
    return clusters.join(hit, ["file", "cluster"], "left_semi").select("structure_id", "entity")


def arrow_lines(modes: DataFrame, coords: DataFrame, scale: float = 25.0, zero: float = 1e-6) -> DataFrame:
    """(``mode``, ``node``, ``line``): arrows from each node along a mode, as long as the root of its variance times ``scale``; modes of no eigenvalue have none.

    ``coords`` has (``node``, x, y, z).
    """
    at = modes.where(F.col("eigval") >= zero).groupBy("mode", "node").agg(*[F.sum(F.when(F.col("axis") == k, F.col("v") * F.sqrt("variance") * scale).otherwise(0.0)).alias("d" + c) for k, c in enumerate("xyz")])
    both = at.join(coords.select("node", *"xyz"), "node")
    return both.select("mode", "node", F.format_string(".arrow %.3f %.3f %.3f %.3f %.3f %.3f", *[F.col(c) for c in "xyz"], *[F.col(c) + F.col("d" + c) for c in "xyz"]).alias("line"))


def write_arrows(modes: DataFrame, coords: DataFrame, path: str, name: str = "modes", scale: float = 25.0) -> None:
    """Arrow files, one a mode, with the mode's number (from 1) and root variance in a comment."""
    lines = arrow_lines(modes, coords, scale).withColumn("part", F.lit(1))
    head = modes.where("eigval >= 1e-6").select("mode", "variance").distinct()
    note = head.select("mode", F.lit(None).cast(modes.schema["node"].dataType).alias("node"), F.format_string(".comment mode %d %.2f", F.col("mode") + 1, F.sqrt("variance")).alias("line"), F.lit(0).alias("part"))
    file: Column = F.concat(F.lit(name + "_"), (F.col("mode") + 1).cast("string"))
    _write_lines(note.unionByName(lines).withColumn("file", file), path, ("part", "node"))


# ---- binary structures ----------------------------------------------------------


def _unpack(data: bytes, at: int = 0) -> tuple[object, int]:
    """One MessagePack value and where it ends."""
    tag = data[at]
    at += 1
    if tag <= 0x7F:
        return tag, at
    if tag >= 0xE0:
        return tag - 256, at
    if tag in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[tag], at
    numbers = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    if tag in numbers:
        return struct.unpack_from(numbers[tag], data, at)[0], at + struct.calcsize(numbers[tag])
    sizes = {0xC4: ">B", 0xC5: ">H", 0xC6: ">I", 0xD9: ">B", 0xDA: ">H", 0xDB: ">I", 0xDC: ">H", 0xDD: ">I", 0xDE: ">H", 0xDF: ">I"}
    if tag <= 0x8F:
        kind, n = "map", tag & 15
    elif tag <= 0x9F:
        kind, n = "list", tag & 15
    elif tag <= 0xBF:
        kind, n = "text", tag & 31
    elif tag in sizes:
        n = struct.unpack_from(sizes[tag], data, at)[0]
        at += struct.calcsize(sizes[tag])
        kind = "bytes" if tag <= 0xC6 else "text" if tag <= 0xDB else "list" if tag <= 0xDD else "map"
    else:
        raise ValueError(f"unknown tag {tag:#x}")
    if kind in ("bytes", "text"):
        raw = data[at : at + n]
        return (raw if kind == "bytes" else raw.decode()), at + n
    out = []
    for _ in range(n * (2 if kind == "map" else 1)):
        value, at = _unpack(data, at)
        out.append(value)
    return (dict(zip(out[::2], out[1::2])) if kind == "map" else out), at


def _pack(value: object) -> bytes:
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, (int, np.integer)):
        return bytes([value]) if 0 <= value < 128 else b"\xd3" + struct.pack(">q", int(value))
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, bytes):
        return b"\xc6" + struct.pack(">I", len(value)) + value
    if isinstance(value, str):
        raw = value.encode()
        return b"\xdb" + struct.pack(">I", len(raw)) + raw
    if isinstance(value, dict):
        return b"\xdf" + struct.pack(">I", len(value)) + b"".join(_pack(k) + _pack(v) for k, v in value.items())
    return b"\xdd" + struct.pack(">I", len(value)) + b"".join(map(_pack, value))  # type: ignore[arg-type]


def _runs(a: np.ndarray) -> np.ndarray:
    return np.repeat(a[::2], a[1::2])


def _summed(a: np.ndarray, top: int) -> np.ndarray:
    """Integers split into parts: parts at the type's limits go on in the next one."""
    ends = (a != top) & (a != -top - 1)
    total = np.cumsum(a.astype(np.int64))[ends]
    return np.diff(total, prepend=0)


def decoded(field: object) -> object:
    """A field's values: MMTF arrays by the codec in their first twelve bytes, other values as they are."""
    if not isinstance(field, bytes):
        return field
    codec, _, parameter = struct.unpack(">iii", field[:12])
    body = field[12:]
    ints = lambda size: np.frombuffer(body, f">i{size}").astype(np.int64)
    if codec == 1:
        return np.frombuffer(body, ">f4").astype(float)
    if codec in (2, 3, 4):
        return ints({2: 1, 3: 2, 4: 4}[codec])
    if codec == 5:
        return [body[k : k + parameter].rstrip(b"\0").decode() for k in range(0, len(body), parameter)]
    if codec == 6:
        return ["" if c == 0 else chr(c) for c in _runs(ints(4))]
    if codec == 7:
        return _runs(ints(4))
    if codec == 8:
        return np.cumsum(_runs(ints(4)))
    if codec == 9:
        return _runs(ints(4)) / parameter
    if codec == 10:
        return np.cumsum(_summed(ints(2), 32767)) / parameter
    if codec == 11:
        return ints(2) / parameter
    if codec in (12, 13):
        return (_summed(ints(2), 32767) if codec == 12 else _summed(ints(1), 127)) / parameter
    if codec in (14, 15):
        return _summed(ints(2), 32767) if codec == 14 else _summed(ints(1), 127)
    raise ValueError(f"unknown codec {codec}")


BINARY = "structure_id string, cset int, atom_index int, serial int, name string, altloc string, resname string, chain string, segment string, resnum int, icode string, x double, y double, z double, occupancy double, beta double, element string, charge int, hetatm boolean"


def _binary_atoms(data: bytes) -> list[tuple]:
    m = {k: decoded(v) for k, v in _unpack(data)[0].items()}  # type: ignore[attr-defined]
    get = lambda k, other: m[k] if m.get(k) is not None and len(m[k]) else other
    n = int(m["numAtoms"])
    blank, one, zero = [""] * n, [1.0] * n, [0.0] * n
    serial, alt, occ, beta = get("atomIdList", range(1, n + 1)), get("altLocList", blank), get("occupancyList", one), get("bFactorList", zero)
    icodes = get("insCodeList", [""] * len(m["groupIdList"]))
    names = get("chainNameList", m["chainIdList"])
    out, a, g, c = [], 0, 0, 0
    for model, n_chains in enumerate(m["chainsPerModel"]):
        first = a
        for _ in range(n_chains):
            for _ in range(m["groupsPerChain"][c]):
                kind = m["groupList"][m["groupTypeList"][g]]
                polymer = "PEPTIDE" in kind["chemCompType"].upper() or "NA LINKING" in kind["chemCompType"].upper()
                for name, element, charge in zip(kind["atomNameList"], kind["elementList"], kind["formalChargeList"]):
                    out.append((
                        str(m.get("structureId") or ""), model, a - first, int(serial[a]), name, alt[a], kind["groupName"], names[c], m["chainIdList"][c], int(m["groupIdList"][g]), icodes[g],
                        float(m["xCoordList"][a]), float(m["yCoordList"][a]), float(m["zCoordList"][a]), float(occ[a]), float(beta[a]), element, int(charge), not polymer,
                    ))
                    a += 1
                g += 1
            c += 1
    return out


def read_mmtf(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Atom rows of binary MMTF files (packed by gzip or not); models are ``cset``, atoms counted from 0 in each."""
    workers_find_package(spark)
    names = [c.split()[0] for c in BINARY.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for pdf in batches:
            for raw in pdf["content"]:
                raw = bytes(raw)
                yield pd.DataFrame(_binary_atoms(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw), columns=names)

    files = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path))
    return files.select("content").mapInPandas(work, BINARY)


def mmtf_bytes(atoms: DataFrame) -> DataFrame:
    """(``structure_id``, ``content``): each structure's atoms (columns as ``read_mmtf`` gives them) as an MMTF file. One task a structure."""
    workers_find_package(atoms.sparkSession)

    def array(codec: int, n: int, parameter: int, body: bytes) -> bytes:
        return struct.pack(">iii", codec, n, parameter) + body

    def runs(a: Sequence[int]) -> bytes:
        out: list[int] = []
        for x in a:
            if out and out[-2] == x:
                out[-1] += 1
            else:
                out += [int(x), 1]
        return np.array(out, ">i4").tobytes()

    def texts(a: Sequence[str]) -> bytes:
        return array(5, len(a), 4, b"".join(x.encode()[:4].ljust(4, b"\0") for x in a))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cset", "atom_index"])
        chains = pdf.groupby("cset", sort=True).apply(lambda d: (d[["chain", "segment"]] != d[["chain", "segment"]].shift()).any(axis=1).cumsum(), include_groups=False).to_numpy().ravel()
        keys = list(zip(pdf["cset"], chains, pdf["resnum"], pdf["icode"], pdf["resname"]))
        starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
        spans = list(zip(starts, [*starts[1:], len(keys)]))
        kinds: dict = {}
        types = []
        for a, b in spans:
            part = pdf.iloc[a:b]
            kind = (part["resname"].iloc[0], tuple(part["name"]), tuple(part["element"]), tuple(int(x) for x in part["charge"]), bool(part["hetatm"].iloc[0]))
            types.append(kinds.setdefault(kind, len(kinds)))
        chain_keys = [keys[a][:2] for a, _ in spans]
        firsts = [k for k in range(len(spans)) if k == 0 or chain_keys[k] != chain_keys[k - 1]]
        per_chain = np.diff([*firsts, len(spans)]).tolist()
        at = [spans[k][0] for k in firsts]
        real = lambda c: array(1, len(pdf), 0, pdf[c].to_numpy(">f4").tobytes())
        whole = lambda a: array(4, len(a), 0, np.array(a, ">i4").tobytes())
        letters = lambda a: array(6, len(a), 0, runs([ord(x[0]) if x else 0 for x in a]))
        body = {
            "mmtfVersion": "1.0.0", "mmtfProducer": "strandlake", "structureId": str(pdf["structure_id"].iloc[0]), "numBonds": 0, "numAtoms": len(pdf), "numGroups": len(spans),
            "numChains": len(firsts), "numModels": int(pdf["cset"].nunique()),
            "groupList": [{"groupName": r, "atomNameList": list(n), "elementList": list(e), "formalChargeList": list(c), "bondAtomList": [], "bondOrderList": [], "singleLetterCode": "X", "chemCompType": "NON-POLYMER" if h else "PEPTIDE LINKING"} for r, n, e, c, h in kinds],
            "xCoordList": real("x"), "yCoordList": real("y"), "zCoordList": real("z"), "bFactorList": real("beta"), "occupancyList": real("occupancy"),
            "atomIdList": whole(pdf["serial"].tolist()), "altLocList": letters(pdf["altloc"].tolist()), "groupIdList": whole([int(keys[a][2]) for a, _ in spans]),
            "groupTypeList": whole(types), "insCodeList": letters([keys[a][3] for a, _ in spans]),
            "chainIdList": texts(pdf["segment"].iloc[at].tolist()), "chainNameList": texts(pdf["chain"].iloc[at].tolist()), "groupsPerChain": per_chain,
            "chainsPerModel": pd.Series([chain_keys[k][0] for k in firsts]).value_counts(sort=False).tolist(),
        }
        return pd.DataFrame({"structure_id": [pdf["structure_id"].iloc[0]], "content": [_pack(body)]})

    return atoms.select(*[c.split()[0] for c in BINARY.split(", ")]).groupBy("structure_id").applyInPandas(pack, "structure_id string, content binary")
