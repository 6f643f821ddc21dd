"""Field names, residue sets and tables that the selection language and the structure operators use.

Fixed values, plainly listed: they have to equal the published definitions for
queries to select the same atoms.
"""

from __future__ import annotations

# ---- fields ----------------------------------------------------------------

STRING_FIELDS = ("name", "altloc", "resname", "chain", "icode", "segment", "type", "element", "secondary", "secid")
INT_FIELDS = ("index", "serial", "resnum", "secclass", "secindex", "resindex", "chindex", "segindex", "fragindex", "numbonds")
FLOAT_FIELDS = ("x", "y", "z", "occupancy", "beta", "charge", "mass", "radius", "siguij", "anisou")
SYNONYMS = {"chid": "chain", "fragment": "fragindex", "resid": "resnum", "secstr": "secondary", "segname": "segment"}
ENTITIES = {"residue": "resindex", "chain": "chindex", "segment": "segindex", "fragment": "fragindex"}
FUNCTION_NAMES = (
    "sqrt", "sq", "abs", "floor", "ceil", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh",
    "exp", "log", "log10",
)

# ---- residues --------------------------------------------------------------

ONE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H",
    "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W",
    "TYR": "Y", "VAL": "V",
}
STANDARD = tuple(ONE_LETTER)
NONSTANDARD = {
    "ASX": "acyclic surface polar medium",
    "GLX": "acyclic surface large polar",
    "ASH": "acyclic acidic surface polar medium",
    "GLH": "acyclic acidic surface large polar",
    "CSO": "acyclic neutral surface medium polar",
    "CYX": "acyclic neutral buried medium polar",
    "HIP": "cyclic basic surface large polar",
    "HID": "cyclic basic surface large polar",
    "HIE": "cyclic basic surface large polar",
    "HSD": "cyclic basic surface large polar",
    "HSE": "cyclic basic surface large polar",
    "HSP": "cyclic acidic surface large polar",
    "HISD": "cyclic basic surface large polar",
    "HISE": "cyclic basic surface large polar",
    "HISP": "cyclic acidic surface large polar",
    "LYN": "acyclic neutral surface large polar",
    "TYM": "cyclic aromatic surface basic large polar",
    "ARN": "acyclic neutral surface large polar",
    "MSE": "acyclic neutral buried large",
    "CME": "acyclic neutral buried large",
    "SEC": "acyclic neutral buried polar medium",
    "SEP": "acyclic surface acidic large polar",
    "TPO": "acyclic surface acidic large polar",
    "PTR": "cyclic aromatic surface acidic large polar",
    "PHD": "acyclic acidic surface polar large",
    "XLE": "aliphatic acyclic buried hydrophobic large",
    "XAA": "",
    "MEN": "",
    "CSB": "",
}
CATEGORIES = {
    "aliphatic": "ALA ILE LEU VAL PRO GLY",
    "aromatic": "HIS PHE TRP TYR",
    "acidic": "ASP GLU",
    "basic": "LYS ARG HIS",
    "neutral": "ALA ASN CYS GLN GLY ILE LEU MET PHE PRO SER THR TRP TYR VAL",
    "buried": "ALA CYS ILE LEU MET PHE TRP VAL",
    "surface": "ARG ASN ASP GLN GLU GLY HIS LYS PRO SER THR TYR",
    "cyclic": "HIS PHE PRO TRP TYR",
    "acyclic": "ALA ARG ASN ASP CYS GLN GLU GLY ILE LEU LYS MET SER THR VAL",
    "hydrophobic": "ALA ILE LEU MET PHE PRO TRP VAL",
    "polar": "ARG ASN ASP CYS GLN GLU GLY HIS LYS SER THR TYR",
    "small": "ALA GLY SER",
    "medium": "ASN ASP CYS PRO THR VAL",
    "large": "ARG GLN GLU HIS ILE LEU LYS MET PHE TRP TYR",
}
RESNAME_FLAGS = {
    "nucleobase": "GUN ADE CYT THY URA",
    "nucleotide": "DA DC DG DT DU A C G T U",
    "nucleoside": "ADN AMP ADP ATP CMP A2P A3P AGS CTN C5P CDP CTP C2P C3P GMP 5GP GDP GTP THM TMP TPP TTP URI UMP UDP UTP",
    "at": "ADE A THY T",
    "cg": "CYT C GUN G",
    "purine": "ADE A GUN G",
    "pyrimidine": "CYT C THY T URA U",
    "water": "HOH DOD WAT TIP3 H2O OH2 TIP TIP2 TIP4 SPC SOL T3P",
    "ion": "AL BA CA CD CL CO CS CU CU1 CUA HG IN IOD K MG MN MN3 NA PB PT RB TB TL WO4 YB ZN CAL CES CLA POT SOD ZN2 CU2 CU2P",
    "lipid": "GPE LPP OLA SDS STE DLPE DMPC LPPC OLEO PALM PCGL POPC POPE STEA",
    "sugar": "GLC GLO BGC AGLC",
    "heme": "1FH 2FH DDH DHE HAS HDD HDE HDM HEA HEB HEC HEM HEO HES HEV NTE SRM VER HEMO HEMR",
}
BACKBONE = "CA C O N"
BACKBONE_FULL = "CA C O N H H1 H2 H3 OXT"
ELEMENT_PATTERNS = {"hydrogen": "[0-9]?H.*", "carbon": "C.*", "nitrogen": "N.*", "oxygen": "O.*", "sulfur": "S.*"}
SECONDARY_CODES = {
    "extended": "E", "helix": "H", "helix310": "G", "helixpi": "I", "turn": "T", "bridge": "B", "bend": "S", "coil": "C",
}
FLAG_SYNONYMS = {
    "calpha": "ca", "aminoacid": "protein", "backbone": "bb", "backbonefull": "bbfull", "sidechain": "sc", "heavy": "noh",
}

# ---- alignments ------------------------------------------------------------

#: Share of each ambiguous letter that counts for each residue letter; X counts for all twenty.
AMBIGUOUS = {"B": "DN", "Z": "EQ", "J": "IL", "X": "ACDEFGHIKLMNPQRSTVWY"}
#: Background frequencies of residues used by statistical coupling analysis.
BACKGROUND = {
    "A": 0.073, "C": 0.025, "D": 0.050, "E": 0.061, "F": 0.042, "G": 0.072, "H": 0.023, "I": 0.053, "K": 0.064,
    "L": 0.089, "M": 0.023, "N": 0.043, "P": 0.052, "Q": 0.040, "R": 0.052, "S": 0.073, "T": 0.056, "V": 0.063,
    "W": 0.013, "Y": 0.033,
}
