"""Masses, defaults and lookup tables of the domain (public chemistry and the workflow's defaults)."""

# Particle and isotope masses in Dalton.
PROTON_MASS = 1.0072764667710
ELECTRON_MASS = 1 / 1822.8885020477
NEUTRON_MASS = 1.00866491566
C13_C12_DIFFERENCE = 1.00335483

# Monoisotopic masses of the atoms.
ATOM_MASSES = {"H": 1.00782503207, "C": 12.0, "N": 14.0030740048, "O": 15.99491461956, "P": 30.97376163, "S": 31.972071}

# Compositions of the residues.
RESIDUE_COMPOSITIONS = {
    "A": {"C": 3, "H": 5, "N": 1, "O": 1},
    "R": {"C": 6, "H": 12, "N": 4, "O": 1},
    "N": {"C": 4, "H": 6, "N": 2, "O": 2},
    "D": {"C": 4, "H": 5, "N": 1, "O": 3},
    "C": {"C": 3, "H": 5, "N": 1, "O": 1, "S": 1},
    "E": {"C": 5, "H": 7, "N": 1, "O": 3},
    "Q": {"C": 5, "H": 8, "N": 2, "O": 2},
    "G": {"C": 2, "H": 3, "N": 1, "O": 1},
    "H": {"C": 6, "H": 7, "N": 3, "O": 1},
    "I": {"C": 6, "H": 11, "N": 1, "O": 1},
    "L": {"C": 6, "H": 11, "N": 1, "O": 1},
    "K": {"C": 6, "H": 12, "N": 2, "O": 1},
    "M": {"C": 5, "H": 9, "N": 1, "O": 1, "S": 1},
    "F": {"C": 9, "H": 9, "N": 1, "O": 1},
    "P": {"C": 5, "H": 7, "N": 1, "O": 1},
    "S": {"C": 3, "H": 5, "N": 1, "O": 2},
    "T": {"C": 4, "H": 7, "N": 1, "O": 2},
    "W": {"C": 11, "H": 10, "N": 2, "O": 1},
    "Y": {"C": 9, "H": 9, "N": 1, "O": 2},
    "V": {"C": 5, "H": 9, "N": 1, "O": 1},
}

# Modifications by name: accession and composition.
MODIFICATIONS = {
    "Acetyl": (1, {"C": 2, "H": 2, "O": 1}),
    "Carbamidomethyl": (4, {"C": 2, "H": 3, "N": 1, "O": 1}),
    "Phospho": (21, {"H": 1, "O": 3, "P": 1}),
    "Oxidation": (35, {"O": 1}),
}
LOCATIONS = {"anywhere": 0, "peptide_n_term": 1, "peptide_c_term": 2, "protein_n_term": 3, "protein_c_term": 4}

# Residues after which (asp-n: before which) a peptide ends.
CLEAVAGE_PATTERNS = {
    "trypsin": "(?<=[KR])",
    "chymotrypsin": "(?<=[FLY])(?=[^P])|(?<=W)(?=[^MP])|(?<=M)(?=[^PY])|(?<=H)(?=[^DMPW])",
    "lys-c": "(?<=K)",
    "glu-c": "(?<=E)",
    "asp-n": "(?=D)",
}

# What a decoy has in place of each residue.
DECOY_FROM = "GAVLIFMPWSCTYHKRQEND"
DECOY_TO = "LLLVVLLLLTSSSSLLNDQE"

RESIDUES = "ARNDCEQGHILKMFPSTWYV"
TERMINALS = {"protein_n": "<", "protein_c": ">", "peptide_n": "_", "peptide_c": "."}


def composition_mass(composition: dict[str, int]) -> float:
    return sum(ATOM_MASSES[a] * n for a, n in composition.items())


def modification(name: str) -> tuple[int, dict[str, int]]:
    """Accession and composition of a known modification."""
    if name not in MODIFICATIONS:
        raise ValueError(f"modification {name} is not known: read it from a table and register it")
    return MODIFICATIONS[name]


def register_modification(name: str, accession: int, composition: dict[str, int]) -> None:
    """Makes a modification known by its name; its atoms must be known."""
    unknown = sorted(set(composition) - set(ATOM_MASSES))
    if unknown:
        raise ValueError(f"modification {name}: no mass for {', '.join(unknown)}")
    MODIFICATIONS[name] = (accession, dict(composition))


RESIDUE_MASSES = {r: composition_mass(c) for r, c in RESIDUE_COMPOSITIONS.items()}
#: Nominal masses: the numbers of nucleons of the commonest isotopes.
NOMINAL_RESIDUE_MASSES = {r: sum(round(ATOM_MASSES[a]) * n for a, n in c.items()) for r, c in RESIDUE_COMPOSITIONS.items()}
WATER_MASS = composition_mass({"H": 2, "O": 1})
PHOSPHORIC_ACID_MASS = composition_mass({"H": 3, "P": 1, "O": 4})
