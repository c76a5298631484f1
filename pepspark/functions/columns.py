"""Column functions: strings, masses, arrays and signals.  All are built-in expressions; none runs Python on executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pepspark.functions import constants as C


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, also where ``f`` uses it inside a function of array elements."""
    return F.element_at(F.transform(F.array(value), f), 1)


# --- strings


def list_text(values: Column | str, sep: str = ";") -> Column:
    return F.array_join(F.transform(col(values), lambda x: x.cast("string")), sep)


def text_list(text: Column | str, sep: str = ";") -> Column:
    """The integers of a separated list; null and empty text have none."""
    parts = F.filter(F.split(F.coalesce(col(text), F.lit("")), sep, -1), lambda x: x != "")
    return F.transform(parts, lambda x: x.cast("bigint"))


def residues_only(sequence: Column | str) -> Column:
    return col(sequence).rlike(f"^[<_]?[{C.RESIDUES}]+[.>]?$")


def residue_code(residue: Column | str, alphabet: str = C.RESIDUES) -> Column:
    """Place in the alphabet, -1 if it isn't there."""
    return F.position(col(residue), F.lit(alphabet)) - 1


def run_name(path: Column | str) -> Column:
    """File name without compression and spectrum extensions."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col(path), r"^.*[/\\]", ""), r"(?i)\.(gz|bz2|zip)$", ""), r"(?i)\.(mzml|raw|hdf5?|h5|d)$", "")


def plain(peptide: Column | str) -> Column:
    """The residues of a peptide without its terminal characters."""
    return F.regexp_replace(col(peptide), r"^[<_]|[.>]$", "")


def decoy_by_map(peptide: Column | str) -> Column:
    """Second and second last residue exchanged by the fixed table; terminal characters stay.  Peptides of fewer than four
    residues, where these aren't two places apart from the ends, are their own decoys."""
    p = col(peptide)
    n = F.length(p)
    second, last = F.translate(F.substr(p, F.lit(3), F.lit(1)), C.DECOY_FROM, C.DECOY_TO), F.translate(F.substr(p, n - 2, F.lit(1)), C.DECOY_FROM, C.DECOY_TO)
    decoy = F.concat(F.substr(p, F.lit(1), F.lit(2)), second, F.substr(p, F.lit(4), n - 6), last, F.substr(p, n - 1, F.lit(2)))
    return F.when(n < 6, p).otherwise(decoy)


def decoy_reversed(peptide: Column | str) -> Column:
    """All residues but the last in reverse."""
    p = col(peptide)
    n = F.length(p)
    return F.when(n < 4, p).otherwise(F.concat(F.substr(p, F.lit(1), F.lit(1)), F.reverse(F.substr(p, F.lit(2), n - 3)), F.substr(p, n - 1, F.lit(2))))


def modified_sequence(peptide: Column | str, mod_ids: Column | str, sites: Column | str) -> Column:
    """``(UniMod:n)`` after the character at each site; site -1 is the last character."""
    p, ids, at = col(peptide), col(mod_ids), col(sites)
    pairs = F.zip_with(ids, at, lambda i, s: F.struct(F.when(s < 0, F.length(p) + s).otherwise(s).alias("site"), i.alias("id")))
    marks = F.transform(F.array_sort(F.transform(pairs, lambda x, i: F.struct(x["site"].alias("site"), i.alias("i"), x["id"].alias("id")))), lambda x: F.struct(x["site"].alias("site"), F.concat(F.lit("(UniMod:"), unimod_id(x["id"]).cast("string"), F.lit(")")).alias("mark")))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def insert(state, m):
        upto = F.least(m["site"] + 1, F.length(p))
        return F.struct(F.greatest(state["at"], upto).alias("at"), F.concat(state["out"], F.substr(p, state["at"] + 1, upto - state["at"]), F.when(m["site"].between(0, F.length(p) - 1), m["mark"]).otherwise("")).alias("out"))

    return F.aggregate(marks, zero, insert, lambda s: F.concat(s["out"], F.substr(p, s["at"] + 1, F.length(p))))


def parsed_sequence(text: Column | str) -> Column:
    """struct(plain, sites array, unimod array) of a modified sequence."""
    t = col(text)
    marks = r"(?:\(UniMod:\d+\))+"
    runs = F.split(t, marks, -1)  # plain text before each group of marks
    groups = F.regexp_extract_all(t, F.lit(f"({marks})"), F.lit(1))
    bare = F.array_join(runs, "")
    ends = F.aggregate(F.slice(runs, F.lit(1), F.size(groups)), F.array(F.lit(0)), lambda a, r: F.concat(a, F.array(F.element_at(a, -1) + F.length(r))))
    each = F.zip_with(groups, F.slice(ends, F.lit(2), F.size(groups)), lambda g, e: F.transform(F.regexp_extract_all(g, F.lit(r"UniMod:(\d+)"), F.lit(1)), lambda u: F.struct((e - 1).alias("site"), u.cast("bigint").alias("unimod"))))
    mods = F.flatten(each)
    return F.struct(bare.alias("plain"), F.transform(mods, lambda m: m["site"]).alias("sites"), F.transform(mods, lambda m: m["unimod"]).alias("unimod"))


def native_terminals(text: Column | str) -> Column:
    """A peptide of any dialect between the native terminal characters: ``_PEP_``, ``-.PEP.-`` and bare ``PEP`` are peptides
    inside a protein; text that has native ones stays."""
    t = col(text)
    native = t.rlike(r"^[<_](?s:.*)[.>](?:\([^()]*\)|\[[^\]]*\])*$")
    return (
        F.when(native, t)
        .when(t.startswith("_"), F.regexp_replace(t, r"_(?=(?:\([^()]*\)|\[[^\]]*\])*$)", "."))
        .when(t.startswith("-."), F.replace(F.replace(t, F.lit("-."), F.lit("_")), F.lit(".-"), F.lit(".")))
        .otherwise(F.concat(F.lit("_"), t, F.lit(".")))
    )


def modification_number(text: Column) -> Column:
    """The accession that ``UniMod:n``, a name, ``Name (X)`` or a mass (``+57``, ``+57.02``, to its own decimals) means, or null."""
    known = list(C.MODIFICATIONS.items())
    names = F.create_map(*[x for name, (number, _) in known for x in (F.lit(name.lower()), F.lit(number).cast("bigint"))])
    unimod = F.regexp_extract(text, r"(?i)^unimod:(\d+)$", 1)
    number = F.regexp_extract(text, r"^([+-]?\d+(?:\.\d*)?)$", 1)
    half = F.pow(F.lit(10.0), -F.length(F.regexp_extract(number, r"\.(\d*)$", 1))) / 2
    masses = F.array(*[F.struct(F.lit(C.composition_mass(parts)).alias("mass"), F.lit(n).cast("bigint").alias("number")) for _, (n, parts) in known])
    off = F.transform(masses, lambda m: F.struct(F.abs(m["mass"] - number.try_cast("double")).alias("off"), m["number"].alias("number")))
    nearest = F.array_min(off)
    by_mass = F.when(nearest["off"] <= half, nearest["number"])
    return F.when(unimod != "", unimod.try_cast("bigint")).when(number != "", by_mass).otherwise(names[F.lower(F.regexp_replace(text, r" \([^)]*\)", ""))])


def parsed_dialect(text: Column | str) -> Column:
    """struct(plain, sites array, unimod array) of a modified sequence of any dialect: ``(UniMod:n)``, ``(Name)``, ``[+mass]``,
    ``[Name (X)]``; a modification that isn't known has a null accession."""
    t = native_terminals(text)
    one = r"(?:\((?:[^()]|\([^()]*\))*\)|\[[^\]]*\])"
    runs = F.split(t, f"{one}+", -1)
    groups = F.regexp_extract_all(t, F.lit(f"({one}+)"), F.lit(1))
    bare = F.array_join(runs, "")
    ends = F.aggregate(F.slice(runs, F.lit(1), F.size(groups)), F.array(F.lit(0)), lambda a, r: F.concat(a, F.array(F.element_at(a, -1) + F.length(r))))

    def marks(group, end):
        found = F.regexp_extract_all(group, F.lit(f"({one})"), F.lit(1))
        return F.transform(found, lambda m: F.struct((end - 1).alias("site"), modification_number(F.substr(m, F.lit(2), F.length(m) - 2)).alias("unimod")))

    mods = F.flatten(F.zip_with(groups, F.slice(ends, F.lit(2), F.size(groups)), marks))
    return F.struct(bare.alias("plain"), F.transform(mods, lambda m: m["site"]).alias("sites"), F.transform(mods, lambda m: m["unimod"]).alias("unimod"))


def composition(text: Column | str) -> Column:
    """Atom counts of ``C(2) H(3)`` or ``C2H3`` as map<string,int>; an atom without a number counts once."""
    atoms = F.regexp_extract_all(col(text), F.lit(r"([A-Z][a-z]?)\(?(-?\d*)\)?"), F.lit(1))
    counts = F.transform(F.regexp_extract_all(col(text), F.lit(r"([A-Z][a-z]?)\(?(-?\d*)\)?"), F.lit(2)), lambda n: F.when(n == "", 1).otherwise(n.try_cast("int")))
    return F.map_from_arrays(atoms, counts)


# --- masses


def residue_mass_sum(sequence: Column | str) -> Column:
    """Sum of residue masses by counting each letter: no loop over characters."""
    s = col(sequence)
    terms = [(F.length(s) - F.length(F.replace(s, F.lit(r)))) * F.lit(m) for r, m in C.RESIDUE_MASSES.items()]
    return reduce(lambda a, b: a + b, terms)


def precursor_mz(mass: Column | str, charge: Column | str) -> Column:
    return col(mass) / col(charge) + F.lit(C.PROTON_MASS)


def isotope_mz(mz: Column | str, isotope: Column | str, charge: Column | str) -> Column:
    return col(mz) + col(isotope) * F.lit(C.C13_C12_DIFFERENCE) / col(charge)


def fragment_mz(mass: Column | str, offset: Column | str, charge: Column | str) -> Column:
    return (col(mass) + col(offset)) / col(charge) + F.lit(C.PROTON_MASS)


def mass_bucket(mass: Column | str, low: int = 300, high: int = 7000, width: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), (F.floor(col(mass) / width) * width).cast("int")))


def ppm_error(mz: Column | str, theoretical: Column | str, tolerance: Column | float) -> Column:
    tolerance = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    return (col(mz) - col(theoretical)) / col(theoretical) * 1e6 / tolerance


def ppm_bin(mz: Column | str, ppm: float, start: float = 1.0) -> Column:
    """Number of the logarithmic bin of width ``ppm`` that holds m/z, from ``start``."""
    return F.ceil(F.log(col(mz) / start) / F.log1p(F.lit(ppm * 1e-6)))


def nominal_mass_sum(sequence: Column | str) -> Column:
    """Sum of the residues' nominal masses, whole numbers."""
    s = col(sequence)
    terms = [(F.length(s) - F.length(F.replace(s, F.lit(r)))) * F.lit(m) for r, m in C.NOMINAL_RESIDUE_MASSES.items()]
    return reduce(lambda a, b: a + b, terms)


RUNNING_BLOCK = 32


def running_sums(values: Column | str) -> Column:
    """Running sums of an array.  Sums run over some elements at a time and then over these blocks, so that long arrays
    don't cost the square of their length."""
    zero = F.array().cast("array<double>")

    def sums(a):
        return F.aggregate(a, zero, lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + x)))

    def joined(blocks):
        begins = F.concat(F.array(F.lit(0.0)), sums(F.transform(blocks, lambda b: F.element_at(b, -1))))
        return F.flatten(F.zip_with(blocks, F.slice(begins, F.lit(1), F.size(blocks)), lambda b, by: F.transform(b, lambda x: x + by)))

    def cut(v):
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / RUNNING_BLOCK).cast("int") - 1), lambda b: sums(F.slice(v, b * RUNNING_BLOCK + 1, F.lit(RUNNING_BLOCK))))
        return F.when(F.size(v) <= RUNNING_BLOCK, sums(v)).otherwise(bound(blocks, joined))

    return bound(col(values), cut)


def prefix_masses(sequence: Column | str, mod_sites: Column | str | None = None, mod_masses: Column | str | None = None) -> Column:
    """Running sums of the residues' masses.  Modification masses are added at their sites in the peptide with its terminal
    characters (0: before the first residue, -1: after the last), which count with the first and last residue."""
    s = col(sequence)
    table = F.create_map(*[F.lit(x) for r, m in C.RESIDUE_MASSES.items() for x in (r, m)])
    letters = F.filter(F.split(s, ""), lambda c: c != "")
    masses = F.transform(letters, lambda c: F.coalesce(table[c], F.lit(0.0)))
    if mod_sites is not None:
        n = F.length(s)
        mods = F.zip_with(col(mod_sites), col(mod_masses), lambda a, m: F.struct(F.least(F.greatest(F.when(a < 0, n).otherwise(a), F.lit(1)), n).alias("at"), m.alias("mass")))
        plain_masses = masses
        masses = bound(mods, lambda ms: F.transform(plain_masses, lambda m, i: m + F.aggregate(F.filter(ms, lambda x: x["at"] == i + 1), F.lit(0.0), lambda t, x: t + x["mass"])))
    return running_sums(masses)


def mod_id(unimod: Column | str, location: Column | str, residue: Column | str, fixed: Column | str) -> Column:
    """Accession, location, residue and fixedness in one number."""
    return F.shiftleft(col(unimod).cast("bigint"), 16).bitwiseOR(F.shiftleft(col(location).cast("bigint"), 13)).bitwiseOR(F.shiftleft(F.ascii(col(residue)).cast("bigint"), 6)).bitwiseOR(col(fixed).cast("bigint"))


def unimod_id(mod: Column | str) -> Column:
    return F.shiftright(col(mod).cast("bigint"), 16).bitwiseAND(F.lit(0xFFFF))


def mod_location(mod: Column | str) -> Column:
    return F.shiftright(col(mod).cast("bigint"), 13).bitwiseAND(F.lit(7))


def mod_residue(mod: Column | str) -> Column:
    return F.char(F.shiftright(col(mod).cast("bigint"), 6).bitwiseAND(F.lit(127)))


def mod_fixed(mod: Column | str) -> Column:
    return col(mod).cast("bigint").bitwiseAND(F.lit(1)) == 1


# --- arrays and signals


def rounded(value: Column | str, places: int) -> Column:
    """``value`` to ``places``, halves of its binary product with the power of ten away from zero.  ``F.round`` decides by the
    shortest decimal text instead: 1.005 is 1.01 to it, though 1.005 * 100 is below 100.5."""
    v, scale = col(value), F.lit(10.0**places)
    size = F.abs(v) * scale
    half = F.lit(0.49999999999999994)  # the double before 0.5: what is below a half stays below it
    return F.when(size < 2.0**52, F.signum(v) * F.floor(size + half) / scale).otherwise(v)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str, empty: float = 0.0) -> Column:
    """Cosine similarity; ``empty`` where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(empty)).otherwise(dot(a, b) / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def mean(a: Column | str) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double")) / F.greatest(F.lit(1), F.size(col(a)))


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation of two arrays; 0 where one does not vary."""
    x, y = (F.transform(col(v), lambda e: e.cast("double")) for v in (a, b))
    mx, my = mean(x), mean(y)
    return cosine(F.transform(x, lambda e: e - mx), F.transform(y, lambda e: e - my))


def spectral_angle(a: Column | str, b: Column | str) -> Column:
    return 1 - F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine(a, b)))) / (F.pi() / 2)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared share of two sets, padding (-1) aside; 0 for two empty ones."""
    x, y = F.filter(col(a), lambda e: e != -1), F.filter(col(b), lambda e: e != -1)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(union, F.lit(1)))


def trapezoid(x: Column | str, y: Column | str) -> Column:
    """Area under the points (x, y)."""
    a, b = col(x), col(y)
    steps = F.transform(F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: i < F.size(a)), lambda i: (F.element_at(b, i) + F.element_at(b, i + 1)) / 2 * (F.element_at(a, i + 1) - F.element_at(a, i)))
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)


def mean_cubed_correlation(rows: Column | str) -> Column:
    """Mean over all pairs of arrays of their cubed correlation; 0 for fewer than two."""
    a = col(rows)
    unit = F.transform(a, lambda v: _standardised(v))
    n = F.size(a)
    pairs = F.flatten(F.transform(unit, lambda x, i: F.transform(F.slice(unit, i + 2, n), lambda y: F.pow(dot(x, y), F.lit(3)))))
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.lit(1), n * (n - 1) / 2))


def _standardised(v: Column) -> Column:
    """Centred and of length 1; zeros for an array that doesn't vary."""
    middle = mean(v)
    centred = F.transform(v, lambda x: x.cast("double") - middle)
    size = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(centred, lambda x: F.when(size > 1e-12, x / size).otherwise(0.0))


def max_normalised(a: Column | str) -> Column:
    most = F.array_max(col(a)).cast("double")
    return F.transform(col(a), lambda x: F.when(most > 0, x / most).otherwise(0.0))


def combinations(sites: Column | str, most: int) -> Column:
    """All combinations of one to ``most`` elements, each in order of place."""
    s = col(sites)
    empty = F.array().cast("array<array<int>>")
    every = F.aggregate(s, F.array(F.array().cast("array<int>")), lambda acc, x: F.concat(acc, F.transform(F.filter(acc, lambda c: F.size(c) < most), lambda c: F.concat(c, F.array(x.cast("int"))))))
    return F.coalesce(F.filter(every, lambda c: F.size(c) > 0), empty)


def normal_cdf(z: Column | str) -> Column:
    """Normal distribution by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    x = F.abs(col(z)) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(col(z) >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def posterior_error(score: Column | str) -> Column:
    return 1 - 1 / (1 + F.exp(-col(score)))
