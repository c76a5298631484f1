"""Queries of readers, sinks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pepspark.functions import columns as K
from pepspark.functions import constants as C
from pepspark.plans import analogs as A
from pepspark.plans.analogs import table
from pepspark.sources import readers, tables

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_RESIDUE_SUM = " + ".join(f"(length(s) - length(replace(s, '{r}', ''))) * CAST({m!r} AS DOUBLE)" for r, m in C.RESIDUE_MASSES.items())


# --- sources and sinks


@query(
    "src01_fasta",
    r"""SELECT concat('doc', doc_id) AS fasta_id, concat(lang, ' ', source) AS description,
    regexp_replace(regexp_replace(translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '\s', '', 'g'), 'X$', '') AS sequence FROM documents""",
)
def _(spark, d):
    records = table(spark, d, "documents").select(F.concat(F.lit(">doc"), "doc_id", F.lit(" "), "lang", F.lit(" "), "source", F.lit("\n"), A.capitals(F.coalesce("text", F.lit("")))).alias("value"))
    return readers.parse_fasta_records(records)


@query("src02b_clean_peaks", "SELECT vec_id, x AS mz, x * 2 AS ab FROM (SELECT vec_id, unnest(embedding)::double AS x FROM embeddings) WHERE x > 0")
def _(spark, d):
    v = A.vectors(spark, d).select("vec_id", F.col("v").alias("mz"), F.transform("v", lambda x: x * 2).alias("ab"))
    return readers.clean_peaks(v)


@query("src02c_scan_seconds", "SELECT event_id, round(CASE WHEN event_type = 'view' THEN value * 60 ELSE value END, 6) AS seconds FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.round(readers.seconds(F.col("value"), F.when(F.col("event_type") == "view", "minutes").otherwise("second")), 6).alias("seconds"))


@query("src02d_isolation_bounds", "SELECT p_partkey, CASE WHEN p_size > 1 THEN p_retailprice - p_size END AS low, CASE WHEN p_size > 1 THEN p_retailprice + p_size END AS high FROM part")
def _(spark, d):
    b = readers.isolation_bounds(F.col("p_retailprice"), F.col("p_size"), F.col("p_size"), F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", b.alias("b")).select("p_partkey", "b.low", "b.high")


@query("src12_run_name", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(concat(url, '.mzML.gz'), '^.*[/\\]', ''), '(?i)\.(gz|bz2|zip)$', ''), '(?i)\.(mzml|raw|hdf5?|h5|d)$', '') AS run FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", K.run_name(F.concat("url", F.lit(".mzML.gz"))).alias("run"))


@query("src13_library_slice", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 25")
def _(spark, d):
    return readers.library_slice(spark, f"{d}/part.parquet", "p_size", 5, 25, ["p_partkey", "p_size"])


@query("src14_isotope_patterns")
def _(spark, d):
    return tables.isotope_patterns(spark)


@query("src09_modification_table", "SELECT * FROM (VALUES (1, 'Acetyl', 42.010565), (4, 'Carbamidomethyl', 57.021464), (21, 'Phospho', 79.966331), (35, 'Oxidation', 15.994915)) t(unimod_id, name, mass)")
def _(spark, d):
    return tables.modifications(spark).withColumn("mass", F.round("mass", 6))


@query("snk07_list_text", "SELECT l_orderkey, array_to_string(list_sort(list(l_linenumber)), ';') AS lines FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    from pepspark.sources.sinks import flat

    return flat(table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("lines")))


# --- strings


@query("str01_split_parts", "SELECT p_partkey, string_split(p_name, ' ')[1] AS first, array_to_string(string_split(p_name, ' ')[2:], ' ') AS rest FROM part")
def _(spark, d):
    words = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", words[0].alias("first"), F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), " ").alias("rest"))


@query("str02_slice_reverse", "SELECT c_custkey, concat(substr(c_name, 1, 3), reverse(substr(c_name, 4, length(c_name) - 4)), right(c_name, 1)) AS turned, length(c_name) AS n FROM customer")
def _(spark, d):
    n = F.length("c_name")
    return table(spark, d, "customer").select("c_custkey", F.concat(F.substr("c_name", F.lit(1), F.lit(3)), F.reverse(F.substr("c_name", F.lit(4), n - 4)), F.right("c_name", F.lit(1))).alias("turned"), n.cast("long").alias("n"))


@query("str05_find_all_positions", f"WITH {A.PROTEINS} SELECT protein_index, CAST(len(l) AS BIGINT) AS n, CAST(list_sum(l) AS BIGINT) AS total FROM (SELECT protein_index, list_filter(range(0, length(sequence)), lambda i: sequence[i + 1] = 'M') AS l FROM prot) WHERE len(l) > 0")
def _(spark, d):
    chars = F.split("sequence", "")
    at = F.filter(F.transform(chars, lambda c, i: F.when(c == "M", i.cast("long"))), lambda i: i.isNotNull())
    p = A.proteins(spark, d).select("protein_index", at.alias("l")).where("size(l) > 0")
    return p.select("protein_index", F.size("l").cast("long").alias("n"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("str06_replace_all", "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '', 'g') AS t FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.regexp_replace("p_type", "[AEIOU]", "").alias("t"))


_PEPTIDES = "pep AS (SELECT protein_index AS doc_id, concat('_', sequence, '.') AS peptide FROM prot)"


def _peptides(spark, d):
    """Every document's whole sequence as one peptide."""
    return A.proteins(spark, d).select(F.col("protein_index").alias("doc_id"), F.concat(F.lit("_"), "sequence", F.lit(".")).alias("peptide"))


@query("str07_decoy_map", f"WITH {A.PROTEINS}, {_PEPTIDES} SELECT doc_id, CASE WHEN length(peptide) < 6 THEN peptide ELSE concat(substr(peptide, 1, 2), translate(substr(peptide, 3, 1), '{C.DECOY_FROM}', '{C.DECOY_TO}'), substr(peptide, 4, length(peptide) - 6), translate(substr(peptide, length(peptide) - 2, 1), '{C.DECOY_FROM}', '{C.DECOY_TO}'), right(peptide, 2)) END AS decoy FROM pep")
def _(spark, d):
    return _peptides(spark, d).select("doc_id", K.decoy_by_map("peptide").alias("decoy"))


@query("str07b_decoy_reverse", f"WITH {A.PROTEINS}, {_PEPTIDES} SELECT doc_id, CASE WHEN length(peptide) < 4 THEN peptide ELSE concat(substr(peptide, 1, 1), reverse(substr(peptide, 2, length(peptide) - 3)), right(peptide, 2)) END AS decoy FROM pep")
def _(spark, d):
    return _peptides(spark, d).select("doc_id", K.decoy_reversed("peptide").alias("decoy"))


_MODIFIED = "CASE WHEN length(peptide) < 4 THEN peptide ELSE concat(substr(peptide, 1, 4), '(UniMod:4)', substr(peptide, 5)) END || '(UniMod:35)'"


def _modified(spark, d):
    ids = F.array(F.lit(4 << 16).cast("bigint"), F.lit(35 << 16).cast("bigint"))
    return _peptides(spark, d).select("doc_id", K.modified_sequence("peptide", ids, F.array(F.lit(3), F.lit(-1))).alias("text"))


@query("str08_modified_sequence", f"WITH {A.PROTEINS}, {_PEPTIDES} SELECT doc_id, {_MODIFIED} AS text FROM pep")
def _(spark, d):
    return _modified(spark, d)


@query("str09_parse_modified", f"WITH {A.PROTEINS}, {_PEPTIDES} SELECT doc_id, peptide AS bare, CASE WHEN length(peptide) < 4 THEN '' ELSE '3;' END || (length(peptide) - 1) AS sites, CASE WHEN length(peptide) < 4 THEN '35' ELSE '4;35' END AS unimod FROM pep")
def _(spark, d):
    p = _modified(spark, d).select("doc_id", K.parsed_sequence("text").alias("p"))
    return p.select("doc_id", F.col("p.plain").alias("bare"), K.list_text("p.sites").alias("sites"), K.list_text("p.unimod").alias("unimod"))


@query(
    "str10_parse_dialects",
    f"""WITH {A.PROTEINS}, {_PEPTIDES}, s AS (SELECT doc_id, peptide, list_filter(range(1, length(peptide) - 1), lambda i: peptide[i + 1] IN ('C', 'M')) AS places FROM pep WHERE length(peptide) > 2)
    SELECT doc_id, k::int AS dialect, peptide AS bare, array_to_string(places, ';') AS sites, array_to_string(list_transform(places, lambda i: CASE WHEN peptide[i + 1] = 'C' THEN 4 ELSE 35 END), ';') AS unimod FROM s, range(0, 5) t(k)""",
)
def _(spark, d):
    p = _peptides(spark, d).where("length(peptide) > 2")
    bare = K.plain("peptide")

    def marked(c: str, m: str):
        return F.replace(F.replace(bare, F.lit("C"), F.lit(f"C{c}")), F.lit("M"), F.lit(f"M{m}"))

    texts = [
        F.concat(F.lit("_"), marked("(#:4)", "(#:35)"), F.lit(".")), F.concat(F.lit("_"), marked("[#57.021]", "[#16]"), F.lit("_")), F.concat(F.lit("-."), marked("[#a (#)]", "[#o (#)]"), F.lit(".-")),
        marked("(#a)", "(#o)"), marked("[#57]", "[#15.9949]"),
    ]
    # placeholders, since the names hold letters that are residues as well
    names = [("#:", "UniMod:"), ("[#a (#)]", "[Carbamidomethyl (C)]"), ("[#o (#)]", "[Oxidation (M)]"), ("(#a)", "(Carbamidomethyl)"), ("(#o)", "(Oxidation)"), ("[#", "[+")]
    for x, y in names:
        texts = [F.replace(t, F.lit(x), F.lit(y)) for t in texts]
    rows = p.select("doc_id", F.posexplode(F.array(*texts)).alias("dialect", "text")).select("doc_id", "dialect", K.parsed_dialect("text").alias("p"))
    return rows.select("doc_id", "dialect", F.col("p.plain").alias("bare"), K.list_text("p.sites").alias("sites"), K.list_text("p.unimod").alias("unimod"))


@query("str11_composition", "SELECT p_partkey, p_size AS c, p_size + 2 AS h, 1 AS n FROM part")
def _(spark, d):
    text = F.concat(F.lit("C("), "p_size", F.lit(") H"), (F.col("p_size") + 2).cast("string"), F.lit(" N"))
    m = table(spark, d, "part").select("p_partkey", K.composition(text).alias("m"))
    return m.select("p_partkey", F.col("m")["C"].alias("c"), F.col("m")["H"].alias("h"), F.col("m")["N"].alias("n"))


@query("str12_list_codec", "SELECT o_orderkey, CAST(o_orderkey + o_custkey AS BIGINT) AS total FROM orders")
def _(spark, d):
    values = K.text_list(F.concat_ws(";", "o_orderkey", "o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("str13_residue_code", f"WITH {A.PROTEINS}, {_PEPTIDES} SELECT doc_id, instr('{C.RESIDUES}', substr(peptide, 2, 1)) - 1 AS code FROM pep")
def _(spark, d):
    return _peptides(spark, d).select("doc_id", K.residue_code(F.substring("peptide", 2, 1)).cast("long").alias("code"))


@query("flt05_standard_residues", f"SELECT doc_id FROM documents WHERE regexp_matches(translate(replace(coalesce(text, ''), ' ', ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '^[<_]?[{C.RESIDUES}]+[.>]?$')")
def _(spark, d):
    return table(spark, d, "documents").where(K.residues_only(A.capitals(F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(""))))).select("doc_id")


# --- masses


@query("mth01_precursor_mz", "SELECT p_partkey, round(p_retailprice / p_size + 1.0072764667710, 6) AS mz FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(K.precursor_mz("p_retailprice", "p_size"), 6).alias("mz"))


@query("mth02_residue_mass", f"WITH {A.PROTEINS} SELECT protein_index, round({_RESIDUE_SUM}, 4) AS mass FROM (SELECT protein_index, sequence AS s FROM prot)")
def _(spark, d):
    return A.proteins(spark, d).select("protein_index", F.round(K.residue_mass_sum("sequence"), 4).alias("mass"))


_NOMINAL_SUM = " + ".join(f"(length(s) - length(replace(s, '{r}', ''))) * {m}" for r, m in C.NOMINAL_RESIDUE_MASSES.items())


@query("mth02b_nominal_mass", f"WITH {A.PROTEINS} SELECT protein_index, CAST({_NOMINAL_SUM} AS BIGINT) AS mass FROM (SELECT protein_index, sequence AS s FROM prot)")
def _(spark, d):
    return A.proteins(spark, d).select("protein_index", K.nominal_mass_sum("sequence").cast("long").alias("mass"))


@query(
    "mth03_prefix_masses",
    f"""WITH {A.PROTEINS}, {_PEPTIDES}, m(r, mass) AS (VALUES {", ".join(f"('{r}', CAST({m!r} AS DOUBLE))" for r, m in C.RESIDUE_MASSES.items())}),
    e AS (SELECT doc_id, i, mass FROM (SELECT doc_id, i, peptide[i + 2] AS r FROM (SELECT doc_id, peptide, unnest(range(0, length(peptide) - 2)) AS i FROM pep)) JOIN m USING (r)),
    f AS (SELECT doc_id, i, sum(mass) OVER (PARTITION BY doc_id ORDER BY i) AS prefix FROM e)
    SELECT doc_id, count(*) AS n, round(min(prefix), 4) AS first, round(max(prefix), 3) AS last, round(avg(prefix), 2) AS mean FROM f GROUP BY doc_id""",
)
def _(spark, d):
    return _summed(_peptides(spark, d).select("doc_id", F.posexplode(K.prefix_masses(K.plain("peptide"))).alias("i", "prefix")))


def _summed(rows):
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("prefix"), 4).alias("first"), F.round(F.max("prefix"), 3).alias("last"), F.round(F.avg("prefix"), 2).alias("mean"))


_SHIFT = C.composition_mass(C.MODIFICATIONS["Carbamidomethyl"][1])


@query(
    "mth03b_modified_prefix_masses",
    f"""WITH {A.PROTEINS}, {_PEPTIDES}, m(r, mass) AS (VALUES {", ".join(f"('{r}', CAST({m!r} AS DOUBLE))" for r, m in C.RESIDUE_MASSES.items())}),
    e AS (SELECT doc_id, i, mass + CASE WHEN i = 0 THEN 42.0 ELSE 0.0 END + CASE WHEN i = 2 THEN CAST({_SHIFT!r} AS DOUBLE) ELSE 0.0 END + CASE WHEN i = n - 1 THEN 7.5 ELSE 0.0 END AS mass
      FROM (SELECT doc_id, i, n, peptide[i + 2] AS r FROM (SELECT doc_id, peptide, length(peptide) - 2 AS n, unnest(range(0, length(peptide) - 2)) AS i FROM pep WHERE length(peptide) >= 5)) JOIN m USING (r)),
    f AS (SELECT doc_id, i, sum(mass) OVER (PARTITION BY doc_id ORDER BY i) AS prefix FROM e)
    SELECT doc_id, count(*) AS n, round(min(prefix), 4) AS first, round(max(prefix), 3) AS last, round(avg(prefix), 2) AS mean FROM f GROUP BY doc_id""",
)
def _(spark, d):
    p = _peptides(spark, d).where("length(peptide) >= 5")
    sites, masses = F.array(F.lit(0), F.lit(3), F.lit(-1)), F.array(F.lit(42.0), F.lit(_SHIFT), F.lit(7.5))
    return _summed(p.select("doc_id", F.posexplode(K.prefix_masses(K.plain("peptide"), sites, masses)).alias("i", "prefix")))


@query("mth05_fragment_mz", "SELECT p_partkey, round((p_retailprice + 18.010564683) / 2 + 1.0072764667710, 6) AS mz FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(K.fragment_mz("p_retailprice", F.lit(18.010564683), F.lit(2)), 6).alias("mz"))


@query("mth06_isotope_mz", "SELECT p_partkey, i::int AS i, round(p_retailprice + i * 1.00335483 / 2, 6) AS mz FROM part, range(0, 3) t(i)")
def _(spark, d):
    rows = table(spark, d, "part").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return rows.select("p_partkey", "i", F.round(K.isotope_mz("p_retailprice", "i", F.lit(2)), 6).alias("mz"))


@query("mth07_mass_bucket", "SELECT p_partkey, greatest(300, least(7000, CAST(floor(p_retailprice / 100) * 100 AS INT))) AS bucket FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", K.mass_bucket("p_retailprice").alias("bucket"))


@query("mth08_robust_z", f"WITH {A.PEAKS}, q AS (SELECT frame_num, quantile_cont(ab, 0.25) AS a, quantile_cont(ab, 0.5) AS b, quantile_cont(ab, 0.75) AS c FROM peaks GROUP BY ALL) SELECT event_id, round(CASE WHEN c = a THEN 0.0 ELSE (ab - b) / (c - a) END, 6) AS z FROM peaks JOIN q USING (frame_num)")
def _(spark, d):
    from pepspark.operators.windows import quantile_scores

    return quantile_scores(A.peaks(spark, d), ["frame_num"], "ab", "z").select("event_id", F.round("z", 6).alias("z"))


_CDF = """round(CASE WHEN z >= 0 THEN (1 + e) / 2 ELSE (1 - e) / 2 END, 6)"""


@query(
    "mth09_normal_cdf",
    f"""SELECT p_partkey, {_CDF} AS p FROM (SELECT p_partkey, z, 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x) AS e
    FROM (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM (SELECT p_partkey, (p_size - 25) / 10.0::double AS z, abs((p_size - 25) / 10.0::double) / sqrt(2.0) AS x FROM part)))""",
)
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(K.normal_cdf((F.col("p_size") - 25) / 10.0), 6).alias("p"))


@query("mth10_ppm_error", f"WITH {A.PEAKS} SELECT event_id, round((mz - 100.0) / 100.0 * 1e6 / 10.0, 4) AS error FROM peaks")
def _(spark, d):
    return A.peaks(spark, d).select("event_id", F.round(K.ppm_error("mz", F.lit(100.0), 10.0), 4).alias("error"))


_PAIRS = "p AS (SELECT a.vec_id, a.label, a.embedding::double[] AS a, b.embedding::double[] AS b FROM embeddings a JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) b USING (label))"


def _pairs(spark, d):
    v = A.vectors(spark, d)
    first = v.groupBy("label").agg(F.min_by("v", "vec_id").alias("b"))
    return v.join(first, "label").select("vec_id", "label", F.col("v").alias("a"), "b")


@query("mth12_cosine", f"WITH {_PAIRS} SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cosine FROM p")
def _(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(K.cosine("a", "b", 1.0), 6).alias("cosine"))


@query("mth13_pearson", f"WITH {_PAIRS}, l AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y FROM p) SELECT vec_id, round(corr(x, y), 6) AS r FROM l GROUP BY vec_id")
def _(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(K.pearson("a", "b"), 6).alias("r"))


@query("mth14_mean_cubed_correlation", f"WITH {_PAIRS}, l AS (SELECT label, vec_id, unnest(a) AS x, unnest(b) AS y FROM p), c AS (SELECT label, vec_id, corr(x, y) AS r FROM l GROUP BY ALL) SELECT label, round(avg(r * r * r), 6) AS r3 FROM c GROUP BY label")
def _(spark, d):
    return _pairs(spark, d).select("label", F.pow(K.pearson("a", "b"), 3).alias("r")).groupBy("label").agg(F.round(F.avg("r"), 6).alias("r3"))


@query("mth24_spectral_angle", f"WITH {_PAIRS} SELECT vec_id, round(1 - acos(least(1.0, greatest(-1.0, list_cosine_similarity(a, b)))) / (pi() / 2), 4) AS angle FROM p")
def _(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(K.spectral_angle("a", "b"), 4).alias("angle"))


@query("mth28_cosine_distance", f"WITH {_PAIRS} SELECT vec_id, round(1 - list_cosine_similarity(a, b), 6) AS distance FROM p")
def _(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(1 - K.cosine("a", "b"), 6).alias("distance"))


@query("mth15_trapezoid", f"WITH {A.PEAKS}, t AS (SELECT run, frame_num AS x, sum(ab) AS y FROM peaks GROUP BY ALL), u AS (SELECT run, (y + lag(y) OVER w) / 2 * (x - lag(x) OVER w) AS part FROM t WINDOW w AS (PARTITION BY run ORDER BY x)) SELECT run, round(coalesce(sum(part), 0), 2) AS area FROM u GROUP BY run")
def _(spark, d):
    from pepspark.operators.windows import trapezoid_area

    sums = A.peaks(spark, d).groupBy("run", "frame_num").agg(F.sum("ab").alias("ab"))
    return trapezoid_area(sums, ["run"], "frame_num", "ab").select("run", F.round("area", 2).alias("area"))


@query("mth15b_trapezoid_arrays", "SELECT vec_id, round(list_sum(list_transform(range(1, 64), lambda i: (embedding[i]::double + embedding[i + 1]) / 2)), 6) AS area FROM embeddings")
def _(spark, d):
    return A.vectors(spark, d).select("vec_id", F.round(K.trapezoid(F.transform("v", lambda x, i: i.cast("double")), F.col("v")), 6).alias("area"))


@query("mth16_percentile_scaling", f"WITH {A.PEAKS}, q AS (SELECT run, quantile_cont(ab, 0.95) AS s FROM peaks GROUP BY run) SELECT frame_num, round(avg(ab / s), 6) AS reference FROM peaks JOIN q USING (run) GROUP BY frame_num")
def _(spark, d):
    p = A.peaks(spark, d)
    s = p.groupBy("run").agg(F.percentile("ab", F.lit(0.95)).alias("s"))
    return p.join(s, "run").groupBy("frame_num").agg(F.round(F.avg(F.col("ab") / F.col("s")), 6).alias("reference"))


@query("mth19_linear_projection", "SELECT p_partkey, round(100.0 + (p_size - 1) / 49.0 * 900.0, 6) AS predicted_rt, round(greatest(100.0, 100.0 + (p_size - 1) / 49.0 * 900.0 - 300.0), 6) AS rt_low, round(least(1000.0, 100.0 + (p_size - 1) / 49.0 * 900.0 + 300.0), 6) AS rt_high FROM part")
def _(spark, d):
    from pepspark.operators.retention import project

    rows = project(table(spark, d, "part"), "p_size", 1.0, 50.0, (100.0, 1000.0), 1 / 3)
    return rows.select("p_partkey", *(F.round(c, 6).alias(c) for c in ("predicted_rt", "rt_low", "rt_high")))


@query("mth21_posterior_error", "SELECT p_partkey, round(1 - 1 / (1 + exp(-(p_size - 25) / 10.0)), 6) AS pep FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(K.posterior_error((F.col("p_size") - 25) / 10.0), 6).alias("pep"))


@query("mth27_mod_ids", "SELECT p_partkey, (p_size::bigint << 16) | (3::bigint << 13) | (67::bigint << 6) | 1 AS id, p_size::bigint AS unimod, 3::bigint AS location, 'C' AS residue, true AS fixed FROM part")
def _(spark, d):
    number = K.mod_id("p_size", F.lit(3), F.lit("C"), F.lit(True))
    rows = table(spark, d, "part").select("p_partkey", number.alias("id"))
    return rows.select("p_partkey", "id", K.unimod_id("id").alias("unimod"), K.mod_location("id").alias("location"), K.mod_residue("id").alias("residue"), K.mod_fixed("id").alias("fixed"))


# --- arrays


@query("arr01_explode_lockstep", "SELECT vec_id, i::int AS i, x, y FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::double AS x, unnest(list_reverse(embedding))::double AS y FROM embeddings)")
def _(spark, d):
    both = A.vectors(spark, d).select("vec_id", F.col("v").alias("x"), F.reverse("v").alias("y"))
    return both.select("vec_id", F.posexplode(F.arrays_zip("x", "y")).alias("i", "p")).select("vec_id", "i", "p.x", "p.y")


@query("arr02_row_ranges", "SELECT p_partkey, unnest(range(0, p_size))::int AS i FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.col("p_size") - 1)).alias("i"))


@query(
    "arr03_site_combinations",
    """WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS s FROM lineitem GROUP BY ALL), e AS (SELECT l_orderkey, unnest(s) AS a FROM s)
    SELECT l_orderkey, a::varchar AS sites FROM e UNION ALL SELECT x.l_orderkey, concat(x.a, ';', y.a) FROM e x JOIN e y ON x.l_orderkey = y.l_orderkey AND x.a < y.a""",
)
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("s"))
    return s.select("l_orderkey", F.explode(K.combinations("s", 2)).alias("c")).select("l_orderkey", K.list_text("c").alias("sites"))


@query("arr04_pivot_cells", f"WITH {A.PEAKS} SELECT run, frame_num, max(ab) AS ab FROM peaks GROUP BY ALL")
def _(spark, d):
    from pepspark.operators.spectra import pivot_chromatograms

    return pivot_chromatograms(A.peaks(spark, d), [], "run", "frame_num", "ab")


@query("arr05_max_normalised", "SELECT vec_id, round(list_sum(list_transform(embedding::double[], lambda x: x / list_max(embedding::double[]))), 5) AS total FROM embeddings")
def _(spark, d):
    return A.vectors(spark, d).select("vec_id", F.round(F.aggregate(K.max_normalised("v"), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))
