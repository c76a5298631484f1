"""The whole workflow from a configuration: library, runs, matches, false discovery, quantities and reports.

Two plug-ins stand where trained models would: a predictor of times and intensities (``operators.predict``) and a scorer of
candidates (``operators.scoring``).  Data-independent runs go through a quick search, calibration of retention times, peak
groups, scoring and MS2 areas; data-dependent ones through matched spectra, scoring and MS1 areas.  Each phase is written.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pepspark import config as settings
from pepspark.functions import columns as K
from pepspark.operators import digest as D
from pepspark.operators import inference as I
from pepspark.operators import quantify as Q
from pepspark.operators import relational as R
from pepspark.operators import retention as T
from pepspark.operators import spectra as S
from pepspark.operators.predict import Predictor, RuleBased
from pepspark.operators.scoring import Scorer
from pepspark.sources import readers, sinks
from pepspark.storage import staged


class State(Enum):
    """Where a search stands; phases are written, so one that stops can be looked into."""

    INIT = 0
    DONE = 1


def build_library(spark: SparkSession, config: dict, predictor: Predictor | None = None) -> dict[str, DataFrame]:
    """Tables of proteins, peptides, peptidoforms, precursors and fragments of a FASTA file."""
    dig, prec, frag = config["digest"], config["precursor"], config["fragment"]
    proteins = R.dense_id(readers.read_fasta(spark, config["fasta_file"]), ["fasta_id"], "protein_index")
    found = D.peptides(D.digest(proteins, dig["enzyme"], dig["min_len"], dig["max_len"], dig["max_missed_cleavages"], dig["n_term_methionine_excision"]))
    both = R.dense_id(D.with_decoys(found, config["decoy"]), ["is_decoy", "peptide"], "peptide_index")
    mods = [(m["mod_name"], m["residue"], m["location"], m["fixed"]) for m in config["modification"]["mod_param_set"]]
    forms = D.modify(both, mods, config["modification"]["max_mods"]) if mods else both.withColumns({"mod_ids": F.array().cast("array<bigint>"), "mod_sites": F.array().cast("array<int>")})
    forms = forms.withColumn("precursor_mass", D.peptide_mass(F.col("peptide"), F.col("mod_ids")))
    forms = R.dense_id(forms, ["peptide_index", "mod_ids", "mod_sites"], "peptidoform_index")
    predictor = predictor or RuleBased()
    precursors = predictor.times(D.precursors(forms, prec["min_charge"], prec["max_charge"], prec["min_mz"], prec["max_mz"]))
    fragments = predictor.intensities(D.fragments(precursors, "precursor_index", frag["max_charge"], frag["min_mz"], frag["max_mz"]))
    return {"sequence": proteins, "precursor": precursors, "fragment": fragments}


def search_run(frames: DataFrame, library: dict[str, DataFrame], config: dict) -> DataFrame:
    """Candidates of data-dependent runs, ``run_name, precursor_index, frame_num, n_matched, signal, score``: second-level
    spectra whose isolation window holds the precursor and that have enough of its fragments, the ten best of each."""
    ppm = float(config["ms2_mass_tol_in_ppm"])
    second = frames.where("ms_level > 1")
    windows = second.select("run_name", "frame_num", "isolation_min_mz", "isolation_max_mz").where("isolation_min_mz is not null")
    inside = S.in_windows(library["precursor"].select("precursor_index", "precursor_mz", "precursor_charge", "sequence_length"), windows, "precursor_mz", "isolation_min_mz", "isolation_max_mz", "precursor_charge", strict=True)
    ions = library["fragment"].select("precursor_index", _fragment(), F.col("mz").alias("theo_mz"))
    wanted = inside.select("run_name", "frame_num", "precursor_index", "sequence_length").join(ions, "precursor_index")
    matches = R.ppm_join(wanted, readers.peaks_of(second), "theo_mz", "mz", ppm, ["run_name", "frame_num"])
    group = ["run_name", "precursor_index"]
    found = S.matched_spectra(matches, group, "frame_num", "fragment", "sequence_length")
    signal = matches.groupBy(*group, "frame_num").agg(F.sum("ab").alias("signal"))
    return found.join(signal, [*group, "frame_num"]).withColumn("score", F.col("n_matched") + F.log1p("signal") / 100).select(*group, "frame_num", "n_matched", "signal", "score")


def _fragment():
    return F.concat_ws("-", "cleavage_index", "is_prefix", "charge").alias("fragment")


def scheme_frames(frames: DataFrame) -> DataFrame:
    """``run_name, window, low, high, frame_num, step, time``: the frames of each isolation window of each run, numbered."""
    runs = [r["run_name"] for r in frames.select("run_name").distinct().collect()]  # the configuration's runs
    out = None
    for name in runs:
        own = frames.where((F.col("run_name") == name) & (F.col("ms_level") > 1))
        scheme = S.checked_scheme(own).select(F.lit(name).alias("run_name"), F.col("isolation_win_idx").alias("window"), "low", "high", F.posexplode("frames").alias("step", "frame_num"))
        out = scheme if out is None else out.unionByName(scheme)
    return out.join(frames.select("run_name", "frame_num", F.col("time_in_seconds").alias("time")), ["run_name", "frame_num"])


def fragment_cells(library: dict[str, DataFrame], steps: DataFrame, peaks: DataFrame, ppm: float, k: int, bounds: DataFrame | None = None) -> DataFrame:
    """``run_name, precursor_index, window, fragment, rank, predicted_intensity, step, ab``: the greatest peak of each of a
    precursor's ``k`` most intense fragments in each frame of its isolation window, between its time ``bounds`` if given."""
    windows = steps.select("run_name", "window", "low", "high").distinct()
    held = R.interval_join(windows, library["precursor"].select("precursor_index", "precursor_mz"), "low", "high", "precursor_mz", 10.0).select("run_name", "window", "precursor_index")
    ions = library["fragment"].select("precursor_index", _fragment(), F.col("mz").alias("theo_mz"), "predicted_intensity")
    by = Window.partitionBy("precursor_index").orderBy(F.desc("predicted_intensity"), "fragment")
    top = ions.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    placed = peaks.join(steps.select("run_name", "frame_num", "window", "step", "time"), ["run_name", "frame_num"])
    wanted = held.join(top, "precursor_index")
    if bounds is not None:
        wanted = wanted.join(bounds.select("run_name", "precursor_index", "rt_low", "rt_high"), ["run_name", "precursor_index"])
    met = R.ppm_join(wanted, placed, "theo_mz", "mz", ppm, ["run_name", "window"])
    if bounds is not None:
        met = met.where("time between rt_low and rt_high")
    return met.groupBy("run_name", "precursor_index", "window", "fragment", "rank", "predicted_intensity", "step").agg(F.max("ab").alias("ab"))


def quick_search(library: dict[str, DataFrame], steps: DataFrame, peaks: DataFrame, config: dict) -> DataFrame:
    """Confident targets of a coarse pass over all frames, with their reference and observed times: what calibrates a run."""
    group = ["run_name", "precursor_index", "window"]
    cells = staged(fragment_cells(library, steps, peaks, float(config["ms2_mass_tol_in_ppm"]), 6), "quick")
    best = S.quick_matches(S.quick_scores(cells, group, "fragment", "step", "ab", "predicted_intensity"), group, "step")
    named = best.join(library["precursor"].select("precursor_index", "is_decoy", "ref_rt"), "precursor_index")
    named = named.join(steps.select("run_name", "window", "step", F.col("time").alias("observed_rt")), ["run_name", "window", "step"])
    named = staged(named, "named")
    out = None
    for r in named.select("run_name").distinct().collect():
        own = S.confident_targets(named.where(F.col("run_name") == r["run_name"]), "score", "is_decoy", "precursor_index")
        out = own if out is None else out.unionByName(own)
    return out


def search_dia(frames: DataFrame, library: dict[str, DataFrame], config: dict) -> tuple[DataFrame, DataFrame]:
    """Candidates of data-independent runs with features (``run_name, precursor_index, window, frame_num, score, ...``), and
    the fragment cells around them (``time``: 1..7, the candidate at 4)."""
    ppm = float(config["ms2_mass_tol_in_ppm"])
    steps, peaks = staged(scheme_frames(frames), "steps"), readers.peaks_of(frames.where("ms_level > 1"))
    confident = quick_search(library, steps, peaks, config)
    span = frames.groupBy("run_name").agg(F.min("time_in_seconds").alias("first"), F.max("time_in_seconds").alias("last"))
    calibrated = None
    if confident is not None and not confident.isEmpty():
        runs = confident.select("run_name").distinct()
        rows = library["precursor"].select("precursor_index", "ref_rt").crossJoin(F.broadcast(runs))  # a row for each run
        calibrated = staged(T.calibrate_run(confident, ["run_name"], "ref_rt", "observed_rt", rows=rows, gradient=span), "calibrated")
    cells = staged(fragment_cells(library, steps, peaks, ppm, 16, calibrated), "cells")
    group = ["run_name", "precursor_index", "window"]
    bounds = steps.groupBy("run_name", "window").agg(F.min("step").alias("first"), F.max("step").alias("last"))
    bounds = cells.select(*group).distinct().join(bounds, ["run_name", "window"])
    found = staged(S.peak_groups(cells, group, "fragment", "step", "ab", F.col("rank") <= 12, bounds, least_peaks=int(config["least_peaks"])), "groups")
    similar = S.quick_scores(cells, group, "fragment", "step", "ab", "predicted_intensity").select(*group, "step", "similarity")
    rows = found.join(similar, [*group, "step"]).join(steps.select("run_name", "window", "step", "frame_num", F.col("time").alias("observed_rt")), ["run_name", "window", "step"])
    if calibrated is not None:
        rows = rows.join(calibrated.select("run_name", "precursor_index", "predicted_rt"), ["run_name", "precursor_index"], "left")
    else:
        rows = rows.withColumn("predicted_rt", F.lit(None).cast("double"))
    off = F.coalesce(F.abs(F.col("observed_rt") - F.col("predicted_rt")), F.lit(0.0))
    rows = rows.withColumns({"features": F.array(F.col("n_maxima").cast("double"), F.log1p(F.col("n_peaks").cast("double")), "merit", "similarity", off / 60), "score": F.col("merit") + F.col("similarity") - off / 3600})
    near = cells.join(rows.select(*group, F.col("step").alias("_apex"), "frame_num"), group).where(F.abs(F.col("step") - F.col("_apex")) <= 3)
    near = near.join(steps.select("run_name", "window", "step", F.col("time").alias("rt")), ["run_name", "window", "step"])
    return rows, near.select(*group, "frame_num", "fragment", (F.col("step") - F.col("_apex") + 4).alias("time"), "rt", "ab")


def analyse(candidates: DataFrame, frames: DataFrame, library: dict[str, DataFrame], config: dict) -> DataFrame:
    """Best candidates with q-values within runs and globally, protein groups and modified sequences."""
    best = R.best_row(candidates, ["run_name", "precursor_index"], "score", ["frame_num"])
    named = R.star_join(best, (library["precursor"].select("precursor_index", "peptide", "peptidoform_index", "protein_index", "precursor_charge", "precursor_mz", "is_decoy", "mod_ids", "mod_sites"), "precursor_index"))
    named = named.drop("observed_rt").join(frames.select("run_name", "frame_num", F.col("time_in_seconds").alias("observed_rt")), ["run_name", "frame_num"])
    named = staged(named.withColumn("pmsm_index", F.xxhash64("run_name", "precursor_index", "frame_num")), "named")
    cutoff = float(config["q_value_cutoff"])
    grouped = I.with_global(named, I.global_analysis(named, proteins="protein_index", cutoff=cutoff))
    tested = staged(I.run_analysis(grouped, "run_name"), "tested")
    return tested.withColumns({"modified_sequence": K.modified_sequence("peptide", "mod_ids", "mod_sites"), "posterior_error": K.posterior_error("score")})


def ms1_amounts(matches: DataFrame, frames: DataFrame, config: dict) -> DataFrame:
    """``run_name, precursor_index, amount``: areas of the precursors' first-level peaks, three frames on each side of the first
    level's frame nearest in time to the match, frames one step apart."""
    first = frames.where("ms_level = 1")
    order = R.dense_id(first.select("run_name", "frame_num", "time_in_seconds"), ["run_name", "time_in_seconds", "frame_num"], "_step")
    apex = R.nearest_join(matches.select("run_name", "precursor_index", "precursor_mz", "observed_rt"), order.select("run_name", "time_in_seconds", "_step"), "observed_rt", "time_in_seconds", "_step", ["run_name"], "_apex")
    wanted = apex.where("_apex is not null").withColumn("_step", F.explode(F.sequence(F.col("_apex") - 3, F.col("_apex") + 3)))
    placed = wanted.join(order.select("run_name", "frame_num", "_step"), ["run_name", "_step"])
    points = R.ppm_join(placed, readers.peaks_of(first), "precursor_mz", "mz", float(config["ms1_mass_tol_in_ppm"]), ["run_name", "frame_num"])
    points = points.withColumn("time", F.col("_step") - F.col("_apex") + 4)
    return Q.ms1_area(points, ["run_name", "precursor_index"], "time", "ab").withColumnRenamed("ms1_area", "amount")


def ms2_amounts(matches: DataFrame, points: DataFrame) -> DataFrame:
    """``run_name, precursor_index, amount``: areas of the fragments that all runs together select."""
    own = points.join(matches.select("run_name", "precursor_index", "window", "frame_num"), ["run_name", "precursor_index", "window", "frame_num"])
    own = staged(own, "own")
    scores = Q.fragment_scores(own, ["run_name", "precursor_index"], "fragment", "time", "ab")
    chosen = Q.select_fragments(scores, ["precursor_index"], "fragment")
    return Q.ms2_area(own, chosen, ["run_name", "precursor_index"], ["precursor_index"], "fragment", "time", "rt", "ab").withColumnRenamed("ms2_area", "amount")


def run_search(spark: SparkSession, config_path: str, scorer: Scorer | None = None, predictor: Predictor | None = None) -> dict:
    """Runs everything and writes reports to the output folder.

    ``scorer`` gets the candidates (data-independent ones with ``features``) and gives their ``score``; one with ``fit`` learns
    from them first.
    """
    config = settings.load(config_path)
    out, dia = config["output_directory"], config["acquisition_method"] == "DIA"
    library = build_library(spark, config, predictor)
    folder = config.get("database_directory") or f"{out}/library"
    sinks.write_library(library, folder, overwrite=True)
    library = {name: spark.read.parquet(f"{folder}/{name}") for name in library}
    for k, path in enumerate(settings.input_files(config, spark)):
        readers.read_run(spark, path).write.mode("append" if k else "overwrite").parquet(f"{out}/frames")
    frames, points = spark.read.parquet(f"{out}/frames"), None
    if dia:
        found, points = search_dia(frames, library, config)
        points.write.mode("overwrite").parquet(f"{out}/points")
        points = spark.read.parquet(f"{out}/points")
    else:
        found = search_run(frames, library, config)
    found.join(library["precursor"].select("precursor_index", "is_decoy", "peptide_index"), "precursor_index").write.mode("overwrite").parquet(f"{out}/candidates")
    candidates = spark.read.parquet(f"{out}/candidates")
    if scorer is not None:
        scorer = scorer.fit(candidates) if hasattr(scorer, "fit") else scorer
        candidates = scorer.score(candidates)
    analyse(candidates.drop("is_decoy", "peptide_index"), frames, library, config).write.mode("overwrite").parquet(f"{out}/matches_unfiltered")
    cutoff = float(config["q_value_cutoff"])
    within = (F.col("precursor_q_value") <= cutoff) & (F.col("global_precursor_q_value") <= cutoff)
    spark.read.parquet(f"{out}/matches_unfiltered").where(within).write.mode("overwrite").parquet(f"{out}/matches")
    matches = spark.read.parquet(f"{out}/matches")
    for r in frames.groupBy("run_name").agg(F.max("time_in_seconds").alias("last"), F.min("time_in_seconds").alias("first"), F.count(F.lit(1)).alias("n")).collect():
        sinks.write_attributes(spark, f"{out}/run_attributes", r["run_name"], gradient_length_in_seconds=r["last"] - r["first"], frames=r["n"])
    targets = matches.where("not is_decoy")
    amounts = ms2_amounts(targets, points) if dia else ms1_amounts(targets, frames, config)
    amounts = targets.select("run_name", "precursor_index", "protein_group", "peptidoform_index").join(amounts, ["run_name", "precursor_index"])
    amounts = amounts.where("protein_group is not null and amount > 0").groupBy(F.col("protein_group").alias("protein"), "peptidoform_index", "run_name").agg(F.median("amount").alias("abundance"))
    quantities = Q.max_lfq(amounts, "protein", "peptidoform_index", "run_name", "abundance").withColumnRenamed("protein", "protein_group")
    sinks.write_report(matches, f"{out}/pmsm_results", config["report_format"])
    sinks.write_report(quantities, f"{out}/protein_group_maxlfq_results", config["report_format"])
    return {"state": State.DONE, "matches": matches, "quantities": quantities, "summary": I.summary(matches.withColumn("protein", F.col("protein_group")), "run_name", cutoff)}
