"""Chained conditional stage models: encoding, fitting, scoring, and their bundles.

Stage i is fitted on the rows that reached it and predicts whether they went further; a
row's score is the product over stages. Trees are MLlib's; missing numbers become a value
below the smallest with a flag beside it.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelforge.functions.scalars import is_blank
from funnelforge.operators import levels, mapping, metrics, profile
from funnelforge.operators.assemble import any_known, formula_rates
from funnelforge.operators.derive import level_of, stage_rows, stage_sizes
from funnelforge.operators.levels import Levels, fit_levels, fold_of
from funnelforge.operators.position import matched, ordered_position
from funnelforge.session import discard, stored

#: Rows that a route needs, its weight, trees and depth of a stage's model.
MIN_ENRICHED, ROUTE_WEIGHT = 30, 0.65
TREES, DEPTH = 300, 6
PROVENANCE_AUC = 0.70

#: Levels of a category that a model tells apart.
MAX_LEVELS = 100

#: Cells that training rows are added up in, at most; bins of a number, and points of its
#: distribution that their centres are picked from.
CELLS, BINS, POINTS = 2**20, 32, 500

#: Names of features that are only known after the outcome.
POST_EVENT = (
    r"turnaround", r"\btat\b", r"_tat\b", r"procedure.*perform", r"treatment.*perform", r"status.*restat", r"final_status", r"closure",
    r"resolved_at", r"completed_at", r"disbursed_at",
)


@dataclass
class Features:
    """Feature columns with what encoding pins: categories, and each number's floor."""

    numeric: list[str]
    vocab: dict[str, list[str]]
    floors: dict[str, float] = field(default_factory=dict)
    levels: Levels | None = None

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.vocab, *(self.levels.columns if self.levels else [])]


def pin(df: DataFrame, numeric: list[str], categorical: list[str], id_col: str | None = None) -> Features:
    """The vocabulary and floors of a training table.

    Categories of more than MAX_LEVELS levels become rates (``operators.levels``), however
    many levels they have, if ``id_col`` tells rows' folds and there is a ``y``. Without an id
    the most frequent levels are told apart (ties by name) and the others share the index
    of unseen ones."""
    floors = df.agg(*(F.min(F.col(c).cast("double")).alias(c) for c in numeric)).first().asDict() if numeric else {}
    vocab: dict[str, list[str]] = {c: [] for c in categorical}
    wide: list[str] = []
    if categorical:
        counts = stored(profile.value_counts(df, categorical), "level-counts")
        if id_col is not None:
            many = profile.solid(counts).groupBy("col").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > MAX_LEVELS)
            wide = sorted(r["col"] for r in many.collect())
        for r in profile.top_values(counts.where(~F.col("col").isin(wide)), MAX_LEVELS).collect():
            vocab[r["col"]].append(r["value"])
        discard(counts)
    rates = fit_levels(df, wide, id_col) if wide else None
    return Features(numeric, {c: sorted(v) for c, v in vocab.items() if c not in wide}, {c: (v if v is not None else 0.0) - 1.0 for c, v in floors.items()}, rates)


def project(df: DataFrame, features: Features, keep: list[str]) -> DataFrame:
    """``keep`` and the pinned features in order; unseen categories become null."""
    missing = [c for c in features.columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    nums = [F.col(c).try_cast("double").alias(c) for c in features.numeric]
    cats = [F.when(F.col(c).cast("string").isin(v), F.col(c).cast("string")).alias(c) for c, v in features.vocab.items()]
    wide = [F.col(c).cast("string").alias(c) for c in (features.levels.columns if features.levels else [])]
    return df.select(*keep, *nums, *cats, *wide)


def encode(df: DataFrame, features: Features, fold: Column | None = None) -> DataFrame:
    """M1: per number its value (the floor where missing) and a flag, per category its
    index in the vocabulary (one beyond it where missing or unseen), per category of many
    levels its rate, or with ``fold`` that of the other folds."""
    value = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c)).cast("double")
    out = df
    for c in features.numeric:
        v = value(c)
        out = out.withColumns({f"{c}__value": F.coalesce(v, F.lit(features.floors[c])), f"{c}__missing": v.isNull().cast("double")})
    for c, levels in features.vocab.items():
        at = F.array_position(F.array(*map(F.lit, levels)), F.col(c)) - 1 if levels else F.lit(-1)
        out = out.withColumn(f"{c}__index", F.when(at >= 0, at).otherwise(len(levels)).cast("double"))
        # What a model trains on: an index of so many categories, not a number.
        out = out.withMetadata(f"{c}__index", {"ml_attr": {"type": "nominal", "name": f"{c}__index", "num_vals": len(levels) + 1}})
    return features.levels.coded(out, fold) if features.levels else out


def _bins(features: Features) -> int:
    return max([BINS, *(len(v) + 1 for v in features.vocab.values())])


def _pipeline(features: Features, trees: int, depth: int, seed: int, weight: str | None = None) -> Pipeline:
    inputs = [x for c in features.numeric for x in (f"{c}__value", f"{c}__missing")]
    inputs += [f"{c}__index" for c, v in features.vocab.items() if v]
    inputs += [f"{c}__rate" for c in (features.levels.columns if features.levels else [])]
    gbt = GBTClassifier(featuresCol="features", labelCol="y", maxIter=trees, maxDepth=depth, maxBins=_bins(features), stepSize=0.1, seed=seed, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), gbt])


def centres(points: list[float], most: int) -> tuple[list[float], list[float]]:
    """At most ``most`` of a distribution's sorted points, its ends among them, evenly by
    rank where there are more; and the edges half-way between them."""
    found = sorted(set(points))
    if len(found) > most:
        found = sorted({points[round(k * (len(points) - 1) / (most - 1))] for k in range(most)})
    kept, edges = found[:1], []
    for v in found[1:]:
        e = (kept[-1] + v) / 2
        if kept[-1] <= e < v and (not edges or e > edges[-1]):
            kept.append(v)
            edges.append(e)
    return kept, edges


def cells(rows: DataFrame, features: Features) -> DataFrame:
    """(y, features, weight): training rows added up by their label, categories, and each number's
    nearest centre.

    A tree looks at a number through its bins alone, and the thresholds between centres are
    the edges half-way, so a row is on its centre's side of each threshold. All trees are
    then grown on rows of bounded number, whatever the table's size."""
    value = {c: F.when(~F.isnan(c), F.col(c)) for c in features.numeric}
    at = [k / POINTS for k in range(POINTS + 1)]
    # One of the bins is for missing values.
    points = rows.agg(*(F.percentile_approx(v, at, 10 * POINTS).alias(c) for c, v in value.items())).first() if value else {}
    out, mids = rows.withColumns(value), {}
    for c in features.numeric:
        mids[c], edges = centres(points[c] or [], _bins(features) - 1)
        if edges:
            # A bucket begins at its lower edge, but a tree sends values at the edge to the left.
            splits = [-math.inf, *(math.nextafter(e, math.inf) for e in edges), math.inf]
            out = Bucketizer(splits=splits, inputCol=c, outputCol="_bucket").transform(out).withColumn(c, F.col("_bucket")).drop("_bucket")
        else:
            out = out.withColumn(c, F.when(F.col(c).isNotNull(), 0.0))
    keys = ["y", *features.columns]
    counts = out.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    back = {c: F.get(F.array(*map(F.lit, mids[c])), F.col(c).cast("int")) if mids[c] else F.lit(None).cast("double") for c in features.numeric}
    return counts.withColumns(back).sortWithinPartitions(*keys)


def _few_cells(features: Features) -> bool:
    """Whether rows of these features have a bounded and small number of cells."""
    n = 2 * _bins(features) ** len(features.numeric) * math.prod(len(v) + 1 for v in features.vocab.values())
    return features.levels is None and n <= CELLS


def fit_stage(rows: DataFrame, features: Features, trees: int = TREES, depth: int = DEPTH, seed: int = 7, id_col: str | None = None) -> PipelineModel:
    """M2: a boosted-tree model of y on the pinned features. Rates of levels are those of
    the folds that ``id_col`` does not put a row in. Rows of few features are first added up
    (``cells``)."""
    if features.levels and id_col is None:
        raise ValueError("categories of many levels need the rows' id")
    if _few_cells(features):
        summed = stored(cells(project(rows, features, ["y"]), features), "cells")
        fitted = _pipeline(features, trees, depth, seed, "weight").fit(encode(summed, features))
        discard(summed)
        return fitted
    fold = fold_of(F.col(id_col)) if features.levels else None
    ready = encode(project(rows, features, ["y", *([id_col] if features.levels else [])]), features, fold)
    return _pipeline(features, trees, depth, seed).fit(ready)


def probability(df: DataFrame, model: PipelineModel, features: Features, name: str) -> DataFrame:
    """Adds the model's probability; all other columns stay."""
    missing = [c for c in features.columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    held = df.select(F.struct("*").alias("_row"), *(F.col(c) for c in features.columns))
    scored = model.transform(encode(project(held, features, ["_row"]), features))
    return scored.select("_row", vector_to_array("probability")[1].alias("_p")).select("_row.*", F.col("_p").alias(name))


def blend(enriched: Column, a: Column, b: Column, weight: float = ROUTE_WEIGHT) -> Column:
    """M5: both routes on enriched rows, the core route elsewhere."""
    return F.when(enriched, weight * a + (1 - weight) * b).otherwise(b)


@dataclass
class Stage:
    core: PipelineModel
    core_features: Features
    rich: PipelineModel | None = None
    rich_features: Features | None = None
    enrichment: list[str] = field(default_factory=list)


@dataclass
class Chain:
    """The fitted stages of a funnel."""

    architecture: str
    target: str
    order: list[str]
    stages: list[Stage]


def train(df: DataFrame, target: str, order: list[str], numeric: list[str], categorical: list[str], enrichment: list[str], architecture: str = "unified", trees: int = TREES, depth: int = DEPTH, id_col: str | None = None) -> Chain:
    """M3, M4, M5: ``baseline`` uses core features only; ``unified`` all, missing ones as
    a signal; ``dual`` blends a model of enriched rows with a core model, where 30 enriched
    rows of both classes exist. ``id_col`` is needed for categories of many levels (``pin``).
    Rows and their levels are derived once and stored while the stages are fitted."""
    rows = _levelled(df, target, order, [*numeric, *categorical], id_col)
    chain = _train(rows, target, order, numeric, categorical, enrichment, architecture, trees, depth, id_col)
    discard(rows)
    return chain


def _levelled(df: DataFrame, target: str, order: list[str], used: list[str], id_col: str | None, **more: Column) -> DataFrame:
    """The id, features, ``_level`` and ``more`` of all rows, stored."""
    keep = dict.fromkeys([*([id_col] if id_col else []), *used])
    return stored(df.select(*keep, level_of(target, order).alias("_level"), *(c.alias(name) for name, c in more.items())), "training-rows")


def _train(levelled: DataFrame, target: str, order: list[str], numeric: list[str], categorical: list[str], enrichment: list[str], architecture: str, trees: int, depth: int, id_col: str | None) -> Chain:
    core = ([c for c in numeric if c not in enrichment], [c for c in categorical if c not in enrichment])
    stages = []
    for i in range(len(order) - 1):
        rows = levelled.where(F.col("_level") >= i).withColumn("y", (F.col("_level") > i).cast("int"))
        used = (numeric, categorical) if architecture == "unified" else core
        features = pin(rows, *used, id_col)
        stage = Stage(fit_stage(rows, features, trees, depth, id_col=id_col), features, enrichment=enrichment)
        if architecture == "dual" and enrichment:
            own = rows.where(any_known(enrichment))
            n = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
            if n["n"] >= MIN_ENRICHED and 0 < n["p"] < n["n"]:
                stage.rich_features = pin(own, numeric, categorical, id_col)
                stage.rich = fit_stage(own, stage.rich_features, trees, depth, id_col=id_col)
        stages.append(stage)
    return Chain(architecture, target, order, stages)


class LeakageError(ValueError):
    """A gate that stops training or evaluation."""


@dataclass
class Gate:
    name: str
    passed: bool
    message: str


@dataclass
class Training:
    """A fitted chain with what its gates, warnings and the pre-flight check need."""

    chain: Chain
    gates: list[Gate]
    warnings: list[str]
    null_rates: dict[str, float]
    pinned: DataFrame | None = None


def feature_gates(target: str, features: list[str], derived: list[str] | None = None, patterns: tuple[str, ...] = POST_EVENT) -> list[Gate]:
    """Gates over the features' names. The target or what derives from it raises; names
    that only exist after the outcome are reported."""
    leaked = sorted(set(features) & {target, *(derived or [])})
    if leaked:
        raise LeakageError(f"features hold the target: {', '.join(leaked)}")
    late = [c for c in features if any(re.search(p, c, re.IGNORECASE) for p in patterns)]
    return [
        Gate("target_leakage", True, "no feature is the target"),
        Gate("post_event_features", not late, f"known only after the outcome: {', '.join(late)}" if late else "no feature is known only after the outcome"),
    ]


def train_run(
    df: DataFrame, target: str, order: list[str], numeric: list[str], categorical: list[str], enrichment: list[str], architecture: str = "unified", trees: int = TREES, depth: int = DEPTH,
    derived: list[str] | None = None, formulas: dict[str, Column] | None = None, source_col: str | None = None, id_col: str | None = None, batch: Column | None = None, least: int = 50,
) -> Training:
    """Gates, warnings and null rates around ``train``.

    The target among the features raises. Names known only after the outcome, formulas that
    do not hold in all sources, and features that tell the two sides of ``batch`` apart
    are reported. Warnings name stages of fewer than ``least`` positives and stages whose
    enriched route was left out. Raises if scores of the training rows grow along the funnel.
    """
    used = [*numeric, *categorical]
    gates = feature_gates(target, used, derived)
    if formulas:
        rows = df if source_col else df.withColumn("_all", F.lit("all"))
        bad = formula_rates(rows, formulas, source_col or "_all").where("fails").collect()
        for name in formulas:
            own = [f"{'all' if r['is_total'] else r['source']}: {r['pass_rate']:.4f}" for r in bad if r["formula"] == name]
            gates.append(Gate(f"formula:{name}", not own, "; ".join(own) or "holds"))
    checked = batch is not None and bool(numeric)
    rows = _levelled(df, target, order, used, id_col, **({"_batch": batch.cast("int")} if checked else {}))
    if checked:
        found = provenance(rows, id_col, F.col("_batch"), numeric).first()
        gates.append(Gate("provenance", not found["fails"], f"AUC {found['auc']}"))
    thin = stage_sizes(rows.select(F.col("_level").alias("k")), len(order), least).where("sparse").orderBy("stage").collect()
    warnings = [f"stage {r['stage']}: only {r['n_positive']} positives" for r in thin]
    chain = _train(rows, target, order, numeric, categorical, enrichment, architecture, trees, depth, id_col)
    if architecture == "dual":
        warnings += [f"stage {i}: no enriched route, fewer than {MIN_ENRICHED} enriched rows or one class" for i, s in enumerate(chain.stages) if s.rich is None]
    # Of numbers only the share of blanks is asked for.
    types = dict(rows.dtypes)
    solid = {c: ~is_blank(F.col(c)) if types[c] == "string" else F.col(c).isNotNull() for c in numeric}
    counts = stored(profile.value_counts(rows.withColumns({c: F.when(known, "known") for c, known in solid.items()}), used), "training-counts")
    rates = {r["col"]: r["blank_rate"] for r in profile.blank_rates(counts).collect()}
    _in_order(score(rows.select(*dict.fromkeys(used)), chain), chain)
    discard(rows)
    return Training(chain, gates, warnings, rates, stored(mapping.pins(counts, batch_features(chain)), "pinned"))


def _in_order(scored: DataFrame, chain: Chain) -> None:
    n = ordinal_violations(scored, [f"stage_{i}" for i in range(len(chain.stages))]).first()["n"]
    if n:
        raise ValueError(f"{n} rows score higher at a later stage")


def score(df: DataFrame, chain: Chain) -> DataFrame:
    """M6: adds stage_<i> probabilities of every row and their product, ``score``."""
    out = df
    for i, s in enumerate(chain.stages):
        out = probability(out, s.core, s.core_features, f"stage_{i}")
        if s.rich is not None:
            out = probability(out, s.rich, s.rich_features, "_rich")
            out = out.withColumn(f"stage_{i}", blend(any_known(s.enrichment), F.col("_rich"), F.col(f"stage_{i}"))).drop("_rich")
    names = [F.col(f"stage_{i}") for i in range(len(chain.stages))]
    return out.withColumn("score", reduce(lambda a, b: a * b, names))


def ordinal_violations(scored: DataFrame, stages: list[str]) -> DataFrame:
    """M7: one row of n: rows whose cumulative probability leaves [0, 1] or grows."""
    each = [F.col(s) for s in stages]
    cums = [reduce(lambda a, b: a * b, each[: k + 1]) for k in range(len(each))]
    bad = reduce(lambda a, b: a | b, [(c < 0) | (c > 1) for c in cums])
    for before, after in zip(cums, cums[1:], strict=False):
        bad = bad | (after > before + 1e-9)
    return scored.agg(F.count(F.when(bad, 1)).alias("n"))


def gains(spark: SparkSession, stage: Stage) -> DataFrame:
    """M8: (feature, gain_pct, kind) with a number's value and flag added up."""
    model = stage.core.stages[-1]
    f = stage.core_features
    slots = [c for c in f.numeric for _ in (0, 1)] + [c for c, v in f.vocab.items() if v] + (f.levels.columns if f.levels else [])
    total = {c: 0.0 for c in f.columns}
    for c, g in zip(slots, model.featureImportances.toArray(), strict=True):
        total[c] += float(g)
    rows = [(c, g, "enrichment" if c in stage.enrichment else "core") for c, g in total.items()]
    table = spark.createDataFrame(rows, "feature string, gain double, kind string")
    whole = sum(total.values()) or 1.0
    return table.select("feature", F.round(100 * F.col("gain") / whole, 4).alias("gain_pct"), "kind")


def _held_out(df: DataFrame, id_col: str, batch: Column, features: list[str]) -> DataFrame:
    """(row_id, features, y, _held): three in ten rows, by a hash of the id, are held out."""
    held = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 4), 16, 10).cast("int") % 10 < 3
    return df.select(F.col(id_col).alias("row_id"), *features, batch.cast("int").alias("y"), held.alias("_held"))


def provenance(df: DataFrame, id_col: str, batch: Column, features: list[str], trees: int = 10) -> DataFrame:
    """M9: (auc, fails): whether features predict which batch a row came from, on the three
    in ten rows that a hash of the id holds out; the smaller batch is the positive one."""
    rows = _held_out(df, id_col, batch, features)
    pinned = pin(rows.where("not _held"), features, [])
    model = fit_stage(rows.where("not _held"), pinned, trees, 3)
    scored = probability(rows.where("_held"), model, pinned, "score")
    return metrics.roc_auc(scored.select("row_id", "y", "score")).withColumn("fails", F.coalesce(F.col("auc") > PROVENANCE_AUC, F.lit(False)))


def provenance_scores(df: DataFrame, id_col: str, batch: Column, features: list[str], trees: int = 10) -> tuple[DataFrame, Stage]:
    """M9: (without, row_id, y, score) of the held-out rows, and the model: scores with every
    feature (``without`` null), and with each in turn taken from another row.

    Rows are put into two orders by hashes of their id, and the row at a place of the one
    lends its values to the row at that place of the other; all features are permuted by
    one such join and scored in one job.
    """
    rows = stored(_held_out(df, id_col, batch, features), "provenance")
    pinned = pin(rows.where("not _held"), features, [])
    fitted = fit_stage(rows.where("not _held"), pinned, trees, 3)
    held = rows.where("_held").drop("_held")
    order = lambda salt: [F.md5(F.concat_ws(salt, F.lit(salt), F.col("row_id").cast("string"))), F.col("row_id")]
    one = ordered_position(held, [], order("a"), "_at")
    two = ordered_position(held, [], order("b"), "_at").select("_at", F.struct(*features).alias("_other"))
    met = one.join(two, "_at")
    variants = [F.struct(F.lit(None).cast("string").alias("without"), *(F.col(c) for c in features))]
    variants += [F.struct(F.lit(f).alias("without"), *(F.col(f"_other.{c}").alias(c) if c == f else F.col(c) for c in features)) for f in features]
    long = met.select("row_id", "y", F.explode(F.array(*variants)).alias("v")).select("row_id", "y", "v.*")
    return probability(long, fitted, pinned, "score").select("without", "row_id", "y", "score"), Stage(fitted, pinned)


def provenance_features(df: DataFrame, id_col: str, batch: Column, features: list[str], trees: int = 10) -> DataFrame:
    """M9: (rank, feature, auc, auc_lost, gain_pct, fails): what the held-out AUC is, and what
    it loses when a feature is permuted, the most telling feature first, beside its gain."""
    scores, stage = provenance_scores(df, id_col, batch, features, trees)
    auc = stored(metrics.roc_auc(stored(scores, "provenance-scores"), ["without"]), "provenance-auc")
    whole = auc.where("without is null").select(F.col("auc").alias("whole"))
    lost = auc.where("without is not null").crossJoin(F.broadcast(whole))  # one row
    met = lost.join(gains(df.sparkSession, stage).select(F.col("feature").alias("without"), "gain_pct"), "without")
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("auc_lost"), "feature")  # a row a feature
    found = met.select(F.col("without").alias("feature"), F.col("whole").alias("auc"), (F.col("whole") - F.col("auc")).alias("auc_lost"), "gain_pct")
    return found.select(F.row_number().over(w).alias("rank"), "feature", "auc", "auc_lost", "gain_pct", F.coalesce(F.col("auc") > PROVENANCE_AUC, F.lit(False)).alias("fails"))


def _by_stage(scored: DataFrame, chain: Chain, id_col: str, by: list[str] | None = None) -> DataFrame:
    """(stage, row_id, y, score and ``by``): each stage on the rows that reached it."""
    parts = []
    for i in range(len(chain.stages)):
        rows = stage_rows(scored, chain.target, chain.order, i)
        parts.append(rows.select(F.lit(i).alias("stage"), F.col(id_col).alias("row_id"), "y", F.col(f"stage_{i}").alias("score"), *(by or [])))
    return reduce(DataFrame.unionByName, parts)


def _measured(long: DataFrame, placed: DataFrame, group: list[str]) -> DataFrame:
    met = matched(metrics.benchmark_metrics(long, group), metrics.roc_auc(long, group), group)
    return metrics.implausible(matched(met, metrics.pr_auc(placed, group), group))


def evaluate(df: DataFrame, chain: Chain, id_col: str) -> DataFrame:
    """(stage, n, n_positive, base_rate, log_loss, brier, auc, average_precision,
    implausible) of held-out rows, each stage on the rows that reached it, all stages in one
    pass."""
    long = stored(_by_stage(score(df, chain), chain, id_col), "scored-stages")
    return _measured(long, metrics.ordered(long, ["stage"]), ["stage"])


def evaluate_run(df: DataFrame, chain: Chain, id_col: str, tiers: int = metrics.TIERS, override: bool = False, by: list[str] | None = None) -> dict[str, DataFrame]:
    """``metrics``, ``tiers``, ``lift`` (with the interval of its ratio where the bottom
    tier has few positives), ``capture`` and ``cutoffs`` of each stage, or of each stage and
    value of the columns ``by``, all in one pass; and ``scored``, the rows they come from.

    Cutoffs are those of all rows, as a batch to come has no outcome that tells which
    stage a row has reached; all else is of the rows that reached the stage. Raises if a
    stage's AUC is implausible, unless ``override``, and if scores grow along the funnel.
    """
    group = ["stage", *(by or [])]
    scored = stored(score(df, chain), "scored")
    _in_order(scored, chain)
    long = stored(_by_stage(scored, chain, id_col, by), "scored-stages")
    placed = stored(metrics.ordered(long, group), "scored-order")
    found = _measured(long, placed, group)
    if not override:
        bad = found.where("implausible").orderBy(*group).collect()
        if bad:
            raise LeakageError("; ".join(f"{', '.join(f'{c} {r[c]}' for c in group)}: AUC {r['auc']:.4f} at a base rate of {r['base_rate']:.4f}" for r in bad))
    table = stored(metrics.tier_table(placed, tiers, group), "tiers")
    interval = metrics.bootstrap_ratio(table, tiers, group=group)
    everyone = F.explode(F.array(*(F.struct(F.lit(i).alias("stage"), F.col(f"stage_{i}").alias("score")) for i in range(len(chain.stages))))).alias("s")
    all_rows = scored.select(F.col(id_col).alias("row_id"), *(by or []), everyone).select("row_id", *(by or []), "s.stage", "s.score", F.lit(0).alias("y"))
    return {
        "metrics": found,
        "tiers": table,
        "lift": matched(metrics.lift(table, tiers, group), interval, group, "left"),
        "capture": metrics.capture_thresholds(placed, group=group),
        "cutoffs": metrics.tier_cutoffs(metrics.ordered(all_rows, group), tiers, group),
        "scored": long,
    }


def save_bundle(chain: Chain, path: str, spark: SparkSession, extra: dict | None = None, pinned: DataFrame | None = None) -> None:
    """Writes models, level tables, what the pre-flight check pins, and a manifest once; a
    path that exists raises."""
    plain = lambda f: f and {"numeric": f.numeric, "vocab": f.vocab, "floors": f.floors, "coded": f.levels.columns if f.levels else []}
    for i, s in enumerate(chain.stages):
        for name, fitted, features in (("core", s.core, s.core_features), ("rich", s.rich, s.rich_features)):
            if fitted is not None:
                fitted.write().save(f"{path}/stage-{i}-{name}")
            if features and features.levels:
                features.levels.table.write.parquet(f"{path}/stage-{i}-{name}-levels")
    if pinned is not None:
        pinned.write.parquet(f"{path}/pinned")
    manifest = {
        "architecture": chain.architecture, "target": chain.target, "order": chain.order, "extra": extra or {},
        "stages": [{"core": plain(s.core_features), "rich": plain(s.rich_features), "enrichment": s.enrichment} for s in chain.stages],
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str) -> tuple[Chain, dict]:
    """The chain and the manifest's extra values."""
    m = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    stages = []
    for i, s in enumerate(m["stages"]):
        rich = PipelineModel.load(f"{path}/stage-{i}-rich") if s["rich"] else None
        known = lambda name, f, i=i: f and Features(f["numeric"], f["vocab"], f["floors"], _levels(spark, f"{path}/stage-{i}-{name}-levels", f.get("coded", [])))
        stages.append(Stage(PipelineModel.load(f"{path}/stage-{i}-core"), known("core", s["core"]), rich, known("rich", s["rich"]), s["enrichment"]))
    return Chain(m["architecture"], m["target"], m["order"], stages), m["extra"]


def _levels(spark: SparkSession, path: str, columns: list[str]) -> Levels | None:
    return levels.pinned(spark.read.schema(levels.TABLE).parquet(path), columns) if columns else None


def load_pinned(spark: SparkSession, path: str) -> DataFrame:
    """What a bundle's pre-flight check pins."""
    return spark.read.schema(mapping.PINNED).parquet(f"{path}/pinned")


class RefusedBatch(ValueError):
    """A batch that lacks features or holds values that are no numbers."""


def score_batch(df: DataFrame, chain: Chain, id_col: str, cutoffs: list[float], bundle_id: str, pinned: DataFrame | None = None) -> DataFrame:
    """Id, stage probabilities, score, pinned tier, bundle and time.

    With ``pinned`` (``mapping.pins`` of the training table) the batch is checked first, in one
    pass over its counts: errors raise RefusedBatch and nothing is scored; warnings do not."""
    if pinned is not None:
        wanted = batch_features(chain)
        have = [c for c in wanted if c in df.columns]
        counts = profile.value_counts(df, have) if have else df.sparkSession.createDataFrame([], "col string, value string, n long")
        bad = mapping.preflight(counts, wanted, pinned).where("severity = 'error'").orderBy("col", "kind").collect()
        if bad:
            raise RefusedBatch("; ".join(f"{r['col']}: {r['kind']} ({r['n']})" for r in bad))
    scored = score(df, chain)
    names = [f"stage_{i}" for i in range(len(chain.stages))]
    return scored.select(id_col, *names, "score", metrics.assign_tier(F.col("score"), cutoffs).alias("tier"), F.lit(bundle_id).alias("bundle_id"), F.current_timestamp().alias("scored_at"))


def batch_features(chain: Chain) -> dict[str, str]:
    """The features that a batch must have, numeric or categorical."""
    out: dict[str, str] = {}
    for s in chain.stages:
        for f in filter(None, (s.core_features, s.rich_features)):
            out |= {c: "numeric" for c in f.numeric} | {c: "categorical" for c in (*f.vocab, *(f.levels.columns if f.levels else []))}
    return out
