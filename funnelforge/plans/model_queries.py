"""Queries of files, audit tables, enrichment runs and models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from funnelforge.operators import assemble, derive, levels, model, profile
from funnelforge.plans.tables import LEAD_COLUMNS, LEADS_SQL, VC_SQL, leads, table
from funnelforge.session import scratch_path, stored
from funnelforge.sources import audit, enrich, ingest

WIDTH = 4


def _files(spark, sf_dir):
    """Lead files, some of whose rows have a field too many or too few."""
    path = scratch_path(spark, "lead-files")
    rows = leads(spark, sf_dir).withColumn("k", F.col("lead_id").cast("long"))
    row = [F.coalesce(c, F.lit("")) for c in (F.col("lead_id"), F.concat(F.lit('"'), F.col("source"), F.lit('|x"')), F.col("score"))]
    line = F.when(F.col("k") % 50 == 1, F.concat_ws("|", *row)).otherwise(F.concat_ws("|", *row, F.coalesce("disposition", F.lit(""))))
    line = F.when(F.col("k") % 60 == 2, F.concat(line, F.lit("|extra"))).otherwise(line)
    rows.select(line.alias("lead_id|source|score|disposition")).write.option("header", True).option("sep", "\x01").option("quote", "").csv(path)
    return path


def s1_read_delimited(spark, sf_dir):
    return ingest.read_delimited(spark, _files(spark, sf_dir), "|")


def s2_encodings(spark, sf_dir):
    """Files of three encodings, by how many bytes they hold."""
    path = scratch_path(spark, "encodings")
    rows = leads(spark, sf_dir).select(F.col("lead_id").alias("line"))
    for name, head in (("plain", ""), ("bom", "\ufeff"), ("accent", "\u00e9")):
        rows.select(F.concat(F.lit(head), "line").alias("value")).write.text(f"{path}/{name}")
    rows.select(F.concat(F.lit("\u00e9"), "line").alias("value")).write.option("encoding", "ISO-8859-1").csv(f"{path}/latin")
    found = ingest.files(spark, f"{path}/*/part-*").where("bytes > 0")
    return found.groupBy("encoding").agg(F.sum("bytes").alias("bytes"))


def s3_detect_delimiter(spark, sf_dir):
    """Files of each delimiter and of 2 to 4 fields: what is found, and how many lines have it."""
    path = scratch_path(spark, "delimiters")
    rows = leads(spark, sf_dir).select(F.col("lead_id").cast("long").alias("k"), *(F.coalesce(c, F.lit("none")).alias(c) for c in ("lead_id", "source", "score", "disposition")))
    for k, d in enumerate(ingest.DELIMITERS):
        names = ("lead_id", "source", "score", "disposition")[: 4 - k % 3]
        rows.where(F.col("k") % len(ingest.DELIMITERS) == k).select(F.concat_ws(d, *names).alias("value")).write.text(f"{path}/{k}")
    found = ingest.lines(spark, f"{path}/*/part-*")
    sizes = found.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return ingest.detect_delimiter(found).join(sizes, "file").groupBy("delimiter", "n_fields").agg(F.sum("n").alias("n"))


def s4_malformed_rows(spark, sf_dir):
    bad = ingest.malformed_rows(ingest.lines(spark, _files(spark, sf_dir)), "|", WIDTH)
    return bad.select("line", "n_fields")


def s5_same_content(spark, sf_dir):
    """Leads written twice, and odd leads once more: how often contents come, and their bytes."""
    path = scratch_path(spark, "contents")
    rows = leads(spark, sf_dir).select(F.concat_ws("|", "lead_id", "source").alias("value"), F.col("lead_id").cast("long").alias("k"))
    for name, some in (("first", rows), ("second", rows), ("odd", rows.where("k % 2 = 1").withColumn("value", F.concat("value", F.lit("!"))))):
        some.repartition(4, "k").sortWithinPartitions("k").select("value").write.text(f"{path}/{name}")
    found = ingest.files(spark, f"{path}/*/part-*").where("bytes > 0")
    return ingest.same_content(found).join(found.select("hash", "bytes").distinct(), "hash").groupBy("n").agg(F.sum("bytes").alias("bytes"))


def s5_earlier_uploads(spark, sf_dir):
    """An upload of all leads by seven files, and one that brings two of these again under
    other names, and a file of new content: by how many bytes, and whether the catalogue has
    each file once."""
    root = scratch_path(spark, "uploads")
    k = F.col("lead_id").cast("long")
    rows = leads(spark, sf_dir).select(F.concat_ws("|", "lead_id", "source").alias("value"), k.alias("k"))
    for name, some in [(f"one/{i}", rows.where(k % 7 == i)) for i in range(7)] + [(f"two/{i}", rows.where(k % 7 == i)) for i in (2, 5)] + [("two/new", rows.where(k % 7 == 3).withColumn("value", F.concat("value", F.lit("!"))))]:
        some.repartition(1).sortWithinPartitions("k").select("value").write.text(f"{root}/{name}")
    for upload in ("one", "two", "two"):
        again = audit.register_upload(ingest.files(spark, f"{root}/{upload}/*/part-*").where("bytes > 0"), root, upload)
    total = audit.uploads(spark, root).agg(F.count(F.lit(1)).alias("n_catalogued"))
    sizes = audit.uploads(spark, root).select("hash", "bytes").distinct()
    return again.join(sizes, "hash").groupBy("first_upload", "n_earlier").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes")).crossJoin(F.broadcast(total))  # one row


def s1_read_layouts(spark, sf_dir):
    """Files of twelve layouts, by delimiter, order of columns and encoding, read as one table."""
    path = scratch_path(spark, "layouts")
    k = F.col("lead_id").cast("long")
    rows = leads(spark, sf_dir).withColumns({"note": F.concat(F.lit("é "), "lead_id"), **{c: F.coalesce(c, F.lit("")) for c in ("source", "score")}})
    for i, d in enumerate(ingest.DELIMITERS):
        quoted = F.concat(F.lit('"'), "source", F.lit(d + '"'))
        for j, names in enumerate((("lead_id", "source", "note"), ("score", "lead_id", "source"), ("source", "note", "lead_id", "score"))):
            line = F.concat_ws(d, *(quoted if c == "source" else F.col(c) for c in names))
            out = rows.where((k % 4 == i) & (k % 3 == j)).select(line.alias(d.join(names)))
            out.coalesce(1).write.option("header", True).option("sep", "\x01").option("quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("encoding", "ISO-8859-1" if j == 2 else "UTF-8").csv(f"{path}/{i}-{j}")
    return ingest.read_layouts(spark, f"{path}/*/part-*", columns=["lead_id", "source", "score", "note"]).drop("file", "row")


def s6_saved_dataset(spark, sf_dir):
    path = scratch_path(spark, "dataset")
    audit.save_dataset(leads(spark, sf_dir), path)
    return audit.load_dataset(spark, path).select("lead_id", "source", "disposition")


def s7_saved_report(spark, sf_dir):
    """A report written as JSON lines and read back."""
    path = scratch_path(spark, "report")
    audit.save_report(profile.blank_rates(profile.value_counts(leads(spark, sf_dir))), path)
    return spark.read.schema("col string, blank_rate double, nullable boolean").json(path).withColumn("blank_rate", F.round("blank_rate", 6))


def s8_audit_rows(spark, sf_dir):
    """Rows of two jobs appended to one table."""
    path = scratch_path(spark, "audit-rows")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"))
    audit.append(rows.where("id % 2 = 0"), path)
    audit.append(rows.where("id % 2 = 1"), path)
    return spark.read.parquet(path)


def s10_cleaned_lineage(spark, sf_dir):
    """A cleaned dataset beside the raw one that it came from."""
    root = scratch_path(spark, "lineage")
    raw = leads(spark, sf_dir)
    audit.register_dataset(raw.where("phone is not null"), root, "cleaned", audit.register_dataset(raw, root, "raw"))
    found = spark.read.parquet(f"{root}/datasets")
    from_ = found.select(F.col("id").alias("source_id"), F.col("name").alias("raw_name"), F.col("n_rows").alias("raw_rows"))
    return found.join(from_, "source_id").select("name", "raw_name", "raw_rows", "n_rows")


def s9_register_dataset(spark, sf_dir):
    """A raw and a cleaned dataset with the link between them."""
    root = scratch_path(spark, "audit")
    raw = leads(spark, sf_dir)
    first = audit.register_dataset(raw, root, "raw")
    audit.register_dataset(raw.where("disposition is not null"), root, "cleaned", first)
    found = spark.read.parquet(f"{root}/datasets")
    return found.select("name", "n_rows", "fingerprint", F.col("source_id").isNotNull().alias("has_source"))


def s12_exported_csv(spark, sf_dir):
    path = scratch_path(spark, "export")
    audit.export_csv(leads(spark, sf_dir).select("lead_id", "phone", "notes"), path)
    return spark.read.option("header", True).csv(path)


def _audit(spark, sf_dir):
    """Orders, customers and nations as runs, bundles, splits and datasets."""
    t = lambda n: table(spark, sf_dir, n)
    datasets = t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("merchant"), F.lit(0).alias("created_at"))
    splits = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("dataset_id"), F.lit(1).alias("created_at"))
    bundles = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("split_id"), F.lit(2).alias("created_at"))
    runs = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("bundle_id"), F.lit(3).alias("created_at"))
    return datasets, splits, bundles, runs


def j7_run_history(spark, sf_dir):
    return audit.history(*_audit(spark, sf_dir), merchant="ASIA").select("kind", F.col("id").cast("long").alias("id"))


def j8_lineage(spark, sf_dir):
    datasets, splits, bundles, runs = _audit(spark, sf_dir)
    return audit.lineage(runs, bundles, splits, datasets).select("run_id", *(F.col(c).cast("long").alias(c) for c in ("bundle_id", "split_id", "dataset_id")))


def u1_merchants(spark, sf_dir):
    t = lambda n, c: table(spark, sf_dir, n).select(F.col(c).alias("merchant"))
    return audit.merchants([t("customer", "c_mktsegment"), t("nation", "n_name"), t("region", "r_name"), t("orders", "o_orderpriority"), t("part", "p_brand")])


def w10_next_versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return audit.next_versions(o.select(F.col("o_custkey").alias("merchant"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("profile")))


def _stub(rows: pd.DataFrame) -> pd.DataFrame:
    """A bureau that answers by the key, and nothing for some."""
    last = rows["key"].str[-1].astype(int)
    status = last.map(lambda k: "SUCCESS_MATCHED" if k < 4 else "ERROR" if k == 4 else "SUCCESS_NO_HIT")
    return pd.DataFrame({"lead_id": rows["lead_id"], "status": status, "payload_json": "{}"})[(last != 9).to_numpy()]


def v2_enrichment_run(spark, sf_dir):
    adapter = enrich.Adapter("stub", _stub, lambda df: df)
    log = stored(enrich.run_source(leads(spark, sf_dir), adapter, "run1", retries=1), "responses")
    return log.select("lead_id", "status", "attempts")


def v2_run_summary(spark, sf_dir):
    adapter = enrich.Adapter("stub", _stub, lambda df: df)
    return assemble.run_summary(stored(enrich.run_source(leads(spark, sf_dir), adapter, "run1"), "responses"))


def _logged(spark, sf_dir):
    """The folder of a run that was stopped after three of eight slices and taken up again, and
    of a run of another source; and these sources."""
    root = scratch_path(spark, "enrichment")
    digit = lambda name: (lambda df: df.withColumn(name, F.col("payload.digit")))
    sources = enrich.Registry(*(enrich.Adapter(s, _digits, digit(f"{s}_digit"), (f"{s}_digit",), "digit int") for s in ("first", "second")))
    df = leads(spark, sf_dir)
    enrich.resume(df, sources["first"], root, "run1", retries=0, slices=8, most=3)
    enrich.resume(df, sources["first"], root, "run1", retries=0, slices=8)
    enrich.run_enrichment(df, [sources["second"]], root, retries=0, slices=2)
    return root, sources


def _digits(rows: pd.DataFrame) -> pd.DataFrame:
    """The stub's answers, with the key's last digit as the payload."""
    return _stub(rows).assign(payload_json=[f'{{"digit": {k[-1]}}}' for k in rows["key"] if k[-1] != "9"])


def v2_resumed_run(spark, sf_dir):
    """Each lead's answer of a run that was taken up again, and how many final ones it has."""
    root, _ = _logged(spark, sf_dir)
    log = enrich.response_log(spark, root).where("source = 'first'")
    n = log.where(F.col("status").isin(*enrich.FINAL)).groupBy("lead_id").agg(F.count(F.lit(1)).alias("n_final"))
    return enrich.final_responses(log).join(n, "lead_id", "left").select("lead_id", "status", F.coalesce("n_final", F.lit(0)).alias("n_final"))


def v2_assembled_runs(spark, sf_dir):
    """Leads with what the last runs of two sources have of them."""
    root, sources = _logged(spark, sf_dir)
    found = enrich.assembled(leads(spark, sf_dir).select("lead_id"), root, sources)
    timed = F.col("first_fetched_at").isNotNull() & F.col("second_fetched_at").isNotNull()
    return found.select("lead_id", "first_match_status", "first_digit", "first_is_enriched", "second_match_status", "second_digit", "second_is_enriched", timed.alias("timed"))


def v2_run_checks(spark, sf_dir):
    """A run of each source and one more of the first: whether the log agrees with their rows."""
    root, sources = _logged(spark, sf_dir)
    enrich.resume(leads(spark, sf_dir), sources["first"], root, "run2", retries=0, slices=4)
    checked = assemble.batch_invariants(enrich.runs(spark, root), enrich.final_responses(enrich.response_log(spark, root)))
    return checked.select("run_id", "n_repeated", "counts_agree", (F.col("spread_seconds") >= 0).alias("in_order"))


def v2_timing_leaks(spark, sf_dir):
    """Responses of the last runs fetched after an outcome of long ago; others lie far ahead."""
    root, _ = _logged(spark, sf_dir)
    k = F.col("lead_id").cast("long")
    outcomes = leads(spark, sf_dir).where(k % 3 > 0).select("lead_id", F.when(k % 3 == 1, F.lit("2001-01-01")).otherwise("2901-01-01").cast("timestamp").alias("outcome_at"))
    return enrich.timing_leaks(root, outcomes).select("source", "lead_id")


FUNNEL = ["O", "P", "F"]
NUMERIC, CATEGORICAL, RICH = ["age", "rich_score"], ["priority"], ["rich_score"]


def _frame(spark, sf_dir):
    """Orders with a core number, a category, and a score that half of them have."""
    o = table(spark, sf_dir, "orders")
    level = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    rich = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") / 1000 + level * 40)
    age = F.datediff(F.lit("2000-01-01"), F.col("o_orderdate")).cast("double") + level * 200
    return o.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("disposition"), age.alias("age"), F.col("o_orderpriority").alias("priority"), rich.alias("rich_score"))


def _sides(spark, sf_dir):
    df = _frame(spark, sf_dir)
    return df.where("row_id % 5 <> 0"), df.where("row_id % 5 = 0")


def _chain(spark, sf_dir, architecture="unified"):
    train, test = _sides(spark, sf_dir)
    return model.train(train, "disposition", FUNNEL, NUMERIC, CATEGORICAL, RICH, architecture, trees=3, depth=3), test


def m1_encode(spark, sf_dir):
    f = model.Features(["rich_score"], {"priority": ["1-URGENT", "2-HIGH", "5-LOW"]}, {"rich_score": -1.0})
    return model.encode(model.project(_frame(spark, sf_dir), f, ["row_id"]), f).select("row_id", F.round("rich_score__value", 6).alias("rich_score__value"), "rich_score__missing", "priority__index")


def p6_project(spark, sf_dir):
    f = model.Features(["age"], {"priority": ["1-URGENT", "5-LOW"]})
    return model.project(_frame(spark, sf_dir), f, ["row_id"])


def m5_blend(spark, sf_dir):
    df = _frame(spark, sf_dir)
    a, b = (F.col("row_id") % 100) / 100, (F.col("row_id") % 7) / 7
    return df.select("row_id", F.round(model.blend(assemble.any_known(RICH), a, b), 6).alias("p"))


def m7_ordinal_violations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return model.ordinal_violations(o.select(((F.col("o_orderkey") % 100) / 90).alias("a"), ((F.col("o_orderkey") % 13) / 12).alias("b")), ["a", "b"])


def _by_customer(spark, sf_dir):
    """Orders that are finished or not, with their customer as a category of many levels."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").cast("string").alias("customer"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


def m1_target_statistics(spark, sf_dir):
    """The rate of each customer with ten orders or more, and of the others as one."""
    found = levels.statistics(_by_customer(spark, sf_dir), ["customer"], levels.fold_of(F.col("row_id")), least=10)
    return found.select("col", "level", "n", F.round("code", 6).alias("code"), *(F.round(F.col("outs")[k], 6).alias(f"out_{k}") for k in range(levels.FOLDS)))


def m1_out_of_fold(spark, sf_dir):
    """Each order's rate of its customer's orders in other folds, as a model trains on it."""
    rows = _by_customer(spark, sf_dir)
    return levels.fit_levels(rows, ["customer"], "row_id", least=10).coded(rows, levels.fold_of(F.col("row_id"))).select("row_id", F.round("customer__rate", 6).alias("rate"))


def m9_top_features(spark, sf_dir):
    """Which feature tells even keys from odd ones, when it is permuted; age does not."""
    found = model.provenance_features(_frame(spark, sf_dir), "row_id", F.col("row_id") % 2 == 0, ["age", "rich_score"], trees=3)
    return found.select("rank", "feature", (F.col("auc_lost") > 0.2).alias("tells"), "fails")


def m2_fit_stage(spark, sf_dir):
    """The model of one stage: held-out rows, probabilities among them, and whether rows that
    went further have the higher mean."""
    train, test = _sides(spark, sf_dir)
    rows = derive.stage_rows(train, "disposition", FUNNEL, 0)
    features = model.pin(rows, NUMERIC, CATEGORICAL)
    held = model.probability(derive.stage_rows(test, "disposition", FUNNEL, 0), model.fit_stage(rows, features, 3, 3), features, "p")
    mean = lambda y: F.avg(F.when(F.col("y") == y, F.col("p")))
    return held.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("p").between(0, 1), 1)).alias("n_probability"), (mean(1) > mean(0)).alias("tells_apart"))


def m6_chained_scores(spark, sf_dir):
    """Whether each score is the product of its stages' probabilities: rows, and those that hold."""
    chain, test = _chain(spark, sf_dir)
    p = [F.col("stage_0"), F.col("stage_1")]
    good = (F.abs(F.col("score") - p[0] * p[1]) < 1e-12) & p[0].between(0, 1) & p[1].between(0, 1)
    return model.score(test, chain).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(good, 1)).alias("n_product"))


def m10_train_run(spark, sf_dir):
    """The gates and warnings of a run in which the rich score tells the batches apart."""
    train, _ = _sides(spark, sf_dir)
    formulas = {"age": F.coalesce(F.col("age") <= F.col("age") + 1, F.lit(True)), "rich": F.col("rich_score").isNotNull()}
    done = model.train_run(train, "disposition", FUNNEL, NUMERIC, CATEGORICAL, RICH, "unified", 3, 3, formulas=formulas, source_col="priority", id_col="row_id", batch=F.col("row_id") % 2 == 0)
    rows = [("gate", g.name, str(g.passed).lower()) for g in done.gates] + [("null_rate", c, f"{r:.6f}") for c, r in done.null_rates.items()]
    return spark.createDataFrame(rows, "kind string, name string, value string")


def m11_evaluate_run(spark, sf_dir):
    """Rows and positives of each stage and tier on held-out rows."""
    chain, test = _chain(spark, sf_dir)
    found = model.evaluate_run(test, chain, "row_id", override=True)
    totals = found["tiers"].groupBy("stage").agg(F.sum("n").alias("n"), F.sum("n_positive").alias("n_positive"), F.count(F.lit(1)).alias("n_tiers"))
    cuts = found["cutoffs"].groupBy("stage").agg(F.count(F.lit(1)).alias("n_cutoffs"))
    return totals.join(cuts, "stage").join(found["capture"].groupBy("stage").agg(F.count(F.lit(1)).alias("n_shares")), "stage").select(F.col("stage").cast("long").alias("stage"), "n", "n_positive", "n_tiers", "n_cutoffs", "n_shares")


def m14_saved_run(spark, sf_dir):
    """A scored batch that is persisted with an audit row of the run."""
    chain, test = _chain(spark, sf_dir, "baseline")
    root = scratch_path(spark, "predictions")
    audit.save_predictions(model.score_batch(test, chain, "row_id", [0.5], "b7"), root, "b7", "held-out")
    runs = spark.read.parquet(f"{root}/runs")
    rows = spark.read.parquet(f"{root}/predictions/*").agg(F.count(F.lit(1)).alias("n_scored"), F.countDistinct("row_id").alias("n_ids"))
    return runs.select("bundle_id", "batch", "n_rows").crossJoin(F.broadcast(rows))  # one row


def m12_bundle(spark, sf_dir):
    """A bundle that is saved and loaded scores every row as the chain itself."""
    chain, test = _chain(spark, sf_dir, "dual")
    path = scratch_path(spark, "bundle")
    model.save_bundle(chain, path, spark, {"note": "kept"})
    loaded, extra = model.load_bundle(spark, path)
    a = model.score(test, chain).select("row_id", F.col("score").alias("a"))
    b = model.score(test, loaded).select("row_id", F.col("score").alias("b"))
    return a.join(b, "row_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("n_equal")).withColumn("note", F.lit(extra["note"]))


def m8_feature_gains(spark, sf_dir):
    """The features by kind, and whether their shares are shares and make up 100 %."""
    chain, _ = _chain(spark, sf_dir)
    found = model.gains(spark, chain.stages[0])
    whole = found.agg(F.abs(F.sum("gain_pct") - 100) < 0.01).first()[0]
    return found.select("feature", "kind", (F.col("gain_pct").between(0, 100) & F.lit(bool(whole))).alias("is_share"))


def m9_provenance(spark, sf_dir):
    """Age tells nothing of a batch of even keys; the rich score, which only these have, does."""
    df, batch = _frame(spark, sf_dir), F.col("row_id") % 2 == 0
    found = [model.provenance(df, "row_id", batch, [c], trees=3).select(F.lit(c).alias("feature"), "fails") for c in ("age", "rich_score")]
    return found[0].unionByName(found[1])


def _measured(architecture):
    def run(spark, sf_dir):
        """Each stage's held-out rows, and whether its model ranks and predicts better than the base rate."""
        chain, test = _chain(spark, sf_dir, architecture)
        found = model.evaluate(test, chain, "row_id")
        flat = F.col("base_rate") * (1 - F.col("base_rate"))
        return found.select(F.col("stage").cast("long").alias("stage"), "n", "n_positive", F.round("base_rate", 6).alias("base_rate"), F.col("auc").between(0.5, 1).alias("ranks"), (F.col("brier") < flat).alias("predicts"))

    return run


def m3_baseline(spark, sf_dir):
    return _measured("baseline")(spark, sf_dir)


def m4_unified(spark, sf_dir):
    return _measured("unified")(spark, sf_dir)


def m5_dual_route(spark, sf_dir):
    return _measured("dual")(spark, sf_dir)


def m14_score_batch(spark, sf_dir):
    """Trains, saves and loads a bundle, and scores the held-out rows with it."""
    chain, test = _chain(spark, sf_dir)
    path = scratch_path(spark, "bundle")
    model.save_bundle(chain, path, spark, {"cutoffs": [0.5, 0.25, 0.1]})
    loaded, extra = model.load_bundle(spark, path)
    found = model.score_batch(test, loaded, "row_id", extra["cutoffs"], "b1")
    tier = F.when(F.col("score") >= 0.5, 1).when(F.col("score") >= 0.25, 2).when(F.col("score") >= 0.1, 3).otherwise(4)
    return found.select("row_id", (F.col("tier") == tier).alias("tier_fits"), (F.abs(F.col("score") - F.col("stage_0") * F.col("stage_1")) < 1e-12).alias("score_fits"), "bundle_id")


def v4_similarity(spark, sf_dir):
    """How alike a part's name is to itself with a letter more, and to a text of other letters."""
    name = F.col("p_name")
    more = profile.similarity(name, F.concat(name, F.lit("#")))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.round(more, 6).alias("longer"), profile.similarity(name, F.repeat(F.lit("#"), 5)).alias("other"))
    return parts


QUERIES = [
    s1_read_delimited, s2_encodings, s3_detect_delimiter, s4_malformed_rows, s1_read_layouts, s5_same_content, s5_earlier_uploads, s6_saved_dataset, s7_saved_report, s8_audit_rows,
    s9_register_dataset, s10_cleaned_lineage, s12_exported_csv,
    j7_run_history, j8_lineage, u1_merchants, w10_next_versions, v2_enrichment_run, v2_run_summary, v2_resumed_run, v2_assembled_runs, v2_run_checks, v2_timing_leaks, m1_encode, m1_target_statistics, m1_out_of_fold, m9_top_features, p6_project, m5_blend, m7_ordinal_violations,
    m2_fit_stage, m6_chained_scores, m8_feature_gains, m9_provenance, m3_baseline, m4_unified, m5_dual_route, m10_train_run, m11_evaluate_run, m12_bundle, m14_score_batch, m14_saved_run,
    v4_similarity,
]

_FOLD = "CAST('0x' || substr(md5(CAST(row_id AS VARCHAR)), 1, 6) AS BIGINT) % 5"
_LEVELS = f"""WITH r AS (SELECT o_orderkey AS row_id, CAST(o_custkey AS VARCHAR) AS customer, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders), f AS (SELECT *, {_FOLD} AS fold FROM r),
  k AS (SELECT customer FROM r GROUP BY 1 HAVING count(*) >= 10), l AS (SELECT *, CASE WHEN customer IN (SELECT customer FROM k) THEN customer ELSE '__RARE__' END AS level FROM f)"""
_RATE = lambda n, p, all_n, all_p: f"({p} + 20.0 * {all_p} / {all_n}) / ({n} + 20.0)"
_OUT = lambda k: _RATE(f"count(*) FILTER (fold <> {k})", f"coalesce(sum(y) FILTER (fold <> {k}), 0)", f"(SELECT count(*) FROM l WHERE fold <> {k})", f"(SELECT sum(y) FROM l WHERE fold <> {k})")

_NA = "(" + ", ".join(f"'{w}'" for w in ingest.NA_WORDS) + ")"
_ROW = "coalesce(lead_id, '') || '|\"' || coalesce(source, '') || '|x\"|' || coalesce(score, '')"
_LINE = f"{_ROW} || CASE WHEN CAST(lead_id AS BIGINT) % 50 <> 1 THEN '|' || coalesce(disposition, '') ELSE '' END || CASE WHEN CAST(lead_id AS BIGINT) % 60 = 2 THEN '|extra' ELSE '' END"
_LONG = "CAST(lead_id AS BIGINT) % 60 = 2 AND CAST(lead_id AS BIGINT) % 50 <> 1"
_STATUS = "CASE WHEN p IS NULL THEN 'NOT_SENT' WHEN CAST(right(p, 1) AS INTEGER) < 4 THEN 'SUCCESS_MATCHED' WHEN CAST(right(p, 1) AS INTEGER) IN (4, 9) THEN 'ERROR' ELSE 'SUCCESS_NO_HIT' END"
_PHONES = LEADS_SQL + r""", d AS (SELECT lead_id, regexp_replace(regexp_replace(trim(phone), '[.]0$', ''), '[^0-9]', '', 'g') AS d FROM leads), k AS (SELECT lead_id, CASE WHEN length(d) >= 10 THEN right(d, 10) END AS p FROM d)"""
_FRAME = """WITH f AS (SELECT o_orderkey AS row_id, o_orderpriority AS priority, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 1000 + 40 * CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END END AS rich_score,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') + 200 * CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS DOUBLE) AS age FROM orders)"""

SQL = {
    "s1_read_delimited": LEADS_SQL + f""", r AS (SELECT lead_id, source || '|x' AS source, score, CASE WHEN CAST(lead_id AS BIGINT) % 50 = 1 THEN CASE WHEN CAST(lead_id AS BIGINT) % 60 = 2 THEN 'extra' END ELSE disposition END AS disposition FROM leads WHERE NOT ({_LONG}))
      SELECT lead_id, source, CASE WHEN score NOT IN {_NA} THEN score END AS score, CASE WHEN disposition NOT IN {_NA} THEN disposition END AS disposition FROM r""",
    "s2_encodings": LEADS_SQL + """, b AS (SELECT CAST(count(*) AS BIGINT) AS k, CAST(sum(octet_length(encode(lead_id)) + 1) AS BIGINT) AS n FROM leads)
      SELECT 'utf-8' AS encoding, 2 * n + 2 * k AS bytes FROM b UNION ALL SELECT 'utf-8-sig', n + 3 * k FROM b UNION ALL SELECT 'latin-1', n + k FROM b""",
    "s3_detect_delimiter": LEADS_SQL + """ SELECT CASE k WHEN 0 THEN ',' WHEN 1 THEN '|' WHEN 2 THEN chr(9) ELSE ';' END AS delimiter, CAST(4 - k % 3 AS BIGINT) AS n_fields, count(*) AS n FROM (SELECT CAST(lead_id AS BIGINT) % 4 AS k FROM leads) GROUP BY k""",
    "s4_malformed_rows": LEADS_SQL + f", l AS (SELECT {_LINE} AS line, CAST(4 + CAST(CAST(lead_id AS BIGINT) % 60 = 2 AS INTEGER) - CAST(CAST(lead_id AS BIGINT) % 50 = 1 AS INTEGER) AS BIGINT) AS n_fields FROM leads) SELECT * FROM l WHERE n_fields <> 4",
    "s5_same_content": LEADS_SQL + " SELECT CAST(2 AS BIGINT) AS n, CAST(sum(octet_length(encode(lead_id || '|' || source)) + 1) AS BIGINT) AS bytes FROM leads",
    "s5_earlier_uploads": LEADS_SQL + " SELECT 'one' AS first_upload, CAST(1 AS BIGINT) AS n_earlier, CAST(2 AS BIGINT) AS n_files, CAST(sum(octet_length(encode(lead_id || '|' || source)) + 1) AS BIGINT) AS bytes, CAST(10 AS BIGINT) AS n_catalogued FROM leads WHERE CAST(lead_id AS BIGINT) % 7 IN (2, 5)",
    "s1_read_layouts": LEADS_SQL + f""", r AS (SELECT *, CAST(lead_id AS BIGINT) AS k, CASE CAST(lead_id AS BIGINT) % 4 WHEN 0 THEN ',' WHEN 1 THEN '|' WHEN 2 THEN chr(9) ELSE ';' END AS d FROM leads)
      SELECT lead_id, source || d AS source, CASE WHEN k % 3 <> 0 AND score NOT IN {_NA} THEN score END AS score, CASE WHEN k % 3 <> 1 THEN 'é ' || lead_id END AS note FROM r""",
    "s6_saved_dataset": LEADS_SQL + " SELECT lead_id, source, disposition FROM leads",
    "s9_register_dataset": LEADS_SQL + ", h AS (SELECT disposition, CAST('0x' || substr(md5(concat_ws(chr(31), " + ", ".join(f"coalesce({c}, chr(0))" for c in LEAD_COLUMNS) + """)), 1, 15) AS HUGEINT) AS h FROM leads)
      SELECT 'raw' AS name, count(*) AS n_rows, CAST(sum(h) AS VARCHAR) AS fingerprint, FALSE AS has_source FROM h UNION ALL SELECT 'cleaned', count(*), CAST(sum(h) AS VARCHAR), TRUE FROM h WHERE disposition IS NOT NULL""",
    "s7_saved_report": VC_SQL + r" SELECT col, round(sum(CASE WHEN value IS NULL OR regexp_full_match(value, '\s*') THEN n ELSE 0 END) / sum(n), 6) AS blank_rate, bool_or(value IS NULL OR regexp_full_match(value, '\s*')) AS nullable FROM vc GROUP BY 1",
    "s8_audit_rows": "SELECT c_custkey AS id, c_mktsegment AS name FROM customer",
    "s10_cleaned_lineage": LEADS_SQL + " SELECT 'cleaned' AS name, 'raw' AS raw_name, count(*) AS raw_rows, count(phone) AS n_rows FROM leads",
    "s12_exported_csv": LEADS_SQL + " SELECT lead_id, phone, notes FROM leads",
    "j7_run_history": """WITH s AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'), b AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM s))
      SELECT 'dataset' AS kind, CAST(r_regionkey AS BIGINT) AS id FROM region WHERE r_name = 'ASIA' UNION ALL SELECT 'split', n_nationkey FROM s UNION ALL SELECT 'bundle', c_custkey FROM b UNION ALL SELECT 'run', o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM b)""",
    "j8_lineage": "SELECT o_orderkey AS run_id, o_custkey AS bundle_id, CAST(c_nationkey AS BIGINT) AS split_id, CAST(n_regionkey AS BIGINT) AS dataset_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "u1_merchants": "SELECT c_mktsegment AS merchant FROM customer UNION SELECT n_name FROM nation UNION SELECT r_name FROM region UNION SELECT o_orderpriority FROM orders UNION SELECT p_brand FROM part",
    "w10_next_versions": "SELECT o_custkey AS merchant, max(o_orderkey) + 1 AS next_version, arg_max(o_orderpriority, o_orderkey) AS profile FROM orders GROUP BY 1",
    "v2_enrichment_run": _PHONES + f" SELECT lead_id, {_STATUS} AS status, CAST(CASE WHEN p IS NULL THEN 0 WHEN {_STATUS} = 'ERROR' THEN 2 ELSE 1 END AS INTEGER) AS attempts FROM k",
    "v2_run_summary": _PHONES + f", s AS (SELECT {_STATUS} AS s FROM k) SELECT 'run1' AS run_id, count(*) AS rows_attempted, count(*) FILTER (s = 'SUCCESS_MATCHED') AS matched, count(*) FILTER (s = 'SUCCESS_NO_HIT') AS no_hit, count(*) FILTER (s = 'ERROR') AS error, count(*) FILTER (s = 'NOT_SENT') AS not_sent FROM s",
    "v2_resumed_run": _PHONES + f" SELECT lead_id, {_STATUS} AS status, CAST({_STATUS} <> 'ERROR' AS BIGINT) AS n_final FROM k",
    "v2_assembled_runs": _PHONES + f", a AS (SELECT lead_id, {_STATUS} AS s, CASE WHEN {_STATUS} = 'SUCCESS_MATCHED' THEN CAST(right(p, 1) AS INTEGER) END AS d FROM k)"
    " SELECT lead_id, s AS first_match_status, d AS first_digit, d IS NOT NULL AS first_is_enriched, s AS second_match_status, d AS second_digit, d IS NOT NULL AS second_is_enriched, TRUE AS timed FROM a",
    "v2_run_checks": "SELECT unnest(['run1', 'run2']) AS run_id, CAST(0 AS BIGINT) AS n_repeated, count(*) > 0 AS counts_agree, TRUE AS in_order FROM customer",
    "v2_timing_leaks": LEADS_SQL + " SELECT unnest(['first', 'second']) AS source, lead_id FROM leads WHERE CAST(lead_id AS BIGINT) % 3 = 1",
    "m1_encode": _FRAME + " SELECT row_id, round(coalesce(rich_score, -1), 6) AS rich_score__value, CAST(rich_score IS NULL AS DOUBLE) AS rich_score__missing, CASE priority WHEN '1-URGENT' THEN 0.0::DOUBLE WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 2 ELSE 3 END AS priority__index FROM f",
    "m1_target_statistics": _LEVELS + f" SELECT 'customer' AS col, level, count(*) AS n, round(CAST({_RATE('count(*)', 'sum(y)', '(SELECT count(*) FROM l)', '(SELECT sum(y) FROM l)')} AS DOUBLE), 6) AS code, "
    + ", ".join(f"round(CAST({_OUT(k)} AS DOUBLE), 6) AS out_{k}" for k in range(5)) + " FROM l GROUP BY level",
    "m1_out_of_fold": _LEVELS + ", c AS (SELECT level, [" + ", ".join(f"CAST({_OUT(k)} AS DOUBLE)" for k in range(5)) + "] AS outs FROM l GROUP BY level) SELECT row_id, round(outs[fold + 1], 6) AS rate FROM l JOIN c USING (level)",
    "m9_top_features": "SELECT CAST(k AS INTEGER) AS rank, CASE k WHEN 1 THEN 'rich_score' ELSE 'age' END AS feature, k = 1 AS tells, TRUE AS fails FROM range(1, 3) AS q(k)",
    "p6_project": _FRAME + " SELECT row_id, age, CASE WHEN priority IN ('1-URGENT', '5-LOW') THEN priority END AS priority FROM f",
    "m5_blend": "SELECT o_orderkey AS row_id, round(CASE WHEN o_orderkey % 2 = 0 THEN 0.65 * (o_orderkey % 100 / 100) + 0.35 * (o_orderkey % 7 / 7) ELSE o_orderkey % 7 / 7 END, 6) AS p FROM orders",
    "m7_ordinal_violations": "SELECT count(*) FILTER (o_orderkey % 100 / 90 > 1 OR (o_orderkey % 100 / 90) * (o_orderkey % 13 / 12) > 1) AS n FROM orders",
    "v4_similarity": "SELECT p_partkey, round(2.0 * length(p_name) / (2 * length(p_name) + 1), 6) AS longer, CAST(0 AS DOUBLE) AS other FROM part",
    "m2_fit_stage": "SELECT count(*) AS n, count(*) AS n_probability, TRUE AS tells_apart FROM orders WHERE o_orderkey % 5 = 0",
    "m14_saved_run": "SELECT 'b7' AS bundle_id, 'held-out' AS batch, count(*) AS n_rows, count(*) AS n_scored, count(DISTINCT o_orderkey) AS n_ids FROM orders WHERE o_orderkey % 5 = 0",
    "m6_chained_scores": "SELECT count(*) AS n, count(*) AS n_product FROM orders WHERE o_orderkey % 5 = 0",
    "m10_train_run": """WITH t AS (SELECT * FROM orders WHERE o_orderkey % 5 <> 0), r AS (SELECT o_orderpriority AS p, avg(CAST(o_orderkey % 2 = 0 AS INTEGER)) AS h FROM t GROUP BY 1)
      SELECT 'gate' AS kind, 'target_leakage' AS name, 'true' AS value UNION ALL SELECT 'gate', 'post_event_features', 'true' UNION ALL SELECT 'gate', 'formula:age', 'true'
      UNION ALL SELECT 'gate', 'formula:rich', CASE WHEN min(h) >= 0.95 THEN 'true' ELSE 'false' END FROM r UNION ALL SELECT 'gate', 'provenance', 'false'
      UNION ALL SELECT 'null_rate', 'age', '0.000000' UNION ALL SELECT 'null_rate', 'priority', '0.000000' UNION ALL SELECT 'null_rate', 'rich_score', printf('%.6f', avg(CAST(o_orderkey % 2 <> 0 AS INTEGER))) FROM t""",
    "m11_evaluate_run": """WITH l AS (SELECT CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS k FROM orders WHERE o_orderkey % 5 = 0)
      SELECT CAST(s AS BIGINT) AS stage, count(*) AS n, count(*) FILTER (k > s) AS n_positive, CAST(10 AS BIGINT) AS n_tiers, CAST(9 AS BIGINT) AS n_cutoffs, CAST(4 AS BIGINT) AS n_shares FROM l, range(0, 2) AS q(s) WHERE k >= s GROUP BY s""",
    **{
        name: """WITH l AS (SELECT CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS k FROM orders WHERE o_orderkey % 5 = 0)
      SELECT CAST(s AS BIGINT) AS stage, count(*) AS n, count(*) FILTER (k > s) AS n_positive, round(avg(CAST(k > s AS INTEGER)), 6) AS base_rate, TRUE AS ranks, TRUE AS predicts FROM l, range(0, 2) AS q(s) WHERE k >= s GROUP BY s"""
        for name in ("m3_baseline", "m4_unified", "m5_dual_route")
    },
    "m8_feature_gains": "SELECT 'age' AS feature, 'core' AS kind, TRUE AS is_share UNION ALL SELECT 'priority', 'core', TRUE UNION ALL SELECT 'rich_score', 'enrichment', TRUE",
    "m9_provenance": "SELECT 'age' AS feature, FALSE AS fails UNION ALL SELECT 'rich_score', TRUE",
    "m12_bundle": "SELECT count(*) AS n, count(*) AS n_equal, 'kept' AS note FROM orders WHERE o_orderkey % 5 = 0",
    "m14_score_batch": "SELECT o_orderkey AS row_id, TRUE AS tier_fits, TRUE AS score_fits, 'b1' AS bundle_id FROM orders WHERE o_orderkey % 5 = 0",
}
