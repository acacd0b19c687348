"""Files of many layouts, and uploads that bring the same bytes again."""

import csv
import random

from pyspark.sql import functions as F

from funnelforge.plans import model_queries
from funnelforge.session import scratch_path
from funnelforge.sources import audit, ingest


def test_a_thousand_layouts_are_one_scan(spark, tmp_path):
    rng, want = random.Random(6), []
    names = [f"c{k}" for k in range(12)]
    for i in range(1000):
        own, d = rng.sample(names, rng.randrange(2, 6)), ",|\t;"[i % 4]
        with open(tmp_path / f"f{i}.csv", "w", newline="") as f:
            w = csv.writer(f, delimiter=d, lineterminator="\n")
            w.writerow(own)
            for _ in range(3):
                row = {c: rng.choice(["x", f"v{i}", f"a{d}b", 'say "no"', "", "NA"]) for c in own}
                w.writerow(row.values())
                if any(row.values()) or d != "\t":  # tabs alone are a blank line
                    want.append(sorted((c, None if v in ("", "NA") else v) for c, v in row.items()))
    found = ingest.read_layouts(spark, f"file://{tmp_path}")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and "Union" not in plan  # the lines, and the stored layouts
    got = [sorted(r["cells"].items()) for r in found.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 2900


def test_layouts_edges(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfn, town\r\n1,Ulm\r\n2,Bonn,extra\r\n3\r\n\r\n,\r\n")
    (tmp_path / "b.txt").write_bytes("town|n|n\nLiège|7|8\n\"a|b\"|x|y\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b"only;names\n")
    rows = ingest.read_layouts(spark, f"file://{tmp_path}", columns=["n", "town", "gone"])
    assert sorted((r["n"] or "", r["town"] or "", r["gone"]) for r in rows.collect()) == [("", "", None), ("1", "Ulm", None), ("3", "", None), ("8", "Liège", None), ("y", "a|b", None)]
    kept = ingest.read_layouts(spark, f"file://{tmp_path}/b.txt", na_words=None).select("cells").collect()
    assert {r["cells"]["town"] for r in kept} == {"Liège", "a|b"}


def test_uploads_that_come_again(spark, tmp_path):
    root = scratch_path(spark, "uploads-test")
    for name, data in {"u1/a": b"1", "u1/b": b"2", "u1/c": b"1", "u2/d": b"2", "u2/e": b"3", "u3/f": b"2"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    seen = {}
    for u in ("u1", "u2", "u2", "u3"):
        found = audit.register_upload(ingest.files(spark, f"file://{tmp_path}/{u}"), root, u)
        seen[u] = [(r["path"][-4:], r["n_earlier"], r["first_upload"], r["first_path"][-4:]) for r in found.collect()]
    assert seen == {"u1": [], "u2": [("u2/d", 1, "u1", "u1/b")], "u3": [("u3/f", 2, "u1", "u1/b")]}
    assert audit.uploads(spark, root).count() == 6
    key = audit.register_dataset(spark.range(3).select(F.col("id").cast("string").alias("x")), root, "d", content_hash="abc")
    assert spark.read.parquet(f"{root}/datasets").where(F.col("id") == key).first()["content_hash"] == "abc"


def test_a_file_of_new_content_is_no_earlier_one(spark, sf_dir):
    found = model_queries.s5_earlier_uploads(spark, sf_dir).collect()
    assert [(r["first_upload"], r["n_earlier"], r["n_files"], r["n_catalogued"]) for r in found] == [("one", 1, 2, 10)]
