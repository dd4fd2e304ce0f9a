import os

import pytest

from tidemark.plans.declaration import Declaration, PlanError
from tidemark.sources import files, registry


def test_found_files_and_their_manifest(spark, tmp_path):
    root = tmp_path / "root"
    for name in ("a.csv", "x/a.csv", "x/y/a.csv", "x/y/b.csv", "x/y/b.txt", "z/a.csv"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"k,t,v\n{name},2024-01-01,1\n")
    names = lambda text: [p.split("/root/", 1)[1] for p in files.found(spark, str(root), text)]
    assert names("**/*.csv") == ["a.csv", "x/a.csv", "x/y/a.csv", "x/y/b.csv", "z/a.csv"]
    assert names("*.csv") == names("?.csv") == ["a.csv"]
    assert names("x/*/?.csv") == ["x/y/a.csv", "x/y/b.csv"]
    assert names("*/a.csv") == ["x/a.csv", "z/a.csv"]
    assert names("x/y/b.txt") == ["x/y/b.txt"]
    assert names("x/**") == ["x/a.csv", "x/y/a.csv", "x/y/b.csv", "x/y/b.txt"]
    for bad in ("none/*.csv", "x/*.txt"):
        with pytest.raises(PlanError, match="SOURCE"):
            files.found(spark, str(root), bad)
    with pytest.raises(ValueError):
        files.found(spark, str(root), "../*.csv")
    assert sorted(r["name"] for r in files.manifest(spark, str(root / "x")).collect()) == ["a.csv", "y/a.csv", "y/b.csv", "y/b.txt"]
    d = Declaration("d", "k", "t", kind="csv", locator="x/**/*.csv")
    assert sorted(r["k"] for r in registry.point(registry.Registry(str(root)), spark, d, "2024-01-02", ["k"]).collect()) == ["x/a.csv", "x/y/a.csv", "x/y/b.csv"]
    (tmp_path / "out.csv").write_text("k\n1\n")
    os.symlink(tmp_path / "out.csv", root / "x" / "link.csv")
    with pytest.raises(PlanError, match="out of its root"):
        files.found(spark, str(root), "x/*.csv")
    assert names("z/*.csv") == ["z/a.csv"]


def test_interrupted_snapshot_is_none(spark, tmp_path):
    df, store = spark.range(10), str(tmp_path / "store")
    digest = registry.rows_digest(df)
    df.limit(3).write.parquet(f"{store}/_{digest}-left-behind")
    assert registry.save_snapshot(df, store) == registry.save_snapshot(df, store) == digest
    assert registry.load_snapshot(spark, store, digest).count() == 10
    assert sorted(os.listdir(store)) == sorted([digest, f"_{digest}-left-behind"])
