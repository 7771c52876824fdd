"""Tables published together: a job that dies half way leaves the old version readable."""

import os

import pytest

from funnelkit.plans.cleaning import run_cleaning
from funnelkit.sources import files, versions
from tests.conftest import rows
from tests.test_jobs import RAW_ORDER_ROWS, _raw_files, _write


def _orders(spark, base):
    t = files.read_tables(spark, versions.published(spark, base), fmt="parquet", raw=False)
    return sorted(rows(t["orders"], "order_id"))


def test_publication_is_all_or_nothing(spark, tmp_path, monkeypatch):
    paths, base = _raw_files(tmp_path), str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        versions.published(spark, base)
    run_cleaning(spark, paths, base, versioned=True)
    first = _orders(spark, base)
    assert first == [(1,), (3,), (4,)]
    _write(paths["orders"], RAW_ORDER_ROWS + ["8,1,10,5,Visited,2024-01-09 10:00:00"])
    write = files.write_table

    def dies(df, path, *args, **kwargs):
        if path.endswith("cleaned_orders"):
            raise OSError("lost")
        write(df, path, *args, **kwargs)
    monkeypatch.setattr(files, "write_table", dies)
    with pytest.raises(OSError):
        run_cleaning(spark, paths, base, versioned=True)
    monkeypatch.undo()
    assert _orders(spark, base) == first          # half a version was written, none is seen
    run_cleaning(spark, paths, base, versioned=True)
    assert _orders(spark, base) == first + [(8,)]
    folders = [n for n in os.listdir(base) if n.startswith("v-")]
    assert len(folders) == 3
    assert len(versions.vacuum(spark, base, keep=1)) == 2
    assert _orders(spark, base) == first + [(8,)]


def test_manifests(spark, tmp_path):
    base = str(tmp_path / "m")
    assert versions.publish(spark, base, {"a": f"{base}/v-1/a"}) == 1
    assert versions.publish(spark, base, {"a": f"{base}/v-2/a", "b": f"{base}/v-2/b"}) == 2
    assert versions.published(spark, base + "/") == {"a": f"{base}/v-2/a", "b": f"{base}/v-2/b"}
    with pytest.raises(ValueError):
        versions.publish(spark, base, {"a": "/elsewhere/a"})
    # a draft that was never renamed is not seen
    (tmp_path / "m" / "_manifests" / ".draft-x").write_text("{")
    assert versions.published(spark, base)["a"].endswith("v-2/a")
    with pytest.raises(ValueError):
        versions.vacuum(spark, base, keep=0)
