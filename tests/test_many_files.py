"""Patterns that name many files."""

import pytest
from pyspark.errors import AnalysisException

from reviewloom.sources import readers


def _listing_tasks(spark, paths):
    return readers.read_page_files(spark, paths).inputFiles(), readers._listed(spark, paths)[1]


def test_a_pattern_of_names_lists_its_folder_once(spark, tmp_path):
    for name in ("a.txt", "b.txt", "c.html", "_d.txt", "e f.txt"):
        (tmp_path / name).write_text(f"text {name}")
    files, listed = _listing_tasks(spark, f"{tmp_path}/*.txt")
    assert listed == [str(tmp_path)] and len(files) == 3
    assert sorted(r["value"] for r in readers.read_notes(spark, f"{tmp_path}/[ab].txt").collect()) == [
        "text a.txt", "text b.txt"]
    (tmp_path / "k=1").mkdir()
    (tmp_path / "k=1" / "g.txt").write_text("below")
    files, listed = _listing_tasks(spark, f"{tmp_path}/*.txt")
    assert listed == [f"{tmp_path}/*.txt"] and len(files) == 3
    with pytest.raises(AnalysisException):
        readers.read_page_files(spark, f"{tmp_path}/*.none")
