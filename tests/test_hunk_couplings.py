"""Couplings of symbols straight from hunks: as by way of the attributed changes, and only counts are written."""

import random

import pytest
from test_catalog import star

from strataweave import catalog, catalog_more
from strataweave.operators import intrafile

SYMBOLS = "file string, symbol string, line_start int, line_end int"
HUNKS = "commit_id string, file string, old_start int, old_lines int, new_start int, new_lines int"


@pytest.mark.parametrize("most", [50, 3])
def test_as_by_attributed_changes(spark, most):
    r = random.Random(most)
    symbols = spark.createDataFrame([(f, f"{f}::{i}", i * 9, i * 9 + r.randrange(4, 9)) for f in "fg" for i in range(1, 12)], SYMBOLS)
    rows = [(f"c{r.randrange(90)}", r.choice("fgh"), 0, r.randrange(3), r.randrange(120), r.choice([0, 1, 9, 30])) for _ in range(400)]
    hunks = spark.createDataFrame(rows, HUNKS)
    want = intrafile.symbol_couplings(intrafile.attributed(hunks, symbols), 3, most)
    got = intrafile.hunk_couplings(hunks, symbols, 3, most, bucket=16)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and not want.isEmpty()


def test_no_hunks(spark):
    assert intrafile.hunk_couplings(spark.createDataFrame([], HUNKS), spark.createDataFrame([], SYMBOLS)).isEmpty()


def test_no_row_a_touch_is_written(spark, tmp_path, monkeypatch):
    _, lines = star(spark, tmp_path, 400)
    written, cut = [], catalog_more.cut

    def counting(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(catalog_more, "cut", counting)
    monkeypatch.setattr(intrafile, "cut", counting, raising=False)
    got = [tuple(x) for x in catalog.QUERIES["intra_file_couplings"](spark, str(tmp_path)).collect()]
    assert got and all(a.startswith(f"{f}::") and b.startswith(f"{f}::") and a < b for f, a, b, _, _ in got)
    assert max(written) < len(lines) / 4
