"""Every registered query runs on the smallest tables; SQL gives the same rows."""

from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_point
from arborspan.plans.queries import ORACLE_SQL, QUERIES



def plain(row):
    return str(tuple(float(v) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else v for v in row))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    out = entry_point.entry(spark)
    assert out.count() > 0 and out.columns == ["leaf", "n", "rate", "rule"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, name):
    got = QUERIES[name](spark, tiny)
    rows = got.collect()
    assert rows
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
        con.execute(ORACLE_SQL[name])
        columns = [d[0] for d in con.description]
        want = con.fetchall()
        assert sorted(columns) == sorted(got.columns)
        assert sorted(plain(r[c] for c in columns) for r in rows) == sorted(map(plain, want))


def test_everything_else_works_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry_point.__file__).parent
    shutil.copytree(root / "arborspan", tmp_path / "arborspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_best_cut_mse_keeps_the_decimals_of_many_large_squares(spark, tmp_path):
    """The squares' sum has more digits than a double; the loss that is left of it hasn't."""
    from fractions import Fraction

    rows = [(k, k * 37 % 50 + 1, 1e7 + (k * 37 % 50 > 30) * 25 + k % 100 / 4) for k in range(3000)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["feature"]: r for r in QUERIES["best_cut_mse"](spark, str(tmp_path)).collect()}
    for feature, at in (("p_size", 1), ("p_partkey", 0)):
        sides = [[Fraction(r[2]) for r in rows if (r[at] <= got[feature]["threshold"]) == left] for left in (True, False)]
        loss = sum(sum(y * y for y in side) - sum(side) ** 2 / len(side) for side in sides)
        assert got[feature]["loss"] == pytest.approx(float(loss), abs=1e-4)
        assert (got[feature]["n_left"], got[feature]["n_right"]) == tuple(map(len, sides))
