import shutil
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark():
    from scenemark.session import local_session

    s = local_session(partitions=8)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    """The smallest tables, whole; the few line items that repeat a key (there are none in
    the larger sets) are dropped, because shape ids must be unique in a scene."""
    src, dst = Path("/root/testdata/sf0.001"), tmp_path_factory.mktemp("tables")
    for f in src.glob("*.parquet"):
        if f.stem != "lineitem":
            shutil.copy(f, dst / f.name)
    duckdb.sql(
        f"""COPY (SELECT DISTINCT ON (l_orderkey, l_linenumber, l_partkey, l_suppkey) *
        FROM '{src}/lineitem.parquet' ORDER BY ALL) TO '{dst}/lineitem.parquet' (FORMAT parquet)"""
    )
    return str(dst)
