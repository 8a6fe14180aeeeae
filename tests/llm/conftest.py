from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF).exists():
        pytest.skip("test tables are not here")
    return SF


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names clash with those of results and helpers."""
    def make(rows, clash="k1 long, kept string, low int, seed string, ids int, hits int"):
        extra = [c.split()[0] for c in clash.split(", ")]
        data = [(i, t, "en", s, *([None] * len(extra)))
                for i, t, s in [(*r, "src0")[:3] for r in rows]]
        return spark.createDataFrame(
            data, f"doc_id long, text string, lang string, source string, {clash}").repartition(3)
    return make
