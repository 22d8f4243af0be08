import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from litspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(os.environ.get("TEST_CPUS", "8"), shuffle_partitions=3, memory="6g")


@pytest.fixture(scope="session")
def papers_of(spark):
    """Papers from tuples (ord, title, abstract, url, journal, year)."""

    def make(rows, parts=3):
        full = [(o, o, t, "A. Author", a, u, j, y) for o, t, a, u, j, y in rows]
        df = spark.createDataFrame(
            full, "ord bigint, paper_id bigint, title string, authors string, abstract string, url string, "
            "journal string, year smallint",
        )
        return df.repartition(parts)

    return make
