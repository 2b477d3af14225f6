import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from glyphmill.session import ensure_worker_import, local_session  # noqa: E402

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cpus=8, shuffle_partitions=8, app="glyphmill-tests")
    ensure_worker_import(s)
    yield s


@pytest.fixture
def one_doc(spark):
    def make(text, doc_id=1):
        return spark.createDataFrame([(doc_id, text)], "doc_id bigint, text string")
    return make


@pytest.fixture
def docs(spark):
    def make(texts):
        return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return make
