import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tenderlens.schema import PAGE  # noqa: E402
from tenderlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 2)
    # Rows are few and plans many: interpret them instead of compiling each one.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def page_row(no, text="", doc=1, seq=None, length=None, printed=None, warning=None, **flags):
    n = len(text.replace(" ", "").replace("\n", "")) if length is None else length
    names = ["has_table", "has_attachment", "has_eval_table", "has_toc", "has_blind", "has_commercial_sw"]
    return (doc, no if seq is None else seq, no, text, n, printed, *[bool(flags.get(f, False)) for f in names], warning)


@pytest.fixture(scope="session")
def make_pages(spark):
    return lambda rows: spark.createDataFrame(rows, PAGE)
