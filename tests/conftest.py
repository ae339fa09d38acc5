import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallysheet.session import build_session  # noqa: E402

FIELD_SCHEMA = (
    "template_id string, field_id string, sort_order int, key string, label string, type string, "
    "required boolean, aliases array<string>, options array<string>"
)
WORD_SCHEMA = (
    "document_id string, page int, word int, text string, x double, y double, width double, "
    "height double, confidence_pct int"
)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def field(template, place, key, label, kind, required=True, aliases=(), options=()):
    return (template, f"{template}_{key}", place, key, label, kind, required, list(aliases), list(options))


def as_map(rows, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}
