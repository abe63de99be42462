import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from crosstie import dims as D  # noqa: E402
from crosstie.schema import FACT_COLUMNS  # noqa: E402
from crosstie.session import local_session  # noqa: E402

FACT_DDL = ("return_id string, tax_year int, sub_no bigint, entity_code string, entity_name string, form string,"
            " instance int, document_id string, basket string, path string, ordinal int, value string, is_blank boolean")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "crosstie-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_facts(spark):
    """Facts from entities: (year, sub_no, code, name, {form: fields or [fields per basket]})."""

    def build(entities, return_id="R"):
        rows = []
        for year, sub, code, name, forms in entities:
            forms = {D.MAIN: {}, **forms}
            for form, filed in forms.items():
                for i, fields in enumerate(filed if isinstance(filed, list) else [filed], 1):
                    basket = fields.get("SeparateCategoryCd", "")
                    for n, (tag, value) in enumerate([("", ""), *fields.items()]):
                        path = f"{form}_{tag}" if tag else form
                        rows.append((return_id, year, sub, code, name, form, i, "", basket, path, n, value, value == ""))
        assert len(FACT_COLUMNS) == 13
        return spark.createDataFrame(rows, FACT_DDL)

    return build
