"""Arrow schemas of the tables that tasks return."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a schema written as in SQL."""
    return to_arrow_schema(StructType.fromDDL(ddl))
